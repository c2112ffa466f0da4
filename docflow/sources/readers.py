"""Sources: text files, raw uploads, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.text import markdown_to_text, normalise_paragraphs
from docflow.operators.extract import sniff_format

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def clean_markdown(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with text as prose: LF line ends, no markup, paragraphs apart by a blank line."""
    lf = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    return docs.withColumn(text, normalise_paragraphs(markdown_to_text(lf)))


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole text and markdown files."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return clean_markdown(raw)


def read_uploads(spark: SparkSession, path: str, cap: int = 20 * 1024 * 1024) -> DataFrame:
    """path, length, format of files up to ``cap`` bytes; larger ones are never read."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= cap)
    return files.select("path", "length", sniff_format(F.col("content"), F.col("path")).alias("format"))


def read_events(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """The event log as a stream, with a timestamp that watermarks accept."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))
