"""Order and structure of extracted text: reading order, runs, fragments, breaks, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import collapse, trim
from docflow.operators.pages import order_statistic

#: Accepted file extensions and what they stand for.
EXTENSIONS = {"pdf": "pdf", "epub": "epub", "docx": "docx", "txt": "txt", "md": "txt", "markdown": "txt"}
MARKUP_TYPES = "html|xml"


def extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), "\\.([^.]+)\\z", 1)


def sniff_format(content: Column, name: Column) -> Column:
    """pdf, docx, epub, txt or null, from the bytes first and the extension last."""
    head = F.hex(F.substring(content, 1, 4))
    body = F.decode(content, "ISO-8859-1")
    zipped = F.when(F.contains(body, F.lit("word/document.xml")), F.lit("docx")).when(
        F.contains(body, F.lit("META-INF/container.xml")) | F.contains(body, F.lit("mimetypeapplication/epub+zip")), F.lit("epub")
    )
    plain = F.when(extension(name).isin(*[e for e, f in EXTENSIONS.items() if f == "txt"]), F.lit("txt"))
    return F.when(F.length(content) < 4, F.lit(None)).when(head == "25504446", F.lit("pdf")).when(head.startswith("504B"), zipped).otherwise(plain)


def accept_uploads(files: DataFrame, name: str, size: str, cap: int = 20 * 1024 * 1024) -> DataFrame:
    return files.where(extension(F.col(name)).isin(*EXTENSIONS) & (F.col(size) <= cap))


def spine_order(spine: DataFrame, manifest: DataFrame, members: DataFrame) -> DataFrame:
    """book_id, text, chapters: members in spine order; other media, missing and empty ones go."""
    media = manifest.where(F.col("media_type").isNull() | F.col("media_type").rlike(MARKUP_TYPES))
    read = (
        spine.join(media, (spine["book_id"] == media["book_id"]) & (spine["idref"] == media["id"]))
        .select(spine["book_id"], "pos", F.col("href").alias("path"))
        .join(members.select("book_id", "path", trim(F.col("content")).alias("content")), ["book_id", "path"])
        .where("content <> ''")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    return read.groupBy("book_id").agg(F.array_join(ordered, "\n\n").alias("text"), F.count(F.lit(1)).alias("chapters"))


def runs_to_paragraphs(runs: DataFrame) -> DataFrame:
    """doc_id, paragraph_no, paragraph: runs in order, a tab as a space, empty paragraphs gone."""
    joined = runs.groupBy("doc_id", "paragraph_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "text"))), lambda x: x["text"]), "").alias("p")
    )
    return joined.select("doc_id", "paragraph_no", collapse(F.col("p")).alias("paragraph")).where("paragraph <> ''")


def fragments_to_lines(frags: DataFrame) -> DataFrame:
    """page_id, line_no, line, y: fragments up to each end of line; y is the first one's."""
    before = Window.partitionBy("page_id").orderBy("frag_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = frags.withColumn("line_no", F.coalesce(F.sum(F.col("has_eol").cast("int")).over(before), F.lit(0)))
    joined = numbered.groupBy("page_id", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frag_no", "str"))), lambda x: x["str"]), "").alias("line"),
        F.min_by("y", "frag_no").alias("y"),
        F.max("has_eol").alias("ended"),
    )
    return joined.where(F.col("ended") | (trim(F.col("line")) != "")).select("page_id", "line_no", "line", "y")


def adaptive_breaks(df: DataFrame, key: str, gap: str, quantile: float = 0.25, ratio: float = 1.5) -> DataFrame:
    """``df`` with usual_gap and is_break: positive gaps over ``ratio`` times the key's usual gap.

    ``gap`` is the distance to the row before (null for the first); usual is the exact order
    statistic at the quantile of the key's positive gaps.
    """
    usual = order_statistic(df.where(F.col(gap) > 0), key, gap, quantile).withColumnRenamed("stat", "usual_gap")
    return df.join(usual, key, "left").withColumn("is_break", F.coalesce(F.col(gap) > F.col("usual_gap") * ratio, F.lit(False)))
