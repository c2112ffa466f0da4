"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of its own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="docflow-shared-")
    return _own_dirs[app]


#: Rows that one task sorts or numbers at most, where the number of tasks is ours to choose.
TASK_ROWS = 1_200_000


def parts_for(rows: DataFrame, least: int = 1) -> int:
    """Partitions for a stored table: the session's, more where they had over ``TASK_ROWS`` rows each.

    Adaptive execution doesn't put such partitions together again. It goes by their compressed size,
    of which narrow rows that are sorted several times need many times over. Of Parquet files only
    the footers are read.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, usual, -(-rows.count() // TASK_ROWS))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: made once however often it is read, of known size."""
    path = f"{shared_dir(df.sparkSession)}/docflow-tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
