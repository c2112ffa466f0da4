"""What the operators of this subpackage share: the shared folder and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: White space and words of the contracts: everything but space and \x09-\x0D.
WORD_BREAK = "[ \\t-\\r]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session that has none (tests, notebooks in local mode) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="docflow-")
    return _own_dirs[app]


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage for iterative work, survives the loss of executors and gives the
    planner true sizes. The files stay as long as the checkpoint folder does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docflow/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(name: str, value: str, use: str) -> str:
    """SQL for ``use`` with ``name`` standing for ``value``, computed once wherever it is moved."""
    return f"transform(array({value}), {name} -> {use})[0]"


def scanned(values: str, op: str) -> str:
    """SQL for the running results of ``op`` ({a} with {b}) over an array of whole numbers, from 0.

    An array that grows by one element a step is copied at each step, so the scan runs over blocks
    of about the square root of the length, then over the blocks' last values. (It is SQL text
    because the many small calls that build the same columns take seconds.)
    """
    empty = "cast(array() as array<bigint>)"

    def grown(acc: str, x: str) -> str:
        return f"concat({acc}, array({op.format(a=f'coalesce(get({acc}, size({acc}) - 1), 0L)', b=x)}))"

    blocks = f"transform(sequence(0, cast(ceil(size(vs) / w) as int) - 1), k -> aggregate(slice(vs, k * w + 1, w), {empty}, (acc, x) -> {grown('acc', 'x')}))"
    lasts = f"aggregate(bs, {empty}, (acc, b) -> {grown('acc', 'get(b, size(b) - 1)')})"
    joined = let("ls", lasts, f"flatten(transform(bs, (b, i) -> transform(b, x -> {op.format(a='coalesce(get(ls, i - 1), 0L)', b='x')})))")
    whole = let("bs", let("w", "cast(ceil(sqrt(size(vs))) as int)", blocks), joined)
    return let("vs", f"cast({values} as array<bigint>)", f"CASE WHEN size(vs) = 0 THEN {empty} ELSE {whole} END")
