"""Sinks: bucketed chunk tables, replaced partitions, progress streams, upserts from streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from docflow.operators.rules import newest
from docflow.sources.shared import written


def write_chunks(chunks: DataFrame, table: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by document, so that joins and windows by document need no shuffle.

    A task reads a whole bucket, so their number goes by the rows (:func:`parts_for`). A bucket is
    written by one task, as one file; chunks that are dealt out so already aren't moved.
    """
    chunks.repartition(buckets, "document_id").write.bucketBy(buckets, "document_id").sortBy("document_id", "idx").mode("overwrite").saveAsTable(table)


#: Spark moves both sides of a join by more keys than the buckets have, unless this is off.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def chunk_table(chunks: DataFrame, buckets: int = 64) -> Iterator[DataFrame]:
    """``chunks`` as a bucketed table that is dropped at the end; write what must outlast it before.

    Inside, joins by document and idx count as joins by document, so they read the buckets as they are.
    """
    spark, name = chunks.sparkSession, f"docflow_chunks_{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(ALL_KEYS)
    try:
        write_chunks(chunks, name, buckets)
        spark.conf.set(ALL_KEYS, "false")
        yield spark.table(name)
    finally:
        spark.conf.set(ALL_KEYS, before)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replace only the partitions that ``df`` has rows of."""
    df.write.options(partitionOverwriteMode="dynamic", compression="zstd").mode("overwrite").partitionBy(*columns).parquet(path)


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:  # nothing was written there yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def replace_rows(new: DataFrame, path: str, keys: list[str], order: list[str], parts: int = 64) -> None:
    """Put ``new`` in the place of the rows with its keys, in a table of ``parts`` partitions by key.

    Only partitions that a new key falls into are read and written again; the files of all others stay.
    ``parts`` is the table's for good. Of new rows with one key the newest by ``order`` counts, then the
    one with the largest rest; null keys are a key; no rows change nothing. The merged rows are on disk
    before the first partition is switched, so doing it again after a loss gives the same table.
    """
    spark, schema = new.sparkSession, StructType([*new.schema.fields]).add("part", IntegerType())
    rest = [c for c in new.columns if c not in (*keys, *order)]
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    incoming = written(newest(new, keys, *order, *rest).select(*new.columns, part.alias("part")), "replacing")
    touched = [r.part for r in incoming.select("part").distinct().collect()]  # at most ``parts`` numbers
    old = _read(spark, path, schema)
    merged = incoming
    if old is not None:
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
        kept = old.where(F.col("part").isin(touched)).alias("o").join(incoming.alias("n").hint("merge"), same, "left_anti")
        merged = written(kept.select(*schema.names).unionByName(incoming), "replaced")
    if touched:
        write_partitions(merged.repartition("part"), path, "part")


def write_progress(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to Parquet files and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


LEDGER = "base string, upto long, version long"
#: The epoch of what a table starts from.
LOADED = -1


class UpsertTable:
    """A table with one row a key, the newest, that micro-batches are merged into at any number of tries.

    Each epoch writes its rows as they come, without an exchange, as a partition of its own; an epoch
    that is played again replaces its partition by the same rows, so nothing changes. Reading takes the
    newest row of each key from the base and the epochs behind it; a base has one row a key, so alone
    it is read as it is. :meth:`compact` writes a new base, then
    appends one row to the ledger; that one file is the switch, so readers see the old base or the
    new one, and a compaction that broke off is as if it had never been.

    ``order`` names the columns that say which row is newer, the first one most. Defined cases: null
    keys are a key; rows that are equal in keys and order but not in the rest are told apart by the
    largest of the rest; an empty batch writes nothing; a table without epochs has no rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str]):
        self.spark, self.path, self.schema, self.keys, self.order = spark, path, schema, keys, order

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in (*self.keys, *self.order)]
        return newest(rows.select(*self.schema.names), self.keys, *self.order, *rest)

    def write_epoch(self, batch: DataFrame, epoch: int) -> None:
        """For ``foreachBatch``: this epoch's rows, in place of those it may have written before."""
        write_partitions(batch.select(*self.schema.names).withColumn("epoch", F.lit(epoch).cast("long")), f"{self.path}/changes", "epoch")

    def _read(self, folder: str, schema: StructType) -> DataFrame | None:
        return _read(self.spark, f"{self.path}/{folder}", schema)

    def _base(self) -> tuple[str | None, int, int]:
        ledger = self._read("ledger", StructType.fromDDL(LEDGER))
        last = ledger.agg(F.max_by(F.struct("base", "upto", "version"), "version").alias("x")).first().x if ledger is not None else None
        return (last.base, last.upto, last.version) if last else (None, LOADED - 1, 0)

    def _changes(self) -> DataFrame | None:
        return self._read("changes", StructType([*self.schema.fields]).add("epoch", "long"))

    def read(self) -> DataFrame:
        """The newest row of each key, of the base and the epochs behind it."""
        base, upto, _ = self._base()
        changes = self._changes()
        behind = changes.where(F.col("epoch") > upto).drop("epoch") if changes is not None else None
        if base and (behind is None or behind.isEmpty()):
            return self._read(base, self.schema)
        parts = [self._read(base, self.schema)] if base else []
        parts += [behind] if behind is not None else []
        return self._newest(reduce(DataFrame.unionByName, parts)) if parts else self.spark.createDataFrame([], self.schema)

    def compact(self) -> None:
        """Fold all epochs so far into a new base; epochs that come meanwhile stay behind it."""
        changes = self._changes()
        upto = changes.agg(F.max("epoch")).first()[0] if changes is not None else None
        if upto is None:
            return
        base, before, version = self._base()
        parts = [changes.where((F.col("epoch") > before) & (F.col("epoch") <= upto)).drop("epoch")]
        parts += [self._read(base, self.schema)] if base else []
        self._switch(reduce(DataFrame.unionByName, parts), upto, version + 1)

    def load(self, rows: DataFrame) -> None:
        """Start from ``rows``, before any epoch; they are merged with the epochs."""
        self.write_epoch(rows, LOADED)

    def _switch(self, rows: DataFrame, upto: int, version: int) -> None:
        name = f"base-{version}-{uuid.uuid4().hex[:8]}"
        self._newest(rows).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(name, upto, version)], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def follow(self, stream: DataFrame, checkpoint: str, mode: str = "append") -> StreamingQuery:
        """Merge what is there of ``stream`` and stop."""
        return stream.writeStream.foreachBatch(self.write_epoch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
