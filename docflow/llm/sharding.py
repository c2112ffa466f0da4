"""Operator 1: shards of near-equal bytes by histogram sort (DataFrame functions only).

Documents are ordered by ``(hash of text, hash of doc_id)``. Splitters between shards are found
by counting, exactly and over all rows, the bytes below candidate boundaries: the first pass
counts 4096 equal cells of the key space, and each further pass counts only the cells in which a
splitter still lies, each cut into 4096 finer ones, until the bytes below a boundary are within
tolerance of the target. Whole rows are exchanged once, by shard and cell, when the splitters are
known, and written as files of one shard each in slot order; sizes and CRCs are those of the files.

Equal texts have equal leading keys, so a group of copies is contiguous and stays in one shard,
unless keeping it whole would break the tolerance; then it is cut at a document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docflow.llm.shared import shared_dir, table, written

BITS = 12
CELLS = 1 << BITS
#: Right shifts that give 12 more bits of a signed 64-bit key each time.
SHIFTS = (52, 40, 28, 16, 4, 0)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Splitter:
    """A row is to its right if ``h > hash`` or ``h = hash and k >= key``; None: no row is."""

    hash: int | None
    key: int = LOWEST

    def right(self, h: Column, k: Column) -> Column:
        if self.hash is None:
            return F.lit(False)
        return (h > self.hash) | ((h == self.hash) & (k >= self.key))


def _size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) + 1).cast("long")


def _keys() -> list[Column]:
    """The two parts of the sort key."""
    return [F.xxhash64(F.col("text")).alias("h"), F.xxhash64(F.col("doc_id")).alias("k")]


def shard_keys(docs: DataFrame) -> DataFrame:
    """size and the two parts of the sort key of each row: what the splitters are found from."""
    return docs.select(_size(F.col("text")).alias("size"), *_keys())


def _edge(prefix: int, shift: int) -> int | None:
    at = prefix << shift
    return at if at <= HIGHEST else None


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float) -> list[Splitter]:
    """The ``n_shards - 1`` splitters; the driver sees at most 4096 counts for each of them."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / n_shards
    found: dict[int, Splitter] = {}
    # target -> (bytes below the open cell, hash of the open group or None, prefix, level)
    todo = {i: (0, None, None, 0) for i in range(1, n_shards)}
    while todo:
        left: dict[int, tuple] = {}
        for in_group in (False, True):
            part = {i: s for i, s in todo.items() if (s[1] is not None) == in_group}
            if part:
                left |= _refine(keys, part, in_group, total, n_shards, slack, found)
        todo = left
    return [found[i] for i in range(1, n_shards)]


def _refine(keys, part, in_group, total, n_shards, slack, found) -> dict[int, tuple]:
    """One counting pass: settle the targets it can, and give the open cells of the others."""
    column = "k" if in_group else "h"
    level = min(s[3] for s in part.values())
    now = {i: s for i, s in part.items() if s[3] == level}
    later = {i: s for i, s in part.items() if s[3] != level}
    shift = SHIFTS[level]
    rows = keys
    group = F.col("h") if in_group else F.lit(0).cast("long")
    if in_group:
        rows = rows.where(F.col("h").isin(sorted({s[1] for s in now.values()})))
    if level:
        cells = sorted({s[2] for s in now.values()})
        rows = rows.where(F.shiftright(column, SHIFTS[level - 1]).isin(cells))
    counted = (
        rows.groupBy(group.alias("g"), F.shiftright(column, shift).alias("p"))
        .agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        .collect()
    )
    counted.sort(key=lambda r: (r.g, r.p))
    for i, (below, opened, prefix, _) in now.items():
        target = total * i / n_shards
        step = SHIFTS[level - 1] - shift if level else 0
        own = [r for r in counted if (opened is None or r.g == opened) and (not level or r.p >> step == prefix)]
        at, cell = below, None
        for r in own:
            if at + r.b > target:
                cell = r
                break
            at += r.b
        if cell is None:  # everything lies below the target
            last = own[-1].p + 1 if own else 0
            found[i] = Splitter(opened, _edge(last, shift)) if in_group else Splitter(_edge(last, shift))
            continue
        before, after = target - at, at + cell.b - target
        if min(before, after) <= slack or cell.n == 1 or (in_group and level == len(SHIFTS) - 1):
            edge = _edge(cell.p + (after < before), shift)
            if in_group:
                found[i] = Splitter(opened, edge) if edge is not None else Splitter(_edge(opened + 1, 0))
            else:
                found[i] = Splitter(edge)
        elif not in_group and cell.lo == cell.hi:
            later[i] = (at, cell.lo, None, 0)  # one group of copies: go on inside it
        else:
            later[i] = (at, opened, cell.p, level + 1)
    return later


def _shard_of(splitters: list[Splitter], h: Column, k: Column, first: int = 0) -> Column:
    """Binary search over the splitters as nested conditions."""
    if not splitters:
        return F.lit(first).cast("int")
    mid = len(splitters) // 2
    return F.when(
        splitters[mid].right(h, k), _shard_of(splitters[mid + 1 :], h, k, first + mid + 1)
    ).otherwise(_shard_of(splitters[:mid], h, k, first))


def _pieces(keys: DataFrame) -> tuple[list[str], Callable[[DataFrame], DataFrame]]:
    """What adds cell, group and piece to rows with the columns h and k, by the counts of ``keys``.

    Their names come first: only the cell if no group is cut (a constant column would keep Spark
    from seeing that rows dealt by these columns lie right for a window over them). No (cell, group, piece) has much over 1/4096 of the rows. A cell is 1/4096 of the hash range;
    a group of copies with more rows than that stands by itself (there are fewer than 4096) and
    is cut into pieces by the hash of doc_id.
    """
    cell = F.shiftright("h", 52)
    sizes = keys.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r.n for r in sizes)
    limit = max(1, total // CELLS)
    full = [r.cell for r in sizes if r.n > max(4 * limit, 1000)]
    if not full:
        return ["cell"], lambda rows: rows.withColumn("cell", cell)
    heavy = (
        keys.where(cell.isin(full)).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
        .select("h", F.lit(1).alias("is_heavy"), F.least(F.lit(BITS), F.ceil(F.log2(F.col("n") / limit))).cast("int").alias("bits"))
    )
    found = [tuple(r) for r in heavy.collect()]  # fewer than 4096, see above
    if not found:
        return ["cell"], lambda rows: rows.withColumn("cell", cell)
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("is_heavy", T.IntegerType()), T.StructField("bits", T.IntegerType())])
    small = keys.sparkSession.createDataFrame(found, schema)
    return ["cell", "grp", "piece"], lambda rows: (
        rows.withColumn("cell", cell).join(F.broadcast(small), "h", "left")
        .withColumn("grp", F.when(F.col("is_heavy") == 1, F.col("h")))
        .withColumn("piece", F.when(F.col("is_heavy") == 1, F.expr("shiftright(k, 64 - greatest(bits, 1))")).otherwise(F.lit(0)).cast("long"))
        .drop("is_heavy", "bits")
    )


def write_shards(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.005) -> str:
    """Write every row of ``docs``, with all its columns, into its shard; returns the folder.

    A folder ``shard=N`` holds Parquet files of ``slot`` and ``row``, a struct of the columns of
    ``docs``. Each file has the rows of one range of slots in their order.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    keys = written(shard_keys(docs), "shard-keys")
    splitters = find_splitters(keys, n_shards, tolerance)
    (names, pieces), shard = _pieces(keys), _shard_of(splitters, F.col("h"), F.col("k"))
    place = ["shard", *names]
    before = Window.partitionBy("shard").orderBy(*[F.col(c).asc_nulls_first() for c in names])
    starts = (  # at most a few times 4096 rows for all shards
        pieces(keys).withColumn("shard", shard).groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(*[F.col(c).alias(f"s_{c}") for c in place], "start")
    )
    rows = pieces(docs.select(F.struct("*").alias("row"), *_keys())).withColumn("shard", shard)
    dealt = rows.repartitionByRange(*place)  # the one exchange of whole rows; the window keeps to it
    order = Window.partitionBy(*place).orderBy("h", "k", "row.doc_id", _size(F.col("row.text")))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in place])
    slots = dealt.withColumn("rank", F.row_number().over(order)).join(F.broadcast(starts), same)
    path = f"{shared_dir(docs.sparkSession)}/docflow/shards-{uuid.uuid4().hex}"
    slots.select("shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "row").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """shard, slot and row (of that type) from the files of :func:`write_shards`."""
    schema = T.StructType([T.StructField("slot", T.LongType()), T.StructField("row", row), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path).select("shard", "slot", "row")


def shard_documents(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.005) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text, anything else) into a shard and a slot in it.

    Law ``bytes``: each splitter is within ``tolerance`` of a shard's bytes of its target, or at
    the document boundary nearest to it. Slots are gapless from 0, in key order by cells (a group
    with over 1/4096 of the rows comes last in its cell).

    Defined cases: a null text has size 1, CRC 0 and is a group of its own, apart from the empty
    text; a null doc_id is kept; repeated rows get a slot each; other columns go into the shards
    in a struct, so their names can't clash; an empty table gives no rows. Returns doc_id, size,
    text_crc32, law, shard, slot, grown_shard (null: this law doesn't grow), read from the shards.
    """
    placed = read_shards(docs.sparkSession, write_shards(docs, n_shards, tolerance), docs.schema)
    return placed.select(
        "row.doc_id",
        _size(F.col("row.text")).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
