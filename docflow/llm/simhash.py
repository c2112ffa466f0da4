"""Operator 9: SimHash near-duplicates, candidates pruned by the pigeonring principle.

A 64-bit fingerprint is cut into five segments that form a ring. If two fingerprints differ in at
most tau = 4 bits, some segment starts a chain in which, for every length l, the first l segments
differ in at most l * tau / 5 bits: none in the first, one in the first two, two in three, three in
four. Pairs are therefore looked up only under (start, its segment, the next segment up to one
bit), the rest of the chain is checked on the pair, and what is left goes to the full check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.shared import table, written

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Lowest bit and width of the segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the 4-word shingles (repeats included); 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x09-\x0D, \x20 only
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes + 1) - 1
        starts = (stops - sizes)[: 1 - SHINGLE].tolist()
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, stops[SHINGLE - 1 :].tolist(), strict=True)]
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 65536):
        block = values[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(values)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:  # Arrow, so that ids next to a null keep all their bits
        prints = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    low, width = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1)


def _mask(i: int) -> int:
    low, width = SEGMENTS[i % len(SEGMENTS)]
    bits = ((1 << width) - 1) << low
    return bits - (1 << 64) if bits >> 63 else bits


def _chain_holds(diff: Column, start: int, max_bits: int) -> Column:
    """Every prefix of the chain from segment ``start`` stays within its share of the budget."""
    held, so_far = F.lit(True), F.lit(0)
    for length in range(1, len(SEGMENTS) + 1):
        so_far = so_far + F.bit_count(diff.bitwiseAND(_mask(start + length - 1)))
        held = held & (so_far <= length * max_bits // len(SEGMENTS))
    return held


def _keys(i: int, first: Column, second: Column) -> Column:
    return F.shiftleft(F.shiftleft(first, 13).bitwiseOR(second), 3).bitwiseOR(F.lit(i).cast("long"))


def _build_keys(fp: Column) -> Column:
    return F.array(*[_keys(i, _segment(fp, i), _segment(fp, i + 1)) for i in range(len(SEGMENTS))])


def _probe_keys(fp: Column) -> Column:
    """Under each start: the next segment itself and with each of its bits flipped."""
    out = []
    for i in range(len(SEGMENTS)):
        width = SEGMENTS[(i + 1) % len(SEGMENTS)][1]
        flips = F.array(*[F.lit(f).cast("long") for f in (0, *[1 << b for b in range(width)])])
        first, second = _segment(fp, i), _segment(fp, i + 1)
        out.append(_flipped(flips, i, first, second))
    return F.concat(*out)


def _flipped(flips: Column, i: int, first: Column, second: Column) -> Column:
    return F.transform(flips, lambda x: _keys(i, first, second.bitwiseXOR(x)))


#: More distinct fingerprints than this under one key are looked up under longer chains.
HOT_KEY = 2000


def _third(start: Column, fp: Column) -> Column:
    """The third segment of the chain that begins at segment ``start``."""
    out = _segment(fp, 1)
    for i in range(len(SEGMENTS)):
        out = F.when(start == i, _segment(fp, i + 2)).otherwise(out)
    return out


def _flips(width: int, most: int) -> list[int]:
    """Masks of up to ``most`` (2 at most) bits of a segment."""
    one = [1 << b for b in range(width)]
    two = [(1 << b) | (1 << c) for b in range(width) for c in range(b)]
    return [0, *one, *(two if most > 1 else [])]


def _longer_probe_keys(key: Column, exact: Column, fp: Column) -> Column:
    """``key`` with the third segment, up to two bits of it flipped; one if the second used one."""
    out = F.array().cast("array<long>")
    for i in range(len(SEGMENTS)):
        width, third = SEGMENTS[(i + 2) % len(SEGMENTS)][1], _segment(fp, i + 2)
        for most, own in ((2, exact), (1, ~exact)):
            flips = F.lit(_flips(width, most)).cast("array<long>")
            out = F.when((key.bitwiseAND(7) == i) & own, _longer(flips, key, third)).otherwise(out)
    return out


def _longer(flips: Column, key: Column, third: Column) -> Column:
    return F.transform(flips, lambda x: _longer_key(key, third.bitwiseXOR(x)))


def _longer_key(key: Column, third: Column) -> Column:
    """Start and three segments: 3 + 13 + 13 + 13 bits."""
    return F.shiftleft(F.shiftright(key, 3), 16).bitwiseOR(F.shiftleft(third, 3)).bitwiseOR(key.bitwiseAND(7))


def links(prints: DataFrame, max_bits: int = MAX_BITS, hot_key: int = HOT_KEY) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that keep all components as they are.

    Each pair at most once: it is taken at the first start whose chain holds. A key with over
    ``hot_key`` fingerprints is cut by a longer chain: its fingerprints are looked up under three
    segments, the third up to the bits that the chain has left. Fingerprints that are still over
    ``hot_key`` under three segments (39 equal bits or all but two) would make a square of pairs
    whatever the chain; they are linked through pivots: two fingerprints differ in 4 bits or fewer
    exactly if both are within 2 bits of some value, so each is linked to the least fingerprint
    around each value within 2 bits of it: 2081 rows for each of these fingerprints, whatever
    their number, and no component is lost. An empty table gives no links.
    """
    if max_bits != MAX_BITS:
        raise ValueError("segments and pivots are laid out for 4 bits")
    build = prints.select(F.col("fp").alias("b"), F.explode(_build_keys(F.col("fp"))).alias("key"))
    probe = prints.select(F.col("fp").alias("a"), F.explode(_probe_keys(F.col("fp"))).alias("key"))
    hot = _over(build, hot_key, "hot-keys")
    if not hot.take(1):
        return _chained(probe.join(build.hint("merge"), "key"), once=True)
    cold = build.join(hot.hint("merge"), "key", "left_anti")
    start = F.col("key").bitwiseAND(7)
    longer = written(
        build.join(hot.hint("merge"), "key", "left_semi").select("b", _longer_key(F.col("key"), _third(start, F.col("b"))).alias("key")), "longer-keys"
    )
    own = F.array_contains(_build_keys(F.col("a")), F.col("key"))
    probed = probe.join(hot.hint("merge"), "key", "left_semi").select("a", F.explode(_longer_probe_keys(F.col("key"), own, F.col("a"))).alias("key"))
    dense = _over(longer, hot_key, "dense-keys")
    short_pairs = probe.join(cold.hint("merge"), "key")
    if not dense.take(1):
        return _chained(short_pairs.unionByName(probed.join(longer.hint("merge"), "key")), once=True)
    sparse = longer.join(dense.hint("merge"), "key", "left_anti")
    # with dense keys left out, the first start may be one of them: keep any start, then distinct
    kept = _chained(short_pairs.unionByName(probed.join(sparse.hint("merge"), "key")), once=False).distinct()
    around = written(probed.join(dense.hint("merge"), "key", "left_semi").select(F.col("a").alias("fp")).distinct(), "dense-prints")
    return kept.unionByName(_pivot_links(around))


def _over(keyed: DataFrame, limit: int, label: str) -> DataFrame:
    """The keys with more than ``limit`` rows."""
    return written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("key"), label)


def _chained(pairs: DataFrame, once: bool) -> DataFrame:
    """The pairs (a, b) whose chain holds; with ``once``, only under the first start where it does."""
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(diff) <= MAX_BITS))
    first = F.lit(None).cast("int")
    for i in reversed(range(len(SEGMENTS))):
        first = F.when(_chain_holds(diff, i, MAX_BITS), F.lit(i)).otherwise(first)
    return pairs.where(F.col("key").bitwiseAND(7) == first if once else first.isNotNull()).select("a", "b")


def _pivot_links(dense: DataFrame) -> DataFrame:
    flips = [0, *[1 << i for i in range(64)], *[(1 << i) | (1 << j) for i in range(64) for j in range(i)]]
    signed = F.lit([f - (1 << 64) if f >> 63 else f for f in flips]).cast("array<long>")
    around = dense.select("fp", F.explode(signed).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("pivot"))
    least = around.groupBy("pivot").agg(F.min("fp").alias("b"))
    return around.join(least.hint("merge"), "pivot").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b) by alternating large and small stars.

    root is the least node; nodes without an edge don't appear. Each round is written to the
    shared folder, so lineage stays short; the driver sees one count and one checksum a round. The
    minima are written before they are joined: a join of two exchanged sides is one that Spark can
    split where a star has many arms.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least-around")
        large = both.join(low.hint("merge"), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large-star")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least-below")
        small = large.join(least.hint("merge"), "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links of 4 bits or fewer reach), root.

    root is the component's least fingerprint; it tells components apart where doc_ids repeat.
    Defined cases: texts without words (null, empty) have fingerprint 0 and are linked like any
    other; repeated rows come back each; a null doc_id is kept and never names a component, unless
    it has no other (then null); extra columns are ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs), "fingerprints")
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-prints")
    roots = components(links(reps.select("fp"), hot_key=hot_key))
    # both sides are written, so the join exchanges them as they are and Spark can split a large root
    linked = written(reps.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "roots")
    least = written(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "least-of-roots")
    named = linked.join(least.hint("merge"), "root").select("fp", "component_id", "root")
    return prints.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id", "root")


#: Up to so many ids (8 bytes each) are broadcast by :func:`one_of_each`; beyond, a shuffled join.
BROADCAST_IDS = 1_000_000


def _by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with the distinct ``doc_id`` of ``ids``; columns stay in place."""
    side = ids.select(F.col("doc_id").alias("one_id"))
    side = F.broadcast(side) if ids.count() <= BROADCAST_IDS else side.hint("merge")
    return docs.join(side, docs["doc_id"] == side["one_id"], how)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, only the row with the smallest doc_id of each component.

    Rows with a null doc_id stay: nothing names them, so none of them can stand for the others.
    Rows that share a doc_id are told apart by their texts: of each component one row stays, and
    rows of other components under the same doc_id are judged by their own component.
    """
    found = written(near_duplicates(docs), "near-duplicates")
    again = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    again = written(again, "repeated-ids")
    extra = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    if not again.take(1):
        return _by_ids(docs, extra, "left_anti")
    single = _by_ids(_by_ids(docs, again, "left_anti"), extra, "left_anti")

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))

    repeated = _by_ids(docs, again, "left_semi").select("doc_id", print_of(F.col("text").cast("string")).alias("fp"), F.struct("*").alias("row"))
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id", "fp", "root").distinct()
    kept = repeated.join(first.hint("merge"), ["doc_id", "fp"]).dropDuplicates(["doc_id", "root"])
    return single.unionByName(kept.select("row.*"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
