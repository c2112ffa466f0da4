"""Operator 12: hard negatives of anchors by a secondary sort of scored pairs.

Anchors are a stated set of rows that meet all rows, block by block: rows and anchors are packed
into matrices of whole numbers, each block of anchors goes to each cell of rows, and a task scores
one pair of blocks at a time. Two such passes leave out of the shuffle what can't be a result: the
first keeps of each block the best partners of an anchor with its label, from which the anchor's
positives follow; the second keeps, for each positive's window of scores, the best partners of
another label. What is left are scored pairs, packed into keys (anchor, descending score, positives
first, id) that are dealt out by anchor and sorted within partitions. A streaming iterator walks
through them: a positive opens its window, a negative goes to the windows that hold it, and no
anchor's pairs are ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docflow.llm.shared import table, written

#: Most rows and bytes of a block of rows; anchors of a block; scores that are held at once.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_ANCHORS, HELD_SCORES = 1 << 16, 1 << 23, 1 << 11, 1 << 21
LONG = (1 << 63) - 1
NONE = -(1 << 62)

PACKED = "part int, dim int, n int, width int, ids binary, labels binary, vectors binary, extra binary"


def usable_rows(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label, v: rows with an id, a label and finite components, in whole numbers.

    A component x becomes floor(scale * x), saturated at the ends of a long.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(F.col("embedding"), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))


def _matrix(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes of a number, and the numbers in as few bytes as hold them all."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return width, values.astype(f"<i{width}").tobytes()


def packed(rows: DataFrame, most_rows: int, extra: tuple[str, int] | None = None) -> DataFrame:
    """Blocks of at most ``most_rows`` rows (vec_id, label, v) of one dimension, in order of vec_id.

    ``extra`` is the name and size of an array column of longs, packed too, nulls behind its values.
    """
    from pyspark import TaskContext

    def block(part: int, dim: int, ids: list, labels: list, vectors: list, extras: list) -> pa.RecordBatch:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        width, cells = _matrix(np.concatenate(vectors).reshape(len(ids), dim)[order])
        more = np.array(extras, np.int64)[order].tobytes() if extra else b""
        row = (part, dim, len(ids), width, np.array(ids, np.int64)[order].tobytes(), np.array(labels, np.int64)[order].tobytes(), cells, more)
        types = [pa.int32()] * 4 + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], PACKED.replace(" int", "").replace(" binary", "").split(", "))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_blocks: dict[int, tuple[list, list, list, list]] = {}
        for b in batches:
            ids, labels, vectors = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))])
            extras = b.column(3).to_pylist() if extra else [None] * len(ids)
            for k, (i, label, more) in enumerate(zip(ids, labels, extras, strict=True)):
                v = flat[ends[k] : ends[k + 1]]
                own = open_blocks.setdefault(len(v), ([], [], [], []))
                own[0].append(i)
                own[1].append(label)
                own[2].append(v)
                own[3].append([*(more or []), *[NONE] * (extra[1] - len(more or []))] if extra else None)
                if len(own[0]) >= max(1, min(most_rows, BLOCK_BYTES // (2 * max(1, len(v))))):
                    yield block(part, len(v), *open_blocks.pop(len(v)))
        for dim, own in open_blocks.items():
            yield block(part, dim, *own)

    columns = ["vec_id", "label", "v", *([extra[0]] if extra else [])]
    return rows.select(*columns).mapInArrow(pack, PACKED)


class Block:
    """A block read back: ids in order, labels, vectors."""

    def __init__(self, n: int, dim: int, width: int, ids: bytes, labels: bytes, vectors: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.v = np.frombuffer(vectors, f"<i{width}").reshape(n, dim)
        self.most = max(int(self.v.max(initial=0)), -int(self.v.min(initial=0)))

    def scores(self, other: Block, some: slice) -> np.ndarray:
        """Inner products (anchors ``some`` of ``other``, rows) as exact longs, saturated at the ends."""
        if max(1, self.v.shape[1]) * self.most * other.most < 1 << 53:
            return (other.v[some].astype(np.float64) @ self.v.T.astype(np.float64)).astype(np.int64)
        exact = other.v[some].astype(object) @ self.v.T.astype(object)
        return np.clip(exact, -LONG, LONG).astype(np.int64)


def firsts(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the first ``k`` allowed scores of each line: higher first, then by column."""
    lines, m = scores.shape
    if not lines or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(int(scores.max()), -int(scores.min())) < (1 << 61) // m:
        keys = np.where(allowed, scores * m + np.arange(m - 1, -1, -1), NONE * 2)
        if m > k:
            top = np.argpartition(keys, m - k, axis=1)[:, m - k :]
        else:
            top = np.broadcast_to(np.arange(m), (lines, m))
        good = np.take_along_axis(keys, top, 1) != NONE * 2
        line = np.repeat(np.arange(lines), good.sum(1))
        return line, top[good]
    found = []
    for i in range(lines):
        columns = np.flatnonzero(allowed[i])
        found += [(i, c) for c in columns[np.lexsort((columns, -scores[i, columns].astype(object)))][:k]]
    line, column = zip(*found, strict=True) if found else ((), ())
    return np.array(line, np.int64), np.array(column, np.int64)


def in_window(score: int, positive: int, low: int, high: int) -> bool:
    return low * positive <= 100 * score <= high * positive


def _windowed(scores: np.ndarray, positive: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which scores of each line lie in the window of that line's positive; exact at any size."""
    most = max(int(np.abs(scores).max(initial=0)), int(np.abs(positive).max(initial=0)))
    if most * max(100, abs(low), abs(high)) > LONG:
        scores, positive = scores.astype(object), positive.astype(object)
    p = positive[:, None]
    return ((low * p <= 100 * scores) & (100 * scores <= high * p)).astype(bool)


PAIRS = "anchor_id long, score long, other_id long"


def _meet(rows: DataFrame, anchors: DataFrame, cells: int, found) -> DataFrame:
    """``found(block of rows, block of anchors, extra, slice of anchors)`` for each pair of blocks.

    It gives (lines, columns, scores). Each block of rows is in one of ``cells`` cells, to each of
    which all blocks of anchors go; the join is by sort and streams, a pair of blocks at a time.
    """
    cell = F.pmod(F.xxhash64("part", F.crc32("ids")), F.lit(cells))
    left = rows.select("dim", cell.alias("cell"), "n", "width", "ids", "labels", "vectors")
    names = ["n", "width", "ids", "labels", "vectors", "extra"]
    right = anchors.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"), *[F.col(c).alias(f"a_{c}") for c in names])
    both = left.join(right.hint("merge"), ["dim", "cell"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                own = Block(r["n"], r["dim"], r["width"], r["ids"], r["labels"], r["vectors"])
                other = Block(r["a_n"], r["dim"], r["a_width"], r["a_ids"], r["a_labels"], r["a_vectors"])
                extra = np.frombuffer(r["a_extra"], np.int64).reshape(r["a_n"], -1) if r["a_extra"] else None
                step = max(1, HELD_SCORES // max(1, r["n"]))
                for at in range(0, r["a_n"], step):
                    some = slice(at, at + step)
                    line, column, scores = found(own, other, extra, some)
                    yield pa.RecordBatch.from_arrays([pa.array(other.ids[some][line]), pa.array(scores), pa.array(own.ids[column])], ["anchor_id", "score", "other_id"])

    return both.mapInArrow(score, PAIRS)


def _best_of_label(k: int):
    def found(own: Block, other: Block, extra, some: slice):
        labels, ids = other.labels[some], other.ids[some]
        out = [(np.zeros(0, np.int64),) * 3]
        for label in np.unique(labels):
            columns, lines = np.flatnonzero(own.labels == label), np.flatnonzero(labels == label)
            if not len(columns):
                continue
            part = Block.__new__(Block)
            part.ids, part.v, part.most = own.ids[columns], own.v[columns], own.most
            scores = part.scores(other, np.arange(some.start, some.start + len(labels))[lines])
            line, column = firsts(scores, part.ids[None, :] != ids[lines][:, None], k)
            out.append((lines[line], columns[column], scores[line, column]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return found


def _best_in_windows(k: int, low: int, high: int):
    def found(own: Block, other: Block, extra: np.ndarray, some: slice):
        scores = own.scores(other, some)
        differs = own.labels[None, :] != other.labels[some][:, None]
        marked = np.zeros(scores.shape, bool)
        for j in range(extra.shape[1]):
            positive = extra[some, j]
            real = positive != NONE
            line, column = firsts(scores, differs & real[:, None] & _windowed(scores, np.where(real, positive, 0), low, high), k)
            marked[line, column] = True
        line, column = np.nonzero(marked)
        return line, column, scores[line, column]

    return found


def _big_endian(c: Column) -> Column:
    """Eight bytes of a long that sort as the long does."""
    return F.unhex(F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def mined(positives: DataFrame, negatives: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The first ``k`` negatives in each positive's window, from scored pairs, by secondary sort."""
    pairs = positives.select("anchor_id", "score", F.lit(0).alias("kind"), "other_id").unionByName(negatives.select("anchor_id", "score", F.lit(1).alias("kind"), "other_id"))
    key = F.concat(_big_endian(F.col("anchor_id")), _big_endian(F.bitwise_not("score")), F.unhex(F.lpad(F.hex("kind"), 2, "0")), _big_endian(F.col("other_id")))
    n = int(positives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.select("anchor_id", key.alias("key")).repartition(n, "anchor_id").sortWithinPartitions("key").select("key")
    layout = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, []
        top = np.uint64(1 << 63)
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(0).to_pylist()), layout)
            anchors, others = ((keys[c].astype(np.uint64) ^ top).view(np.int64).tolist() for c in ("anchor", "id"))
            scores = (~(keys["score"].astype(np.uint64) ^ top)).view(np.int64).tolist()
            out = []
            for anchor, score, kind, other in zip(anchors, scores, keys["kind"].tolist(), others, strict=True):
                if anchor != now:
                    now, windows = anchor, []
                if not kind:
                    windows.append([other, score, 0])
                    continue
                for w in windows:
                    if w[2] < k and in_window(score, w[1], low, high):
                        w[2] += 1
                        out.append((anchor, w[0], w[2], other, w[1], score))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if name == "rank" else pa.int64()) for c, name in zip(columns, names, strict=True)], names)

    return ordered.mapInArrow(walk, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for ``rows`` of :func:`usable_rows`.

    An anchor's positives are its best ``n_positives`` partners of the same label; a positive's
    negatives the best ``n_negatives`` of another label whose score is between ``low`` and ``high``
    percent of the positive's. Higher scores come first, ties by smaller id.

    Defined cases: a row is no partner of an anchor of its own id; of anchors that share an id the
    first by label and vector counts; other repeated rows are partners each; only rows of the anchor's
    dimension are partners; scores beyond a long saturate; an anchor without positives, or an empty
    table, gives no rows. Rows with nulls or components that aren't finite were left out before.
    """
    if n_positives < 1 or n_negatives < 1 or block_rows < 1:
        raise ValueError("numbers of positives, negatives and block rows must be at least 1")
    spark = rows.sparkSession
    all_rows = rows.groupBy(is_anchor.alias("a")).agg(F.count(F.lit(1)).alias("n")).collect()  # two rows
    n_rows, n_anchors = sum(r.n for r in all_rows), sum(r.n for r in all_rows if r.a)
    # smaller blocks where there would be fewer than two for each core
    most = max(1, min(block_rows, max(1024, -(-n_rows // (2 * spark.sparkContext.defaultParallelism)))))
    blocks = written(packed(rows, most), "negatives-rows")
    cells = max(1, -(-n_rows // most))
    first = F.min(F.struct("label", "v")).alias("x")
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(first).select("vec_id", "x.label", "x.v")
    shares = max(1, -(-n_anchors // BLOCK_ANCHORS))
    anchors = written(anchors.repartition(shares, "vec_id"), "negatives-anchors")
    same = _meet(blocks, packed(anchors, BLOCK_ANCHORS), cells, _best_of_label(n_positives))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    positives = written(same.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n_positives).drop("r"), "negatives-positives")
    scores = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list("score")).alias("scores"))  # at most n_positives each
    opened = anchors.join(scores.hint("merge"), F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "scores").repartition(shares, "vec_id")
    different = _meet(blocks, written(packed(opened, BLOCK_ANCHORS, ("scores", n_positives)), "negatives-windows"), cells, _best_in_windows(n_negatives, low, high))
    return mined(positives, different, n_negatives, low, high)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable_rows(table(spark, sf_dir, "embeddings"))
    seventh = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", seventh), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
positives AS (SELECT anchor_id, other_id, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS n FROM pairs WHERE same) WHERE n <= 5),
found AS (SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""
