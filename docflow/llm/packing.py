"""Operator 13: documents packed into training sequences of one length by concatenating and cutting.

The token ids of all documents, each closed by an end id, stand one behind the other in the order of
the table's partitions. The first pass encodes each partition once and writes its ids in blocks with
their places in the partition; the partitions' totals, a row each, are summed up to global offsets.
The second pass cuts each block at the multiples of the sequence length. Windows that lie in one
block are whole and stay where they are; only the parts of windows that blocks share, at most two a
block, are exchanged and joined. A window keeps boundary records: which document's ids, from where, stand at which offset.

Only the last sequence can be short of tokens. Padding, if asked for, fills it up to the full
length, unless the number of its tokens is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docflow.llm.shared import table, written
from docflow.llm.tokens import encoder

LENGTH, END_ID = 4096, 2
#: Tokens from which a block is closed; texts that are encoded at once, and characters from which fewer are.
BLOCK_TOKENS, TEXTS, CHARS = 1 << 19, 1024, 1 << 22

_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
_WINDOW = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("pieces", pa.list_(_PIECE))])
PIECES = "array<struct<doc_id:long,start:long,length:long,doc_tokens:long,offset:long>>"
WINDOW = f"sequence_id long, offset long, n_tokens long, width int, ids binary, pieces {PIECES}"
BLOCK = "part int, at long, doc_ids array<long>, sizes array<long>, n_tokens long, width int, ids binary"


def _narrow(ids: np.ndarray) -> tuple[int, bytes]:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return width, ids.astype(f"<u{width}").tobytes()


def encoded_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Blocks of whole documents with their ids and their place in the partition; written once."""
    end = np.array([end_id], "<u4").tobytes()

    def block(part: int, at: int, doc_ids: list, parts: list[bytes]) -> pa.RecordBatch:
        width, ids = _narrow(np.frombuffer(b"".join(parts), "<u4"))
        sizes = [len(p) // 4 for p in parts]
        types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary()]
        row = (part, at, doc_ids, sizes, sum(sizes), width, ids)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["part", "at", "doc_ids", "sizes", "n_tokens", "width", "ids"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held, doc_ids, parts = TaskContext.get().partitionId(), 0, 0, [], []
        words = encoder(tokenizer)
        for b in batches:
            step = max(1, min(TEXTS, CHARS * b.num_rows // max(1, b.column(1).nbytes)))
            for k in range(0, b.num_rows, step):
                some = b.slice(k, step)
                doc_ids += some.column(0).to_pylist()
                fresh = [x + end for x in words.encode(some.column(1).to_pylist())]
                parts += fresh
                held += sum(map(len, fresh)) // 4
                if held >= BLOCK_TOKENS:
                    yield block(part, at, doc_ids, parts)
                    at, held, doc_ids, parts = at + held, 0, [], []
        if parts:
            yield block(part, at, doc_ids, parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written(rows.mapInArrow(encode, BLOCK), "packing-blocks", compression="zstd")


def _cut(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, base: int, length: int, whole: bool) -> Iterator[tuple]:
    """Windows (sequence_id, offset, ids, pieces) of a block that starts at the global offset ``base``:
    those that lie in it, or its parts of those that don't."""
    stops = base + np.cumsum(sizes)
    starts = stops - sizes
    end = base + len(ids)
    within = range(-(-base // length), end // length)
    shared = [seq for seq in dict.fromkeys((base // length, (end - 1) // length)) if seq not in within]
    for seq in within if whole else shared:
        lo, hi = max(base, seq * length), min(end, (seq + 1) * length)
        pieces = []
        for k in range(int(np.searchsorted(stops, lo, "right")), int(np.searchsorted(starts, hi, "left"))):
            a, b = max(lo, int(starts[k])), min(hi, int(stops[k]))
            pieces.append((doc_ids[k], a - int(starts[k]), b - a, int(sizes[k]), a - seq * length))
        yield seq, lo - seq * length, ids[lo - base : hi - base], pieces


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    """A record batch of (sequence_id, offset, ids, pieces)."""
    columns: list[list] = [[] for _ in _WINDOW]
    for seq, offset, ids, pieces in rows:
        named = [dict(zip(("doc_id", "start", "length", "doc_tokens", "offset"), p, strict=True)) for p in pieces]
        for c, v in zip(columns, (seq, offset, len(ids), *_narrow(ids), named), strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WINDOW, strict=True)], schema=_WINDOW)


def pack_sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """sequence_id, offset (0), n_tokens, width, ids (little-endian, of ``width`` bytes each) and
    pieces (doc_id, start, length, doc_tokens, offset) of each sequence of ``docs`` (doc_id, text).

    Every sequence but the last has ``length`` tokens; each id of a document and its end id are in
    one piece of one sequence. Defined cases: a null or empty text is its end id alone; a null
    doc_id is kept; repeated rows are packed each; other columns are ignored; texts are encoded
    whole, at any length; an empty table gives no sequences. A read of the table fixes the order:
    the ids are written before they are counted, so lost executors change nothing.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    blocks = encoded_blocks(docs, tokenizer, end_id)
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def cut(whole: bool):
        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    r = b.slice(k, 1).to_pylist()[0]
                    ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                    found = _cut(r["doc_ids"], np.array(r["sizes"], np.int64), ids, r["start"], length, whole)
                    while some := list(islice(found, 64)):
                        yield _windows(some)

        return placed.mapInArrow(windows, WINDOW)

    placed = blocks.join(F.broadcast(bases), F.col("part") == F.col("b_part")).select((F.col("base") + F.col("at")).alias("start"), "doc_ids", "sizes", "width", "ids")
    return cut(True).unionByName(_joined(cut(False)))


def _joined(parts: DataFrame) -> DataFrame:
    """Windows put together of the parts that blocks hold of them; each has at most ``length`` parts."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                ids = np.concatenate([np.frombuffer(x["ids"], f"<u{x['width']}").astype("<u4") for x in r["parts"]])
                rows.append((r["sequence_id"], 0, ids, [tuple(p.values()) for x in r["parts"] for p in x["pieces"]]))
            yield _windows(rows)

    grouped = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "width", "ids", "pieces"))).alias("parts"))
    return grouped.mapInArrow(join, WINDOW)


def padded_ids(sequences: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids as an array, filled with ``pad_id`` up to ``length``, unless
    the number of tokens is a power of two."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for n, width, cells in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                own = np.frombuffer(cells, f"<u{width}").astype(np.int32)
                ids.append(own if n & (n - 1) == 0 else np.pad(own, (0, length - n), constant_values=pad_id))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "n_tokens", "ids"])

    return sequences.select("sequence_id", "n_tokens", "width", "ids").mapInArrow(fill, "sequence_id long, n_tokens long, ids array<int>")


def pieces_of(sequences: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece, from the sequences' ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seq, width, cells, pieces in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(cells, f"<u{width}").astype("<u4")
                out += [(p["doc_id"], p["start"], p["length"], zlib.crc32(ids[p["offset"] : p["offset"] + p["length"]]), p["doc_tokens"], seq, p["offset"]) for p in pieces]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return sequences.select("sequence_id", "width", "ids", "pieces").mapInArrow(read, ", ".join(f"{c} long" for c in names))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces_of(pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
