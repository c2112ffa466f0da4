"""Operator 4: token ids as files, with document boundaries in Elias-Fano form.

A token table is Parquet; each of its rows is a block of consecutive documents:

====================  =======================================================================
part, block           order of the blocks; ``start`` is the block's first id within the part
doc_ids               ids of its documents, ascending, nulls first
n_tokens, width       number of token ids, bytes of each
ids                   the documents' token ids, concatenated, little-endian, ``width`` bytes each
low_bits, low, high   Elias-Fano form of the ends of the documents in ``ids``
ones                  select samples: place in ``high`` of every 256th one bit (unsigned 32 bits)
====================  =======================================================================
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections import ChainMap
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docflow.llm.shared import table, written

SAMPLE = 256
BLOCK_TOKENS = 1 << 20
END_ID = 1
#: Pieces of up to so many characters are kept by a worker, at most so many whole pieces and words
#: of letters; later ones are encoded whenever they come.
CACHED_CHARS, CACHED_PIECES, CACHED_LETTERS = 40, 300_000, 500_000


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits a value, with select."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    ones: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, int(values[-1] // n).bit_length() - 1)
        places = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1, np.uint8)
        high[places] = 1
        cells = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        return cls(
            n,
            low_bits,
            np.packbits(cells.reshape(-1), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(),
            places[::SAMPLE].astype("<u4").tobytes(),
        )

    def select(self, i: int) -> int:
        """Value number ``i``, found from the sample before it without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.ones, "<u4", 1, 4 * (i // SAMPLE))[0])
        left = i % SAMPLE
        byte, bit = divmod(at, 8)
        word = self.high[byte] >> bit << bit
        while (count := word.bit_count()) <= left:
            left -= count
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        first = i * self.low_bits
        span = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return ((place - i) << self.low_bits) | (span >> first % 8) & ((1 << self.low_bits) - 1)

    def run(self, j: int) -> np.ndarray:
        """Values number ``SAMPLE * j`` to the next sample's, from sample ``j`` on, for reading in order."""
        count = min(SAMPLE, self.n - SAMPLE * j)
        marks = np.frombuffer(self.ones, "<u4")
        at = int(marks[j])
        end = int(marks[j + 1]) if j + 1 < len(marks) else 8 * len(self.high)
        cells = np.unpackbits(np.frombuffer(self.high, np.uint8)[at // 8 : (end + 7) // 8], bitorder="little")
        places = np.flatnonzero(cells[at % 8 :])[:count] + at
        number = SAMPLE * j + np.arange(count)
        first = SAMPLE * j * self.low_bits  # a whole byte: SAMPLE is a multiple of 8
        low = np.unpackbits(np.frombuffer(self.low, np.uint8)[first // 8 :][: (count * self.low_bits + 7) // 8], count=count * self.low_bits, bitorder="little")
        return ((places - number) << self.low_bits) + low.reshape(count, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits))

    def decode(self) -> np.ndarray:
        """All values."""
        if not self.n:
            return np.zeros(0, np.int64)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), count=self.n * self.low_bits, bitorder="little")
        weights = np.int64(1) << np.arange(self.low_bits)
        return ((places - np.arange(self.n)) << self.low_bits) + low.reshape(self.n, self.low_bits).astype(np.int64) @ weights


class TextEncoder:
    """Ids of whole texts, as little-endian 32-bit bytes, by any tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)

    def _each(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)] if pieces else []

    def encode(self, texts: list[str]) -> list[bytes]:
        return self._each(texts)


class WordEncoder(TextEncoder):
    """The same for tokenizer files whose normaliser and pattern are those of :meth:`fits`.

    That normaliser turns white space into a space and that pattern never matches across one, so
    the ids of a text are those of its space- and line-separated pieces in order. Pieces repeat,
    so a worker keeps the ids of short ones. A piece of Latin letters and trailing marks falls
    into two matches of the pattern, the letters and the marks; the letters of new pieces go
    straight to the tokenizer's merges.
    """

    LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?#%$&*|]*)")
    #: What the file must say for the pieces to be independent.
    NORMALISERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    @classmethod
    def fits(cls, path: str) -> bool:
        """Whether pieces may be encoded apart under this file."""
        form = json.loads(Path(path).read_text("utf-8"))
        normal, split = form.get("normalizer") or {}, form.get("pre_tokenizer") or {}
        steps = split.get("pretokenizers", [])
        spaced = any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in form.get("added_tokens", []))
        return (
            form["model"].get("type", "BPE") == "BPE"
            and not form["model"].get("dropout")
            and tuple(normal.get("normalizers", ())) == cls.NORMALISERS
            and len(steps) == 2
            and steps[0] == {"type": "Split", "pattern": {"Regex": cls.PATTERN}, "behavior": "Removed", "invert": True}
            and steps[1].get("type") == "ByteLevel"
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and not spaced
        )

    def __init__(self, path: str):
        super().__init__(path)
        self.known: dict[str, bytes] = {"": b""}
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        # byte-level tokenizers write a byte that isn't printable as the next character from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.as_bytes = {b: 256 + k for k, b in enumerate(sorted(set(range(256)).difference(plain)))}

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters, each of which is one match of the pattern."""
        merge = self.tokenizer.model.tokenize
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(self.as_bytes) for w in words]
        return [array("I", [t.id for t in merge(w)]).tobytes() for w in spelled]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, each by itself; of a piece there may be none at all, b""."""
        known, letters, marks = self.known, self.letters, self.marks
        ids = list(map(known.get, pieces))
        new = [w for w, x in zip(pieces, ids, strict=True) if x is None]
        parts = [(w, m[1].lower(), m[2]) for w in new if len(w) <= CACHED_CHARS and (m := self.LETTERS.fullmatch(w))]
        fresh = list({x for _, x, _ in parts}.difference(letters))
        of_fresh = dict(zip(fresh, self._words(fresh), strict=True))
        if len(letters) < CACHED_LETTERS:
            letters.update(of_fresh)
            of_fresh = letters
        else:
            of_fresh = ChainMap(of_fresh, letters)
        fresh = list({x for _, _, x in parts}.difference(marks))
        marks.update(zip(fresh, self._each(fresh), strict=True))
        found = {w: of_fresh[x] + marks[y] for w, x, y in parts}
        rest = [w for w in new if w not in found]
        found.update(zip(rest, self._each(rest), strict=True))
        if len(known) < CACHED_PIECES:
            known.update((w, x) for w, x in found.items() if len(w) <= CACHED_CHARS)
        return [found[w] if x is None else x for w, x in zip(pieces, ids, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each different piece of a batch is looked up once; Arrow and NumPy do the rest."""
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        ids = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        which = coded.indices.to_numpy()
        ends = np.cumsum(sizes[which])
        # id number k of the batch is id number k + ahead of the different pieces put together
        ahead = (np.cumsum(sizes) - sizes)[which] - (ends - sizes[which])
        whole = np.frombuffer(b"".join(ids), "<u4")[np.repeat(ahead, sizes[which]) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return [whole[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=1)
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process, whose tasks follow each other."""
    return WordEncoder(path) if WordEncoder.fits(path) else TextEncoder(path)


TOKEN_TABLE = "part int, block int, start long, doc_ids array<long>, n_tokens long, width int, ids binary, low_bits int, low binary, high binary, ones binary"
_BLOCK = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("width", pa.int32())]
    + [("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("ones", pa.binary())]
)


def _block(part: int, number: int, start: int, doc_ids: list, parts: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(parts), "<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ends = EliasFano.of(np.cumsum([len(p) // 4 for p in parts]))
    row = (part, number, start, doc_ids, len(ids), width, ids.astype(f"<u{width}").tobytes(), ends.low_bits, ends.low, ends.high, ends.ones)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK.types, strict=True)], schema=_BLOCK)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The token table of ``docs`` (doc_id, text), written to the shared folder and read back.

    Rows are dealt out by ranges of doc_id, so blocks in order of (part, block) hold the documents
    in ascending doc_id order. A null text is empty: its only id is ``end_id``; null doc_ids come
    first; repeated rows are written each; other columns are ignored; an empty table makes an
    empty one. Ids of documents keep all their 64 bits.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        words = encoder(tokenizer)
        doc_ids: list = []
        parts: list[bytes] = []
        held = 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                doc_ids += some.column(0).to_pylist()
                fresh = [x + end for x in words.encode(some.column(1).to_pylist())]
                parts += fresh
                held += sum(map(len, fresh)) // 4
                if held >= block_tokens:
                    yield _block(part, number, start, doc_ids, parts)
                    number, start, held, doc_ids, parts = number + 1, start + held, 0, [], []
        if doc_ids:
            yield _block(part, number, start, doc_ids, parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    return written(ordered.mapInArrow(encode, TOKEN_TABLE), "token-table", compression="zstd")


_DOCUMENT = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _documents(block: dict, wanted: list[int] | None, with_ids: bool) -> pa.RecordBatch:
    """Rows of a block's documents in order, or of the ``wanted`` ones (sorted), each by two selects."""
    ids = np.frombuffer(block["ids"], f"<u{block['width']}")
    doc_ids = block["doc_ids"]
    ends = EliasFano(len(doc_ids), block["low_bits"], block["low"], block["high"], block["ones"])
    bounds: list[tuple[int, int, int]] = []  # place of the document, its first id and the end
    if wanted is None:
        stops = np.concatenate([ends.run(j) for j in range(-(-ends.n // SAMPLE))]).tolist()
        bounds = list(zip(range(ends.n), [0, *stops], stops, strict=False))
    else:
        nulls = doc_ids.count(None) if doc_ids and doc_ids[0] is None else 0
        for d in wanted:
            k = bisect_left(doc_ids, d, nulls)
            while k < len(doc_ids) and doc_ids[k] == d:
                bounds.append((k, ends.select(k - 1) if k else 0, ends.select(k)))
                k += 1
    rows = []
    for k, start, end in bounds:
        own = ids[start:end].astype("<u4")
        rows.append((block["part"], doc_ids[k], block["start"] + start, end - start, zlib.crc32(own), own.astype(np.int32) if with_ids else None))
    schema = _DOCUMENT if with_ids else _DOCUMENT.remove(5)
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)], schema=schema)


def read_tokens(blocks: DataFrame, with_ids: bool = False, doc_ids: list[int] | None = None) -> DataFrame:
    """Per document of a token table: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    ``start`` counts the ids of all documents before it: the offset in the block, which the select
    samples give run by run, plus the block's place in its part, plus the parts before it. With ``doc_ids`` only
    these documents are read, from the blocks that hold them: two selects give a document's ids,
    and no other document's bounds or ids are decoded. An empty table gives no rows.
    """
    schema = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    wanted = None if doc_ids is None else sorted(set(doc_ids))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                yield _documents(b.slice(at, 1).to_pylist()[0], wanted, with_ids)

    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    read = blocks if wanted is None else blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(d).cast("long") for d in wanted]).cast("array<long>")))
    docs = read.mapInArrow(decode, schema)
    ids = ["ids"] if with_ids else []
    return docs.join(F.broadcast(bases), F.col("part") == F.col("b_part")).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *ids
    )


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
