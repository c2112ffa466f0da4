"""Operator 5: SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding is agenda processing: all adjacent pairs whose concatenation is a piece are candidates,
the best-scored (then leftmost) one is merged, and its new neighbours join the agenda. With
dropout, a candidate is skipped if a hash keyed by the seed, the document, the word's place in it,
the candidate's place in the word and its two pieces falls below the dropout rate. So every
occurrence of a word draws for itself, the same run gives the same segmentation on any cluster,
and other seeds give others; all decode to the text.

Pieces hold a space mark only in front, never a line break, so words with the spaces before them
are encoded on their own, many at a time: the agendas of thousands of words are the columns of one
matrix, and each round does the first entry of every agenda.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm.shared import table

MARK = "▁"
SEED, DROPOUT = 20_240_101, 0.1
#: Words of up to so many characters share a matrix; longer ones have a heap each. (Results are equal.)
WIDTHS = (4, 6, 8, 10, 13, 18, 40)
#: Words encoded together.
SLICE_WORDS = 1 << 14
MIX, MORE = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
M64 = (1 << 64) - 1
TOKEN = re.compile(" *[^ \n]+| +|\n")
#: Symbols from here on stand for characters without a piece; they never merge.
LOOSE = 1 << 20
FAR = np.int64(1) << 62


def _occurrences(document: int, n: int) -> np.ndarray:
    """A key for each of the document's ``n`` words."""
    x = np.uint64(document & M64) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(MIX)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MORE)
    return x ^ (x >> np.uint64(27))


def _draw(keys, candidates):
    """24 hash bits of each occurrence key and candidate (place << 40 | left << 20 | right)."""
    x = (keys ^ (candidates * np.uint64(MIX))) * np.uint64(MORE)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX)
    return x >> np.uint64(40)


def _draw_one(key: int, candidate: int) -> int:
    x = (key ^ (candidate * MIX & M64)) * MORE & M64
    return (x ^ x >> 29) * MIX % (1 << 64) >> 40


class PieceCodec:
    """Encoder and decoder of one model; a text's literal space marks are coded as bytes."""

    def __init__(self, path: str, seed: int = SEED, dropout: float = DROPOUT):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.seed, self.limit = seed, int(dropout * (1 << 24))
        self.bytes_of = [b""] * n
        self.byte_id = [0] * 256
        normal = {}
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal[p] = i
                self.bytes_of[i] = p.replace(MARK, " ").encode()
        score = {i: -sp.get_score(i) for i in normal.values()}
        rank = {s: k for k, s in enumerate(sorted(set(score.values())))}
        self.char = {p: i for p, i in normal.items() if len(p) == 1}
        symbols = dict(normal)
        merges = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    merges[a, b] = (rank[score[i]], i)
        self.merges = merges
        self._hash(np.array([a << 32 | b for a, b in merges], np.int64), np.array(list(merges.values()), np.int64).reshape(-1, 2))
        self.of_code_point = np.arange(0x110000, dtype=np.int64) + LOOSE
        for p, i in self.char.items():
            self.of_code_point[ord(p)] = i
        self.of_code_point[ord(" ")], self.of_code_point[ord(MARK)] = self.char[MARK], LOOSE + ord(MARK)

    def symbols(self, word: str) -> list[int]:
        """A piece's id for each character, or LOOSE + code point; spaces become space marks."""
        get = self.char.get
        return [LOOSE + 0x2581 if c == MARK else get(MARK if c == " " else c, LOOSE + ord(c)) for c in word]

    def _ids(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            if s < LOOSE:
                out.append(s)
            else:
                out += [self.byte_id[b] for b in chr(s - LOOSE).encode("utf-8", "surrogatepass")]
        return out

    def agenda(self, word: str, key: int) -> list[int]:
        """Ids of one occurrence of a word by a heap of candidate merges: n log n for any length."""
        sym: list[int | None] = list(self.symbols(word))
        n = len(sym)
        prev, following = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = following[i]
            if j < n and (m := self.merges.get((sym[i], sym[j]))) and not (self.limit and _draw_one(key, (i << 40 | sym[i] << 20 | sym[j]) & M64) < self.limit):
                heapq.heappush(heap, (m[0], i, sym[i], sym[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = following[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # one of the two was merged meanwhile
            sym[i], sym[j] = made, None
            following[i] = following[j]
            if following[i] < n:
                prev[following[i]] = i
            if prev[i] >= 0:
                offer(prev[i])
            offer(i)
        return self._ids([s for s in sym if s is not None])

    def _hash(self, pairs: np.ndarray, results: np.ndarray) -> None:
        """A table of the merges with open addresses: slots of pair, rank and result."""
        self.bits = max(4, int(len(pairs)).bit_length() + 3)
        size = 1 << self.bits
        self.slots = np.full(size, -1, np.int64)
        of_slot = np.zeros((size, 2), np.int64)
        at, left, self.probes = self._slot(pairs), np.arange(len(pairs)), 0
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.slots[at[left]] < 0)
            _, first = np.unique(at[left[free]], return_index=True)
            won = left[free[first]]
            self.slots[at[won]], of_slot[at[won]] = pairs[won], results[won]
            left = np.setdiff1d(left, won)
            at[left] = (at[left] + 1) & (size - 1)
        self.ranks, self.made = of_slot[:, 0].copy(), of_slot[:, 1].copy()

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(MIX)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _candidates(self, left, right, place, keys) -> tuple[np.ndarray, np.ndarray]:
        """Agenda entry (rank << 6 | place) and result of merging ``left`` with ``right``; FAR if none."""
        pair = left << 32 | right
        at = self._slot(pair)
        got = self.slots[at]
        rest = np.flatnonzero((got != pair) & (got >= 0))
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & (len(self.slots) - 1)
            got[rest] = self.slots[at[rest]]
            rest = rest[(got[rest] != pair[rest]) & (got[rest] >= 0)]
        found = np.flatnonzero((got == pair) & (pair >= 0))
        entry, made = np.full(len(pair), FAR), np.zeros(len(pair), np.int64)
        if self.limit and len(found):
            candidate = (place[found] << 40 | left[found] << 20 | right[found]).astype(np.uint64)
            found = found[_draw(keys[found], candidate) >= np.uint64(self.limit)]
        at = at[found]
        entry[found], made[found] = self.ranks[at] << 6 | place[found], self.made[at]
        return entry, made

    def _matrix(self, words: list[str], keys: np.ndarray, width: int) -> list[bytes]:
        """Ids of words of up to ``width`` characters; a word is a column, a symbol a cell.

        Row ``width`` is beyond the ends of all words: it holds no symbol and takes no entry.
        """
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        flat = self.of_code_point[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        column = np.repeat(np.arange(n), sizes)
        row = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sym = np.full((width + 1, n), -1, np.int64)
        sym[row, column] = flat
        following = np.repeat(np.minimum(np.arange(1, width + 2), width)[:, None], n, axis=1)
        before = np.repeat(np.r_[width, np.arange(width)][:, None], n, axis=1)
        entry, made = np.full((width + 1, n), FAR), np.zeros((width + 1, n), np.int64)
        inner = np.flatnonzero(row + 1 < sizes[column])
        own = row[inner], column[inner]
        entry[own], made[own] = self._candidates(flat[inner], flat[inner + 1], row[inner], keys[column[inner]])
        at_end = sizes - 1
        following[at_end, np.arange(n)] = width
        out = np.full((width, n), -1, np.int64)
        name = np.arange(n)
        while n:
            best = entry.min(axis=0)
            live = np.flatnonzero(best < FAR)
            if len(live) < 0.75 * n or not len(live):
                done = np.flatnonzero(best >= FAR)
                out[:, name[done]] = sym[:width, done]
                sym, following, before, entry, made = (np.ascontiguousarray(x[:, live]) for x in (sym, following, before, entry, made))
                name, keys, best, n = name[live], keys[live], best[live], len(live)
                live = np.arange(n)
                if not n:
                    break
            s, f, b, e, m = sym.ravel(), following.ravel(), before.ravel(), entry.ravel(), made.ravel()
            place = best[live] & 63
            at = place * n + live
            gone = f[at] * n + live
            merged = m[at]
            s[at], s[gone], e[gone] = merged, -1, FAR
            after, prior = f[gone], b[at]
            f[at] = after
            b[after * n + live] = place
            to, back = after * n + live, prior * n + live
            k = keys[live]
            both = self._candidates(np.r_[merged, s[back]], np.r_[s[to], merged], np.r_[place, prior], np.r_[k, k])
            e[at], m[at] = both[0][: len(at)], both[1][: len(at)]
            e[back], m[back] = both[0][len(at) :], both[1][len(at) :]
        cells = out.T
        held = cells >= 0
        flat, counts = cells[held], held.sum(axis=1)
        raw = flat.astype("<i4").tobytes()
        cuts = np.r_[0, np.cumsum(counts)].tolist()
        coded = [raw[4 * a : 4 * z] for a, z in zip(cuts, cuts[1:], strict=False)]
        for w in np.unique(np.repeat(np.arange(len(words)), counts)[flat >= LOOSE]).tolist():  # characters without a piece become bytes
            coded[w] = np.array(self._ids(flat[cuts[w] : cuts[w + 1]].tolist()), "<i4").tobytes()
        return coded

    def _encode_words(self, words: list[str], keys: np.ndarray) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        least = 0
        for width in WIDTHS:
            chosen = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            if len(chosen):
                places = chosen.tolist()
                for k, ids in zip(places, self._matrix([words[k] for k in places], keys[chosen], width), strict=True):
                    out[k] = ids
        for k in np.flatnonzero(sizes > least).tolist():
            out[k] = np.array(self.agenda(words[k], int(keys[k])), "<i4").tobytes()
        return out

    def encode(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """Ids of whole texts; ``documents`` are the keys of their draws."""
        split = [TOKEN.findall(" " + t) if t else [] for t in texts]
        words = [w for ws in split for w in ws]
        keys = np.concatenate([_occurrences(d ^ self.seed * MIX, len(ws)) for ws, d in zip(split, documents, strict=True)]) if split else np.zeros(0, np.uint64)
        coded: list[bytes] = []
        for at in range(0, len(words), SLICE_WORDS):
            coded += self._encode_words(words[at : at + SLICE_WORDS], keys[at : at + SLICE_WORDS])
        out, at = [], 0
        for ws in split:
            out.append(np.frombuffer(b"".join(coded[at : at + len(ws)]), "<i4"))
            at += len(ws)
        return out

    def decode(self, ids) -> str:
        """The text of the ids: bytes of the pieces, without the space put in front."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=1)
def codec(model: str, seed: int, dropout: float) -> PieceCodec:
    """One codec for each worker process, whose tasks follow each other."""
    return PieceCodec(model, seed, dropout)


def encode_pieces(docs: DataFrame, model: str, seed: int = SEED, dropout: float = DROPOUT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, the text's ``ids`` and ``lossless``.

    ``lossless`` says that decoding the ids gave the text back. A document's draws are keyed by
    its doc_id and text, so copies under other ids get other segmentations. Defined cases: a null
    text counts as empty and has no ids; a null doc_id is a key like others; repeated rows come
    back each (and alike); columns that aren't asked for are ignored, those that are keep their
    values whatever their type; an empty table gives no rows; texts are encoded whole.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec(model, seed, dropout)
        for b in batches:
            for at in range(0, b.num_rows, 128):  # few documents at a time bound the memory
                some = b.slice(at, 128)
                *kept, keys, column = some.columns
                texts = column.to_pylist()
                ids = words.encode(texts, keys.to_pylist())
                lossless = [words.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate([*ids, np.zeros(0, "<i4")]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(lossless)], [*keep, "ids", "lossless"])

    rows = docs.select(*keep, F.xxhash64("doc_id", text).alias("_key"), text.alias("_text"))
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])
    return rows.mapInArrow(encode, schema)


def decode_pieces(coded: DataFrame, model: str) -> DataFrame:
    """``coded`` with ``text``, decoded from its ``ids``; null ids give a null text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = codec(model, SEED, DROPOUT)
        for ids in batches:
            yield pd.Series([None if x is None else words.decode([int(i) for i in x]) for x in ids])

    return coded.withColumn("text", decode(F.col("ids")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.withColumn("n_ids", F.size("ids").cast("long"))
