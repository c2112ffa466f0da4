"""Operator 6: benchmark decontamination by BM25 with block-max WAND.

Test items, and the question parts of those that have an answer, are units of an inverted index
with BM25 impacts. Every passage of every training text is a query against it; all units above a
threshold are retrieved, then their items are verified by five-word shingles: a part of an item is
held if some ``width`` consecutive words of the text contain 0.8 of its distinct shingles, where the
width is twice the item's words, 96 at least. A text
leaks an item if it holds the whole item, or both its question and its answer, wherever they stand.

The threshold loses nothing that verification would accept. If 0.8 of a unit's distinct shingles
are there, at most a fifth of them are missing, and a word is missing only if all shingles with it
are: each missing word before a shingle that is there is the first word of a missing shingle, each
one that stands only behind it the last word of another one, so no more words are missing than
shingles. The passage scores at least the unit's own score less its highest impacts for so many
words. Impacts are divided by that bound; a unit is retrieved at 1. Items are indexed by classes of
width (128, 256, 512, ...), each with passages twice as long as its width that overlap by half, so any
``width`` consecutive words lie in one. A long item has long passages, but no other item has; all
items share one set of statistics.

Units are numbered by length, so units of one block have impacts alike. Bounds are kept for groups
of 64 units and for blocks of 4: a query adds up the bounds of its terms for the groups, follows
pointers to the blocks of groups that may reach the threshold only, and to the postings of blocks
that may; over those, WAND moves one cursor a term from pivot to pivot.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.shared import table, written

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
#: Units of a block and of a group of blocks; maxima bound what a word gives to any of them.
BLOCK, GROUP = 4, 64
#: Words in which an item's parts must be held; twice the item's words if that is more.
PASSAGE = 96
#: Width of the first class of items: up to 64 words, as most test items are, which share one index
#: and one pass. The classes change which windows are searched, not what is found.
CLASS_WIDTH = 128
#: Characters of test items in one set of indexes (it is broadcast and takes about ten bytes for each);
#: more items make more sets. Document frequencies and mean length are those of all items.
INDEX_CHARS = 16_000_000
WHOLE, QUESTION = 0, 1

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of 0-9, a-z and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def question_and_answer(text: str) -> tuple[str, str]:
    """The last line, or else the last sentence, is the answer; what stands before, the question."""
    lines = text.strip().rsplit("\n", 1)
    if len(lines) == 1:
        head, stop, tail = lines[0].rstrip(".").rpartition(". ")
        lines = [head + stop, tail] if head else lines
    return (lines[0], lines[1]) if len(lines) == 2 else (lines[0], "")


def shingle_hashes(terms: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash at each place where ``size`` terms begin; 0 where one of them is unknown (-1)."""
    n = max(0, len(terms) - size + 1)
    x, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        own = terms[k : k + n]
        known &= own >= 0
        x = (x ^ own.astype(np.uint64)) * _STEP
        x ^= x >> np.uint64(29)
    return np.where(known, x | np.uint64(1), np.uint64(0))


def width_of(words: int) -> int:
    """In how many consecutive words an item of so many words must be held."""
    return max(PASSAGE, 2 * words)


def class_of(width: int) -> int:
    """The least k with CLASS_WIDTH << k >= width."""
    return ((width - 1) // CLASS_WIDTH).bit_length()


def needed(shingles: int) -> int:
    """How many of so many distinct shingles make an overlap of 0.8."""
    return math.ceil(OVERLAP * shingles - 1e-9)


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one range after the other."""
    counts = last - first
    upto = np.cumsum(counts)
    return np.repeat(first - upto + counts, counts) + np.arange(upto[-1] if len(upto) else 0)


class ItemIndex:
    """Postings of the units with impacts, bounds of blocks and groups, and the shingles to verify.

    All but the vocabulary is a few arrays: about 50 bytes a word of the items.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int] | None = None, n: int = 0, mean: float = 0.0):
        kept = [(i, t, w) for i, t in items if (w := words_of(t))]
        if df is None:  # these are all items there are
            df, n, mean = statistics(kept)
        self.ids = [i for i, _, _ in kept]
        self.widths = [width_of(len(w)) for _, _, w in kept]
        self.width = CLASS_WIDTH << class_of(max(self.widths, default=PASSAGE))
        self.term: dict[bytes, int] = {}
        parts, units = [], []
        for at, (_, text, words) in enumerate(kept):
            question, answer = (words_of(p) for p in question_and_answer(text))
            own = [np.array([self.term.setdefault(w, len(self.term)) for w in ws], np.int64) for ws in (words, question, answer)]
            parts.append([self._distinct(x) for x in own])
            units.append((len(words), at, WHOLE))
            if question and answer:
                units.append((len(question), at, QUESTION))
        # shingles of item i and part p: hashes[bounds[3 i + p]:bounds[3 i + p + 1]], sorted, of sizes[3 i + p] words
        flat = [h for p in parts for h, _ in p]
        self.sizes = np.array([size for p in parts for _, size in p], np.int8)
        self.bounds = np.cumsum([0, *map(len, flat)])
        self.hashes = np.concatenate([*flat, np.zeros(0, np.uint64)])
        units.sort()
        self.item_of, self.part_of = [u[1] for u in units], [u[2] for u in units]
        names = list(self.term)
        rows: list[tuple[int, int, float]] = []
        for number, (_, at, part) in enumerate(units):
            text = kept[at][1]
            words = kept[at][2] if part == WHOLE else words_of(question_and_answer(text)[0])
            impacts = {
                self.term[w]: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean))
                for w, c in Counter(words).items()
            }
            shingles = int(self.bounds[3 * at + part + 1] - self.bounds[3 * at + part])
            least = max(1, len(impacts) - (shingles - needed(shingles)))
            bound = sum(sorted(impacts.values())[:least]) * (1 - 1e-9)
            rows += [(t, number, x / bound) for t, x in impacts.items()]
        rows.sort()
        term_of = np.array([r[0] for r in rows], np.int64)
        self.units = np.array([r[1] for r in rows], np.int64)
        self.impacts = np.array([r[2] for r in rows])
        # each level points into the one below: a term's groups, a group's blocks, a block's postings
        self.block, self.block_max, self.block_first, block_term = self._level(term_of, self.units // BLOCK, self.impacts)
        self.group, self.group_max, self.group_first, group_term = self._level(block_term, self.block * BLOCK // GROUP, self.block_max)
        self.term_first = np.searchsorted(group_term, np.arange(len(names) + 1))

    @staticmethod
    def _distinct(terms: np.ndarray) -> tuple[np.ndarray, int]:
        size = min(SHINGLE, len(terms))
        return (np.unique(shingle_hashes(terms, size)) if size else np.zeros(0, np.uint64)), size

    @staticmethod
    def _level(term: np.ndarray, bin_of: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each term and bin: the bin, its maximum, its first entry (and the end), its term."""
        if not len(term):
            return bin_of, bound, np.zeros(1, np.int64), term
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (bin_of[1:] != bin_of[:-1])])
        return bin_of[starts], np.maximum.reduceat(bound, starts), np.r_[starts, len(term)], term[starts]

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """(unit, score) of all units that score 1 or more for the distinct ``terms``."""
        if not len(terms):
            return []
        groups = _spread(self.term_first[terms], self.term_first[terms + 1])
        groups = groups[np.bincount(self.group[groups], self.group_max[groups])[self.group[groups]] >= 1]
        if not len(groups):
            return []
        blocks = _spread(self.group_first[groups], self.group_first[groups + 1])
        live = np.bincount(self.block[blocks], self.block_max[blocks])
        blocks = blocks[live[self.block[blocks]] >= 1]
        return self._wand(blocks, live) if len(blocks) else []

    def _wand(self, blocks: np.ndarray, live: np.ndarray) -> list[tuple[int, float]]:
        """WAND with block maxima over the postings of the live ``blocks``, a cursor for each term."""
        cursors = []  # [unit, postings left (next one last), bound over them]
        term_of = np.searchsorted(self.term_first, np.searchsorted(self.group_first, blocks, "right") - 1, "right")
        cuts = np.flatnonzero(np.r_[True, term_of[1:] != term_of[:-1], True])
        for a, z in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            own = _spread(self.block_first[blocks[a:z]], self.block_first[blocks[a:z] + 1])
            rest = list(zip(self.units[own].tolist(), self.impacts[own].tolist(), strict=True))[::-1]
            cursors.append([rest[-1][0], rest, float(self.block_max[blocks[a:z]].max())])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= 1:
                    pivot = k
                    break
            if pivot < 0:
                break  # what is left of all lists together can't reach the threshold
            unit = cursors[pivot][0]
            if live[unit // BLOCK] < 1:
                to = (unit // BLOCK + 1) * BLOCK
            elif cursors[0][0] == unit:
                score = sum(c[1][-1][1] for c in cursors if c[0] == unit)
                if score >= 1:
                    out.append((unit, score))
                to = unit + 1
            else:
                to = unit
            for c in cursors:
                if c[0] >= to:
                    break
                while c[1] and c[1][-1][0] < to:
                    c[1].pop()
                c[0] = c[1][-1][0] if c[1] else None
            cursors = [c for c in cursors if c[0] is not None]
        return out

    def leaks(self, words: list[bytes]) -> list[tuple[int, float, float, float, float]]:
        """(item_id, score, overlap, question_overlap, answer_overlap) of the items in a text's ``words``.

        ``score`` is the best of the item's units over the passages, an overlap the best share of the
        part's distinct shingles in consecutive words of the item's width; a part without words has 1.
        """
        if not self.ids:
            return []
        terms = np.fromiter(map(self.term.get, words, repeat(-1)), np.int64, len(words))
        scores: dict[int, float] = {}
        for start in range(0, max(1, len(words) - self.width), self.width):
            window = np.unique(terms[start : start + 2 * self.width])
            for unit, score in self.retrieve(window[window >= 0]):
                at = self.item_of[unit]
                scores[at] = max(score, scores.get(at, 0.0))
        hashes: dict[int, np.ndarray] = {}
        found = []
        for at in sorted(scores):
            shares = [self._share(at, part, terms, hashes) for part in range(3)]
            if shares[0] >= OVERLAP or min(shares[1:]) >= OVERLAP:
                found.append((self.ids[at], scores[at], *shares))
        return found

    def _share(self, at: int, part: int, terms: np.ndarray, hashes: dict[int, np.ndarray]) -> float:
        """The best share of the part's distinct shingles in the item's width of consecutive words."""
        wanted = self.hashes[self.bounds[3 * at + part] : self.bounds[3 * at + part + 1]]
        size = int(self.sizes[3 * at + part])
        if not size:
            return 1.0
        if size not in hashes:
            hashes[size] = shingle_hashes(terms, size)
        have = hashes[size]
        which = np.minimum(np.searchsorted(wanted, have), len(wanted) - 1)
        places = np.flatnonzero(wanted[which] == have)
        if not len(places) or len(wanted) == 1:
            return float(len(places) > 0)
        inside: Counter[int] = Counter()
        best, left = 0, 0
        spots, which = places.tolist(), which[places].tolist()
        for right, place in enumerate(spots):
            inside[which[right]] += 1
            while place - spots[left] > self.widths[at] - size:
                if inside[which[left]] == 1:
                    del inside[which[left]]
                else:
                    inside[which[left]] -= 1
                left += 1
            best = max(best, len(inside))
        return best / len(wanted)


def statistics(kept: list[tuple[int, str, list[bytes]]]) -> tuple[Counter, int, float]:
    """Document frequencies, number and mean length of items (id, text, words)."""
    return Counter(w for _, _, ws in kept for w in set(ws)), len(kept), sum(len(w) for _, _, w in kept) / max(1, len(kept))


class ItemSet:
    """Items in one index for each class of width, all with the same statistics."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int] | None = None, n: int = 0, mean: float = 0.0):
        if df is None:
            df, n, mean = statistics([(i, t, w) for i, t in items if (w := words_of(t))])
        classes: dict[int, list[tuple[int, str]]] = {}
        for i, t in items:
            classes.setdefault(class_of(width_of(len(words_of(t)))), []).append((i, t))
        self.indexes = [ItemIndex(own, df, n, mean) for _, own in sorted(classes.items())]

    def leaks(self, text: str) -> list[tuple[int, float, float, float, float]]:
        """As :meth:`ItemIndex.leaks`, of all items, for a whole text."""
        words = words_of(text)
        return [leak for index in self.indexes for leak in index.leaks(words)]


def item_sets(benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> tuple[int, Iterator[ItemSet]]:
    """How many sets there are, and the sets, one at a time: one, or several of disjoint items if the
    items' characters exceed ``index_chars``.

    Several have the statistics of all items, so it doesn't matter to a score how they are split.
    """
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-chars // index_chars) or 1
    return blocks, _sets(items, blocks)


def _sets(items: DataFrame, blocks: int) -> Iterator[ItemSet]:
    if blocks == 1:
        yield ItemSet([(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()])
        return

    @F.pandas_udf("array<binary>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("part")
    parsed = written(items.select("item_id", "text", split("text").alias("words"), part).where(F.size("words") > 0), "items")
    n, mean = parsed.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    frequency = written(parsed.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")), "item-words")
    for b in range(blocks):
        own = parsed.where(F.col("part") == b)
        needs = own.select(F.explode("words").alias("w")).distinct()
        df = {bytes(r.w): r.df for r in frequency.join(needs.hint("merge"), "w", "left_semi").collect()}
        yield ItemSet([(r.item_id, r.text) for r in own.orderBy("item_id", "text").select("item_id", "text").collect()], df, n, mean)


LEAK = "array<struct<item_id:long,score:double,overlap:double,question_overlap:double,answer_overlap:double>>"


def leaks_in(text: Column, shared: Broadcast[ItemSet]) -> Column:
    @F.pandas_udf(LEAK)
    def find(texts: pd.Series) -> pd.Series:
        one = shared.value
        names = ("item_id", "score", "overlap", "question_overlap", "answer_overlap")
        return pd.Series([[dict(zip(names, r, strict=True)) for r in one.leaks(t)] if t else [] for t in texts])

    return find(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap: items in each document.

    One row for each document row and item. Whether a document leaks an item depends on no other
    item. Of several sets of items, one is in memory at a time, and what it finds is written.
    Defined cases: null and empty texts and items without words have no leaks; null ids are kept;
    repeated documents and items come back each; other columns are ignored; empty tables give no
    rows; texts are read whole.
    """
    n, sets = item_sets(benchmark, index_chars)
    parts = []
    for items in sets:
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by INDEX_CHARS
        part = docs.select("doc_id", F.explode(leaks_in(F.col("text").cast("string"), shared)).alias("leak")).select("doc_id", "leak.*")
        parts.append(written(part, "leaks") if n > 1 else part)
        if n > 1:
            shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """``docs`` with all its columns, without the documents that contain a test item.

    Of several sets of items, one is in memory at a time, and what it leaves is written.
    Defined cases: null and empty texts stay; rows with a null or repeated doc_id, and repeated
    rows, are judged each by their text; no column but text is looked at; an empty benchmark, or
    one without words, removes nothing; an empty table gives no rows.
    """
    n, sets = item_sets(benchmark, index_chars)
    for items in sets:
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by INDEX_CHARS
        docs = docs.where(F.size(leaks_in(F.col("text").cast("string"), shared)) == 0)
        if n > 1:
            docs = written(docs, "without-leaks")
            shared.destroy()
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
