"""Operator 3: language ID by prediction by partial matching (PPM) over bytes.

For each language a context tree of the bytes up to three back is counted on a bounded sample of
labelled documents; every context of the sample is kept. A byte is coded in its longest context
seen; if it wasn't seen there, an escape is coded and the next shorter context is tried, down to
an even distribution over 256 bytes (escape method C: in a context seen n times with d different
bytes, a byte seen c times has probability c / (n + d), the escape d / (n + d)). Statistics are
frozen, so the length of a byte depends on its three predecessors only, and the lengths of all
languages are looked up together in sparse tables, one for each context length. A text's code
length is summed exactly over its whole bytes; the language with the shortest one wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docflow.llm.shared import table, written

ORDER = 3
#: Distinct texts of each language that the model is fitted on (at most); they are taken whole.
SAMPLE_DOCS = 400
#: Tasks that count the sample.
SAMPLE_TASKS = 8
UNDETERMINED = "und"
#: A text whose shortest code is longer than this many bits a byte is in no learned language:
#: an even distribution over all bytes, which has learned nothing, takes 8.
MOST_BITS = 8.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass(frozen=True)
class Level:
    """Contexts of one length: ``grams`` (context and next byte, as sorted ints) with the whole
    lengths of that byte in each language, and ``contexts`` with the escapes of each language
    (0 where the language hasn't seen the context: it falls through)."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the sorted ``keys``, and the places of those."""
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[place] == wanted
    return hit, place[hit]


@dataclass(frozen=True)
class Model:
    """``levels[k]`` holds the contexts of k bytes; without a sample there are no languages."""

    langs: tuple[str, ...]
    levels: tuple[Level, ...]

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits of the whole text in each language; contexts before its start are zero bytes."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        padded = np.concatenate([np.zeros(ORDER, np.uint8), raw])
        total = np.zeros(len(self.langs))
        for at in range(0, len(raw), 1 << 16):  # blocks bound the memory, not the text
            x = padded[at : at + (1 << 16) + ORDER].astype(np.uint32)
            total += self._lengths((x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:])
        return total

    def _lengths(self, grams: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.langs))
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            grams = grams & np.uint32((1 << 8 * (order + 1)) - 1)
            hit, place = _found(level.grams, grams)
            total += level.bits.take(place, axis=0).sum(axis=0, dtype=np.float64)
            grams = grams[~hit]
            if not len(grams):
                return total
            _, place = _found(level.contexts, grams >> 8)
            total += level.escapes.take(place, axis=0).sum(axis=0, dtype=np.float64)
        return total + 8.0 * len(grams)


def partial_counts(sample: DataFrame) -> DataFrame:
    """lang, gram, n by task.

    The sample is bounded, so a few tasks count it, however many partitions it came in. Each keeps
    its counts to its end: it gives a gram once, not once a batch.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.Series] = {}
        for b in batches:
            for lang, part in b.groupby("lang"):
                grams = []
                for t in part["text"]:
                    x = np.concatenate([np.zeros(ORDER, np.uint8), np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)]).astype(np.int64)
                    grams.append((x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:])
                keys, n = np.unique(np.concatenate(grams), return_counts=True)
                new = pd.Series(n, index=keys)
                held[lang] = held[lang].add(new, fill_value=0).astype("int64") if lang in held else new
        for lang, counts in held.items():
            yield pd.DataFrame({"lang": lang, "gram": counts.index, "n": counts.to_numpy()})

    return sample.coalesce(SAMPLE_TASKS).mapInPandas(count, "lang string, gram long, n long")


def gram_counts(sample: DataFrame) -> DataFrame:
    """lang, gram (four bytes as an int), n: how often each byte follows each three-byte context."""
    return partial_counts(sample).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def hash_cell(h: Column) -> Column:
    """A number that never falls as the hash ``h`` rises: 64 cells for each doubling of the distance
    from the least hash, so 4096 at most, and of few rows wherever the smallest hashes end."""
    return F.floor(F.log2(F.greatest(h.cast("double") + F.lit(2.0**63), F.lit(1.0))) * 64)


def training_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """lang, text: of each language the ``sample_docs`` distinct texts with the smallest hashes.

    Only labelled documents that aren't held out count. Copies count once, so a language with any
    usable text is learned. The hashes are cut down within each partition (of the rows, so no
    copies gather); those left are counted by :func:`hash_cell`, and only the cells that hold a
    language's smallest ``sample_docs`` are ranked together, however many partitions there were.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & ~held_out(F.col("doc_id"))).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    keyed = usable.withColumn("h", F.xxhash64("text"))

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"lang": pd.Series(dtype=object), "h": pd.Series(dtype="int64")})
        for b in batches:
            kept = pd.concat([kept, b]).drop_duplicates().sort_values("h", kind="stable").groupby("lang").head(sample_docs)
        yield kept

    some = keyed.select("lang", "h").mapInPandas(smallest, "lang string, h long").distinct()
    some = written(some.withColumn("cell", hash_cell(F.col("h"))), "sample-hashes")
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = some.groupBy("lang", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    last = cells.where(F.col("before") < sample_docs).groupBy("lang").agg(F.max("cell").alias("last"))  # one row a language
    near = some.join(F.broadcast(last), "lang").where("cell <= last")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # at most sample_docs rows a language
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= sample_docs).select("lang", "h")

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, int]] = set()
        for b in batches:
            b = b[[k not in seen for k in zip(b["lang"], b["h"], strict=True)]].drop_duplicates(["lang", "h"])
            seen.update(zip(b["lang"], b["h"], strict=True))
            yield b

    few = keyed.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "text").mapInPandas(once, "lang string, h long, text string")
    return few.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on the sample; the driver gets its distinct four-byte counts, never a text.

    The tables grow with the sample's distinct four-byte strings times its languages, so with
    ``sample_docs`` and the number of languages, not with the corpus.
    """
    counts = gram_counts(training_sample(docs, sample_docs)).toPandas()
    langs = tuple(sorted(counts["lang"].unique()))
    if not langs:
        return Model((), ())
    grams, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    lang = np.searchsorted(np.array(langs, object), counts["lang"].to_numpy(object))
    levels: list[Level] = []
    for order in range(ORDER + 1):
        keys, row = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        c = np.bincount(row * len(langs) + lang, n, len(keys) * len(langs)).reshape(len(keys), len(langs))
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        starts = np.searchsorted(of, np.arange(len(contexts)))  # keys of one context follow each other
        total, distinct = np.add.reduceat(c, starts), np.add.reduceat(c > 0, starts, dtype=np.float64)
        below = 8.0
        if order:
            shorter = levels[-1]
            below = shorter.bits[np.searchsorted(shorter.grams, keys & ((1 << 8 * order) - 1))]
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            bits = np.where(c > 0, -np.log2(c / (total + distinct)[of]), escapes[of] + below)
        levels.append(Level(keys.astype(np.uint32), bits, contexts.astype(np.uint32), escapes.astype(np.float32)))
    return Model(langs, tuple(Level(x.grams, x.bits.astype(np.float32), x.contexts, x.escapes) for x in levels))


def language(text: Column, model: Model, spark: SparkSession) -> Column:
    """struct(lang, score, bits) of a text; only the text is looked at.

    ``score`` is the posterior of the language at even priors, ``bits`` the shortest code's bits a
    byte. A text that is null or has no letter, and any text if no language was learned, is
    ``und`` with score 0 and null bits.
    """
    shared = spark.sparkContext.broadcast(model)  # bounded by SAMPLE_DOCS texts a language

    @F.pandas_udf("lang string, score double, bits double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        rows = []
        for t in texts:
            if t is None or not m.langs:
                rows.append((UNDETERMINED, 0.0, None))
                continue
            lengths = m.code_lengths(t)
            best = int(lengths.argmin())
            score = 1.0 / np.exp2(np.maximum(lengths[best] - lengths, -1000.0)).sum()
            rows.append((m.langs[best], float(score), float(lengths[best]) / len(t.encode("utf-8", "surrogatepass"))))
        return pd.DataFrame(rows, columns=["lang", "score", "bits"])

    lettered = F.when(text.rlike("\\p{L}"), text)
    return predict(lettered)


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits: fit on the documents not held out, predict all.

    Defined cases: null and empty texts are ``und``; a null doc_id isn't held out; rows with a null
    lang are predicted, not learned from; repeated rows come back each; other columns are ignored;
    an empty table gives no rows.
    """
    found = language(F.col("text").cast("string"), fit(docs, sample_docs), docs.sparkSession)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("f")).select(
        "doc_id", "held_out", F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score"), F.col("f.bits").alias("bits")
    )


def known_language_only(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with all its columns, without the texts in no learned language.

    Those are ``und`` texts and texts whose shortest code takes over :data:`MOST_BITS` a byte.
    Defined cases: null, empty and letterless texts go; if no language was learned (no labelled
    text, an empty table) all go; null ids and null labels don't matter; repeated rows are judged
    each; no other column is looked at and none is changed.
    """
    found = language(F.col("text").cast("string"), fit(docs, sample_docs), docs.sparkSession)
    return docs.where(F.coalesce(found["bits"] <= MOST_BITS, F.lit(False)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).drop("bits")
