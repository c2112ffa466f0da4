"""Operator 8: quality rules as a short-circuit cascade (DataFrame functions only).

Each rule reads measures of the text that it needs and rejects or passes. On a bounded sample the
cascade estimates every rule's rejection rate and cost beyond what is there anyway (the words, the
lines and the measures asked for), then orders the rules by rejection per cost; a document leaves
at the first rule that rejects it, so the measures of later rules are not computed for it. The
order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.shared import WORD_BREAK, table

WINDOW = 5
#: Documents (about) in the sample on which costs and selectivities are estimated.
SAMPLE_DOCS = 2000


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_BREAK))


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, first ones included.

    Words are hashed once and windows by their words' hashes; only a text in which two hashes are equal pays for sorting the (hash,
    place) pairs, which puts equal windows side by side: n log n for any text.
    """

    def windows(ws: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ws) - WINDOW)
        hashed = F.transform(ws, lambda w: F.xxhash64(w))
        return _let(hashed, lambda hs: F.transform(places, lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(WINDOW)])))[0]

    def doubled(pairs: Column) -> Column:
        return F.filter(
            pairs, lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])) | (F.get(pairs, i + 1)["h"] == x["h"])
        )

    def covered(hs: Column) -> Column:
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        at = F.array_sort(F.transform(F.flatten(_let(pairs, doubled)), lambda x: x["at"]))
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(
                (i + WINDOW).alias("upto"), (acc["n"] + (i + WINDOW - F.greatest(acc["upto"], i)).cast("long")).alias("n")
            ),
            lambda acc: acc["n"],
        )

    zero = F.lit(0).cast("long")

    def counted(hs: Column) -> Column:
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), zero).otherwise(covered(hs))

    # everything is bound inside the expression: a filter on the result, which Spark moves below
    # the projection that splits the words, would else split them again for each window
    return _let(words, lambda ws: F.when(F.size(ws) <= WINDOW, zero).otherwise(_let(windows(ws), counted)[0]))[0]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """array(use(value)) with ``value`` computed once."""
    return F.transform(F.array(value), use)


BULLET = "^[ \\t]*(?:[-*+•]|[0-9]+[.)])[ \\t]"
OPEN_END = "(?:\\.\\.\\.|…)[ \\t\\r]*\\z"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A text with fewer letters a to z has no entropy to speak of (nor has one in another script).
LEAST_LETTERS = 200


def letter_bits(text: Column) -> Column:
    """Entropy of the letters a to z, case folded; null for a text with few of them."""
    letters = F.lit(list(LETTERS))

    def counts(low: Column) -> Column:
        return F.transform(letters, lambda c: F.char_length(low) - F.char_length(F.replace(low, c, F.lit(""))))

    def bits(cs: Column) -> Column:
        n = F.aggregate(cs, F.lit(0), lambda a, c: a + c)
        inner = F.aggregate(cs, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0)))
        return F.when(n >= LEAST_LETTERS, F.log2(n) - inner / n)

    return _let(_let(F.translate(text, LETTERS.upper(), LETTERS), counts)[0], bits)[0]


#: Measures by name, each from the columns that :func:`prepared` gives.
MEASURES: dict[str, Callable[[], Column]] = {
    "n_words": lambda: F.size("words").cast("long"),
    "word_chars": lambda: F.char_length(F.regexp_replace("text", WORD_BREAK, "")).cast("long"),
    "n_symbols": lambda: F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long"),
    "n_dup_lines": lambda: (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    "n_repeat_words": lambda: repeat_words(F.col("words")),
    "n_lines": lambda: F.size("lines").cast("long"),
    "n_letter_words": lambda: F.size(F.filter("words", lambda w: w.rlike("[A-Za-z]|[^\\x00-\\x7F]"))).cast("long"),
    "n_long_words": lambda: F.size(F.filter("words", lambda w: F.char_length(w) > 60)).cast("long"),
    "n_bullets": lambda: F.size(F.filter("lines", lambda x: x.rlike(BULLET))).cast("long"),
    "n_open_ends": lambda: F.size(F.filter("lines", lambda x: x.rlike(OPEN_END))).cast("long"),
    "letter_bits": lambda: letter_bits(F.col("text")),
}
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a condition from the measures it ``needs``; ``sql`` says the same."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]
    sql: str


#: Thresholds leave room for short notes and lists: clean prose is far from all of them.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10, "n_words < 10"),
    Rule("repetition", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 20 * n, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > 5 * n, "10 * n_symbols > 5 * n_words"),
    Rule("same_lines", ("n_lines", "n_dup_lines"), lambda n, d: 10 * d > 3 * n, "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 20 * n), "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("no_letters", ("n_words", "n_letter_words"), lambda n, w: 2 * w < n, "2 * n_letter_words < n_words"),
    Rule("long_words", ("n_words", "n_long_words"), lambda n, w: 5 * w > n, "5 * n_long_words > n_words"),
    Rule("bullets", ("n_lines", "n_bullets"), lambda n, b: (n >= 5) & (10 * b > 9 * n), "n_lines >= 5 AND 10 * n_bullets > 9 * n_lines"),
    Rule("open_ends", ("n_lines", "n_open_ends"), lambda n, e: (n >= 3) & (2 * e > n), "n_lines >= 3 AND 2 * n_open_ends > n_lines"),
    Rule("few_letters", ("letter_bits",), lambda h: F.coalesce(h < 2.0, F.lit(False)), "coalesce(letter_bits < 2.0, false)"),
)
BASE_RULES = ("few_words", "repetition")


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejected: float
    seconds: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), its words and its lines with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("*", words_of(F.col("text")).alias("words"), lines_of(F.col("text")).alias("lines"))


def measured(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.select("*", *[MEASURES[n]().alias(n) for n in names])


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_docs: int = SAMPLE_DOCS, have: tuple[str, ...] = ()) -> list[Estimate]:
    """Rejection rate and seconds of each rule on about ``sample_docs`` documents, best gain first.

    The sample is drawn by a hash of the row, so it doesn't depend on the partitioning; only its
    counts come to the driver. It is kept prepared, with the measures ``have``, so a rule's seconds
    are those of its own measures: the time of its count less that of a count without a rule.
    """
    share = min(1.0, sample_docs / max(docs.count(), 1))
    below = min(int((2 * share - 1) * 2**63), 2**63 - 1)
    drawn = docs.where(F.xxhash64("doc_id", "text") <= below).select("doc_id", "text").coalesce(8)
    sample = measured(prepared(drawn), have).cache()
    rows = sample.count()

    def counted(condition: Column) -> tuple[int, float]:
        began = time.monotonic()
        bad = sample.where(condition).count()
        return bad, time.monotonic() - began

    _, idle = counted(F.size("words") < 0)
    found = []
    for rule in rules:
        bad, seconds = counted(_rejects(rule, have))
        found.append(Estimate(rule, bad / max(rows, 1), max(seconds - idle, 0.0)))
    sample.unpersist()
    return sorted(found, key=lambda e: (-e.gain, e.seconds, e.rule.name))


def _rejects(rule: Rule, have: tuple[str, ...]) -> Column:
    return rule.rejects(*[F.col(n) if n in have else MEASURES[n]() for n in rule.needs])


def verdict(order: list[Rule], have: tuple[str, ...]) -> Column:
    """Name of the first rule that rejects, in this order, else null.

    A measure that is a column already (``have``) is used as it is; another is written into the
    branch of the rule that needs it, so only documents that come so far pay for it.
    """
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(_rejects(rule, have), F.lit(rule.name)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_docs: int = SAMPLE_DOCS, measures: tuple[str, ...] = BASE_MEASURES) -> DataFrame:
    """doc_id, the asked ``measures``, ``rejected_by`` (first rule of the cascade, else null), kept.

    Defined cases: a null or empty text has no words, all measures are 0 and ``few_words`` rejects
    it; a null doc_id is kept; repeated rows are judged each; other columns are ignored; an empty
    table gives no rows; texts are measured whole.
    """
    order = [e.rule for e in estimate(docs, rules, sample_docs, measures)]
    out = measured(prepared(docs), measures)
    return out.select("doc_id", *measures, verdict(order, measures).alias("rejected_by")).withColumn("kept", F.col("rejected_by").isNull())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = apply_rules(table(spark, sf_dir, "documents"))
    failed = " OR ".join(f"({r.sql})" for r in RULES if r.name in BASE_RULES)
    return ruled.select("doc_id", *BASE_MEASURES, F.expr(failed).alias("base_failed"), "kept")


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^ \\t-\\r]+') AS words FROM docs),
wins AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5)),
dups AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM wins) WHERE c >= 2),
cover AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dups) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
liney AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup,
  count(*) FILTER (WHERE regexp_matches(line, '{BULLET}')) AS n_bullets, count(*) FILTER (WHERE regexp_matches(line, '{OPEN_END}')) AS n_open_ends FROM lines
  WHERE regexp_matches(line, '[^ \\t-\\r]') GROUP BY rid),
m AS (SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[ \\t-\\r]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_open_ends, 0) AS n_open_ends,
  len(list_filter(words, lambda w: regexp_matches(w, '[A-Za-z]|[^\\x00-\\x7F]'))) AS n_letter_words, len(list_filter(words, lambda w: length(w) > 60)) AS n_long_words,
  (SELECT CASE WHEN sum(c) >= {LEAST_LETTERS} THEN log2(sum(c)) - sum(CASE WHEN c > 0 THEN c * log2(c) ELSE 0 END) / sum(c) END
    FROM (SELECT unnest(list_transform(string_split('{LETTERS}', ''), lambda x: length(text) - length(replace(translate(text, '{LETTERS.upper()}', '{LETTERS}'), x, '')))) AS c)) AS letter_bits
  FROM split s LEFT JOIN cover c ON s.rid = c.rid LEFT JOIN liney l ON s.rid = l.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {" OR ".join(f"({r.sql})" for r in RULES if r.name in BASE_RULES)} AS base_failed,
  NOT ({" OR ".join(f"({r.sql})" for r in RULES)}) AS kept
FROM m
"""
