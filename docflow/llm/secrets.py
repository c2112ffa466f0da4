"""Operator 2: secret scan through a trigram inverted index (DataFrame functions only).

1. From each rule's regex a Boolean trigram query is derived: an OR of ANDs of trigrams that any
   match must contain (:func:`trigram_query`). A rule without mandatory trigrams scans fully.
2. The index holds, for every trigram of these queries, posting lists of the documents that
   contain it, cut into buckets by a hash of doc_id so that no list is unbounded.
3. Posting lists of a branch are intersected per bucket; what is left are candidates.
4. Candidates are verified by running the regex over the whole text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.shared import let, scanned, table, written

KEY_WORDS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"


@dataclass(frozen=True)
class Rule:
    """``regex`` is valid in Java, RE2 and Python alike; ``group`` must have ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The base kinds of the contract come first; the order breaks ties between spans.
RULES = (
    Rule("assign", KEY_WORDS + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "(?:ghp_|gho_|ghs_|ghu_|github_pat_)[A-Za-z0-9_]{30,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = ("assign", "access", "hex")
MAX_BRANCHES = 64
#: Up to so many candidates (8 bytes and a mask each) are broadcast; beyond, a shuffled join.
BROADCAST_CANDIDATES = 400_000
BUCKET_DOCS = 16_384


def _folded(op, arg) -> str | None:
    """The one lower-case character that this item must match, or None."""
    if op is sre.LITERAL:
        return chr(arg).lower() if arg < 128 else None
    if op is sre.IN and all(o is sre.LITERAL and a < 128 for o, a in arg):
        chars = {chr(a).lower() for _, a in arg}
        return chars.pop() if len(chars) == 1 else None
    return None


def _runs(items) -> list[tuple[str, ...]]:
    """Alternatives, each a tuple of literal runs that a match contains in this order."""
    alternatives: list[tuple[str, ...]] = [("",)]

    def glue(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
        return (*a[:-1], a[-1] + b[0], *b[1:])

    for op, arg in items:
        c = _folded(op, arg)
        if c is not None:
            more = [(c,)]
        elif op is sre.SUBPATTERN:
            more = _runs(arg[-1])
        elif op is sre.BRANCH:
            more = [a for branch in arg[1] for a in _runs(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[:2] == (0, 1) and len(arg[2]) == 1 and _folded(*arg[2][0]):
            more = [("",), (_folded(*arg[2][0]),)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            more = [(*a, "") for a in _runs(arg[2])] if arg[1] > 1 else _runs(arg[2])
        else:
            more = [("", "")]
        if len(alternatives) * len(more) > MAX_BRANCHES:
            more = [("", "")]
        alternatives = [glue(a, b) for a in alternatives for b in more]
    return alternatives


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams; None if some branch has no mandatory trigram."""
    branches = []
    for runs in _runs(sre_parser.parse(regex)):
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return None
        branches.append(grams)
    return sorted(set(branches), key=sorted)


def _key() -> Column:
    """What postings name a row by: a hash of id and text, so rows without an id don't gather."""
    return F.xxhash64("doc_id", "text")


def trigram_postings(docs: DataFrame, trigrams: list[str], n_buckets: int) -> DataFrame:
    """The inverted index: (trigram number, bucket, doc keys) for the given lower-case trigrams."""
    low = docs.select(_key().alias("key"), F.lower(F.col("text")).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return (
        low.select("key", F.explode(held).alias("trigram"))
        .groupBy("trigram", F.pmod("key", F.lit(n_buckets)).alias("bucket"))
        .agg(F.collect_set("key").alias("keys"))
    )


def candidates(postings: DataFrame, queries: dict[int, list[frozenset[str]]], trigrams: list[str]) -> DataFrame:
    """Doc keys with the mask of rules (bit = rule number) whose trigram query they satisfy."""
    number = {t: i for i, t in enumerate(trigrams)}
    branches = [(rule, grams) for rule, qs in queries.items() for grams in qs]
    of_trigram = F.array(
        *[F.array(*[F.lit(b) for b, (_, grams) in enumerate(branches) if t in grams]) for t in trigrams]
    )
    needed = F.array(*[F.lit(len(grams)) for _, grams in branches])
    mask = F.array(*[F.lit(1 << rule) for rule, _ in branches])
    assert len(number) == len(trigrams)
    lists = postings.withColumn("branch", F.explode(F.element_at(of_trigram, F.col("trigram") + 1))).groupBy("branch", "bucket").agg(F.collect_list("keys").alias("lists"))
    both = F.aggregate(
        F.slice("lists", 2, F.greatest(F.size("lists"), F.lit(1))), F.col("lists")[0], lambda a, b: F.array_intersect(a, b)
    )
    return (
        lists.where(F.size("lists") == F.element_at(needed, F.col("branch") + 1))
        .select(F.explode(both).alias("key"), F.element_at(mask, F.col("branch") + 1).alias("mask"))
        .groupBy("key")
        .agg(F.bit_or("mask").alias("mask"))
    )


_SPANS = "ARRAY<STRUCT<start: INT, kind: INT, `end`: INT, name: STRING, at: INT, `to`: INT>>"
_MATCHES = "ARRAY<STRUCT<gap: STRING, hit: STRING, word: STRING>>"


def matches_of(text: Column, rule: Rule) -> Column:
    """The rule's matches: array of the piece before each (gap), its text (hit) and its group (word)."""
    gaps = F.split(text, rule.regex, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    words = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("0"), hits.alias("1"), words.alias("2")).cast(_MATCHES)
    return F.when(text.rlike(rule.regex), zipped).otherwise(F.array().cast(_MATCHES))


def spans_of(matches: str, rule: Rule, order: int) -> str:
    """SQL for array<struct<start,kind,end,name,at,to>> of a column of :func:`matches_of`: start
    and end in code points, at and to in bytes.

    Java's regex functions give texts, not places; the lengths of the pieces between the matches
    and of the matches add up to the places.
    """
    upto = lambda size: scanned(f"transform(ms, m -> {size}(m.gap) + {size}(m.hit))", "{a} + {b}")
    place = "cast(get({0}, i) - {1}(m.hit) as int) as {2}, cast(get({0}, i) as int) as {3}"
    span = f"struct({place.format('ends', 'char_length', 'start', '`end`')}, {place.format('stops', 'octet_length', 'at', '`to`')})"
    kept = f"transform(ms, (m, i) -> CASE WHEN char_length(m.word) >= {rule.least} THEN {span} END)"
    each = f"transform(array_compact({let('ends', upto('char_length'), let('stops', upto('octet_length'), kept))}), s -> named_struct('start', s.start, 'kind', {order}, 'end', s.`end`, 'name', '{rule.kind}', 'at', s.at, 'to', s.`to`))"
    return let("ms", matches, f"CASE WHEN size(ms) = 0 THEN cast(array() as {_SPANS}) ELSE {each} END")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text and ``found`` of every row: all spans, sorted by start, then rule.

    Every row of ``docs`` comes back once. Defined cases: a null text counts as empty and has no
    spans; a null doc_id is kept; repeated rows (or ids) each get their own spans; other columns
    are ignored; an empty table gives no rows; texts are never cut.
    """
    return _scanned(docs, rules, ("doc_id",)).select("row.*", "text", "found")


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], keep: tuple[str, ...]) -> DataFrame:
    """``row`` (a struct of the columns ``keep``, whatever their names), text and found."""
    base = docs.select("doc_id", F.struct(*keep).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.regex)) is not None}
    if queries:
        trigrams = sorted({t for q in queries.values() for grams in q for t in grams})
        n_buckets = max(8, base.count() // BUCKET_DOCS)
        postings = written(trigram_postings(base, trigrams, n_buckets), "trigram-index")
        hits = written(candidates(postings, queries, trigrams), "secret-candidates")
        side = hits.select(F.col("key").alias("c_key"), F.col("mask").alias("c_mask"))
        side = F.broadcast(side) if hits.count() <= BROADCAST_CANDIDATES else side.hint("merge")
        base = base.join(side, _key() == F.col("c_key"), "left")
    else:
        base = base.withColumn("c_mask", F.lit(0))
    mask = F.coalesce(F.col("c_mask"), F.lit(0))
    none = F.array().cast(_MATCHES)
    matches = []
    for i, rule in enumerate(rules):
        own = matches_of(F.col("text"), rule)
        matches.append((F.when(mask.bitwiseAND(1 << i) != 0, own).otherwise(none) if i in queries else own).alias(f"m{i}"))
    spans = [spans_of(f"m{i}", rule, i) for i, rule in enumerate(rules)]
    return base.select("row", "text", *matches).select("row", "text", F.expr(f"array_sort(concat({', '.join(spans)}))").alias("found"))


def redacted(text: str = "text", found: str = "found") -> Column:
    """``text`` with every span of ``found`` (sorted by start) replaced by <kind>; overlaps merge.

    The pieces between the spans are cut out of the text's bytes, so each costs its own length.
    """
    cut = "cast(substring(raw, cast({0} + 1 as int), cast(greatest({1} - {0}, 0L) as int)) as string)"
    before = "coalesce(get(reach, {0} - 1), 0L)"
    label = f"CASE WHEN s.at >= {before.format('i')} THEN concat('<', s.name, '>') ELSE '' END"
    parts = f"transform({found}, (s, i) -> concat({cut.format(before.format('i'), 's.at')}, {label}))"
    rest = cut.format(before.format("size(reach)"), "octet_length(raw)")
    reach = scanned(f"transform({found}, s -> s.`to`)", "greatest({a}, {b})")
    whole = let("raw", f"cast({text} as binary)", let("reach", reach, f"concat(array_join({parts}, ''), {rest})"))
    return F.expr(f"CASE WHEN size({found}) = 0 THEN {text} ELSE {whole} END")


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with all its columns, each secret in the text replaced by its <kind>.

    A column n_chars, if there is one, follows the new text. Defined cases: a null text becomes
    empty; rows with a null or repeated doc_id, and repeated rows, are masked each by their own
    text; every row stays; other columns are not changed, whatever their names; an empty table
    gives no rows; texts are masked whole.
    """
    others = [c for c in docs.columns if c != "text"]
    clean = _scanned(docs, rules, tuple(others)).select("row", redacted().alias("text"))
    out = {c: F.col("row")[c] for c in others} | {"text": F.col("text")}
    if "n_chars" in others:
        out["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[out[c].alias(c) for c in docs.columns])


def _number(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["name"] == kind)).cast("long")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(table(spark, sf_dir, "documents"))
    number = [_number(k).alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("found", lambda s: s["name"].isin(*BASE_KINDS))
    return scanned.drop("text").select(
        "doc_id", *number, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans")
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _oracle() -> str:
    parts = [
        f"SELECT doc_id, text, {i} AS ord, '{r.kind}' AS kind, {r.least} AS least, "
        f"string_split_regex(text, {_quoted(r.regex)}) AS pieces, regexp_extract_all(text, {_quoted(r.regex)}, 0) AS hits, "
        f"regexp_extract_all(text, {_quoted(r.regex)}, {r.group}) AS words FROM docs WHERE regexp_matches(text, {_quoted(r.regex)})"
        for i, r in enumerate(RULES)
    ]
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each AS (SELECT doc_id, ord, kind, least, i, length(pieces[i]) AS gap, length(hits[i]) AS n, length(words[i]) AS w
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found)),
placed AS (SELECT doc_id, ord, kind, w >= least AS ok, n,
  sum(gap + n) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop FROM each),
spans AS (SELECT doc_id, ord, kind, CAST(stop - n AS BIGINT) AS start,
  kind || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s FROM placed WHERE ok),
grouped AS (SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access,
  count(*) FILTER (WHERE ord = 2) AS n_hex,
  coalesce(string_agg(s, ',' ORDER BY start, ord) FILTER (WHERE ord < 3), '') AS base,
  string_agg(s, ',' ORDER BY start, ord) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN grouped g ON d.doc_id = g.doc_id
"""


ORACLE = _oracle()
