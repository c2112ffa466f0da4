"""Paragraphs, sentences, and chunks within a budget of characters; one row in, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import WS, let, paragraphs, split_at, split_sentences

DEFAULT_MAX_CHARS = 2000
#: Between two tokens, and where the next one starts a chunk. Sentences are split at it, so no token holds it.
TOKEN = "\x01"
APART = TOKEN * 2


def split_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, paragraph_idx from 0, paragraph."""
    return docs.select(key, F.posexplode(paragraphs(F.col(text))).alias("paragraph_idx", "paragraph"))


def _oversized(sentence: Column, n: int) -> Column:
    """A sentence over the budget with its marks: clauses, else words, else pieces of a word."""

    def words(fragment: Column) -> Column:
        apart = F.concat(F.lit(APART), F.regexp_replace(fragment, f"[{WS}]+", TOKEN))
        long = F.regexp_replace(apart, f"(?<![^{TOKEN}])[^{TOKEN}]{{{n + 1},}}+", f"{TOKEN}$0{TOKEN}")
        return F.regexp_replace(long, f"(?:(?<![^{TOKEN}])|\\G)[^{TOKEN}]{{{n}}}+(?=[^{TOKEN}])", f"$0{APART}")

    fragments = F.split(F.regexp_replace(sentence, f"([,;:])[{WS}]+", f"$1{TOKEN}"), TOKEN)
    return F.array_join(F.transform(fragments, lambda f: F.when(F.length(f) > n, words(f)).otherwise(f)), TOKEN)


def marked_tokens(sentences: Column, n: int) -> Column:
    """Sentences as tokens that packing joins in order, ``TOKEN`` between two and ``APART`` where a chunk starts."""
    each = F.transform(sentences, lambda s: F.when(F.length(s) > n, F.concat(F.lit(APART), _oversized(s, n), F.lit(APART))).otherwise(s))
    return F.array_join(each, TOKEN)


def pack_marked(marked: Column, n: int) -> Column:
    """Greedy chunks: tokens joined by a space while they fit into ``n`` characters; a longer one stays alone.

    A chunk is the longest match of up to ``n`` characters that ends with a token, so regexes walk
    through a text once and no row is made for a token. Null gives null, no tokens give no chunks.
    """
    chunk = f"[^{TOKEN}](?s:.{{0,{n - 1}}})(?<!{TOKEN})(?=[{TOKEN}]|\\z)|[^{TOKEN}]++"
    runs = F.transform(split_at(marked, APART, f"{APART}+"), lambda run: F.regexp_extract_all(run, F.lit(chunk), F.lit(0)))
    return F.transform(F.flatten(runs), lambda c: F.replace(c, F.lit(TOKEN), F.lit(" ")))


def pack(tokens: Column, n: int) -> Column:
    """As :func:`pack_marked`, of structs (text: not empty, without ``TOKEN``; fresh: starts a chunk; solo: is one)."""

    def mark(t: Column) -> Column:
        before = F.when(t["fresh"] | t["solo"], APART).otherwise("")
        return F.concat(before, t["text"], F.when(t["solo"], APART).otherwise(""))

    return pack_marked(F.array_join(F.transform(tokens, mark), TOKEN), n)


def chunk_paragraph(paragraph: Column, n: int, trimmed: bool = False) -> Column:
    return pack_marked(marked_tokens(split_sentences(paragraph, trimmed), n), n)


def chunk_text(docs: DataFrame, max_chars: int = DEFAULT_MAX_CHARS, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """key, idx over the document, text, char_count, paragraph_idx, ends_paragraph.

    A document without words (a null text too) has no rows, or with ``outer`` one of nulls.
    """
    if not isinstance(max_chars, int) or max_chars < 1:
        raise ValueError(f"max_chars must be a positive whole number, not {max_chars!r}")

    def numbered(p: Column, i: Column) -> Column:
        def rows(parts: Column) -> Column:
            return F.transform(parts, lambda t, k: F.struct(t.alias("text"), i.alias("paragraph_idx"), (k == F.size(parts) - 1).alias("ends_paragraph")))

        return let(chunk_paragraph(p, max_chars, trimmed=True), rows)

    chunks = F.flatten(F.transform(paragraphs(F.col(text)), numbered))
    explode = F.posexplode_outer if outer else F.posexplode
    return docs.select(key, *keep, explode(chunks).alias("idx", "c")).select(
        key, *keep, "idx", "c.text", F.length("c.text").alias("char_count"), "c.paragraph_idx", "c.ends_paragraph"
    )
