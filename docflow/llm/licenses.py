"""Operator 10: license scan by a positional rare-token index (DataFrame functions only).

Texts are split once: of a file's words those of the templates' vocabulary are kept at their
places, the others are blanks, and this sparse form is written. Document frequencies over the
whole corpus come from it. The index holds, for the words of highest IDF in each template's
mandatory phrase, (word, template, place). A file's licence words, the rarest first, are looked up
in it: a template is reached only if the file holds all its rare words. The places of its rarest
word give the offsets at which it may stand, the postings of its other rare words are intersected
with them by relative position, and the mandatory phrase is verified word by word.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.shared import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words`` is the whole template, ``key`` the phrase in it that must stand word by word."""

    label: str
    words: str
    key: str
    base: bool = False

    @property
    def tokens(self) -> list[str]:
        return self.words.split()

    @property
    def at(self) -> int:
        """Position of the key phrase."""
        want = self.key.split()
        return next(i for i in range(len(self.tokens)) if self.tokens[i : i + len(want)] == want)


#: The phrases of the contract, then notices and openings of public licence texts.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
        "any person obtaining a copy of this software and associated documentation files",
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "you may not use this file except in compliance with the license",
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "under the terms of the gnu general public license",
    ),
    Template("gpl", "licensed under the gnu general public license version 3", "gnu general public license version"),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "gnu lesser general public license",
    ),
    Template(
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "gnu affero general public license",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms with or without modification",
    ),
    Template(
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "subject to the terms of the mozilla public license",
    ),
    Template("mpl", "licensed under the mozilla public license version 2", "mozilla public license version 2"),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software for any purpose",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        "free and unencumbered software released into the public domain",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "permission is granted to anyone to use this software for any purpose including commercial applications",
    ),
    Template(
        "boost",
        "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",
        "any person or organization obtaining a copy of the software and accompanying documentation",
    ),
    Template(
        "epl",
        "the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance",
        "under the terms of this eclipse public license",
    ),
    Template(
        "postgresql",
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
        "without fee and without a written agreement is hereby granted",
    ),
    Template("wtfpl", "do what the fuck you want to public license everyone is permitted to copy and distribute verbatim or modified copies", "do what the fuck you want to public license"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    Template("cc-by", "licensed under a creative commons attribution license", "creative commons attribution license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
)
#: Words of highest IDF of each key phrase that must agree on the offset (all of a shorter one).
RARE = 3


def license_words(text: Column) -> Column:
    """Words of the text with A-Z lowered: runs of 0-9, a-z and characters beyond ASCII."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BREAK), lambda w: w != "")


def sparse_words(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """doc_id, n_words, words: each word of the templates' vocabulary at its place, blanks between."""
    vocabulary = sorted({w for t in templates for w in t.tokens})
    words = F.transform(license_words(F.coalesce(F.col("text").cast("string"), F.lit(""))), lambda w: F.when(w.isin(*vocabulary), w).otherwise(""))
    return docs.select("doc_id", words.alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), "words")


def document_frequencies(words: DataFrame, templates: tuple[Template, ...]) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many each template word occurs (one count a word)."""
    in_file = F.array_union(F.array_distinct("words"), F.array(F.lit("")))  # the blank counts documents
    rows = words.select(F.explode(in_file).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r.w: r.n for r in rows}
    return counts.pop("", 0), {w: counts.get(w, 0) for t in templates for w in t.tokens}


def rare_words(key: list[str], idf: dict[str, float]) -> list[tuple[str, int]]:
    """(word, place) of a key phrase's words of highest IDF, the rarest first."""
    rarest = sorted(range(len(key)), key=lambda i: (-idf[key[i]], i))[:RARE]
    return [(key[i], i) for i in rarest]


#: ``own``: a file's indexed words, rarest first; ``f``: a template that all its rare words reach; ``p``: a place of its key phrase.
_HITS = """
transform(array(array_intersect({indexed}, words)), own -> flatten(transform(
  filter({forms}, f -> forall(f.rare, r -> array_contains(own, r.word))),
  f -> transform(
    filter(
      filter(transform(words, (w, i) -> CASE WHEN w = f.rare[0].word THEN i - f.rare[0].place END), p -> p >= 0),
      p -> forall(f.rare, r -> get(words, p + r.place) <=> r.word) AND slice(words, p + 1, size(f.key)) = f.key),
    p -> named_struct('template', f.template, 'start', p, 'label', f.label, 'base', f.base, 'score', least(1D, aggregate(
      transform(f.tokens, (t, j) -> CASE WHEN get(words, p - f.at + j) = t THEN get(f.idf, j) ELSE 0D END), 0D, (a, x) -> a + x) / f.mass))))))[0]
"""
_FORM = (
    "array<struct<template: int, label: string, base: boolean, key: array<string>, at: int, rare: array<struct<word: string, place: int>>, "
    "tokens: array<string>, idf: array<double>, mass: double>>"
)


def _constant(value: list, schema: str) -> str:
    """SQL for a constant, which the optimizer folds once."""
    quoted = json.dumps(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{quoted}', '{schema}')"


def template_index(templates: tuple[Template, ...], idf: dict[str, float]) -> tuple[list[str], list[dict]]:
    """The indexed words by falling IDF, and each template with its postings."""
    forms = []
    for n, t in enumerate(templates):
        key, own = t.key.split(), [idf[w] for w in t.tokens]
        rare = [{"word": w, "place": i} for w, i in rare_words(key, idf)]
        forms.append({"template": n, "label": t.label, "base": t.base, "key": key, "at": t.at, "rare": rare, "tokens": t.tokens, "idf": own, "mass": sum(own)})
    indexed = {r["word"] for f in forms for r in f["rare"]}
    return sorted(indexed, key=lambda w: (-idf[w], w)), forms


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and ``hits``: array of (template, start, label, base, score).

    ``start`` is the place of the key phrase's first word, words counted from 0; ``score`` is the
    share of the template's IDF mass that stands at its place. Every row of ``docs`` comes back
    once. Each row is decided for itself, so nothing but one count a template word is shuffled.
    Defined cases: a null text counts as empty; a null doc_id is kept; repeated rows are scanned
    each; other columns are ignored; an empty table gives no rows; texts are read whole.
    """
    words = written(sparse_words(docs, templates), "license-words")
    total, df = document_frequencies(words, templates)
    idf = {w: math.log((total + 1) / (n + 1)) + 1.0 for w, n in df.items()}
    indexed, forms = template_index(templates, idf)
    hits = F.expr(_HITS.format(indexed=_constant(indexed, "array<string>"), forms=_constant(forms, _FORM)))
    return words.select("doc_id", "n_words", hits.alias("hits"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["base"])
    labels = lambda hs: F.array_join(F.array_sort(F.array_distinct(F.transform(hs, lambda h: h["label"]))), ",")
    starts = F.transform(base, lambda h: h["start"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)), 6).alias("score"),
    )


def _oracle() -> str:
    def listed(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    rows = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {listed(t.tokens)}, {listed(t.key.split())}, {t.at})" for n, t in enumerate(TEMPLATES))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK}'), lambda w: w <> '') AS ws FROM documents),
templates(n, label, base, tokens, key, pos) AS (VALUES {rows}),
word AS (SELECT rid, i, ws[i] AS w, ws FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs)),
hits AS (SELECT rid, ws, i - 1 AS start, t.* FROM word JOIN templates t ON w = key[1] AND ws[i:i + len(key) - 1] = key),
df AS (SELECT w, count(DISTINCT rid) AS n FROM word GROUP BY w),
idf AS (SELECT v.w, ln(((SELECT count(*) FROM docs) + 1) / (coalesce(df.n, 0) + 1)) + 1.0 AS idf
  FROM (SELECT DISTINCT unnest(tokens) AS w FROM templates) v LEFT JOIN df ON v.w = df.w),
cells AS (SELECT rid, start, n, tokens[j] AS w, ws[start - pos + j] = tokens[j] AND start - pos + j >= 1 AS same
  FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS j FROM hits)),
scores AS (SELECT rid, max(s) AS score FROM (SELECT rid, start, n,
  least(1.0, sum(CASE WHEN same THEN idf ELSE 0 END) / sum(idf)) AS s
  FROM cells JOIN idf ON cells.w = idf.w GROUP BY rid, start, n) GROUP BY rid),
grouped AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
  max(start) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM docs LEFT JOIN grouped ON docs.rid = grouped.rid LEFT JOIN scores ON docs.rid = scores.rid
"""


ORACLE = _oracle()
