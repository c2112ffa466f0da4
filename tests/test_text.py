"""Examples for the text functions; each pair is an input and what it must become."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docflow.functions import text as fx
from docflow.operators import chunks


def applied(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


SENTENCES = [
    ("One. Two.", ["One.", "Two."]),
    ("Dr. Smith met Prof. Jones. They left.", ["Dr. Smith met Prof. Jones.", "They left."]),
    ("J. R. R. Tolkien wrote it. Yes.", ["J. R. R. Tolkien wrote it.", "Yes."]),
    ("It is 3.14 exactly. Next.", ["It is 3.14 exactly.", "Next."]),
    ("Cats, e.g. lions, roam. Dogs too.", ["Cats, e.g. lions, roam.", "Dogs too."]),
    ("Apples, pears, etc. Then home.", ["Apples, pears, etc. Then home."]),
    ('He said "stop." Then he left.', ['He said "stop."', "Then he left."]),
    ("Wait... What?! No!", ["Wait...", "What?!", "No!"]),
    ("Open main.js now. Done.", ["Open main.js now.", "Done."]),
    ("No final stop", ["No final stop"]),
    ("lower. case stays. Upper splits.", ["lower. case stays.", "Upper splits."]),
    ("", []),
    ("   ", []),
]


def test_sentences(spark):
    assert applied(spark, fx.split_sentences, [a for a, _ in SENTENCES]) == [b for _, b in SENTENCES]


def test_sentences_around_marks_and_spellings(spark):
    """White space goes with the end before it; marks of a text's own split it too, and are trimmed."""
    pairs = [
        ("\ufeff A.\u3000 B. ", ["A.\u3000 B."]), ("Ab.\u3000 \n7 b! (C", ["Ab.", "7 b!", "(C"]), ("a \x01 b. \x01\x01 C", ["a", "b.", "C"]),
        ("{1}. It. Xmr. It. MR. It. Sect. It. \u017f. It", ["{1}.", "It.", "Xmr.", "It.", "MR. It.", "Sect.", "It. \u017f.", "It"]), (None, None),
    ]
    assert applied(spark, fx.split_sentences, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_patterns_are_not_compiled_for_texts_without_their_sign(spark, capsys):
    """A split's pattern is compiled for each text, which for short ones took longer than the rest."""
    df = spark.createDataFrame([("A b. C",), ("A.\n \nB",), ("",), (None,)], "t string")
    made = df.select(fx.paragraphs(F.col("t")).alias("o"))
    assert [r.o for r in made.collect()] == [["A b. C"], ["A.", "B"], [], None]
    for each in (made, df.select(chunks.chunk_paragraph(F.col("t"), 9).alias("o"))):
        each.explain()
        assert "CASE WHEN NOT Contains(" in capsys.readouterr().out


def test_sentences_keep_every_character(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice(["Ab", "c", ". ", "! ", "? ", ", ", "Dr. ", "e.g. ", '"', ") ", " "]) for _ in range(60)) for _ in range(80)]
    for text, parts in zip(made, applied(spark, fx.split_sentences, made)):
        assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)


def test_page_numbers(spark):
    yes = ["42", "  7 ", "- 12 -", "Page 4", "page 4 of 40", "xiv", "mix"]
    no = ["Chapter 4 begins", "In 1945 the war ended", "A", "12345", ""]
    assert applied(spark, fx.is_page_number, yes + no) == [True] * len(yes) + [False] * len(no)


def test_markup(spark):
    html = ["<head><title>t</title></head><h1>One &amp; two</h1><p>a<br>b<script>x</p></script></p>", "A&nbsp;B &#65;&#x42; &unknown; &shy;x &#1114112; &#xD800;", "<p>&amp;lt;</p>"]
    assert applied(spark, fx.html_to_text, html) == ["One & two\n\na b", "A B AB &unknown; x &#1114112; &#xD800;", "&lt;"]
    md = "# Title\n\n- **bold** and _it_ [link](u)\n> quote\n```\ncode\n```\nend"
    assert applied(spark, fx.markdown_to_text, [md]) == ["Title\nbold and it link\nquote\n\nend"]


def test_titles_and_formats(spark):
    long = "word " * 30
    got = applied(spark, fx.chapter_title, ["Short  one", long, "x" * 80])
    assert got[0] == "Short one" and got[1].endswith("word…") and len(got[1]) <= 61 and got[2] == "x" * 60 + "…"
    assert applied(spark, lambda c: fx.format_chars(c.cast("int")), ["999", "1000", "12345", "1960"]) == ["999 chars", "1.0k chars", "12.3k chars", "2.0k chars"]
    assert applied(spark, lambda c: fx.format_time(c.cast("double")), ["0", "61.9", None]) == ["0:00", "1:01", "0:00"]
    assert applied(spark, fx.derive_title, ["a.b.pdf", "Algorithms Ch. 1", ".x"]) == ["a.b", "Algorithms Ch", ""]



def restated(tokens_in, n):
    """Chunks of a paragraph's sentences, step by step."""
    out, now = [], ""

    def flush():
        nonlocal now
        if now:
            out.append(now)
        now = ""

    def add(t):
        nonlocal now
        if now and len(now) + 1 + len(t) > n:
            flush()
        now = f"{now} {t}" if now else t

    for s in tokens_in:
        if len(s) <= n:
            add(s)
            continue
        flush()
        for part in re.split(r"(?<=[,;:])\s+", s):
            if len(part) <= n:
                add(part)
                continue
            flush()
            for w in re.split(r"\s+", part):
                if len(w) > n:
                    flush()
                    out.extend(w[i : i + n] for i in range(0, len(w), n))
                else:
                    add(w)
        flush()
    flush()
    return out


@pytest.mark.parametrize("n", [7, 30, 200])
def test_chunks_equal_a_restatement(spark, n):
    rng = random.Random(n)
    words = ["alpha", "be,", "gamma;", "d", "Epsilon.", "zeta!", "averyverylongtoken" * 3, "Eta:", "theta"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    sentences = applied(spark, fx.split_sentences, made)
    got = applied(spark, lambda c: chunks.chunk_paragraph(c, n), made)
    assert got == [restated(s, n) for s in sentences]
    assert all(len(c) <= n for cs in got for c in cs)


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "One. Two.\n\n  \nThree."), (2, None), (3, " ")], "doc_id long, text string")
    rows = chunks.chunk_text(docs, 5).orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.idx, r.text, r.char_count, r.paragraph_idx, r.ends_paragraph) for r in rows] == [
        (1, 0, "One.", 4, 0, False), (1, 1, "Two.", 4, 0, True), (1, 2, "Three", 5, 1, False), (1, 3, ".", 1, 1, True),
    ]
    with pytest.raises(ValueError):
        chunks.chunk_text(docs, 0)


def test_many_chunks_of_one_paragraph(spark):
    # several leaves, and ends on either side of a leaf's last chunk
    for words in (1, 255, 256, 257, 512, 513, 1500):
        text = " ".join(f"w{i}" for i in range(words))
        (got,) = applied(spark, lambda c: chunks.pack(F.transform(F.split(c, " "), lambda w: F.struct(w.alias("text"), F.lit(False).alias("fresh"), F.lit(False).alias("solo"))), 5), [text])
        assert got == restated([text], 5)
    tokens = "array<struct<text:string,fresh:boolean,solo:boolean>>"
    rows = spark.createDataFrame([(None,), ([],), ([("a", False, True), ("b", False, False), ("c", False, False), ("d", True, False)],)], f"t {tokens}")
    assert [r.o for r in rows.select(chunks.pack(F.col("t"), 9).alias("o")).collect()] == [None, [], ["a", "b c", "d"]]


def test_packing_folds_nothing_token_by_token(spark, capsys):
    """A struct a token was most of the time of small budgets; characters of one and two units alternate below."""
    text = "ab cd, " * 5_000 + "\U0001d4b3a" * 1_500 + " e"
    df = spark.createDataFrame([(text,)], "t string")
    for n in (5, 2000):
        made = df.select(chunks.chunk_paragraph(F.col("t"), n).alias("o"))
        assert made.first().o == restated([text], n)
        made.explain("extended")
        assert "aggregate(" not in capsys.readouterr().out
