"""Operators 3, 4, 5, 6, 7, 9 and the pipeline against brute force, round trips and held-out data."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docflow.llm import decontamination, html, language, pieces, simhash, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, ids string, _x string"
DIR = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n a", "é", "a" * 5000, "word " * 3000, "x\ty\x0bz\r\n", "▁ mark ▁▁", "日本語 العربية 😀"]


def table(spark, texts, ids=None, langs=None):
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else None, "s", len(t or ""), "f", "i", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


# ---------------------------------------------------------------- operator 3
def test_language_on_held_out_documents(docs):
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert found and sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in found)


def test_counting_the_sample_does_not_grow_with_its_partitions(spark):
    sample = spark.createDataFrame([("A", "one same text")] * 300, "lang string, text string").repartition(60)
    rows = language.partial_counts(sample)
    assert rows.count() <= language.SAMPLE_TASKS * 13  # thirteen places, so as many grams a task at most
    assert rows.agg(F.sum("n")).first()[0] == 300 * 13


def test_code_lengths_by_definition(spark):
    own = ["".join(chr(c) for c in range(start, start + 200)) for start in (0x400, 0x4E00)]  # more than 128 byte values
    texts = ["abababababac" + own[0], "xyzxyzxyzx" + own[1], "abab xyz"]
    df = table(spark, texts * 8, langs=(["A", "B", None] * 8))
    model = language.fit(df, sample_docs=1000)
    grams = {r: {} for r in model.langs}
    for r in language.gram_counts(language.training_sample(df, 1000)).collect():
        grams[r.lang][r.gram.to_bytes(4, "big")] = r.n

    def bits(lang, context, byte):
        for k in range(len(context) + 1):
            tail = context[k:]
            c = {}
            for g, n in grams[lang].items():
                if g[:3].endswith(tail):
                    c[g[3]] = c.get(g[3], 0) + n
            total, d = sum(c.values()), len(c)
            if byte in c:
                return bits.escaped - np.log2(c[byte] / (total + d))
            if total:
                bits.escaped -= np.log2(d / (total + d))
        return bits.escaped + 8

    for text in ["abac", "xyab", "zzzz", own[0][40:80] + own[1][3:50] + "ab", "\t~ unseen"]:
        padded = b"\0\0\0" + text.encode()
        for k, lang in enumerate(model.langs):
            expected = 0.0
            for i in range(3, len(padded)):
                bits.escaped = 0.0
                expected += bits(lang, padded[i - 3 : i], padded[i])
            assert model.code_lengths(text)[k] == pytest.approx(expected, rel=1e-4)


def test_a_language_of_a_few_hot_texts_is_learned(spark):
    hot = ["uno dos tres cuatro", "cinco seis siete ocho", "nueve diez once doce"]
    texts = [f"the cat {i} sat on the mat {i * i}" for i in range(300)] + [hot[i % 3] for i in range(600)]
    df = table(spark, texts, langs=["en"] * 300 + ["es"] * 600).repartition(5)
    got = [(r.lang, r.text) for r in language.training_sample(df, 20).collect()]
    assert sorted(t for lang, t in got if lang == "es") == sorted(hot)
    assert len({t for lang, t in got if lang == "en"}) == 20 and len(got) == 23
    found = language.identify(df, 20).where("doc_id >= 300").groupBy("lang_pred").count().collect()
    assert [(r.lang_pred, r["count"]) for r in found] == [("es", 600)]


def test_many_copies_of_one_text_push_no_text_out(spark):
    texts = ["the very same english words again"] * 20_000 + [f"the cat {i} sat on the mat {i * i}" for i in range(200)] + [f"el gato {i} se sienta {i * i}" for i in range(50)]
    df = table(spark, texts, langs=["en"] * 20_200 + ["es"] * 50)
    got = [(r.lang, r.text) for r in language.training_sample(df, 100).collect()]
    usable = {(lang, t) for i, (lang, t) in enumerate(zip(["en"] * 20_200 + ["es"] * 50, texts, strict=True)) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(got) == len(set(got)) and set(got) <= usable
    assert sum(lang == "en" for lang, _ in got) == 100 and {t for lang, t in got if lang == "es"} == {t for lang, t in usable if lang == "es"}


def test_the_sample_has_the_smallest_hashes(spark):
    texts = [f"{w} {i % 400}" for i in range(2000) for w in ("one", "uno")]
    df = table(spark, texts, langs=["en", "es"] * 2000).repartition(7)
    hashed = df.where(~language.held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("text").alias("h")).distinct().collect()
    for most in (1, 30, 1000):
        expected = {(r.lang, r.text) for lang in ("en", "es") for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: r.h)[:most]}
        got = [(r.lang, r.text) for r in language.training_sample(df, most).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    edges = [-(2**63), -(2**63) + 1, -(2**63) + 5000, -(2**62), -1, 0, 1, 2**62, 2**63 - 1]
    cells = [r.c for r in spark.createDataFrame([(e,) for e in edges], "h long").select("h", language.hash_cell(F.col("h")).alias("c")).orderBy("h").collect()]
    assert None not in cells and cells == sorted(cells) and 0 <= cells[0] and cells[-1] <= 4096


def test_language_of_odd_tables(spark):
    got = {r.doc_id: r for r in language.identify(table(spark, ODD)).collect()}
    assert len(got) == len(ODD) and all(r.lang_pred == "und" and r.score == 0 for r in got.values())
    assert language.identify(table(spark, [])).count() == 0
    df = table(spark, [*ODD, *["the cat and the dog"] * 9], langs=[None] * len(ODD) + ["en"] * 9)
    kept = language.known_language_only(df)
    assert kept.columns == df.columns and {r.text for r in kept.collect()} >= {"the cat and the dog"}
    assert not {None, "", " "} & {r.text for r in kept.collect()}


# ---------------------------------------------------------------- operator 4
def test_token_tables_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = [*ODD, "it's Élan's CAFÉ, naïve... a.b,c <|endoftext|>x 12,3 İ ΣΑΣ", "dup", "dup"]
    ids = [*range(len(texts) - 1), None]
    df = table(spark, texts, ids)
    rows = tokens.read_tokens(tokens.write_tokens(df, path, block_tokens=50), with_ids=True).collect()
    assert len(rows) == len(texts)
    at = 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id)):
        text = texts[-1] if r.doc_id is None else texts[r.doc_id]
        expected = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, list(r.ids)) == (at, len(expected), expected), text
        assert r.ids_crc32 == zlib.crc32(np.array(expected, "<u4").tobytes())
        at += len(expected)
    assert tokens.read_tokens(tokens.write_tokens(table(spark, []), path)).count() == 0


def test_line_breaks_and_tabs_that_come_again(spark):
    """Pieces without any id (a lone return, tab or control) are as good as others, batch after batch."""
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = [f"one {i % 7}\r\n\r\ntwo \t \t \x0b \x1f\x1f end\r\n\r\n" for i in range(4000)]
    df = table(spark, texts).repartition(1)
    rows = tokens.read_tokens(tokens.write_tokens(df, path), with_ids=True).collect()
    expected = {t: [*whole.encode(t, add_special_tokens=False).ids, 1] for t in set(texts)}
    assert len(rows) == 4000 and all(list(r.ids) == expected[texts[r.doc_id]] for r in rows)


def test_single_documents_are_read_through_select(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    blocks = tokens.write_tokens(table(spark, [f"text {i} of words" for i in range(900)] + [None], [*range(899), None, 7]), path, block_tokens=1500)
    everything = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(blocks).collect()}
    some = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(blocks, doc_ids=[7, 500, 898, 12345]).collect()}
    assert some == {r for r in everything if r[0] in (7, 500, 898)} and len(some) == 4 and len(everything) == 901
    assert tokens.read_tokens(blocks, doc_ids=[]).count() == 0


def test_other_tokenizer_files_are_encoded_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.WordEncoder.fits(public_tokenizers.path("word_bpe_49k.json")) and not tokens.WordEncoder.fits(path)
    rows = tokens.read_tokens(tokens.write_tokens(table(spark, ODD), path), with_ids=True).collect()
    whole = Tokenizer.from_file(path)
    assert all(list(r.ids) == [*whole.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids, 1] for r in rows)


FAR = 2**53 + 1


def test_ids_next_to_a_null_keep_their_bits(spark):
    df = table(spark, ["a b", "c d e", "f", "g"], [FAR, None, FAR + 2, -FAR]).coalesce(1)
    wanted = {FAR, None, FAR + 2, -FAR}
    assert {r.doc_id for r in simhash.near_duplicates(df).collect()} == wanted == {r.component_id for r in simhash.near_duplicates(df).collect()}
    word, piece = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert {r.doc_id for r in tokens.read_tokens(tokens.write_tokens(df, word)).collect()} == wanted
    assert {r.doc_id for r in pieces.encode_pieces(df, piece).collect()} == wanted
    pages = df.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")
    assert {r.page_id for r in html.extract_pages(pages).collect()} == wanted


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 0, 1, 10**6], list(range(0, 9000, 7))])
def test_elias_fano(values):
    e = tokens.EliasFano.of(np.array(values))
    assert e.decode().tolist() == values and [e.select(i) for i in range(len(values))] == values
    assert [v for j in range(-(-len(values) // tokens.SAMPLE)) for v in e.run(j).tolist()] == values
    if len(values) > 1000:
        assert 8 * (len(e.low) + len(e.high) + len(e.ones)) < 8 * len(values)


# ---------------------------------------------------------------- operator 5
def test_pieces_without_dropout_are_the_library_s():
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in ODD if t and "▁" not in t] + ["  lead", "a  b \n c", "'''\"\" 0123", "tail  "]
    coded = pieces.PieceCodec(path, dropout=0.0).encode(texts, [0] * len(texts))
    assert [c.tolist() for c in coded] == sp.encode(texts)


def test_pieces_vary_and_decode(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = table(spark, [*ODD, "internationalization of representations", "internationalization of representations"])
    runs = [pieces.encode_pieces(df, path, seed=s).collect() for s in (1, 1, 2, 3)]
    assert [tuple(r.ids) for r in sorted(runs[0])] == [tuple(r.ids) for r in sorted(runs[1])]
    assert len({tuple(next(r.ids for r in run if r.doc_id == len(ODD))) for run in runs}) > 1
    assert all(r.lossless for run in runs for r in run)
    back = {r.doc_id: r.text for r in pieces.decode_pieces(pieces.encode_pieces(df, path), path).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))


def test_each_occurrence_draws_for_itself():
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec = pieces.PieceCodec(path, dropout=0.3)
    text = "internationalization of the representation " * 400 + "ééé😀 xyz. 日本 " + "a" * 39 + " " + "the" * 30 + " \n\n  of"
    (ids,) = codec.encode([text], [17])
    words = pieces.TOKEN.findall(" " + text)
    keys = pieces._occurrences(17 ^ codec.seed * pieces.MIX, len(words))
    single = [codec.agenda(w, int(k)) for w, k in zip(words, keys, strict=True)]
    assert ids.tolist() == [i for one in single for i in one]  # the matrix equals the heap
    forms = {tuple(one) for one, w in zip(single, words, strict=True) if w == " internationalization"}
    assert len(forms) > 50 and len({tuple(one) for one, w in zip(single, words, strict=True) if w == " the"}) > 2
    again, other = codec.encode([text, text], [17, 18])
    assert again.tolist() == ids.tolist() != other.tolist() and codec.decode(other.tolist()) == text


def test_dropout_rate_is_that_of_the_candidates():
    keys = pieces._occurrences(5, 200_000)
    share = (pieces._draw(keys, np.full(len(keys), 3 << 40 | 300 << 20 | 400, np.uint64)) < int(0.1 * (1 << 24))).mean()
    assert abs(share - 0.1) < 0.005
    assert [int(x) for x in pieces._draw(keys[:50], np.arange(50, dtype=np.uint64))] == [pieces._draw_one(int(k), i) for i, k in enumerate(keys[:50])]


# ---------------------------------------------------------------- operator 6
def held(part, words, width):
    """Best share of the part's shingles over all windows of ``width`` words, by definition."""
    want = decontamination.words_of(part)
    if not want:
        return 1.0
    k = min(5, len(want))
    grams = lambda ws: {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
    return max((len(grams(want) & grams(words[s : s + width])) / len(grams(want)) for s in range(max(1, len(words) - width + 1))), default=0.0)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(rng.randint(3, 40)) + ". " + say(rng.randint(1, 9)) + "." for _ in range(40)] + [None, "", "one two", "q only " * 6, "w1 w2 w3 w4 w5 w6 w7 w8 w9. w3"]
    texts = []
    for _ in range(100):
        item = rng.choice(items[:40])
        own = item.split(" ")
        if rng.random() < 0.5:
            own[rng.randrange(len(own))] = "changed"
        if rng.random() < 0.4:  # question and answer apart, at any offset from the passages' bounds
            question, answer = decontamination.question_and_answer(item)
            own = [question, say(rng.randint(20, 150)), answer]
        texts.append(say(rng.randint(0, 300)) + " " + " ".join(own) + " " + say(rng.randint(0, 200)))
    texts += [*ODD, "one two", "w1 w2 w3 w4 w5 w6 w7 w8 w9", "q only " * 3]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = table(spark, texts)
    width = lambda x: max(96, 2 * len(decontamination.words_of(x)))
    expected = {}
    for d, t in enumerate(texts):
        have = decontamination.words_of(t or "")
        for i, x in enumerate(items):
            if not decontamination.words_of(x or ""):
                continue
            parts = (x, *decontamination.question_and_answer(x))
            most = [held(p, have, len(have)) for p in parts]
            if most[0] < 0.8 and min(most[1:]) < 0.8:
                continue  # not even in the whole text
            shares = [held(p, have, width(x)) for p in parts]
            if shares[0] >= 0.8 or min(shares[1:]) >= 0.8:
                expected[d, i] = tuple(shares)
    rows = decontamination.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id): (r.overlap, r.question_overlap, r.answer_overlap) for r in rows} == expected and len(expected) > 80
    assert len(rows) == len(expected) and all(r.score >= 1 for r in rows)
    split = decontamination.find_leaks(df, bench, index_chars=700).collect()
    assert sorted(split) == sorted(rows)  # more indexes, same leaks and scores
    clean = decontamination.without_leaks(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    assert decontamination.find_leaks(df, bench.limit(0)).count() == 0 and decontamination.find_leaks(df.limit(0), bench).count() == 0


def test_other_items_decide_nothing(spark):
    rng = random.Random(66)
    say = lambda n, k=300: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    item, long, longer = say(40), say(300), say(1000)
    halves = item.split(" ")
    far = " ".join([*halves[:20], say(200, 9), *halves[20:]])  # the item's halves stand 200 words apart
    texts = [far, say(50) + " " + item, long, say(300) + " " + longer[: len(longer) // 2] + " " + say(300) + longer[len(longer) // 2 :], None]
    leaks = lambda items: {(r.doc_id, r.item_id, r.overlap) for r in decontamination.find_leaks(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    alone = leaks([(1, item)])
    assert {d for d, _, _ in alone} == {1}
    more = leaks([(1, item), (2, long), (3, longer)])
    assert {x for x in more if x[1] == 1} == alone and {(d, i) for d, i, _ in more} == {(1, 1), (2, 2), (3, 3)}
    assert [decontamination.class_of(w) for w in (96, 128, 129, 256, 257, 2000)] == [0, 0, 1, 1, 2, 4]


def test_retrieval_equals_exhaustive_scoring():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(2, 30)))) for i in range(400)]
    index = decontamination.ItemIndex(items)
    term_of = np.searchsorted(index.term_first, np.searchsorted(index.group_first, np.searchsorted(index.block_first, np.arange(len(index.units)), "right") - 1, "right") - 1, "right") - 1
    for _ in range(200):
        terms = np.unique(np.array([index.term[rng.choice(words).encode()] for _ in range(rng.randint(1, 160))]))
        scores = np.bincount(index.units, np.where(np.isin(term_of, terms), index.impacts, 0.0), len(index.item_of))
        got = dict(index.retrieve(terms))
        assert set(got) == set(np.flatnonzero(scores >= 1).tolist()) and all(abs(scores[u] - x) < 1e-9 for u, x in got.items())


# ---------------------------------------------------------------- operator 7
def page(i, body, host="h.example"):
    return (i, f"https://{host}/{i}?q#f", f"<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class='cookie-notice'>We use cookies</div>{body}<footer>(c)</footer></body></html>")


def test_pages(spark):
    rows = [page(i, f"<article><header><h1>T{i}</h1></header><p>First &amp;&nbsp; {i}<br>line<p>Second<aside>ad</aside></article><section id=comments><p>nice!</p></section>") for i in range(5)]
    rows += [page(10 + i, f"<div><p>Body text {i}</p><p>Subscribe to our list</p></div>", "plain.example") for i in range(6)]
    rows += [(90, None, None), (91, "odd url", ""), (92, "x://y", "<p>a</p><!-- <p>no --><script>'<p>'</script>b < c"), (92, "x://y", "<p>a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS host", "'z' AS template", "'z' AS text")
    got = {}
    for r in html.extract_pages(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert got[3] == ["T3\nFirst & 3 line\nSecond"]
    assert got[12] == ["Body text 2"]  # the repeated line is the template's
    assert got[90] == [""] and got[91] == [""] and sorted(got[92]) == ["a", "a\nb < c"]
    assert html.extract_pages(df.limit(0)).count() == 0


def test_boilerplate_inside_an_article_is_static(spark):
    words = "tree river stone cloud".split()
    body = lambda i: f"<h1>Title {i}</h1><p>First {i} about {words[i % 4]}.</p><p>Second {i}.</p>"
    rows = [page(i, f"<article>{body(i)}<p>All rights reserved.</p></article>") for i in range(60)]
    # a layout of 3 of 63 pages with a line of its own
    rows += [page(100 + i, f"<article class=long>{body(100 + i)}<div class=box><p>Tell your friends.</p></div></article>") for i in range(3)]
    # copies of one page but for a word: their text is no template
    rows += [page(200 + i, f"<article><h1>Same</h1><p>Same one.</p><p>Same two.</p><p>Word {i}.</p></article>", "copies.example") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_pages(df).collect()}
    assert got[5] == "Title 5\nFirst 5 about river.\nSecond 5."
    assert got[101] == "Title 101\nFirst 101 about river.\nSecond 101."
    assert got[202] == "Same\nSame one.\nSame two.\nWord 2."


def test_classes_nest():
    places = {1: [0], 2: [10], 3: [20], 4: [2, 12], 5: [4, 14], 6: [15], 7: [25], 8: [5, 9], 9: [6, 8]}
    valid = html.valid_classes([[1, 2, 3], [4, 5], [6, 7], [1, 9], [8, 9], [3, 99]], places)
    assert valid == [[1, 2, 3], [4, 5]]  # [6, 7] crosses the first, [8, 9] isn't in order, [1, 9] isn't as often
    assert html.valid_classes([[4, 5], [1, 2, 3]], places) == [[4, 5], [1, 2, 3]]
    assert not html._nested([(1, 5)], [(0, 3, 9)]) and html._nested([(4, 5)], [(0, 3, 9)]) and html._nested([(0, 3, 9)], [(4, 5), (6, 8)])


def test_slots_are_chosen_by_what_they_say(spark):
    """Without article elements: menus of links and stock phrases go, whatever their names."""
    menu = lambda i: "<div class=x1>" + "".join(f"<a href=/{i}>topic {i * k}</a> " for k in range(5)) + "</div>"
    deals = ["Buy a lamp today.", "Our shop has chairs.", "Rugs are cheap now."]
    rows = [(i, f"https://plain.example/{i}", f"<body>{menu(i)}<div class=x2><h1>Head {i}</h1><p>Body text {i}, with a <a href=#>link {i}</a>.</p></div><div class=x3>{deals[i % 3]}</div></body>") for i in range(30)]
    rows += [(100 + i, f"https://same.example/{i}", "<body><div class=x2><h1>Same</h1><p>All of it is the same.</p></div></body>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract_pages(df).collect()}
    assert got[7].text == "Head 7\nBody text 7, with a link 7."
    assert {s.slot.rpartition("/")[2] for s in got[7].slots if not s.kept} >= {"div.x3"}
    assert html.extract(rows[7][2], [])[0] != got[7].text  # the template decides
    assert got[102].text == "Same\nAll of it is the same."


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<body><div><p>Text.</p></div><article class='comment even'><p>Nice.</p></article></body>", "Text."),
        ("<body><div><p>Text.</p></div><aside><article><p>Teaser.</p></article></aside></body>", "Text."),
        ("<body><div class=comments><article><p>Nice.</p></article></div><p>Text.</p></body>", "Text."),
        ("<body class='has-sidebar'><p>Text.</p></body>", "Text."),
        ("<body class='page no-sidebar'><main class='main main-search'><p>Text.</p></main></body>", "Text."),
        ("<body><nav>Home</nav><article class='post share-enabled'><p>Text.</p></article></body>", "Text."),
        ("<body><main><p>Text.</p><article class=comment>Nice.</article></main></body>", "Text."),
        ("<body><nav>Home</nav><article class=comment>One.</article><article class=comment>Two.</article></body>", "One.\nTwo."),
        # wrappers whose names only speak of asides
        ("<div class='content-sidebar-wrap'><main><article><p>Text.</p></article></main></div>", "Text."),
        ("<div id='page' class='site has-sidebar'><p>Text.</p></div>", "Text."),
        ("<div class='container no-sidebar'><article><p>Text.</p></article></div>", "Text."),
        ("<article><p>One.</p><section id='social-policy'><p>Two.</p></section></article>", "One.\nTwo."),
        ("<article><p>One.</p><div class='related-work'><p>Two.</p></div></article>", "One.\nTwo."),
        ("<div class='layout sidebar-left'><div class=sidebar><a href=/>Home</a></div><div><p>Some longer text.</p></div></div>", "Some longer text."),
        ("<div id=search><main><p>Text.</p></main></div>", "Text."),
        ("<div class=modal><div><p>Text of it all.</p></div></div>", "Text of it all."),
        ("<div class='page-login'><article><p>Short.</p></article></div><p>Something that is longer than that.</p>", "Short."),
        ("<div class='ad-free'><p>Text.</p></div>", "Text."),
        ("<div class='share-price-page'><p>Text.</p></div>", "Text."),
        ("<div class='social widget'><p>Text one.</p><div class=comments><p>Nice.</p></div></div>", "Text one."),
        ("<div class='notice-board'><h1>News</h1><p>Text.</p></div>", "News\nText."),
        ("<div class='wrapper-nav-open'><p>Text.</p></div>", "Text."),
        ("<section class='search_engines'><p>Text.</p></section><div class=search><p>Find</p></div>", "Text."),
        ("<div class=related><p>Text.</p></div>", "Text."),
        # and asides that stay asides
        ("<div><p>Text of a page.</p></div><div class='sidebar_2'><p>Other.</p></div>", "Text of a page."),
        ("<div><p>Text.</p></div><div class='post-comments'><p>A long comment of a reader.</p></div>", "Text."),
        ("<div><p>A text that is long.</p></div><div class='cookie-banner-text'><p>We use them.</p></div>", "A text that is long."),
        ("<div><p>A text that is long.</p></div><div class=related><article><p>Teaser.</p></article></div>", "A text that is long."),
        ("<article><p>A text that is long.</p><div class=ad>Buy.</div><div class='share-buttons'>Tell.</div></article>", "A text that is long."),
    ],
)
def test_names_and_asides_lose_no_text(body, text):
    assert html.extract(f"<html class=no-ads>{body}</html>", [])[0] == text


@pytest.mark.parametrize(
    ("attributes", "names"),
    [
        (' class="a b" ID=c role = \'d\'', "a b c d"),
        (' data-id="ad" aria-grid=menu xclass="nav"', ""),
        (' title="no class=ads here" alt=\'id="menu"\' id=x', "x"),
        (' href="/a?id=nav"class="y"', "y"),
        (" class id role=", ""),
    ],
)
def test_names_come_from_their_own_attributes(attributes, names):
    assert html._names(attributes) == names
    text, _ = html.extract(f"<article><p{attributes}>Body.</p></article>", [])
    assert text == "Body."


def test_references_without_a_semicolon_are_decoded():
    """As HTML has it for the names that once needed none; a heading cut inside one ends like that."""
    text, _ = html.extract("<article><h1>a &amp b and&amp</h1><p>&copy 1 &#65 &nosuch &amp;amp</p></article>", [])
    assert text == "a & b and&\n© 1 A &nosuch &amp"


def test_long_attributes_take_linear_time():
    for junk in ("x" * 300_000, " " * 300_000, "x " * 150_000, "= " * 150_000, "'" * 299_999):
        assert html._names(f" {junk} ") in ("", "=")


# ---------------------------------------------------------------- operator 9
def brute(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 4:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fs}


@pytest.mark.parametrize("hot_key", [2, 20, 2000])
def test_components_equal_brute_force(spark, hot_key):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)}
    ring = rng.getrandbits(64)  # many with two equal segments, few with three
    fps |= {ring ^ (rng.getrandbits(25) << 39 | rng.getrandbits(13) << 26) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:30]:
        for _ in range(4):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, hot_key=hot_key)).collect()}
    groups = {}
    for f, r in brute(fps).items():
        groups.setdefault(r, set()).add(signed(f))
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_fingerprints_by_definition(spark):
    import xxhash

    for text in ["a b c", "A  b\tC d e", *[t for t in ODD if t]]:
        ws = text.translate({i: i + 32 for i in range(65, 91)})
        ws = [w for w in __import__("re").split("[ \t-\r]+", ws) if w]
        hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))] if ws else []
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_copies_of_odd_tables(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [base, base, base.replace("word7 ", "other "), "unrelated text of its own kind here", *ODD]
    df = table(spark, texts, [5, 9, 7, 3, *range(20, 20 + len(ODD))])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got[5] == got[9] == got[7] == 5 and got[3] == 3 and got[21] == got[20]
    kept = simhash.one_of_each(df.unionByName(df.where("doc_id = 3")))
    assert kept.columns == df.columns and kept.where("doc_id IN (5, 7, 9)").count() == 1 and kept.where("doc_id = 3").count() == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "x y"), (None, "x y"), (4, "x y")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(nulls).collect()} == {4}


def test_one_id_with_several_texts_loses_none(spark):
    copy, other, third, fourth = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcd")
    rows = [(copy, 5, "kept"), (copy, 7, "copy"), (other, 7, "kept"), (third, 9, "kept"), (fourth, 9, "kept"), (None, None, "kept"), (third, 9, "kept")]
    df = spark.createDataFrame(rows, "text string, doc_id long, root string")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns  # doc_id stays where it was
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(0, ""), (5, copy), (7, other), (9, third), (9, fourth)])
    assert {r.root for r in kept.collect()} == {"kept"}


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, docs):
    bench = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    given = {r.doc_id: r for r in docs.collect()}
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DIR).cache()
        assert now.columns == docs.columns
        seen[name] = {r.doc_id: r for r in now.collect()}
    assert all(any(c.isalpha() for c in given[d].text) for d in seen["language"])
    fps = {d: simhash.fingerprint(r.text) for d, r in seen["language"].items()}
    groups = brute(set(fps.values()))
    least = {}
    for d, f in fps.items():
        least[groups[f]] = min(d, least.get(groups[f], d))
    assert set(seen["near_copies"]) == set(least.values())
    assert set(seen["leaks"]) == {d for d, r in seen["near_copies"].items() if not any(b in r.text for b in bench)}
    assert set(seen["secrets"]) == set(seen["leaks"]) and not any('token = "' in r.text for r in seen["secrets"].values())
    last = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in last} == set(seen["secrets"]) and all(r.lossless for r in last)


def test_pipeline_of_odd_tables(spark, tmp_path):
    clean = [f"the quick brown fox number {i} walks over {i * 7} lazy dogs and comes home at {i + 3} in the evening" for i in range(12)]
    leak = "which river runs through the old town of the northern hills and where does it meet the sea at last"
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    texts = [*ODD, *clean, clean[0], f"before {leak} after", 'use password = "hunter2hunter2" here and then go on with the work of the day']
    rows = table(spark, texts, ids=[None, None, *range(2, len(texts))], langs=["en" if t in clean else None for t in texts])
    again = rows.unionByName(rows.where("doc_id = 12"))  # a repeated row
    again.write.parquet(f"{tmp_path}/odd/documents.parquet")
    at = {t: i for i, t in reversed(list(enumerate(texts))) if t in texts}
    now = again
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, f"{tmp_path}/odd").cache()
        assert now.columns == again.columns, name
        ids = {r.doc_id for r in now.collect()}
        assert ids <= {r.doc_id for r in before.collect()} and {at[t] for t in clean} <= ids, name
    kept = now.collect()
    assert [r.doc_id for r in kept].count(12) == 1 and len(ODD) + len(clean) not in ids and at[texts[-2]] not in ids
    assert "hunter2hunter2" not in "".join(r.text for r in kept)
    coded = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted(str(r.doc_id) for r in coded) == sorted(str(r.doc_id) for r in kept) and all(r.lossless for r in coded)


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
