"""Operators 11, 12 and 13 against brute force, with nulls, ties, repeats, odd columns and empty tables."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docflow.llm import negatives, packing, resampling

SCHEMA = "doc_id long, text string, kept string, weight string, rank string, part int"
ODD = [None, "", " ", "\n\n", "é", "a" * 70 + " " + "B" * 5000, "Word " * 3000, "x\ty\x0bz\r\n", "İstanbul ŞİŞ K", "\x00 nul ÿ", "日本語 العربية 😀 x"]
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FAR = 2**53 + 1


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "k", "w", "r", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


# ---------------------------------------------------------------- operator 11
def grams(text, n_max):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]


def drawn(texts, ids, target, percent, min_words, buckets, n_max):
    """(doc_id, n_features, weight, score, rank) of each text, in plain Python."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in side for f in grams(x, n_max)[1]) for side in (texts, target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (t_all + buckets) / ((s[b] + 1) * (s_all + buckets))))
    rows = []
    for i, x in zip(ids, texts, strict=True):
        n, fs = grams(x, n_max)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice(["the", "Of", "und", "x1", "naïve", "w" * 66, f"n{rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 60)))
    return [say() for _ in range(n)]


@pytest.mark.parametrize(("percent", "buckets", "n_max"), [(25, 10_000, 2), (100, 64, 3), (0, 1, 1)])
def test_resampling_equals_brute_force(spark, percent, buckets, n_max):
    texts = corpus(1, 120) + ODD + ["The same text " * 8] * 9
    ids = [*range(len(texts) - 9), *[500] * 5, *[None] * 3, FAR]
    target = [*corpus(2, 9), None, ""]
    got = resampling.importance(table(spark, texts, ids).repartition(5), table(spark, target), percent=percent, buckets=buckets, n_max=n_max).collect()
    expected = drawn(texts, ids, target, percent, 20, buckets, n_max)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got), key=repr) == expected
    assert sorted(r.rank for r in got if r.rank) == list(range(1, sum(len(WORD.findall((t or "").translate(LOWER))) >= 20 for t in texts) * percent // 100 + 1))


def test_gains_compare_shares():
    """By the contract a bucket's gain is floor(1000 ln((t+1)(S+B)/((s+1)(T+B)))): above 0 where the target has the larger share."""
    corpus_counts, target_counts = np.array([900, 100, 0]), np.array([1, 8, 0])
    expected = [math.floor(1000 * math.log((t + 1) * (1000 + 3) / ((s + 1) * (9 + 3)))) for s, t in ((900, 1), (100, 8), (0, 0))]
    assert resampling.gains(corpus_counts, target_counts).tolist() == expected
    assert expected[0] < 0 < expected[1]


def test_weights_are_those_of_the_contract(spark):
    got = {r.doc_id: r.weight for r in resampling.importance(table(spark, ["a a a a", "b", None]), table(spark, ["b b"]), buckets=1, n_max=1).collect()}
    assert got == {0: math.floor(1000 * math.log(3 * 6 / (6 * 3))), 1: 0, 2: 0}
    rows = resampling.importance(table(spark, ["a a a a", "b", None]), table(spark, ["b b"]), n_max=1).collect()
    gain = lambda s, t: math.floor(1000 * math.log((t + 1) * 10_005 / ((s + 1) * 10_002)))
    assert {r.doc_id: r.weight for r in rows} == {0: gain(4, 0), 1: gain(1, 2), 2: 0}


def test_batches_change_nothing(monkeypatch):
    texts = [(t or "").encode() for t in corpus(3, 40) + ODD]
    whole = resampling.features(texts, 3)
    each = [resampling.features([t], 3) for t in texts]
    assert whole[0].tolist() == [int(w[0].sum()) for w in each]
    for n in range(3):
        assert whole[1][n][1].tolist() == [c for x in each for c in x[1][n][1].tolist()]
    assert resampling.features([], 2)[0].tolist() == []


def test_drawn_rows_come_back_whole(spark):
    texts = corpus(4, 80) + ODD
    df = table(spark, texts)
    got = resampling.resample(df, table(spark, corpus(5, 5)), percent=50)
    ranked = {r.doc_id for r in resampling.importance(df, table(spark, corpus(5, 5)), percent=50).collect() if r.rank}
    assert got.schema == df.schema and sorted(got.collect()) == sorted(r for r in df.collect() if r.doc_id in ranked) and ranked
    assert resampling.resample(df.limit(0), df).count() == 0
    assert resampling.importance(df, df.limit(0)).count() == len(texts)
    with pytest.raises(ValueError):
        resampling.importance(df, df, buckets=0)


# ---------------------------------------------------------------- operator 12
VECTORS = "vec_id long, embedding array<double>, label int, v string, dim string, n string"


def mined(rows, k_positives=5, k=3, low=50, high=95, every=50):
    rows = [(i, label, tuple(max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in e)) for i, e, label in rows if None not in (i, e, label) and all(x is not None and math.isfinite(x) for x in e)]
    anchors = {}
    for i, label, v in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        dot = lambda u: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(u, v, strict=True))))  # noqa: B023, E731
        others = sorted((-dot(u), i, m) for i, m, u in rows if i != a and len(u) == len(v))
        for s, i, _ in [x for x in others if x[2] == label][:k_positives]:
            held = [x for x in others if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(a, i, r + 1, x[1], -s, -x[0]) for r, x in enumerate(held)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [1 << 16, 30])
def test_negatives_equal_brute_force(spark, monkeypatch, block_rows):
    rng = random.Random(12)
    rows = [(i - 100, [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(8)], rng.randint(0, 3)) for i in range(600)]
    rows += [(1000 + i, [0.5] * 8, i % 2) for i in range(120)]  # copies: many ties
    rows += [(2000 + i, [rng.random()] * 3, i % 2) for i in range(60)] + [(2100 + i, [], i % 2) for i in range(3)]  # other dimensions
    rows += [(3000, [1.0] * 8, 1), (3000, [1.0] * 8, 0), (3001, [1.0] * 8, 1), (3001, [1.0] * 8, 1)]  # repeated ids
    rows += [(None, [1.0] * 8, 1), (3050, None, 1), (3051, [1.0] * 8, None), (3052, [float("nan")] + [1.0] * 7, 1), (3053, [float("inf")] * 8, 1), (3054, [None] * 8, 1)]
    rows += [(FAR, [0.7] * 8, 2), (4000, [0.0] * 8, 2)]
    monkeypatch.setattr(negatives, "HELD_SCORES", 900)
    df = spark.createDataFrame([(*r, "v", "d", "n") for r in rows], VECTORS).repartition(3)
    got = negatives.hard_negatives(negatives.usable_rows(df), F.col("vec_id") % 50 == 0, block_rows=block_rows)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows) and len(mined(rows)) > 250
    assert negatives.hard_negatives(negatives.usable_rows(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components_are_exact(spark):
    rng = random.Random(13)
    rows = [(i, [rng.choice([1e9, -1e9, 3e8]) * rng.random() for _ in range(4)], rng.randint(0, 1)) for i in range(200)]
    rows += [(300 + i, [rng.choice([1e15, -1e15, 1e300]) for _ in range(4)], i % 2) for i in range(10)]  # scores beyond a long
    df = spark.createDataFrame([(*r, "v", "d", "n") for r in rows], VECTORS)
    got = negatives.hard_negatives(negatives.usable_rows(df), F.col("vec_id") % 50 == 0, n_positives=2, n_negatives=4, low=10, high=99)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 2, 4, 10, 99)


def test_firsts_of_lines():
    rng = np.random.default_rng(0)
    for top in (9, 1 << 61):
        scores = rng.integers(-top, top, (20, 30))
        allowed = rng.random((20, 30)) < 0.3
        line, column = negatives.firsts(scores, allowed, 4)
        for i in range(20):
            want = sorted(np.flatnonzero(allowed[i]), key=lambda c: (-int(scores[i, c]), c))[:4]
            assert sorted(column[line == i].tolist()) == sorted(int(c) for c in want)


# ---------------------------------------------------------------- operator 13
@pytest.mark.parametrize("length", [1, 7, 64, 4096])
def test_packing_is_whole(spark, monkeypatch, length):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 50)  # many blocks share windows
    monkeypatch.setattr(packing, "TEXTS", 2)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [t for t in ODD if length > 1 or not t or len(t) < 100] + [f"Number {i}, and more." for i in range(60)]
    ids = [*range(len(texts) - 4), None, None, 3, FAR]
    sequences = packing.pack_sequences(table(spark, texts, ids).repartition(4), path, length)
    found = {r.sequence_id: r for r in sequences.collect()}
    assert sorted(found) == list(range(len(found))) and all(r.n_tokens == length for r in found.values() if r.sequence_id < len(found) - 1)
    stored = {k: np.frombuffer(r.ids, f"<u{r.width}").astype("<u4") for k, r in found.items()}
    documents = Counter()
    open_pieces = {}
    for k in range(len(found)):  # documents stand one behind the other
        at = 0
        for p in found[k].pieces:
            assert p.offset == at
            at += p.length
            own = open_pieces.setdefault("ids", [])
            assert p.start == len(own)
            own += stored[k][p.offset : at].tolist()
            if len(own) == p.doc_tokens:
                documents[p.doc_id, tuple(open_pieces.pop("ids"))] += 1
        assert at == found[k].n_tokens == len(stored[k])
    assert not open_pieces
    assert documents == Counter((i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in zip(ids, texts, strict=True))
    rows = packing.pieces_of(packing.pack_sequences(table(spark, texts, ids), path, length)).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == Counter((d, len(t)) for (d, t), n in documents.items() for _ in range(n))


def test_crc_padding_and_empty_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = table(spark, ["one two three four five six seven"] * 5)
    sequences = packing.pack_sequences(df, path, 16)
    whole = [i for _ in range(5) for i in Tokenizer.from_file(path).encode("one two three four five six seven", add_special_tokens=False).ids + [2]]
    by = {r.sequence_id: list(r.ids) for r in packing.padded_ids(sequences, 16, pad_id=9).collect()}
    for k in range(0, len(whole), 16):
        own = whole[k : k + 16]
        assert by[k // 16] == (own if len(own).bit_count() == 1 else own + [9] * (16 - len(own)))
    for r in packing.pieces_of(sequences).collect():
        at = 16 * r.sequence_id + r.offset
        assert r.ids_crc32 == zlib.crc32(array("I", whole[at : at + r.length]).tobytes())
    assert packing.pack_sequences(df.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack_sequences(df, path, 0)
