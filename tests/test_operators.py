"""Examples for operators over tables."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docflow.operators import extract, feeds, jobs, pages, planning, rules, timeline, usage


def book(spark, *texts):
    return spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(texts)], "book string, page_no int, text string")


def paragraphs(df):
    return [r.paragraph for r in df.orderBy("paragraph_no").collect()]


def test_furniture_and_page_numbers_go(spark):
    body = ["the first page tells of many things and of", "more things that go on for long enough to wrap", "over the page and there it", "ends. A second sentence follows here to fill."]
    texts = [f"My Header\n{b}\nsome filler line {'abcd'[i] * 9} that is long enough\nPage {i + 1} of 4" for i, b in enumerate(body)]
    got = " ".join(paragraphs(pages.clean_pages(book(spark, *texts))))
    assert "My Header" not in got and "Page" not in got and "over the page and there it" in got
    lines = pages.page_lines(book(spark, *texts))
    assert {r.key for r in pages.find_furniture(lines).collect()} == {"my header", "page # of #"}
    assert pages.find_furniture(pages.page_lines(book(spark, *texts[:2]))).count() == 0


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("This line is wrapped\nin the middle of it.", ["This line is wrapped in the middle of it."]),
        ("We sat an exam-\nple of it.", ["We sat an example of it."]),
        ("the Anglo-\nSaxon king came.", ["the Anglo-Saxon king came."]),
        ("one\n\ntwo", ["one", "two"]),
        ("", []),
    ],
)
def test_reflow(spark, text, expected):
    assert paragraphs(pages.reflow(pages.page_lines(book(spark, text)))) == expected


def test_first_position_decides_near_edge(spark):
    # the repeated line stands at the top too, so its later occurrence counts as near the edge
    texts = ["head\n" + "\n".join(f"line {x} {p} {'x' * k}" for k, x in enumerate("abcdef")) + "\nhead\n" + "\n".join(f"tail {x}{p * 3} {'y' * k}" for k, x in enumerate("ghijk")) for p in "qrst"]
    lines = pages.page_lines(book(spark, *texts))
    kept = pages.drop_furniture(lines, pages.find_furniture(lines))
    assert kept.where("line = 'head'").count() == 0


def test_rules(spark):
    docs = spark.createDataFrame([(1, "AI and maintain US GDP of US [12] C++ AI"), (2, "x"), (1, None)], "user_id long, text string")
    given = spark.createDataFrame(
        [(1, "AI", "A I", 1), (1, "US", "states", 2), (1, "US GDP", "output", 3), (1, "[12]", "US$1", 4), (1, "C++", "see", 5), (1, "", "no", 6)],
        "user_id long, pattern string, replacement string, created_at long",
    )
    got = {(r.user_id, r.text) for r in rules.apply_rules(docs, given).collect()}
    # US$1 comes in before the rule for US runs over it, as that one is shorter
    assert got == {(1, "A I and maintain output of states states$1 see A I"), (2, "x"), (1, None)}


def test_timeline(spark):
    rows = [(1, 0, 0, 1000, False), (1, 1, 0, 1000, True), (1, 2, 1, 1000, True), (2, 0, 0, None, True)]
    chunks = spark.createDataFrame(rows, "document_id int, idx int, paragraph_idx int, duration_ms long, ends_paragraph boolean")
    lines = timeline.timeline(chunks)
    assert [(r.start_ms, r.end_ms) for r in lines.where("document_id = 1").orderBy("idx").collect()] == [(0, 1000), (1350, 2350), (3100, 4100)]
    assert [(r.chapter_no, r.start_ms) for r in timeline.chapters(lines).where("document_id = 1").orderBy("idx").collect()] == [(0, 0), (1, 3100)]
    places = spark.createDataFrame([(1, 1, 0), (1, 2, 1300), (1, 3, 9999), (3, 4, 5)], "document_id int, position_id long, position_ms long")
    assert [r.idx for r in timeline.active_chunk(places, lines).orderBy("position_id").collect()] == [0, 1, 2, -1]


def test_throttle_keeps_by_what_was_kept(spark):
    times = [0, 3, 6, 9, 12, 30]
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, t)) for t in times], "k int, ts timestamp")
    assert [r.ts.second for r in timeline.throttle(rows, ["k"], "ts").orderBy("ts").collect()] == [0, 6, 12, 30]


def test_admission_replay(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = spark.createDataFrame([(1, at(0), 6), (1, at(1), 6), (1, at(2), 4), (1, at(25), 6), (2, at(1), 11)], "user_id long, ts timestamp, chars long")
    got = usage.replay_admission(rows, quota=10).orderBy("user_id", "ts").collect()
    assert [r.admitted for r in got] == [True, False, True, True, False]


def test_error_triage(spark):
    rows = [
        ("nested", 401, '{"detail": {"status": "quota_exceeded", "message": "none left"}}', None),
        ("nested", 401, '{"detail": "you are out of characters"}', None),
        ("nested", 401, "{}", None),
        ("nested", None, None, None),
        ("plain", 429, '{"error": {"message": "slow"}}', "7"),
        ("plain", 503, "<html>", None),
        ("plain", 401, None, None),
    ]
    got = jobs.triage_errors(spark.createDataFrame(rows, "flavour string, status int, body string, retry_after string")).collect()
    assert [(r.message, r.retryable, r.retry_after_ms) for r in got] == [
        ("monthly quota reached: none left", False, None), ("monthly quota reached: you are out of characters", False, None), ("invalid key", False, None),
        ("network error", True, None), ("slow", True, 7000), ("server error 503", True, None), ("invalid key", False, None),
    ]


def test_retry_bounds(spark):
    rows = spark.createDataFrame([(1, True, None, j / 10) for j in range(11)] + [(2, True, 40, 0.0), (3, False, None, 0.0)], "k int, retryable boolean, retry_after_ms long, jitter double")
    got = jobs.retry_schedule(rows, base_ms=100, max_ms=300)
    waits = {a: [r.wait_ms for r in got.where(f"k = 1 AND attempt = {a}").collect()] for a in (1, 2, 3)}
    assert min(waits[1]) == 50 and max(waits[1]) == 150 and max(waits[2]) == 300 and max(waits[3]) == 450
    assert {r.wait_ms for r in got.where("k = 2").collect()} == {40} and got.where("k = 3").count() == 0


def test_cache_plan(spark):
    chunks = spark.createDataFrame([(1, 7, 0, "h1", 10, 0), (1, 7, 1, "h2", 20, 0), (1, 7, 2, "h2", 20, 1)], "document_id int, user_id int, idx int, content_hash string, char_count int, paragraph_idx int")
    cache = spark.createDataFrame([(7, "h1", "p")], "user_id int, content_hash string, path string")
    s = planning.plan_summary(planning.cache_probe(chunks, cache), "document_id").first()
    assert (s.chunks, s.cached_count, s.billable_chars) == (3, 1, 40)  # the quote bills repeats
    assert planning.synthesis_plan(chunks).where("paid").agg(F.sum("char_count")).first()[0] == 30  # synthesis doesn't
    all_cached = chunks.select("user_id", "content_hash", F.lit("p").alias("path")).distinct()
    assert planning.plan_summary(planning.cache_probe(chunks, all_cached), "document_id").first().billable_chars == 0


def test_breaks_and_lines(spark):
    gaps = spark.createDataFrame([("p", i, g) for i, g in enumerate([None, 14, 28, 14, 14])], "k string, i int, gap long")
    assert [r.is_break for r in extract.adaptive_breaks(gaps, "k", "gap").orderBy("i").collect()] == [False, False, True, False, False]
    even = gaps.withColumn("gap", F.lit(14).cast("long"))
    assert extract.adaptive_breaks(even, "k", "gap").where("is_break").count() == 0


def test_feeds(spark):
    assets = spark.createDataFrame([(1, 1, "a", 61400, 5, dt.datetime(2024, 1, 2)), (1, 2, "b", None, None, dt.datetime(2024, 1, 1)), (1, 3, "gone", 1, 1, dt.datetime(2024, 1, 1))], "user_id int, document_id int, path string, duration_ms long, byte_size long, created_at timestamp")
    docs = spark.createDataFrame([(1, 1, 'A & "B"')], "user_id int, document_id int, title string")
    links = spark.createDataFrame([("a", "http://x?a=1&b=2"), ("b", "http://y")], "path string, url string")
    items = feeds.feed_items(assets, docs, links)
    xml = {r.user_id: r.xml for r in feeds.render_feeds(spark.createDataFrame([(1,), (2,)], "user_id int"), items).collect()}
    assert xml[1].index("A &amp; &quot;B&quot;") < xml[1].index("Untitled") and "a=1&amp;b=2" in xml[1] and "<itunes:duration>61<" in xml[1] and "gone" not in xml[1]
    assert "<item>" not in xml[2] and xml[2].endswith("</channel></rss>")


def test_books_without_a_key_are_books(spark):
    from docflow.operators import pages

    text = "Header\nThe {0} begins a line of some text that is long\nand {0} ends here.\n\nAnother {0} exam-\nple of {0}.\n7"
    rows = [(b, n, text.format(w)) for b in ("x", None) for n, w in zip((None, 1, 2, 3, 4), ("oak", "elm", "ash", "fir", "yew"), strict=True)]
    df = spark.createDataFrame(rows, "book string, page_no int, text string")
    lines = pages.page_lines(df)
    furniture = {(r.book, r.key) for r in pages.find_furniture(lines).collect()}
    assert (None, "header") in furniture and ("x", "header") in furniture
    assert {r.book for r in pages.median_width(lines).collect()} == {"x", None}
    got = {}
    for r in sorted(pages.clean_pages(df).collect(), key=lambda r: r.paragraph_no):
        got.setdefault(r.book, []).append(r.paragraph)
    assert got["x"] == got[None] and got["x"][0] == "The oak begins a line of some text that is long and oak ends here."
    assert got["x"][1].startswith("Another oak example of oak. The elm begins")  # pages run on
    assert not any("Header" in p for p in got[None])
    assert {r.book for r in pages.reflow(lines).collect()} == {"x", None}
    assert pages.clean_pages(df.limit(0)).count() == 0


def test_positions_of_a_hot_document_spread_over_tasks(spark):
    rng = random.Random(5)
    lines = [(d, i, i * rng.choice([3000, 5000, 70_000]) if d else i * 4000) for d in (0, 1, 2) for i in range(120)] + [(1, 900, None), (None, 1, 0), (2, None, 5), (3, 4, 10), (3, 6, 10)]
    places = [(0 if k % 3 == 0 else rng.choice([1, 2, 3, 8, None]), k, rng.randrange(-5000, 600_000)) for k in range(3000)]
    places += [(0, 5000, 0), (0, 5000, 0), (1, 5001, None), (2, 5002, 10**12)]
    given = spark.createDataFrame(lines, "document_id int, idx int, start_ms long").withColumn("extra", F.lit(1))
    asked = spark.createDataFrame(places, "document_id int, position_id long, position_ms long").withColumn("idx", F.lit("clash"))

    def last(d, ms):
        seen = [(s, i) for doc, i, s in lines if None not in (doc, i, s, d, ms) and doc == d and s <= ms + 50]
        return max(seen)[1] if seen else -1

    expected = sorted((k, last(d, ms)) for d, k, ms in places)
    for width in (1, 60_000, 10**9):
        got = timeline.active_chunk(asked, given, bucket_ms=width)
        assert sorted((r.position_id, r.idx) for r in got.collect()) == expected
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hot = timeline.active_chunk(asked, given).where("document_id = 0").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(hot) > 1 and max(r["count"] for r in hot) < 1000
    starts = given.select("document_id", F.col("idx").alias("chapter_no"), "start_ms")
    assert timeline.active_chapter(asked.limit(0), starts).count() == 0
    assert {r.chapter_no for r in timeline.active_chapter(asked, starts.limit(0)).collect()} == {0}


def test_submit_plan_by_hand(spark):
    docs = spark.createDataFrame(
        [(1, 7, "One is here.\n\nTwo is here."), (2, 7, "Two is here."), (3, 8, "One is here."), (4, 7, None), (5, 9, " \n\n "), (None, None, "Null one.")],
        "document_id long, user_id long, text string",
    )
    given = spark.createDataFrame([(8, "One", "Three", 1)], "user_id long, pattern string, replacement string, created_at long")
    made = planning.plan_chunks(docs, given, "v", "m")
    sha = lambda t: hashlib.sha256(f"v:m:{t}".encode()).hexdigest()
    assert {(r.document_id, r.content_hash) for r in made.collect()} == {
        (1, sha("One is here.")), (1, sha("Two is here.")), (2, sha("Two is here.")), (3, sha("Three is here.")), (4, None), (5, None), (None, sha("Null one.")),
    }
    cache = spark.createDataFrame([(7, sha("Two is here."), "a"), (7, sha("Two is here."), "b"), (8, sha("One is here."), "c")], "user_id long, content_hash string, path string")
    used = spark.createDataFrame([(7, 20), (7, 1), (None, 99)], "user_id long, used long")
    got = {r.document_id: (r.user_id, r.chunks, r.cached_count, r.billable_chars, r.total_chars, r.used, r.remaining, r.ok, r.problem) for r in planning.submit_plan(made, cache, used, quota=30).collect()}
    assert got == {
        1: (7, 2, 1, 12, 24, 21, 9, False, "over quota"),
        2: (7, 1, 1, 0, 12, 21, 9, True, None),
        3: (8, 1, 0, 14, 14, 0, 30, True, None),
        4: (7, 0, 0, 0, 0, 21, 9, True, "no words"),
        5: (9, 0, 0, 0, 0, 0, 30, True, "no words"),
        None: (None, 1, 0, 9, 9, 0, 30, True, None),
    }
    assert planning.submit_plan(planning.plan_chunks(docs.limit(0), given, "v", "m"), cache, used).count() == 0


def test_lookups_with_nulls_ties_and_repeats(spark):
    chunks = spark.createDataFrame([(1, 0, 7, "a"), (1, 0, 7, "a"), (1, 1, 7, None), (2, 0, None, "a"), (None, 0, 8, "a")], "document_id int, idx int, user_id int, content_hash string")
    cache = spark.createDataFrame([(7, "a", "q"), (7, "a", "p"), (None, "a", "n"), (7, None, "z")], "user_id int, content_hash string, path string")
    key = lambda r: (r.document_id is None, r.document_id, r.idx)
    probed = planning.cache_probe(chunks, cache)
    assert [r.cache_path for r in sorted(probed.collect(), key=key)] == ["p", "p", None, None, None]
    assert planning.cache_probe(chunks, cache.limit(0)).where("cache_path IS NULL").count() == 5
    assert planning.cache_hits(chunks, cache).count() == 2 and planning.cache_misses(chunks, cache).count() == 3
    lines = spark.createDataFrame([(1, 0, 5, 9), (None, 0, 1, 2)], "document_id int, idx int, start_ms long, end_ms long")
    assert [r.start_ms for r in sorted(timeline.read_along(chunks, lines).collect(), key=key)] == [5, 5, None, None, None]
    assert timeline.read_along(chunks.limit(0), lines).count() == 0


def test_resume_points_and_rolling_usage_with_nulls(spark):
    assets = spark.createDataFrame([(1, 60_000), (2, None)], "document_id int, duration_ms long")
    places = spark.createDataFrame([(0, 1, 5_000), (1, 1, 5_001), (2, 1, 54_999), (3, 1, 55_000), (4, 2, 9_000), (5, 3, 9_000), (6, None, 9_000), (7, 1, None), (8, 1, 5_001)], "n int, document_id int, position_ms long")
    assert [r.resume_ms for r in timeline.resume_point(places, assets).orderBy("n").collect()] == [0, 5_001, 54_999, 0, 0, 0, 0, 0, 5_001]
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    spent = [(0, 1, at(0), 5), (1, 1, at(0), 5), (2, 1, at(24), None), (3, 1, at(24.5), 1), (4, None, at(0), 2), (5, None, at(1), 3), (6, 1, None, 4), (7, 2, at(0), None)]
    got = usage.rolling_usage(spark.createDataFrame(spent, "n int, user_id int, ts timestamp, chars long")).orderBy("n").collect()
    assert [r.rolling for r in got] == [10, 10, 10, 1, 2, 5, 4, None]


def test_chunk_grid_and_outcome_with_nothing_to_show(spark):
    progress = spark.createDataFrame([(1, 1, 3), (2, 0, 0), (3, None, 1), (4, 0, None)], "document_id int, done long, total long")
    known = spark.createDataFrame([(1, 1, "failed", False), (1, 9, "done", True), (None, 0, "done", False)], "document_id int, idx int, status string, cached boolean")
    got = sorted((r.document_id, r.idx, r.cell) for r in jobs.chunk_grid(progress, known).collect())
    assert got == [(1, 0, "done"), (1, 1, "failed"), (1, 2, "pending"), (3, 0, "pending")]
    chunks = spark.createDataFrame([(1, 0, "done"), (2, 0, "failed"), (2, 1, "failed"), (3, 0, "done"), (None, 0, "done")], "document_id int, idx int, status string")
    fatal = spark.createDataFrame([(3, "z"), (3, "b"), (1, None), (9, "x"), (None, "y")], "document_id int, message string")
    found = {r.document_id: (r.status, r.message) for r in jobs.job_outcome(chunks, fatal).collect()}
    assert found == {1: ("succeeded", None), 2: ("failed", "2 failed chunks"), 3: ("failed", "b"), None: ("succeeded", None)}


def test_lines_of_a_book_are_not_dealt_out_by_book(spark, capsys):
    """A book's facts come to its lines: a join by sort would bring all lines of a book into one task."""
    lines = pages.page_lines(book(spark, "One line of it.\nTwo.", "Three"))
    pages.reflow(lines).explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out
    pages.drop_furniture(lines, pages.find_furniture(lines)).explain()
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_paragraphs_run_over_pages(spark):
    """Page by page, with pages that are blank or without a word, against a walk over all lines."""
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["", "", "word", "a line without an end", "Short end.", "hyphen-"]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    flat = [line for t in texts for line in t.split("\n")]
    widths = sorted(len(x) for x in flat if x)
    stat, open_, want = widths[len(widths) // 2], [], []
    for line in [*flat, ""]:
        open_ += [line] if line else []
        if open_ and (not line or (line[-1] in ".!?" and len(line) < stat * 0.6)):
            said = open_[0]
            for x in open_[1:]:
                said = (said[:-1] if x[0].islower() else said) + x if said.endswith("-") else f"{said} {x}"
            want, open_ = [*want, said], []
    assert paragraphs(pages.reflow(pages.page_lines(book(spark, *texts)))) == want
