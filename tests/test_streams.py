"""Streams against batch results on small event logs."""

import datetime as dt
import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docflow.operators import usage
from docflow.sources.readers import read_events, read_text_docs, read_uploads
from docflow.sources.sinks import UpsertTable
from docflow.streaming import progress
from docflow.streaming import usage as rolling
from docflow.streaming.run import ROCKSDB, drained


def stream_of(spark, tmp_path, rows, schema, name="in"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


EVENTS = "document_id long, idx int, status string, job_status string, ts timestamp"


def test_progress_counts_chunks_not_attempts(spark, tmp_path):
    rows = [(1, 0, "failed", None, at(0)), (1, 0, "done", None, at(5)), (1, 1, "failed", None, at(6)), (2, 0, "done", None, at(1)), (2, None, None, "succeeded", at(9)), (2, 1, "done", None, at(20))]
    got = {r.document_id: r for r in drained(progress.progress_stream(stream_of(spark, tmp_path, rows, EVENTS)), "update").collect()}
    assert (got[1].kind, got[1].done, got[1].failed) == ("progress", 1, 1)
    assert (got[2].kind, got[2].done) == ("succeeded", 1)  # what comes after the end is dropped


def test_snapshot_comes_first(spark, tmp_path):
    snapshot = spark.createDataFrame([(1, 3, 0, "done"), (1, 3, 1, "pending"), (1, 3, 2, "pending")], "document_id long, total long, idx int, status string")
    live = stream_of(spark, tmp_path, [(1, 1, "done", None, at(1))], EVENTS)
    got = drained(progress.progress_stream(live, snapshot), "update").collect()
    assert [(r.kind, r.total, r.done, r.pending) for r in got] == [("snapshot", 3, 1, 2), ("progress", 3, 2, 1)]


def test_the_snapshot_goes_out_once_over_many_batches(spark, tmp_path):
    snapshot = spark.createDataFrame([(1, 3, 0, "done"), (1, 3, 1, "pending"), (1, 3, 2, "pending")], "document_id long, total long, idx int, status string")
    for n, rows in enumerate([[(1, 1, "done", None, at(1))], [(1, 2, "failed", None, at(2)), (2, 0, "done", None, at(2))], [(1, None, None, "failed", at(3))], [(1, 2, "done", None, at(4))]]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        __import__("time").sleep(1.1)  # files are read in the order of their times
    live = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [(r.kind, r.total, r.done, r.failed, r.pending) for r in drained(progress.progress_stream(live, snapshot), "update").where("document_id = 1").collect()]
    assert sorted(got) == sorted([("snapshot", 3, 1, 0, 2), ("progress", 3, 2, 0, 1), ("progress", 3, 2, 1, 0), ("failed", 3, 2, 1, 0)])


def test_chunks_to_synthesise(spark, tmp_path):
    from docflow.operators.planning import with_hash

    rows = [(1, 7, "One. Two.\n\nThree.", at(0)), (2, 7, "Three.", at(1)), (3, 8, "Three.", at(2)), (4, 7, None, at(3))]
    known = with_hash(spark.createDataFrame([("One. Two.",)], "text string"), "v", "m").first().content_hash
    cache = spark.createDataFrame([(7, known)], "user_id long, content_hash string")
    live = stream_of(spark, tmp_path, rows, "document_id long, user_id long, text string, ts timestamp")
    got = drained(progress.chunk_stream(live, cache, "v", "m")).collect()
    assert sorted((r.user_id, r.text) for r in got) == [(7, "Three."), (8, "Three.")]  # not the cached one, and once a user


def test_chunks_to_synthesise_end_with_the_last_document(spark, tmp_path, monkeypatch):
    """A batch without rows would only take apart a state that isn't used again; settings are as before afterwards."""
    from docflow.plans import stream_queries

    with_batches = []
    monkeypatch.setattr(stream_queries, "drained", lambda stream, *mode, **how: with_batches.append(drained(stream, *mode, **how)) or with_batches[-1])
    keys = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows")
    before = [spark.conf.get(k, None) for k in keys]
    rows = stream_queries.x4(spark, "/root/testdata/sf0.001").count()
    assert [spark.conf.get(k, None) for k in keys] == before
    batches = {re.search("epoch=([0-9]+)", f).group(1) for f in with_batches[0].inputFiles()}
    assert rows > 0 and batches == {"0"}


def test_contents_are_told_once_over_batches_without_timers(spark, tmp_path):
    schema = "document_id long, user_id long, text string, ts timestamp"
    live = in_batches(spark, tmp_path, [[(1, 7, "One.", at(0))], [(2, 7, "One.", at(60)), (3, 7, "Two.", at(60))], [(4, 7, "Two.", at(90)), (5, 8, "Two.", at(90))]], schema)
    cache = spark.createDataFrame([], "user_id long, content_hash string")
    got = drained(progress.chunk_stream(live, cache, "v", "m"), timers=False).collect()
    assert sorted((r.user_id, r.text) for r in got) == [(7, "One."), (7, "Two."), (8, "Two.")]


def test_stale_work_needs_a_later_event(spark, tmp_path):
    rows = [(1, 0, "processing", at(0)), (1, 1, "processing", at(0)), (1, 1, "done", at(60)), (2, 0, "done", at(3600))]
    got = drained(progress.stale_stream(stream_of(spark, tmp_path, rows, "document_id long, idx int, status string, ts timestamp")), "update").collect()
    assert [(r.document_id, r.idx) for r in got] == [(1, 0)]


def test_latest_position_and_rates(spark, tmp_path):
    rows = [(1, 7, 100, 5, at(1)), (2, 7, 100, 9, at(3)), (3, 7, 100, 7, at(2)), (4, 7, 100, -1, at(9))]
    got = drained(progress.position_stream(stream_of(spark, tmp_path, rows, "position_id long, user_id long, document_id long, position_ms long, ts timestamp")), "complete").collect()
    assert [(r.user_id, r.position_ms) for r in got] == [(7, 9)]
    calls = stream_of(spark, tmp_path, [(1, at(s)) for s in (0, 1, 2, 1000)], "user_id long, ts timestamp", "calls")
    got = drained(progress.rate_stream(calls, 2), "complete").orderBy("window_start").collect()
    assert [(r.requests, r.limited) for r in got] == [(3, 1), (1, 0)]


def test_sources(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files/a.txt").write_bytes(b"# One\r\n\r\ntwo\r\nthree")
    (tmp_path / "files/b.txt").write_bytes(b"%PDF-1.4 pretending")
    (tmp_path / "files/c.bin").write_bytes(b"PK\x03\x04 word/document.xml")
    (tmp_path / "files/d.exe").write_bytes(b"MZ..")
    formats = {r.path.rsplit("/", 1)[1]: r.format for r in read_uploads(spark, str(tmp_path / "files")).collect()}
    assert formats == {"a.txt": "txt", "b.txt": "pdf", "c.bin": "docx", "d.exe": None}
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in read_text_docs(spark, str(tmp_path / "files/a.txt")).collect()}
    assert texts == {"a.txt": "One\n\ntwo three"}
    assert read_events(spark, "/root/testdata/sf0.001", "events.parquet").isStreaming


# ---------------------------------------------------------------- any order, any split
def in_batches(spark, tmp_path, batches, schema, name="split"):
    """A stream that gives each of ``batches`` as a micro-batch of its own, in this order."""
    folder, seen = tmp_path / name, set()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("part-*")) - seen:
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
            seen.add(f)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def of(rows, *fields):
    return {r.document_id: tuple(r[f] for f in fields) for r in rows}


#: A job fails, late news of it comes, a second job ends well; then an event without a job.
LOG = [(0, "processing", None, 0), (0, "failed", None, 1), (1, "done", None, 60), (None, None, "failed", 100), (0, "done", None, 600), (None, None, "succeeded", 700)]


def test_every_order_and_split_of_a_log_ends_the_same(spark, tmp_path):
    orders = list(itertools.permutations(LOG))  # 720 documents, each with the log in another order
    event = lambda d, e: (d, e[0], e[1], e[2], at(e[3]))
    splits = [[[event(d, e) for d, o in enumerate(orders) for e in o[a:b]] for a, b in cuts] for cuts in ([(0, 6)], [(0, 2), (2, 3), (3, 6)], [(0, 1), (1, 5), (5, 6)])]
    for n, batches in enumerate(splits):
        rows = drained(progress.progress_stream(in_batches(spark, tmp_path, batches, EVENTS, f"s{n}")), "update")
        last = of(progress.last_rows(rows).collect(), "kind", "total", "done", "failed", "pending")
        assert set(last) == set(range(720)) and set(last.values()) == {("succeeded", 2, 2, 0, 0)}


def test_an_older_event_never_wins(spark, tmp_path):
    live = in_batches(spark, tmp_path, [[(1, 0, "done", None, at(60))], [(1, 0, "failed", None, at(1))], [(1, 0, "done", None, at(60))]], EVENTS)
    rows = drained(progress.progress_stream(live), "update").collect()
    assert [(r.kind, r.done, r.failed, r.seq) for r in rows] == [("progress", 1, 0, 1)]  # what changes nothing says nothing


def test_a_resumed_document_speaks_again(spark, tmp_path):
    jobs = EVENTS + ", job_id long"
    batches = [
        [(1, 0, "done", None, at(1), 5), (1, None, None, "failed", at(2), 5), (2, None, None, "failed", at(2), None), (3, 0, "done", None, at(1), None), (3, None, None, "succeeded", at(2), None)],
        [(1, 1, "done", None, at(300), 5), (3, 1, "done", None, at(300), None), (2, None, None, "running", at(300), None)],  # late news of the old job; no job; a new job
        [(1, 2, "done", None, at(600), 6), (2, 0, "done", None, at(600), None)],
        [(1, None, None, "succeeded", at(700), 6), (2, None, None, "succeeded", at(700), None)],
    ]
    rows = sorted(drained(progress.progress_stream(in_batches(spark, tmp_path, batches, jobs)), "update").collect(), key=lambda r: (r.document_id, r.seq))
    assert [(r.kind, r.done) for r in rows if r.document_id == 1] == [("failed", 1), ("progress", 3), ("succeeded", 3)]
    assert [(r.kind, r.done) for r in rows if r.document_id == 2] == [("failed", 0), ("progress", 0), ("progress", 1), ("succeeded", 1)]
    assert [(r.kind, r.done) for r in rows if r.document_id == 3] == [("succeeded", 1)]


def test_snapshots_of_silent_and_finished_documents(spark, tmp_path):
    schema = "document_id long, total long, idx int, status string, job_status string, ts timestamp"
    snapshot = spark.createDataFrame([(1, 2, 0, "done", "running", at(5)), (1, 2, 1, "pending", "running", at(5)), (2, 1, 0, "done", "succeeded", None), (4, 1, 0, "done", None, at(9))], schema)
    live = in_batches(spark, tmp_path, [[(3, 0, "done", None, at(9)), (4, 0, "failed", None, at(3))], [(3, 1, "done", None, at(9000))]], EVENTS)
    got = drained(progress.progress_stream(live, snapshot), "update").collect()
    kinds = {d: [(r.kind, r.total, r.done, r.pending) for r in sorted(got, key=lambda r: r.seq) if r.document_id == d] for d in range(1, 5)}
    assert kinds[1] == [("snapshot", 2, 1, 1)]  # no event, yet a snapshot
    assert kinds[2] == [("snapshot", 1, 1, 0), ("succeeded", 1, 1, 0)]
    assert kinds[3] == [("progress", 1, 1, 0), ("progress", 2, 2, 0)]
    assert kinds[4] == [("snapshot", 1, 1, 0), ("progress", 1, 1, 0)]  # the event is older than the snapshot


def state_rows(stream, tmp_path, spark, mode="update"):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        run = stream.writeStream.outputMode(mode).format("noop").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in run.recentProgress if p["stateOperators"]]


def test_a_document_that_stops_telling_is_forgotten(spark, tmp_path):
    batches = [[(1, 0, "processing", None, at(0)), (1, 1, "done", None, at(0))], [(None, 0, "done", None, at(10)), (2, 0, "done", None, at(100_000))], [(2, None, None, "succeeded", at(200_000))], [(2, None, None, "running", at(900_000)), (3, None, None, None, None)]]
    stream = progress.progress_stream(in_batches(spark, tmp_path, batches, EVENTS), keep_ms=60_000, delay="10 seconds")
    rows = state_rows(stream.where("document_id = 1 OR document_id = 2"), tmp_path, spark)
    assert max(rows) > 0 and rows[-1] <= min(x for x in rows if x)  # only what is known of the newest event is left
    quiet = in_batches(spark, tmp_path, [[(1, 0, "processing", at(0)), (1, 1, "done", at(0))], [(1, 0, "done", at(30))], [(2, 0, "pending", at(99_999))]], "document_id long, idx int, status string, ts timestamp", "quiet")
    (tmp_path / "second").mkdir()
    assert state_rows(progress.stale_stream(quiet), tmp_path / "second", spark)[-1] <= 2  # the newest event's


def test_a_finished_chunk_is_never_requeued(spark, tmp_path):
    schema = "document_id long, idx int, status string, ts timestamp"
    batches = [[(1, 0, "done", at(60)), (1, 1, "processing", at(1)), (1, 2, "processing", at(1))], [(1, 0, "processing", at(1)), (1, 1, "done", at(61)), (1, 2, "processing", at(1))], [(9, 0, "done", at(9000))], [(9, 1, "strange", at(9001)), (None, 1, "processing", at(9001)), (9, None, "processing", at(9001))]]
    got = drained(progress.stale_stream(in_batches(spark, tmp_path, batches, schema), delay="2 minutes"), "update").collect()
    assert [(r.document_id, r.idx) for r in got] == [(1, 2)]


# ---------------------------------------------------------------- exact usage and admissions
REQUESTS = "event_id long, user_id long, ts timestamp, chars long"


def requests(seed, n=120):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 2, 2**53 + 1]), at(rng.randrange(0, 4 * 86_400, 600)), rng.choice([0, 5, 40, 400])) for i in range(n)]
    return sorted(rows, key=lambda r: r[2])


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_rolling_usage_on_a_stream_is_exact(spark, tmp_path, parts):
    rows = requests(1)
    random.Random(2).shuffle(rows)  # all within the delay
    batches = [rows[k::parts] for k in range(parts)]
    batches[0] = batches[0] + [(900, None, at(5), 1), (901, 1, None, 1)]
    stream = rolling.rolling_usage_stream(in_batches(spark, tmp_path, batches, REQUESTS), delay="5 days")
    got = rolling.last_totals(drained(stream, "update")).select("user_id", "event_id", "chars", "rolling").collect()
    expected = usage.rolling_usage(spark.createDataFrame(rows, REQUESTS)).select("user_id", "event_id", "chars", "rolling").collect()
    assert sorted(got) == sorted(expected) and len(got) == len(rows)


def test_usage_state_goes_with_its_window(spark, tmp_path):
    rows = [(1, 1, at(0), 5), (2, 1, at(100_000), 7), (3, 2, at(400_000), 1)]
    stream = rolling.rolling_usage_stream(in_batches(spark, tmp_path, [[r] for r in rows] + [[(4, 2, at(900_000), 1)]], REQUESTS), delay="0 seconds")
    rows = state_rows(stream, tmp_path, spark)
    assert rows[-1] <= max(rows) and rows[-1] == min(x for x in rows if x)  # of the user who was last only


@pytest.mark.parametrize("parts", [1, 4])
def test_admissions_on_a_stream_equal_the_replay(spark, tmp_path, parts):
    rows = requests(3)
    random.Random(4).shuffle(rows)
    batches = [rows[k::parts] for k in range(parts)] + [[(999, 5, at(30 * 86_400), 0)]]  # the last one lets the watermark pass
    got = drained(rolling.admission_stream(in_batches(spark, tmp_path, batches, REQUESTS), quota=900, delay="6 days")).collect()
    expected = usage.replay_admission(spark.createDataFrame(rows, REQUESTS), quota=900).collect()
    assert sorted(got) == sorted(expected) and {r.admitted for r in got} == {True, False}


def test_replay_keeps_ids_and_nulls(spark):
    far = 2**53 + 1
    rows = [(1, far, at(0), 6), (2, far + 2, at(0), 6), (3, None, at(1), 6), (4, None, at(2), 6), (5, None, at(3), None), (6, far, None, 1), (7, far, at(1), 4), (7, far, at(1), 4)]
    got = usage.replay_admission(spark.createDataFrame(rows, REQUESTS).coalesce(1), quota=10).collect()
    assert sorted(((r.user_id or 0, r.chars, r.admitted) for r in got)) == [(0, 0, True), (0, 6, False), (0, 6, True), (far, 4, False), (far, 4, True), (far, 6, True), (far + 2, 6, True)]
    assert usage.replay_admission(spark.createDataFrame([], REQUESTS)).count() == 0


# ---------------------------------------------------------------- upserts
def test_upserts_can_be_played_again(spark, tmp_path):
    schema = "k long, at long, v string"
    table = UpsertTable(spark, str(tmp_path / "table"), StructType.fromDDL(schema), ["k"], ["at"])
    frame = lambda rows: spark.createDataFrame(rows, schema)
    read = lambda: sorted(table.read().collect(), key=repr)
    assert read() == []
    table.compact()
    epochs = [[(1, 5, "a"), (1, 3, "old"), (None, 1, "n")], [(1, 4, "late"), (2, 1, "b"), (2, 1, "a")], [], [(None, 2, "m"), (None, 2, "m")]]
    for n, rows in enumerate(epochs):
        table.write_epoch(frame(rows), n)
    once = read()
    assert once == sorted([(1, 5, "a"), (2, 1, "b"), (None, 2, "m")], key=repr)
    table.write_epoch(frame(epochs[1]), 1)
    assert read() == once
    table.compact()
    assert read() == once
    table.write_epoch(frame(epochs[3]), 3)  # an epoch that is in the base already
    table.write_epoch(frame([(2, 9, "new")]), 4)
    table.compact()
    (tmp_path / "table" / "base-9-broken").mkdir()  # of a compaction that broke off
    assert read() == sorted([(1, 5, "a"), (2, 9, "new"), (None, 2, "m")], key=repr)
    assert spark.read.parquet(str(tmp_path / "table" / "ledger")).count() == 2


def test_a_base_alone_is_read_as_it_is(spark, tmp_path):
    schema = "k long, at long, v string"
    table = UpsertTable(spark, str(tmp_path / "table"), StructType.fromDDL(schema), ["k"], ["at"])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    read = lambda: sorted(table.read().collect(), key=repr)
    table.load(spark.createDataFrame([(1, 5, "a"), (1, 3, "old"), (1, 5, "a"), (None, 1, "n")], schema))
    once = read()
    assert once == [(1, 5, "a"), (None, 1, "n")]
    table.compact()
    assert read() == once and "Exchange" not in plan(table.read())
    table.write_epoch(spark.createDataFrame([], schema), 0)  # nothing is behind the base
    assert read() == once and "Exchange" not in plan(table.read())
    table.write_epoch(spark.createDataFrame([(1, 6, "b"), (1, 6, "a"), (2, 0, None)], schema), 1)
    after = [(1, 6, "b"), (2, 0, None), (None, 1, "n")]
    assert read() == after and "Exchange" in plan(table.read())
    table.compact()
    assert read() == after and "Exchange" not in plan(table.read())


def test_packed_cache_rows_are_shorter_and_equal(spark):
    from docflow.plans.state_queries import packed_cache, unpacked_cache

    rows = spark.range(5).selectExpr("id AS user_id", "sha2(string(id), 256) AS content_hash", "id AS created_at").selectExpr("user_id", "content_hash", "concat(user_id, '/audio/', content_hash, '.mp3') AS path", "created_at")
    packed = packed_cache(rows)
    assert {(len(r.content_hash), r.path) for r in packed.collect()} == {(32, f"{k}/audio/") for k in range(5)}
    assert sorted(unpacked_cache(packed).collect()) == sorted(rows.collect())


def test_state_calls_are_few():
    """Each call on a state is a round trip: two for a document's snapshot, however many chunks it has; nothing to tell is no frame."""
    from types import SimpleNamespace

    import pandas as pd

    class Value:
        calls, held = 0, None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, row):
            self.calls += 1
            self.held = row

    value = Value()
    fold = progress.ProgressFold()
    fold.init(SimpleNamespace(getValueState=lambda *a: value, registerTimer=lambda t: None))
    rows = pd.DataFrame({"total": [50] * 50, "idx": range(50), "status": ["done"] * 50, "at": [0] * 50, "job_status": [""] * 50})
    fold.handleInitialState((1,), rows, None)
    assert value.calls == 2  # one read and one write a document, not one a chunk
    stale = progress.StaleTimer(10)
    stale.init(SimpleNamespace(getValueState=lambda *a: Value(), registerTimer=lambda t: None, deleteTimer=lambda t: None))
    assert list(stale.handleInputRows((1, 1), iter([pd.DataFrame({"at": [5, 7], "stage": [1, 1]})]), None)) == []


class Cell:
    """A state value, and how often it was asked or told; also the handle that gives it."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, None, []

    def getValueState(self, *_):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def get(self):
        self.calls += 1
        return self.held

    def update(self, row):
        self.calls += 1
        self.held = row

    def clear(self):
        self.calls, self.held = self.calls + 1, None


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def started(processor):
    cell = Cell()
    processor.init(cell)
    return processor, cell


def test_progress_of_many_documents_is_one_call():
    import pandas as pd

    fold, cell = started(progress.ProgressFold(keep_ms=1_000))
    told = pd.DataFrame({"document_id": [1, 2, 3] * 2, "at": [5, 6, 7_000_000] * 2, "idx": [0, 0, 0, 1, -1, 1], "status": ["done"] * 4 + ["", "failed"], "job_status": [""] * 4 + ["succeeded", ""], "job_id": -1})
    (out,) = fold.handleInputRows((9,), iter([told]), Clock(0))
    assert [tuple(r)[:5] for r in out.itertuples(index=False)] == [(1, "progress", 2, 2, 0), (2, "succeeded", 1, 1, 0), (3, "progress", 2, 1, 1)]
    assert (cell.calls, cell.timers) == (2, [1_000])
    assert list(fold.handleExpiredTimer((9,), Clock(1_001), None)) == [] and cell.timers == [1_000, 8_000]
    assert set(fold._load()[0]) == {3}  # each document is forgotten in its own time


def test_usage_and_admissions_of_many_users_are_one_call():
    import pandas as pd

    day = 86_400_000_000
    told = pd.DataFrame({"user_id": [1, 2, 2, 1], "at": [0, day, 0, day + 1], "event_id": [1, 2, 3, 4], "chars": [5, 6, 7, 8]})
    rolling_usage, cell = started(rolling.RollingUsage(86_400))
    (out,) = rolling_usage.handleInputRows((9,), iter([told]), Clock(0))
    assert list(zip(out["user_id"], out["event_id"], out["rolling"], strict=True)) == [(1, 1, 5), (1, 4, 8), (2, 3, 7), (2, 2, 13)]
    assert cell.calls == 2 and len(cell.timers) == 1
    late = pd.DataFrame({"user_id": [2], "at": [1], "event_id": [5], "chars": [100]})
    (out,) = rolling_usage.handleInputRows((9,), iter([late]), Clock(0))
    assert list(zip(out["user_id"], out["event_id"], out["rolling"], strict=True)) == [(2, 5, 107), (2, 2, 113)]
    list(rolling_usage.handleExpiredTimer((9,), Clock(10 * 86_400_000), None))
    assert cell.held is None

    replay, cell = started(rolling.AdmissionReplay(12, 86_400))
    assert list(replay.handleInputRows((9,), iter([told]), Clock(0))) == [] and cell.calls == 2
    (out,) = replay.handleExpiredTimer((9,), Clock(86_400_000), None)
    assert list(out.itertuples(index=False, name=None)) == [(1, 0, 5, True), (2, 0, 7, True), (2, day, 6, False)]
    (out,) = replay.handleExpiredTimer((9,), Clock(86_400_001), None)
    assert list(out.itertuples(index=False, name=None)) == [(1, day + 1, 8, True)]


class OneTimer(Cell):
    """Also takes timers back."""

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_stale_work_of_many_chunks_is_one_call():
    import pandas as pd

    far = 2**53 + 1
    cell = OneTimer()
    stale = progress.StaleTimer(10)
    stale.init(cell)
    frame = lambda rows: pd.DataFrame(rows, columns=["document_id", "idx", "at", "stage"])
    told = frame([(1, 0, 5_000_000, 1), (far, 0, 6_000_000, 1), (1, 1, 5_000_000, 1), (1, 1, 5_000_000, 3), (2, 0, 1, 1), (2, 0, 700_000_000, 1)])
    assert list(stale.handleInputRows((9,), iter([told[:3], told[3:]]), Clock(0))) == []
    assert (cell.calls, cell.timers) == (2, [5_001])  # one read and one write, one timer: of two statuses at one time the one further on
    assert list(stale.handleInputRows((9,), iter([frame([(1, 1, 4_000_000, 1), (far, 0, 7_000_000, 1)])]), Clock(0))) == []
    cell.timers.remove(5_001)  # as it fires
    (out,) = stale.handleExpiredTimer((9,), Clock(605_000), None)
    assert list(out.itertuples(index=False, name=None)) == [(1, 0, 605_000)] and cell.timers == [607_000]
    assert list(stale.handleInputRows((9,), iter([frame([(2, 0, 700_000_000, 3)])]), Clock(605_000))) == [] and cell.timers == [607_000]
    cell.timers.clear()
    (out,) = stale.handleExpiredTimer((9,), Clock(700_001), None)
    assert list(out.itertuples(index=False, name=None)) == [(far, 0, 607_000)] and cell.held is None and cell.timers == []


def test_stale_work_is_the_same_in_every_split(spark, tmp_path):
    """Chunks of several documents share a group; a hot document's chunks are dealt out to many."""
    schema = "document_id long, idx int, status string, ts timestamp"
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 2**53 + 1]), rng.randrange(300), rng.choice(["processing", "processing", "done", "failed"]), at(rng.randrange(3600))) for _ in range(1500)]
    newest = {}
    for d, k, status, ts in rows:
        newest[d, k] = max(newest.get((d, k), (ts, 0)), (ts, progress.STAGES.index(status)))
    wanted = sorted((d, k, ts + dt.timedelta(minutes=10)) for (d, k), (ts, stage) in newest.items() if stage == 1 and ts + dt.timedelta(minutes=10) <= at(3600))
    for parts in (1, 4):
        batches = [rows[k::parts] for k in range(parts)] + [[(9, 0, "pending", at(3600 + 7200))]]  # the last one takes the watermark to an hour
        stream = progress.stale_stream(in_batches(spark, tmp_path, batches, schema, f"s{parts}"), delay="2 hours")
        got = drained(stream, "update").select("document_id", "idx", F.timestamp_millis("stale_at").cast("timestamp_ntz")).collect()
        assert sorted(map(tuple, got)) == wanted and wanted
    groups = {r.bucket for r in spark.range(300).selectExpr("1L AS document_id", "CAST(id AS INT) AS idx").select(progress.bucket("document_id", "idx")).collect()}
    assert len(groups) > 200


def test_a_snapshot_whose_join_is_shuffled(spark, monkeypatch):
    """As with long tables: orders aren't broadcast, and the chunks are dealt out to more tasks than the state."""
    from docflow.plans import stream_queries
    from docflow.sources import shared

    x2 = lambda: sorted(stream_queries.x2(spark, "/root/testdata/sf0.001").collect())
    usual = x2()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert x2() == usual
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_long_tables_are_not_broadcast(spark, monkeypatch):
    """Bytes of Parquet files tell little of how many rows the driver would hold."""
    from docflow.plans import adapters

    plan = lambda: adapters.view(spark, "/root/testdata/sf0.001", "chunks_v").select("document_id", "idx", "status")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(adapters, "BROADCAST_ROWS", 100)
    assert "Broadcast" not in plan() and "SortMergeJoin" in plan()


def test_quiet_documents_of_a_snapshot_are_held_as_columns():
    import pandas as pd

    fold, cell = started(progress.ProgressFold(keep_ms=10_000))
    far = 2**53 + 1
    rows = [(2, 3, 1, "done"), (far, 2, 0, "failed"), (2, 3, 0, "pending"), (2, 3, 0, "done"), (2, 3, 0, "strange"), (5, 1, 0, "done"), (7, 2, -1, None), (3, 1, 0, "failed")]
    table = pd.DataFrame(rows, columns=["document_id", "total", "idx", "status"]).assign(at=0, job_status="")
    table.loc[table["document_id"] == 5, "job_status"] = "succeeded"
    fold.handleInitialState((9,), table[:3], None)
    fold.handleInitialState((9,), table[3:], None)
    assert set(fold._load()[0]) == {5} and len(cell.held[2]) == 8 * 7  # an object for the one with an end, columns for the rows of the others
    told = pd.DataFrame({"document_id": [3], "at": [5_000_000], "idx": [0], "status": ["done"], "job_status": [""], "job_id": [-1]})
    (out,) = fold.handleInputRows((9,), iter([told]), Clock(0))
    assert [tuple(r) for r in out.itertuples(index=False)] == [(3, "snapshot", 1, 0, 1, 0, 1), (3, "progress", 1, 1, 0, 0, 2)]
    out = pd.concat(list(fold.handleExpiredTimer((9,), Clock(5_000), None)))
    assert sorted(tuple(r) for r in out.itertuples(index=False)) == [(2, "snapshot", 3, 2, 0, 1, 1), (5, "snapshot", 1, 1, 0, 0, 1), (5, "succeeded", 1, 1, 0, 0, 2), (7, "snapshot", 2, 0, 0, 2, 1), (far, "snapshot", 2, 0, 1, 1, 1)]
    assert list(fold.handleExpiredTimer((9,), Clock(5_001), None)) == []  # once
    told = told.assign(document_id=2, at=6_000_000, idx=2)
    (out,) = fold.handleInputRows((9,), iter([told]), Clock(5_001))
    assert [tuple(r) for r in out.itertuples(index=False)] == [(2, "progress", 3, 3, 0, 0, 2)]  # what was told before isn't told again
    assert list(fold.handleExpiredTimer((9,), Clock(15_000), None)) == [] and set(fold._load()[0]) == {2}
    assert list(fold.handleExpiredTimer((9,), Clock(16_000), None)) == [] and cell.held is None
