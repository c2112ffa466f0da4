"""Stream queries: each drains the event log once; SQL restates those that have a closed form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.functions.text import content_hash
from docflow.operators import jobs, timeline
from docflow.operators.rules import newest
from docflow.plans import state_queries  # noqa: F401  its SQL is used below
from docflow.plans.adapters import oracle, table, view
from docflow.plans.registry import ORACLES, query
from docflow.sources.readers import read_events
from docflow.sources.shared import parts_for, shared_dir, written
from docflow.sources.sinks import UpsertTable, chunk_table, replace_rows, write_progress
from docflow.streaming import progress, usage
from docflow.streaming.run import drained


def _events(s: SparkSession, d: str) -> DataFrame:
    return read_events(s, d, "events.parquet")


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _chunk_events(s: SparkSession, d: str) -> DataFrame:
    """The event log as chunk and job events: a user is a document, k a chunk."""
    kind = F.col("event_type")
    status = F.when(kind.isin("click", "purchase"), "done").when(kind == "error", "failed").when(kind == "view", "processing")
    ended = F.when((kind == "signup") & (F.col("value") > 250), "succeeded")
    told = _events(s, d).where((kind != "signup") | ended.isNotNull())
    return told.select(F.col("user_id").alias("document_id"), F.when(status.isNotNull(), _k()).alias("idx"), status.alias("status"), ended.alias("job_status"), "ts")


#: Of two statuses at one time the one further on.
_STAGE = "CASE status WHEN 'done' THEN 3 WHEN 'failed' THEN 2 ELSE 1 END"
#: Chunk and job events as above; the last status of each chunk up to the last end of a job of its document.
_LAST = f"""e AS (SELECT user_id AS document_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'done' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'processing' END AS status,
  CAST(json_extract_string(props, '$.k') AS INT) AS idx, CASE WHEN event_type = 'signup' AND value > 250 THEN 'succeeded' END AS job_status, ts FROM events WHERE event_type <> 'signup' OR value > 250),
  d AS (SELECT document_id, max(ts) FILTER (WHERE job_status IS NOT NULL) AS ended FROM e GROUP BY document_id),
  l AS (SELECT document_id, idx, status FROM (SELECT e.*, row_number() OVER (PARTITION BY e.document_id, idx ORDER BY ts DESC, {_STAGE} DESC) AS r FROM e JOIN d ON e.document_id = d.document_id
    WHERE status IS NOT NULL AND idx IS NOT NULL AND (ended IS NULL OR ts <= ended)) WHERE r = 1)"""
_COUNTS = "count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed"


@query("s5_write_chunks", oracle("SELECT document_id, idx, status FROM chunks_v", "chunks_v"))
def s5(s, d):
    with chunk_table(view(s, d, "chunks_v").select("document_id", "idx", "status"), buckets=parts_for(table(s, d, "lineitem"), 8)) as stored:
        return written(stored, "chunks")


@query("s5_read_along_buckets", oracle(f"""SELECT t.document_id, t.idx, c.status, t.start_ms, t.end_ms, p.done, p.total FROM ({state_queries.TIMELINE}) t
  JOIN chunks_v c ON c.document_id = t.document_id AND c.idx = t.idx JOIN ({state_queries.PROGRESS}) p ON p.document_id = t.document_id""", "chunks_v"))
def s5_buckets(s, d):
    """Timeline, chunks and progress of each document, all from the buckets of one stored table."""
    with chunk_table(view(s, d, "chunks_v"), buckets=parts_for(table(s, d, "lineitem"), 8)) as stored:
        return written(along_with_progress(stored), "along")


def along_with_progress(chunks: DataFrame) -> DataFrame:
    """document_id, idx, status, start_ms, end_ms, done, total."""
    along = timeline.read_along(chunks, timeline.timeline(chunks).hint("merge"))
    counts = jobs.document_progress(chunks).select("document_id", "done", "total")
    return along.join(counts.hint("merge"), "document_id").select("document_id", "idx", "status", "start_ms", "end_ms", "done", "total")


@query("s6_upsert_stream", ORACLES["s6_upsert_cache"])
def s6_stream(s, d):
    """The cache grows by a stream of chunks; each micro-batch is merged once."""
    chunks = s.readStream.schema(table(s, d, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    owners = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    owned = chunks.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))  # hashes are made behind the exchange
    made = owned.withColumn("content_hash", F.sha2(F.col("l_partkey").cast("string"), 256))
    new = state_queries.packed_cache(made.select("user_id", "content_hash", F.concat(F.lit("new/"), "content_hash", F.lit(".mp3")).alias("path"), F.col("l_shipdate").alias("created_at")))
    old = state_queries.packed_cache(view(s, d, "cache_rows_v").withColumn("created_at", F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")))
    folder = f"{shared_dir(s)}/docflow-streams/{uuid.uuid4().hex}"
    cache = UpsertTable(s, f"{folder}/cache", new.schema, ["user_id", "content_hash"], ["created_at", "path"])
    cache.load(old)
    cache.follow(new, f"{folder}/checkpoint").awaitTermination()
    cache.compact()
    return state_queries.unpacked_cache(cache.read())


@query("s7_replace_partitions", ORACLES["s7_replace_assets"])
def s7_partitions(s, d):
    """Assets in partitions by document; those of a new asset are written again, the others stay."""
    path = f"{shared_dir(s)}/docflow-tables/assets-{uuid.uuid4().hex}"
    old = newest(view(s, d, "assets_v"), ["document_id"], "created_at", "id").select("document_id", "id", "path")
    replace_rows(old, path, ["document_id"], ["id"], parts=16)
    new = old.where("document_id % 3 = 0").select("document_id", (F.col("id") + 1_000_000).alias("id"), F.lit("new").alias("path"))
    replace_rows(new, path, ["document_id"], ["id"], parts=16)
    return s.read.parquet(path).drop("part")


@query("s8_event_log", "SELECT event_id, user_id, event_type, value FROM events")
def s8(s, d):
    path = f"{shared_dir(s)}/docflow-streams/{uuid.uuid4().hex}"
    log = _events(s, d).select("event_id", "user_id", "event_type", "value")
    write_progress(log, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return s.read.schema(log.schema).parquet(f"{path}/out")


@query("x1_progress_stream", f"""WITH {_LAST}, c AS (SELECT document_id, count(*) AS total, {_COUNTS} FROM l GROUP BY document_id)
  SELECT d.document_id, CASE WHEN ended IS NULL THEN 'progress' ELSE 'succeeded' END AS kind, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed,
  coalesce(total - done - failed, 0) AS pending FROM d LEFT JOIN c ON d.document_id = c.document_id""")
def x1(s, d):
    return progress.last_rows(drained(progress.progress_stream(_chunk_events(s, d)), "update")).drop("seq")


@query("x2_snapshot_then_stream", oracle(f"""WITH {_LAST}, t AS (SELECT document_id, count(*) AS total, {_COUNTS} FROM chunks_v GROUP BY document_id),
  u AS (SELECT * FROM l UNION ALL SELECT v.document_id, v.idx, v.status FROM chunks_v v WHERE v.status IN ('done', 'failed') AND NOT EXISTS (SELECT 1 FROM l WHERE l.document_id = v.document_id AND l.idx = v.idx)),
  c AS (SELECT document_id, count(*) AS n, {_COUNTS} FROM u GROUP BY document_id)
  SELECT document_id, 'snapshot' AS kind, total, done, failed, total - done - failed AS pending FROM t
  UNION ALL SELECT d.document_id, CASE WHEN ended IS NULL THEN 'progress' ELSE 'succeeded' END, coalesce(t.total, n, 0), coalesce(c.done, 0), coalesce(c.failed, 0),
  greatest(0, coalesce(t.total, n, 0) - coalesce(c.done, 0) - coalesce(c.failed, 0)) FROM d LEFT JOIN t ON d.document_id = t.document_id LEFT JOIN c ON d.document_id = c.document_id""", "chunks_v"))
def x2(s, d):
    total = F.count(F.lit(1)).over(Window.partitionBy("document_id"))
    # a table of its own: Spark plans a snapshot anew with each batch, and from the second on fails on a join of rows dealt out by repartition
    snapshot = written(view(s, d, "chunks_v").select("document_id", total.alias("total"), "idx", "status"), "snapshot")
    rows = drained(progress.progress_stream(_chunk_events(s, d), snapshot), "update")
    return rows.where("kind = 'snapshot'").unionByName(progress.last_rows(rows)).drop("seq")


@query("x3_until_terminal", """SELECT DISTINCT user_id AS document_id, 'succeeded' AS kind FROM events WHERE event_type = 'signup' AND value > 250""")
def x3(s, d):
    return drained(progress.until_terminal(_chunk_events(s, d)), "update").select("document_id", "kind").distinct()


#: A text is two sentences, which a budget of 24 keeps apart; what big errors said is cached.
@query("x4_chunk_stream", """WITH t AS (SELECT user_id, event_type = 'error' AND value > 50 AS cached, unnest([event_type || '. Got ' || props || '.', 'It ended.']) AS text, unnest([0, 1]) AS idx FROM events),
  h AS (SELECT *, sha256('voice-a:model-a:' || text) AS content_hash FROM t)
  SELECT DISTINCT user_id, CAST(idx AS INT) AS idx, content_hash FROM h WHERE NOT EXISTS (SELECT 1 FROM h AS c WHERE c.cached AND c.idx = 0 AND c.user_id = h.user_id AND c.content_hash = h.content_hash)""")
def x4(s, d):
    """Which document tells a content first depends on the split into micro-batches, so contents are returned."""
    first = F.concat(F.col("event_type"), F.lit(". Got "), F.col("props"), F.lit("."))
    docs = _events(s, d).select(F.col("event_id").alias("document_id"), "user_id", F.concat(first, F.lit(" It ended.")).alias("text"), "ts")
    cache = table(s, d, "events").where("event_type = 'error' AND value > 50").select("user_id", content_hash(first, F.lit("voice-a"), F.lit("model-a")).alias("content_hash"))
    return drained(progress.chunk_stream(docs, cache, "voice-a", "model-a", 24), timers=False).select("user_id", "idx", "content_hash").distinct()


def _usage(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).where("event_type IN ('purchase', 'click')").select("user_id", "ts", F.floor(F.col("value") * 10).cast("long").alias("chars"))


@query("x5_usage_stream", oracle("""SELECT user_id, w AS window_start, w + INTERVAL 24 HOUR AS window_end, CAST(sum(chars) AS BIGINT) AS chars FROM (
  SELECT user_id, chars, unnest(range(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 1 HOUR, INTERVAL 6 HOUR)) AS w FROM usage_v) GROUP BY user_id, w""", "usage_v"))
def x5(s, d):
    return drained(progress.usage_stream(_usage(s, d), slide="6 hours"), "complete")


@query("x5_rolling_usage", ORACLES["q3_rolling_usage"])
def x5_exact(s, d):
    requests = _events(s, d).where("event_type IN ('purchase', 'click')").select("event_id", "user_id", "ts", F.floor(F.col("value") * 10).cast("long").alias("chars"))
    return usage.last_totals(drained(usage.rolling_usage_stream(requests), "update")).select("event_id", "user_id", "chars", "rolling")


#: The replay of the batch form, as far as the watermark has come.
@query("q4_admission_stream", ORACLES["q4_replay_admission"] + " WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM usage_v) - INTERVAL 1 HOUR")
def q4_stream(s, d):
    return drained(usage.admission_stream(_usage(s, d), quota=3000))


@query("x6_stale_stream", f"""WITH {_LAST}, s AS (SELECT * FROM e WHERE status IS NOT NULL),
  r AS (SELECT document_id, idx, status, ts, row_number() OVER (PARTITION BY document_id, idx ORDER BY ts DESC, {_STAGE} DESC) AS r FROM s WHERE idx IS NOT NULL)
  SELECT document_id, idx, epoch_us(ts) // 1000 + 600000 AS stale_at FROM r WHERE r = 1 AND status = 'processing' AND ts + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM s WHERE idx IS NOT NULL)""")
def x6(s, d):
    told = _chunk_events(s, d).where("status IS NOT NULL").select("document_id", "idx", "status", "ts")
    return drained(progress.stale_stream(told), "update")


@query("x7_rate_stream", """SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS requests, greatest(0, count(*) - 1) AS limited FROM events GROUP BY 1, 2""")
def x7(s, d):
    return drained(progress.rate_stream(_events(s, d).select("user_id", "ts"), 1), "complete")


@query("x8_position_stream", oracle("""SELECT user_id, document_id, position_ms, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, document_id
  ORDER BY updated_at DESC, position_id DESC) AS r FROM positions_v) WHERE r = 1""", "positions_v"))
def x8(s, d):
    views = _events(s, d).where("event_type = 'view'")
    updates = views.select(F.col("event_id").alias("position_id"), "user_id", _k().cast("long").alias("document_id"), F.floor(F.col("value") * 1000).cast("long").alias("position_ms"), "ts")
    return drained(progress.position_stream(updates), "complete")


@query("x8_upsert_positions", ORACLES["x8_position_stream"])
def x8_upsert(s, d):
    """As x8, without state: each micro-batch leaves its newest rows in a table of upserts."""
    views = _events(s, d).where("event_type = 'view' AND value >= 0")
    updates = views.select("user_id", _k().cast("long").alias("document_id"), F.floor(F.col("value") * 1000).cast("long").alias("position_ms"), F.col("ts").alias("updated_at"), F.col("event_id").alias("position_id"))
    folder = f"{shared_dir(s)}/docflow-streams/{uuid.uuid4().hex}"
    positions = UpsertTable(s, f"{folder}/positions", updates.schema, ["user_id", "document_id"], ["updated_at", "position_id"])
    positions.follow(updates, f"{folder}/checkpoint").awaitTermination()
    return positions.read().drop("position_id")
