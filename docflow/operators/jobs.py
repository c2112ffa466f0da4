"""Chunk and job state: claims, progress, retries, stale work, outcomes, errors, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import half_up

MAX_ATTEMPTS = 3
STALE_MINUTES = 10


def next_pending(chunks: DataFrame, k: int = 1) -> DataFrame:
    """The first ``k`` pending chunks of each document, as claimed: processing, one more attempt."""
    order = Window.partitionBy("document_id").orderBy("idx")
    first = chunks.where("status = 'pending'").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    return first.withColumn("attempts", F.col("attempts") + 1).withColumn("status", F.lit("processing"))


def document_progress(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "failed", "pending", "processing")]
    )


def progress_view(progress: DataFrame, jobs: DataFrame) -> DataFrame:
    """percent of finished chunks and the stage of the document's latest job."""
    latest = latest_per_document(jobs).select("document_id", F.col("status").alias("job_status"))
    finished = F.col("done") + F.col("failed")
    percent = F.when(F.col("total") > 0, half_up(100 * finished / F.col("total"))).otherwise(F.lit(0)).cast("long")
    assembling = F.coalesce(F.col("job_status") == "assembling", F.lit(False))
    voiced = assembling | ((F.col("total") > 0) & (finished >= F.col("total")))
    return progress.join(latest, "document_id", "left").select(
        "document_id", "total", finished.alias("finished"), percent.alias("percent"), "job_status",
        F.when(voiced, "done").otherwise("active").alias("voice"), F.when(assembling, "active").otherwise("pending").alias("stitch"),
    )


def chunk_grid(progress: DataFrame, known: DataFrame) -> DataFrame:
    """document_id, idx, cell: what events say, else "done" from the lowest idx while done ones last.

    ``known`` has (document_id, idx, status, cached), one row a chunk that an event told of. Defined
    cases: a total of 0 or null gives no cells; events of chunks beyond the total, or with a null
    key, are left out; a null count of done chunks is 0.
    """
    idx = F.when(F.col("total") > 0, F.sequence(F.lit(0), F.col("total").cast("int") - 1))
    cells = progress.select("document_id", F.coalesce("done", F.lit(0)).alias("done"), F.explode(idx).alias("idx"))
    joined = cells.hint("merge").join(known, ["document_id", "idx"], "left")
    unknown = F.col("status").isNull()
    before = F.count_if(unknown).over(Window.partitionBy("document_id").orderBy("idx"))
    told = F.when(F.col("status") == "failed", "failed").when(F.col("cached"), "cached").otherwise("done")
    cell = F.when(~unknown, told).when(before <= F.col("done"), F.lit("done")).otherwise(F.lit("pending"))
    return joined.select("document_id", "idx", cell.alias("cell"))


def exhausted(chunks: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Chunks whose next claim would be over the budget of attempts."""
    return chunks.where(F.col("attempts") + 1 > most)


def failure_status(df: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """``df`` (retryable, attempts, error) with status and the error cut to 500 characters."""
    again = F.col("retryable") & (F.col("attempts") < most)
    return df.withColumn("status", F.when(again, "pending").otherwise("failed")).withColumn("error", F.substring("error", 1, 500))


def calls_after_fatal(calls: DataFrame) -> DataFrame:
    """``calls`` (job_id, ts, status_code, ...) with suppressed: later than the job's first 401 or 429."""
    first = F.min(F.when(F.col("status_code").isin(401, 429), F.col("ts"))).over(Window.partitionBy("job_id"))
    return calls.withColumn("suppressed", F.coalesce(F.col("ts") > first, F.lit(False)))


def requeue_failed(chunks: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """``chunks`` with failed ones that have attempts left pending again, and ``requeued``."""
    again = (F.col("status") == "failed") & (F.col("attempts") < most)
    return chunks.withColumn("requeued", again).withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def reap_stale(chunks: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """``chunks`` with stale processing ones pending again (attempts stay), and ``reaped``."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return chunks.withColumn("reaped", stale).withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def reap_jobs(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """``jobs`` with stale running ones queued again, without a start."""
    stale = (F.col("status") == "running") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumn("reaped", stale).withColumns(
        {"status": F.when(stale, "queued").otherwise(F.col("status")), "started_at": F.when(~stale, F.col("started_at"))}
    )


def queue_head(jobs: DataFrame, k: int = 2) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy("created_at", "id").limit(k)


def latest_per_document(df: DataFrame, at: str = "created_at", tie: str = "id") -> DataFrame:
    order = Window.partitionBy("document_id").orderBy(F.desc(at), F.desc(tie))
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def active_documents(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "running")).select("document_id").distinct()


def resume_decision(chunks: DataFrame, jobs: DataFrame, assets: DataFrame) -> DataFrame:
    """Per document: refused while a job is active or nothing is left to do, else a new job."""
    after = requeue_failed(chunks)
    counts = after.groupBy("document_id").agg(
        F.count_if("requeued").alias("requeued"),
        F.count_if(F.col("status").isin("pending", "processing")).alias("outstanding"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    active = active_documents(jobs).withColumn("is_active", F.lit(True))
    built = assets.select("document_id").distinct().withColumn("has_asset", F.lit(True))
    joined = counts.join(active, "document_id", "left").join(built, "document_id", "left")
    nothing = (F.col("outstanding") == 0) & ((F.col("failed") > 0) | F.coalesce("has_asset", F.lit(False)))
    decision = (
        F.when(F.coalesce("is_active", F.lit(False)), "active")
        .when(nothing & (F.col("failed") > 0), "exhausted")
        .when(nothing, "complete")
        .otherwise("new job")
    )
    return joined.select("document_id", "requeued", "outstanding", "failed", decision.alias("decision"))


def job_outcome(chunks: DataFrame, fatal: DataFrame) -> DataFrame:
    """Per document: succeeded, or failed with a message; the rows are the truth.

    ``fatal`` has (document_id, message) of runs that a fatal answer stopped. Defined cases: of
    several messages the smallest counts, null ones don't; documents without chunks, and fatal
    answers of such, give no row; a null document is one that no fatal answer belongs to.
    """
    progress = document_progress(chunks).select("document_id", "failed")
    joined = progress.join(fatal.groupBy("document_id").agg(F.min("message").alias("fatal")), "document_id", "left")
    some = F.col("failed") > 0
    return joined.select(
        "document_id",
        F.when(some | F.col("fatal").isNotNull(), "failed").otherwise("succeeded").alias("status"),
        F.coalesce("fatal", F.when(some, F.concat(F.col("failed").cast("string"), F.lit(" failed chunks")))).alias("message"),
    )


def overview(docs: DataFrame, chunks: DataFrame, jobs: DataFrame, assets: DataFrame, positions: DataFrame) -> DataFrame:
    """Document, progress, latest job and asset, and position, one row a document."""
    job = latest_per_document(jobs).select("document_id", F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    asset = latest_per_document(assets).select("document_id", F.col("id").alias("asset_id"), "duration_ms")
    return (
        docs.join(document_progress(chunks), "document_id", "left")
        .join(job, "document_id", "left")
        .join(asset, "document_id", "left")
        .join(positions.select("user_id", "document_id", "position_ms"), ["user_id", "document_id"], "left")
    )


# Fixed value: reasons that tell of an exhausted allowance.
QUOTA_WORDS = "(?i)quota|character limit|exceeds your|out of characters"


def triage_errors(responses: DataFrame) -> DataFrame:
    """``responses`` (flavour, status, body, retry_after) with message, retryable, retry_after_ms.

    Flavour ``nested`` has its reason under detail (an object or a string), flavour ``plain`` under
    error.message; a null status is a network failure. A body that isn't JSON has no reason.
    """
    body = F.col("body")
    nested = F.col("flavour") == "nested"
    detail_text = F.get_json_object(body, "$.detail")
    inner = F.get_json_object(body, "$.detail.message")
    is_object = detail_text.rlike("^[{\\[]")
    reason = F.coalesce(
        F.when(nested, F.coalesce(F.nullif(inner, F.lit("")), F.when(~is_object, detail_text))).otherwise(F.get_json_object(body, "$.error.message")), F.lit("")
    )
    quota = (F.coalesce(F.get_json_object(body, "$.detail.status"), F.lit("")) == "quota_exceeded") | F.col("reason").rlike(QUOTA_WORDS)
    status = F.col("status")
    or_else = lambda text: F.coalesce(F.nullif(F.col("reason"), F.lit("")), text if isinstance(text, Column) else F.lit(text))
    numbered = lambda text: F.concat(F.lit(text), status.cast("string"))
    message = (
        F.when(status.isNull(), F.lit("network error"))
        .when((status == 401) & nested & quota, F.concat(F.lit("monthly quota reached: "), "reason"))
        .when((status == 401) & ~nested, F.lit("invalid key"))
        .when(status == 401, or_else("invalid key"))
        .when((status == 422) & nested, or_else("rejected as invalid"))
        .when(status == 429, or_else("rate limit or quota exceeded"))
        .when(status >= 500, or_else(numbered("server error ")))
        .otherwise(or_else(numbered("error ")))
    )
    wait = F.when(status == 429, F.expr("try_cast(retry_after AS DOUBLE)") * 1000).cast("long")
    return responses.withColumn("reason", reason).withColumns(
        {"message": message, "retryable": status.isNull() | (status == 429) | (status >= 500), "retry_after_ms": wait}
    ).drop("reason")


def public_status(df: DataFrame, preview: bool = False) -> DataFrame:
    """``df`` (status, retryable) with what a caller gets to see."""
    status = F.col("status")
    if preview:
        seen = F.when(status == 429, 503).when(F.col("retryable"), 502).otherwise(400)
    else:
        seen = F.when(status == 429, 503).when(status == 422, 400).otherwise(500)
    return df.withColumn("public_status", seen)


def retry_schedule(failures: DataFrame, attempts: int = 4, base_ms: int = 500, max_ms: int = 15_000) -> DataFrame:
    """``failures`` (retryable, retry_after_ms, jitter 0..1), one row a wait: attempt, wait_ms.

    Permanent failures have no waits. A server's own wait wins over backoff times (0.5 + jitter).
    """
    each = failures.where("retryable").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts - 1))))
    backoff = F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.col("attempt") - 1), F.lit(float(max_ms)))
    return each.withColumn("wait_ms", F.coalesce("retry_after_ms", half_up(backoff * (F.lit(0.5) + F.col("jitter")))))


def hashed_jitter(*keys: str) -> Column:
    """A jitter in 0..1 that the keys determine."""
    return F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) / F.lit(1_000_000.0)


def notification_outbox(jobs: DataFrame, users: DataFrame, docs: DataFrame) -> DataFrame:
    """Mails to send: finished and not skipped jobs of known users with an address, guests excepted."""
    ended = jobs.where(F.col("status").isin("succeeded", "failed") & ~F.coalesce("skipped", F.lit(False)))
    known = users.where("email IS NOT NULL AND email <> '' AND NOT is_anonymous").select("user_id", "email")
    joined = ended.join(known, "user_id").join(docs.select("document_id", "title"), "document_id", "left").withColumn("title", F.coalesce("title", F.lit("Untitled")))
    ok = F.col("status") == "succeeded"
    quoted = F.concat(F.lit('"'), "title", F.lit('"'))
    subject = F.when(ok, F.concat(quoted, F.lit(" is ready"))).otherwise(F.concat(quoted, F.lit(" has no audio yet")))
    failure = F.concat(F.lit("The work on "), quoted, F.lit(" ended with this problem: "), F.coalesce("error", F.lit("none was given")))
    body = F.when(ok, F.concat(F.lit("The audio of "), quoted, F.lit(" has finished."))).otherwise(failure)
    return joined.select("id", "user_id", "email", subject.alias("subject"), body.alias("body"))


def history(conversions: DataFrame, user: int) -> DataFrame:
    return conversions.where(F.col("user_id") == user).orderBy(F.desc("ts"))
