"""Timelines of narrated chunks, chapters, and where a listener is in them. Times are whole ms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import chapter_title

SENTENCE_MS, PARAGRAPH_MS = 350, 750
#: Width of the buckets in which positions look for starts; a chunk lasts some seconds.
BUCKET_MS = 60_000


def _by_idx():
    return Window.partitionBy("document_id").orderBy("idx")


def assembly_ready(chunks: DataFrame) -> DataFrame:
    """document_id, unfinished, ready: every chunk done with a path."""
    whole = (F.col("status") == "done") & F.col("path").isNotNull()
    return chunks.groupBy("document_id").agg(F.count_if(~whole).alias("unfinished"), F.bool_and(whole).alias("ready"))


def timeline(chunks: DataFrame, sentence_ms: int = SENTENCE_MS, paragraph_ms: int = PARAGRAPH_MS) -> DataFrame:
    """document_id, idx, paragraph_idx, start_ms, end_ms: durations and pauses before each chunk.

    The pause is longer after a paragraph's end; a missing duration counts as 0.
    """
    duration = F.coalesce("duration_ms", F.lit(0)).cast("long")
    pause = F.when(F.col("ends_paragraph"), paragraph_ms).otherwise(sentence_ms)
    start = F.coalesce(F.sum(duration + pause).over(_by_idx().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return chunks.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + duration).select("document_id", "idx", "paragraph_idx", "start_ms", "end_ms")


def chapters(lines: DataFrame) -> DataFrame:
    """document_id, chapter_no, paragraph_idx, start_ms: one at each change of paragraph, in order."""
    changed = ~F.col("paragraph_idx").eqNullSafe(F.lag("paragraph_idx").over(_by_idx())) | (F.row_number().over(_by_idx()) == 1)
    starts = lines.withColumn("_new", changed).where("_new")
    return starts.select("document_id", (F.row_number().over(_by_idx()) - 1).alias("chapter_no"), "idx", "paragraph_idx", "start_ms")


def titled(starts: DataFrame, texts: DataFrame) -> DataFrame:
    """``starts`` with the title from the text of the chapter's first chunk, null if there is none.

    Texts may come from a generator, whose size Spark can't tell, so the join is always by sort.
    """
    return starts.join(texts.hint("merge").select("document_id", "idx", chapter_title(F.col("text")).alias("title")), ["document_id", "idx"], "left")


def asset_totals(chunks: DataFrame, lines: DataFrame, bytes_per_ms: int = 16) -> DataFrame:
    """document_id, duration_ms, byte_size (at a constant bit rate), chapters."""
    marks = chapters(lines).groupBy("document_id").agg(F.count(F.lit(1)).alias("chapters"))
    ends = lines.groupBy("document_id").agg(F.max("end_ms").alias("duration_ms"))
    return ends.join(marks, "document_id").select("document_id", "duration_ms", (F.col("duration_ms") * bytes_per_ms).alias("byte_size"), "chapters")


def pack_asset(lines: DataFrame) -> DataFrame:
    """document_id, timeline: the lines in order as an array."""
    return lines.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("idx", "paragraph_idx", "start_ms", "end_ms"))).alias("timeline"))


def unpack_asset(packed: DataFrame) -> DataFrame:
    return packed.select("document_id", F.inline("timeline"))


def read_along(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Chunks with their times; those that the timeline lacks stay without.

    Defined cases: chunks with a null key stay without times; repeated chunks each stay, repeated
    lines give a row each; empty lines leave all chunks without times.
    """
    return chunks.join(lines.select("document_id", "idx", "start_ms", "end_ms"), ["document_id", "idx"], "left")


def _as_of(positions: DataFrame, starts: DataFrame, value: str, tol_ms: int, bucket_ms: int) -> DataFrame:
    """``positions`` (document_id, position_id, position_ms) with ``value`` of the last start by then.

    Time is cut into buckets. A document's positions are spread over tasks by bucket, each looks among
    the starts of its own bucket, and what the buckets before left off with is carried over by a scan
    of one short row a bucket. Positions are never sorted; a bucket that many ask for is a join key
    that adaptive execution splits, as only its few starts would be copied.

    Of starts at the same time the largest value counts. Starts without a document, time or value
    don't count; positions without a document or time, or before the first start, find null; repeated
    positions each stay.
    """

    def bucket(t: Column) -> Column:
        return F.floor(t / bucket_ms).alias("_bucket")

    asked = positions.select("document_id", "position_id", "position_ms", (F.col("position_ms") + tol_ms).alias("_t")).select("*", bucket(F.col("_t")))
    mark = F.struct(F.col("start_ms").alias("t"), F.col(value).cast("int").alias("v"))
    known = starts.where(F.col("start_ms").isNotNull() & F.col(value).isNotNull()).select("document_id", bucket(F.col("start_ms")), mark.alias("_mark"))
    both = known.unionByName(asked.select("document_id", "_bucket"), allowMissingColumns=True).where("document_id IS NOT NULL AND _bucket IS NOT NULL")
    grid = both.groupBy("document_id", "_bucket").agg(F.array_sort(F.collect_list("_mark")).alias("_marks"))
    earlier = Window.partitionBy("document_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_carried", F.last(F.get("_marks", F.size("_marks") - 1)["v"], ignorenulls=True).over(earlier))
    met = asked.join(grid.hint("merge"), ["document_id", "_bucket"], "left")
    own = F.filter("_marks", lambda m: m["t"] <= F.col("_t"))
    found = F.coalesce(F.get(own, F.size(own) - 1)["v"], "_carried")
    return met.select("document_id", "position_id", "position_ms", found.alias(value))


def active_chunk(positions: DataFrame, lines: DataFrame, tol_ms: int = 50, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """idx of the chunk that is read at each position, -1 where there is none yet."""
    found = _as_of(positions, lines, "idx", tol_ms, bucket_ms)
    return found.withColumn("idx", F.coalesce("idx", F.lit(-1)))


def active_chapter(positions: DataFrame, starts: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """chapter_no at each position, 0 where there is none yet."""
    found = _as_of(positions, starts, "chapter_no", 0, bucket_ms)
    return found.withColumn("chapter_no", F.coalesce("chapter_no", F.lit(0)))


def regroup_paragraphs(chunks: DataFrame) -> DataFrame:
    """document_id, group_no, paragraph_idx, chunks: runs of chunks of one paragraph, in order."""
    changed = ~F.col("paragraph_idx").eqNullSafe(F.lag("paragraph_idx").over(_by_idx()))
    numbered = chunks.withColumn("_c", changed.cast("int")).withColumn("group_no", F.sum("_c").over(_by_idx()))
    return numbered.groupBy("document_id", "group_no", "paragraph_idx").agg(F.array_sort(F.collect_list("idx")).alias("idxs"))


def resume_point(positions: DataFrame, assets: DataFrame, margin_ms: int = 5000) -> DataFrame:
    """``positions`` with resume_ms: 0 near the start, near the end, or without an asset.

    Defined cases: ``assets`` has one row a document; a null document, position or duration gives 0;
    positions at the margins give 0; repeated positions each stay.
    """
    joined = positions.join(assets.select("document_id", "duration_ms"), "document_id", "left")
    inside = (F.col("position_ms") > margin_ms) & (F.col("position_ms") < F.col("duration_ms") - margin_ms)
    return joined.withColumn("resume_ms", F.when(inside, F.col("position_ms")).otherwise(F.lit(0)).cast("long"))


def latest_position(updates: DataFrame) -> DataFrame:
    """user_id, document_id, position_ms, updated_at: last write wins; negative ones are refused."""
    last = F.max_by(F.struct("position_ms", "updated_at"), F.struct("updated_at", "position_id"))
    return updates.where("position_ms >= 0").groupBy("user_id", "document_id").agg(last.alias("x")).select("user_id", "document_id", "x.position_ms", "x.updated_at")


def throttle(df: DataFrame, key: list[str], ts: str, ms: int = 5000) -> DataFrame:
    """key, ts: only what comes over ``ms`` after the last row kept before it.

    What is kept depends on what was kept, so times are folded in order. A row that comes over
    ``ms`` after the row before it is always kept, so each run between such pauses is folded for
    itself, and a busy key is many small arrays. Null times are dropped.
    """
    times = df.select(*key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")).where("_us IS NOT NULL")
    order = Window.partitionBy(*key).orderBy("_us")
    pause = F.coalesce(F.col("_us") - F.lag("_us").over(order) > ms * 1000, F.lit(False))
    runs = times.withColumn("_pause", pause.cast("int")).withColumn("_run", F.sum("_pause").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.array().cast("array<bigint>")
    kept = F.aggregate(
        F.array_sort(F.collect_list("_us")), start, lambda acc, t: F.when((F.size(acc) == 0) | (t - F.coalesce(F.element_at(acc, -1), t) > ms * 1000), F.concat(acc, F.array(t))).otherwise(acc)
    )
    folded = runs.groupBy(*key, "_run").agg(kept.alias("_kept"))
    return folded.select(*key, F.explode("_kept").alias("_us")).select(*key, F.timestamp_micros("_us").alias(ts))
