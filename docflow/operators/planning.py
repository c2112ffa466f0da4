"""Settings, cache probes and cost plans of chunks before anything is paid for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import content_hash
from docflow.operators.chunks import DEFAULT_MAX_CHARS, chunk_text
from docflow.operators.rules import apply_rules, newest
from docflow.operators.usage import DAILY_QUOTA, check_quota
from docflow.sources.shared import written


def resolve_settings(df: DataFrame, providers: DataFrame, default: str) -> DataFrame:
    """``df`` with provider, voice_id, model_id filled in, and ``error`` for unknown providers.

    ``providers`` (name, voice, model) is a short configuration table.
    """
    named = df.withColumn("provider", F.coalesce(F.nullif("provider", F.lit("")), F.lit(default)))
    known = F.broadcast(providers.select(F.col("name").alias("_name"), F.col("voice").alias("_voice"), F.col("model").alias("_model")))
    joined = named.join(known, F.col("provider") == F.col("_name"), "left")
    return joined.withColumns(
        {
            "voice_id": F.when(F.col("_name").isNotNull(), F.coalesce(F.nullif("voice_id", F.lit("")), "_voice")),
            "model_id": F.when(F.col("_name").isNotNull(), F.coalesce(F.nullif("model_id", F.lit("")), "_model")),
            "error": F.when(F.col("_name").isNull(), F.concat(F.lit("unknown provider "), "provider")),
        }
    ).drop("_name", "_voice", "_model")


def with_hash(chunks: DataFrame, voice: str, model: str, provider: str = "alpha") -> DataFrame:
    return chunks.withColumn("content_hash", content_hash(F.col("text"), F.lit(voice), F.lit(model), F.lit(provider)))


def cache_probe(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """``chunks`` with cache_path: that of the user's cached audio of the same content, else null.

    Defined cases: of several cached rows the smallest path counts; a null user or hash is never
    cached; repeated chunks each stay; an empty cache leaves all chunks without a path.
    """
    known = cache.groupBy("user_id", "content_hash").agg(F.min("path").alias("cache_path"))
    return chunks.join(known, ["user_id", "content_hash"], "left")


def cache_hits(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.join(cache, ["user_id", "content_hash"], "left_semi")


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.join(cache, ["user_id", "content_hash"], "left_anti")


def plan_summary(probed: DataFrame, *keys: str) -> DataFrame:
    """Per document: chunks, cached ones, and characters to bill; repeats of a miss are all billed.

    A row with a null hash stands for a document without chunks.
    """
    missed = F.col("cache_path").isNull()
    return probed.groupBy(*keys).agg(
        F.count("content_hash").alias("chunks"),
        F.count_if(~missed).alias("cached_count"),
        F.coalesce(F.sum(F.when(missed, F.col("char_count"))), F.lit(0)).cast("long").alias("billable_chars"),
        F.coalesce(F.sum("char_count"), F.lit(0)).cast("long").alias("total_chars"),
    )


def plan_chunks(docs: DataFrame, rules: DataFrame, voice: str, model: str, provider: str = "alpha", max_chars: int = DEFAULT_MAX_CHARS) -> DataFrame:
    """Hashed chunks of ``docs`` (document_id, user_id, text) after their users' rules, written once.

    A document without words (a null text too) has one row whose idx and hash are null.
    """
    ruled = apply_rules(docs.select("document_id", "user_id", "text"), rules)
    made = with_hash(chunk_text(ruled, max_chars, key="document_id", keep=("user_id",), outer=True), voice, model, provider)
    return written(made.withColumn("content_hash", F.when(F.col("text").isNotNull(), F.col("content_hash"))), "planned-chunks")


def submit_plan(chunks: DataFrame, cache: DataFrame, used: DataFrame, quota: int = DAILY_QUOTA) -> DataFrame:
    """What each document of :func:`plan_chunks` costs, next to what its user has left.

    ``used`` (user_id, used) is what a user spent in the running window; each document is judged
    for itself. ``problem`` tells why a document isn't taken: it has no words, or it costs more
    than remains. Defined cases: a user without usage, or a null one, has spent nothing; null ids
    are keys like others, but a null user has no cache; repeated cache rows count once; empty
    tables give no rows.
    """
    summary = plan_summary(cache_probe(chunks, cache), "document_id", "user_id")
    spent = used.groupBy("user_id").agg(F.sum("used").alias("used"))
    told = summary.join(spent, "user_id", "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("long"))
    checked = check_quota(told.withColumn("want", F.col("billable_chars")), quota)
    return checked.withColumn("problem", F.when(F.col("chunks") == 0, "no words").when(~F.col("ok"), "over quota"))


def chunk_rows(probed: DataFrame) -> DataFrame:
    """Chunk rows to insert: a hit is done and from the cache, a miss is pending."""
    hit = F.col("cache_path").isNotNull()
    return probed.select(
        "document_id", "user_id", "idx", "char_count", "content_hash", "paragraph_idx",
        F.when(hit, "done").otherwise("pending").alias("status"), F.col("cache_path").alias("path"), hit.alias("from_cache"),
    )


def synthesis_plan(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``paid``: only a user's first chunk of some content costs a call."""
    order = Window.partitionBy("user_id", "content_hash").orderBy("document_id", "idx")
    return chunks.withColumn("paid", F.row_number().over(order) == 1)


def estimate(docs: DataFrame, summary: DataFrame, usage: DataFrame, quota: int) -> DataFrame:
    """Per document: its plan next to what its user has left."""
    left = docs.join(summary, "document_id").join(usage, "user_id", "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("long"))
    return left.select(
        "document_id", "user_id", "title", "total_chars", "chunks", "cached_count", "billable_chars", "used",
        F.greatest(F.lit(0), F.lit(quota) - F.col("used")).cast("long").alias("remaining"),
        F.lit(quota).cast("long").alias("quota"), (F.col("used") + F.col("billable_chars") <= quota).alias("fits"),
    )


def preview_plan(users: DataFrame, voices: DataFrame, cache: DataFrame, sentence: str) -> DataFrame:
    """(user, voice) pairs whose preview isn't cached; ``voices`` is a short configuration table."""
    rows = F.array_sort(F.collect_list(F.struct("provider", "voice_id", "model_id")))
    listed = voices.agg(rows.alias("v"))  # one row
    pairs = users.select("user_id").join(F.broadcast(listed)).select("user_id", F.inline("v"))
    hashed = pairs.withColumn("content_hash", content_hash(F.lit(sentence), F.col("voice_id"), F.col("model_id"), F.col("provider")))
    return hashed.join(cache.select("user_id", "content_hash").hint("merge"), ["user_id", "content_hash"], "left_anti")


def voice_catalogue(providers: DataFrame) -> DataFrame:
    """One row a voice of each provider's JSON list; the description joins its non-empty labels."""
    schema = "array<struct<voice_id:string,name:string,labels:struct<accent:string,description:string>>>"
    each = providers.select("provider", "is_default", F.explode(F.from_json("voices", schema)).alias("v"))
    labels = F.filter(F.array("v.labels.accent", "v.labels.description"), lambda x: x.isNotNull() & (x != ""))
    return each.select("provider", "is_default", "v.voice_id", "v.name", F.array_join(labels, ", ").alias("description"))


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The union of both, the newest row of each user and content."""
    return newest(cache.unionByName(new), ["user_id", "content_hash"], "created_at", "path")


def replace_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    """One asset a document: the new one where there is one."""
    return old.join(new.select("document_id"), "document_id", "left_anti").unionByName(new)
