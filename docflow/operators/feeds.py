"""Podcast feeds as rendered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import escape_xml, half_up, http_date


def feed_items(assets: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """Assets with a link, with title, whole seconds, length and a lasting guid."""
    titles = docs.select("user_id", "document_id", F.col("title").alias("doc_title"))
    return (
        assets.join(links.select("path", "url"), "path")
        .where("url IS NOT NULL")
        .join(titles, ["user_id", "document_id"], "left")
        .select(
            "user_id", "document_id", "created_at", "url", F.coalesce(F.nullif("doc_title", F.lit("")), F.lit("Untitled")).alias("title"),
            half_up(F.coalesce("duration_ms", F.lit(0)) / 1000).alias("seconds"), F.coalesce("byte_size", F.lit(0)).cast("long").alias("length"),
            F.concat(F.lit("docflow-"), F.col("document_id").cast("string")).alias("guid"),
        )
    )


def render_items(items: DataFrame) -> DataFrame:
    xml = F.concat(
        F.lit("<item><title>"), escape_xml(F.col("title")), F.lit('</title><guid isPermaLink="false">'), F.col("guid"), F.lit("</guid><pubDate>"),
        http_date(F.col("created_at")), F.lit('</pubDate><enclosure url="'), escape_xml(F.col("url")), F.lit('" length="'), F.col("length").cast("string"),
        F.lit('" type="audio/mpeg"/><itunes:duration>'), F.col("seconds").cast("string"), F.lit("</itunes:duration></item>"),
    )
    return items.withColumn("xml", xml)


def render_feeds(users: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, xml: one channel a user, newest item first; a user without items has an empty one."""
    newest_first = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("o"), "document_id", "xml")))
    body = render_items(items).groupBy("user_id").agg(F.array_join(F.transform(newest_first, lambda x: x["xml"]), "\n").alias("items"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>Library</title>\n'
    xml = F.concat(F.lit(head), F.coalesce("items", F.lit("")), F.lit("\n</channel></rss>"))
    return users.select("user_id").join(body, "user_id", "left").select("user_id", xml.alias("xml"))


def resolve_tokens(requests: DataFrame, feeds: DataFrame) -> DataFrame:
    """Requests with the user whose token they carry; unknown tokens yield nothing."""
    return requests.join(feeds.select("token", "user_id"), "token")
