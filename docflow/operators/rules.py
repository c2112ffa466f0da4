"""Per-user rewrite rules: validation, upsert, listing, application to texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import literal_replacement, rule_regex, trim

#: Up to so many rules are broadcast (300 characters each at most); beyond, a shuffled join.
BROADCAST_RULES = 100_000


def validate_rules(rules: DataFrame) -> DataFrame:
    """``rules`` trimmed, with ``reason``: null if the rule is valid."""
    trimmed = rules.withColumn("pattern", trim(F.coalesce("pattern", F.lit("")))).withColumn("replacement", F.coalesce("replacement", F.lit("")))
    reason = (
        F.when(F.col("pattern") == "", F.lit("pattern is empty"))
        .when(F.length("pattern") > 100, F.lit("pattern is over 100 characters"))
        .when(F.length("replacement") > 200, F.lit("replacement is over 200 characters"))
    )
    return trimmed.withColumn("reason", reason)


def newest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert_rules(rules: DataFrame) -> DataFrame:
    """The newest rule of each user and pattern."""
    return newest(rules, ["user_id", "pattern"], "created_at", "replacement")


def list_rules(rules: DataFrame) -> DataFrame:
    return rules.select("user_id", "pattern", "replacement", "created_at").orderBy("user_id", "created_at", "pattern")


def apply_rules(docs: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (user_id, text) with each user's rules applied, longest pattern first.

    Each rule runs once over the text as the rules before it left it; ties go by created_at, then
    pattern. Users without rules keep their texts.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.length("pattern")).alias("o"), "created_at", "pattern", rule_regex(F.col("pattern")).alias("re"), literal_replacement(F.col("replacement")).alias("by")))
    )
    per_user = rules.where("pattern <> ''").groupBy("user_id").agg(ordered.alias("_rules"))
    side = F.broadcast(per_user) if rules.count() <= BROADCAST_RULES else per_user.hint("merge")
    applied = F.aggregate(F.col("_rules"), F.col(text), lambda acc, r: F.regexp_replace(acc, r["re"], r["by"]))
    return docs.join(side, "user_id", "left").withColumn(text, F.coalesce(applied, F.col(text))).drop("_rules")
