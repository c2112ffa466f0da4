"""Ownership and constraint audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scope(df: DataFrame, user: int, column: str = "user_id") -> DataFrame:
    return df.where(F.col(column) == user)


def foreign_objects(objects: DataFrame, bucket: str) -> DataFrame:
    """Objects of ``bucket`` (bucket, path, owner) whose first folder isn't their owner's."""
    return objects.where((F.col("bucket") == bucket) & ~F.split("path", "/")[0].eqNullSafe(F.col("owner").cast("string")))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def domain_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of those they break; null breaks none, as in SQL checks."""
    broken = F.array_compact(F.array(*[F.when(~holds, F.lit(name)) for name, holds in rules.items()]))
    return df.withColumn("reasons", broken).where(F.size("reasons") > 0)


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    keys = parents.select(F.col(parent_key).alias(child_key))
    return children.join(keys, child_key, "left_anti")


def cascade_delete(children: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The children that go with the deleted parents."""
    keys = deleted.select(F.col(parent_key).alias(child_key))
    return children.join(keys, child_key, "left_semi")
