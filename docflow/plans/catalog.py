"""What ``__spark_entry__`` serves: importing the query modules fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docflow.plans import state_queries, stream_queries, text_queries  # noqa: F401
from docflow.plans.registry import ORACLES, QUERIES, QueryFn


def queries() -> dict[str, QueryFn]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["k7_plan_from_text"](spark, sf_dir)
