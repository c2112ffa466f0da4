"""Views that bind the operators to the tables at hand, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docflow.sources.shared import parts_for

TABLES = "customer documents events lineitem orders pages part".split()

#: name -> (views it needs, SQL). {sha} stands for the engine's hex SHA-256 of l_partkey.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "chunks_v": (
        (),
        """SELECT *, paragraph_idx IS DISTINCT FROM lead(paragraph_idx) OVER (PARTITION BY document_id ORDER BY idx) AS ends_paragraph,
        CASE WHEN status = 'done' THEN concat(CAST(user_id AS STRING), '/audio/', content_hash, '.mp3') END AS path FROM (
        SELECT l_orderkey AS document_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INT) AS idx,
        CAST(l_linenumber AS INT) AS paragraph_idx, o_custkey AS user_id, CAST(l_quantity * 40 AS INT) AS char_count,
        CAST(l_quantity * 1000 AS BIGINT) AS duration_ms,
        CASE WHEN l_returnflag = 'A' THEN 'done' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'processing' ELSE 'pending' END AS status,
        CAST(l_linenumber % 5 AS INT) AS attempts, l_linestatus = 'O' AS from_cache, {sha} AS content_hash,
        l_shipdate AS updated_at, o_orderdate AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x""",
    ),
    "jobs_v": (
        (),
        """SELECT o_orderkey AS id, o_orderkey % 5000 AS document_id, o_custkey AS user_id,
        CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'running' END AS status,
        o_orderdate AS created_at, o_orderdate AS updated_at, o_orderdate AS started_at FROM orders""",
    ),
    "cache_v": (
        ("chunks_v",),
        """SELECT DISTINCT user_id, content_hash, concat(CAST(user_id AS STRING), '/audio/', content_hash, '.mp3') AS path
        FROM chunks_v WHERE updated_at < TIMESTAMP '1998-01-01 00:00:00'""",
    ),
    "assets_v": (
        (),
        """SELECT o_orderkey AS id, o_orderkey % 5000 AS document_id, o_custkey AS user_id, concat('lib/', CAST(o_orderkey AS STRING), '.mp3') AS path,
        CAST(floor(o_totalprice) AS BIGINT) AS duration_ms, CAST(floor(o_totalprice) AS BIGINT) * 16 AS byte_size, o_orderdate AS created_at
        FROM orders WHERE o_orderstatus = 'F'""",
    ),
    "titles_v": (
        (),
        """SELECT o_orderkey AS document_id, o_custkey AS user_id, concat('Order & "', o_orderpriority, '" <', CAST(o_orderkey AS STRING), '>') AS title
        FROM orders WHERE o_orderkey % 7 <> 0""",
    ),
    "usage_v": (
        (),
        """SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'chunk' ELSE 'single' END AS kind, CAST(floor(value * 10) AS BIGINT) AS chars
        FROM events WHERE event_type IN ('purchase', 'click')""",
    ),
    "positions_v": (
        (),
        """SELECT event_id AS position_id, user_id, CAST({k} AS BIGINT) AS document_id, CAST(floor(value * 1000) AS BIGINT) AS position_ms, ts AS updated_at
        FROM events WHERE event_type = 'view'""",
    ),
    "rules_v": (
        (),
        """SELECT CAST(u AS BIGINT) AS user_id, p AS pattern, r AS replacement, CAST(c AS BIGINT) AS created_at FROM (VALUES
        (0, 'the', 'THE', 1), (0, 'of', 'OF', 2), (1, 'que', 'k', 3), (1, 'de', 'D', 4), (1, 'que', 'QUE', 5), (2, 'der', 'D.E.R', 6),
        (2, 'und', '$1 & und', 7), (2, '', 'x', 8), (3, ' la ', 'LA', 9), (3, 'los', '', 10)) AS v(u, p, r, c)""",
    ),
    "told_rules_v": (  # each event tells a rule; ties in time are many
        (),
        """SELECT user_id, event_type AS pattern, concat('said ', CAST(event_id % 10 AS STRING)) AS replacement, CAST(floor(event_id / 50) AS BIGINT) AS created_at FROM events""",
    ),
    "docs_v": ((), "SELECT doc_id, doc_id % 4 AS user_id, text FROM documents"),
    "books_v": (  # pages are numbered without their texts
        (),
        """SELECT /*+ MERGE(n) */ d.source AS book, n.page_no, d.doc_id, d.text FROM documents AS d JOIN (
        SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_no FROM documents) n
        ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.source IS NOT DISTINCT FROM n.source""",
    ),
    "paragraphs_v": ((), "SELECT doc_id, replace(text, chr(10), concat(chr(10), chr(10))) AS text FROM documents"),
}

#: The cache without DISTINCT, for where the newest row of each key is taken anyway.
VIEWS["cache_rows_v"] = (("chunks_v",), VIEWS["cache_v"][1].replace("SELECT DISTINCT", "SELECT", 1))

SPARK = {"sha": "sha2(CAST(l_partkey AS STRING), 256)", "k": "get_json_object(props, '$.k')"}
DUCKDB = {"sha": "sha256(CAST(l_partkey AS STRING))", "k": "json_extract_string(props, '$.k')"}


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in [*_ordered(VIEWS[n][0]), n] if x not in out]
    return out


#: Tables of long texts, on which work a row outweighs moving the row once.
TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that comes in fewer splits than there are cores is dealt out to all."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores else df


#: Rows of a joined table that Spark may broadcast. Of a long table it may, going by the bytes of Parquet files, of
#: which a key or two is a small share; the driver then holds a row for each.
BROADCAST_ROWS = 1_000_000

#: The key by which a table is dealt out before a view joins and numbers its rows by it.
DEALT_BY = {"lineitem": "l_orderkey"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by its SQL over the Parquet tables in ``sf_dir``; only the tables it names are read.

    Its joins and windows by document run in as many tasks as :func:`parts_for` says, so that what
    a task sorts doesn't grow with the table.
    """
    needed = _ordered((name,))
    text = ", ".join(f"{n} AS ({VIEWS[n][1].format(**SPARK)})" for n in needed)
    sources = {t: table(spark, sf_dir, t) for t in TABLES if f" {t}" in text}
    for t in sources.keys() & DEALT_BY.keys():
        sources[t] = sources[t].repartition(parts_for(sources[t]), DEALT_BY[t])
    for t in sources.keys() & set(re.findall(r"\bJOIN (\w+)\b", text)):
        if sources[t].count() > BROADCAST_ROWS:
            sources[t] = sources[t].hint("merge")
    # the tables go in as arguments, so no view is registered
    for t in sources:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **sources)


def oracle(sql: str, *views: str) -> str:
    """``sql`` for DuckDB with the views it needs in front."""
    ctes = [f"{n} AS ({VIEWS[n][1].format(**DUCKDB)})" for n in _ordered(views)]
    sql = sql.strip()
    if not ctes:
        return sql
    recursive = "RECURSIVE " if sql.upper().startswith("WITH RECURSIVE ") else ""
    head = f"WITH {recursive}" + ", ".join(ctes)
    sql = sql.replace(sql[5:15], "", 1) if recursive else sql
    return f"{head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"{head} {sql}"
