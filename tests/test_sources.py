"""Books from packages, tables in buckets, partitions that are replaced."""

from pathlib import Path

from pyspark.sql import functions as F

from docflow.operators import packages
from docflow.plans.adapters import view
from docflow.plans.stream_queries import along_with_progress
from docflow.sources import shared
from docflow.sources.sinks import chunk_table, replace_rows

DIR = "/root/testdata/sf0.001"


def container(path):
    return f"<?xml version='1.0'?>\n<container xmlns='urn:oasis:names:tc:opendocument:xmlns:container'><rootfiles><rootfile full-path='{path}' media-type='x'/><rootfile full-path='other.opf'/></rootfiles></container>"


def package(items, refs, prefix=""):
    tags = "".join(f"<{prefix}item {i}/>" for i in items)
    spine = "".join(f"<{prefix}itemref {r}/>" for r in refs)
    ns = "xmlns:opf='http://www.idpf.org/2007/opf' " if prefix else ""
    return f"﻿<{prefix}package {ns}version='2.0'><metadata/><{prefix}manifest>{tags}</{prefix}manifest><{prefix}spine toc='n'>{spine}</{prefix}spine></{prefix}package>"


def books(spark, members):
    df = spark.createDataFrame([(*m, "x") for m in members], "book_id string, path string, content string, text string")
    return {r.book_id: (r.text, r.chapters) for r in packages.read_books(df).collect()}


def test_books_read_in_spine_order(spark):
    html = "<html><head><title>no</title></head><body><p>{}</p></body></html>"
    items = [
        "id='a' href='part%20one/a.xhtml' media-type='application/xhtml+xml'",
        "id='b' href='./../b+c.xhtml'",
        "id='pic' href='pic.png' media-type='image/png'",
        "id='gone' href='gone.xhtml'",
        "id='none'",
        "href='nameless.xhtml'",
        "id='twice' href='first.xhtml'",
        "id='twice' href='second.xhtml#start'",
        "id='raw' href='100%25.xhtml'",
        "id='bad' href='50%.xhtml' media-type=''",
        "id='empty' href='empty.xhtml'",
        "id='up' href='../../../b+c.xhtml'",
    ]
    refs = [f"idref='{i}'" for i in ("b", "pic", "a", "gone", "none", "twice", "raw", "bad", "empty", "unknown", "up", "a")] + ["linear='no'"]
    files = {"O/E/part one/a.xhtml": "A", "O/b+c.xhtml": "B", "O/E/pic.png": "P", "O/E/nameless.xhtml": "N", "O/E/first.xhtml": "F", "O/E/second.xhtml": "S", "O/E/100%25.xhtml": "raw", "O/E/100%.xhtml": "decoded", "O/E/50%.xhtml": "bad", "b+c.xhtml": "top"}
    chapters = [(p, html.format(t)) for p, t in files.items()] + [("O/E/empty.xhtml", "<p> </p>"), ("O/E/null.xhtml", None)]
    for prefix in ("", "opf:"):
        whole = [("k", packages.CONTAINER, container("./O\\E/p.opf")), ("k", "O/E/p.opf", package(items, refs, prefix))] + [("k", *c) for c in chapters]
        odd = [
            ("broken", packages.CONTAINER, "<container><rootfiles>"), ("broken", "p.opf", "x"), ("nothing", "a", "A"), ("null", packages.CONTAINER, None),
            ("nopackage", packages.CONTAINER, container("p.opf")), ("badpackage", packages.CONTAINER, container("p.opf")), ("badpackage", "p.opf", "<package><manifest>"),
            ("single", packages.CONTAINER, container("p.opf")), ("single", "p.opf", package(["id='a' href='a'"], ["idref='a'"])), ("single", "a", "<p>Only &amp; one</p>"),
            ("blank", packages.CONTAINER, container("")), (None, packages.CONTAINER, container("p.opf")), (None, "p.opf", package(["id='a' href='a'"], ["idref='a'"])), (None, "a", "A"), ("single", None, "x"),
        ]
        assert books(spark, whole + whole + odd) == {"k": ("B\n\nA\n\nS\n\nraw\n\nbad\n\nA", 6), "single": ("Only & one", 1)}
    assert books(spark, []) == {}


def test_buckets_need_no_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with chunk_table(view(spark, DIR, "chunks_v"), buckets=4) as stored:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            df = along_with_progress(stored)
            plan = df._jdf.queryExecution().executedPlan().toString()
            n = df.count()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert n == spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("docflow_chunks_")]


def stored(spark, path):
    files = {str(f) for f in Path(path).rglob("*.parquet")}
    return files, sorted((tuple(r) for r in spark.read.parquet(path).drop("part").collect()), key=repr)


def test_replacing_leaves_other_partitions(spark, tmp_path):
    path, schema = str(tmp_path / "assets"), "document_id long, id long, path string"
    rows = [(k, k, "old") for k in range(200)] + [(None, 1, "null")]
    replace_rows(spark.createDataFrame(rows, schema), path, ["document_id"], ["id"], parts=8)
    files, found = stored(spark, path)
    assert found == sorted(rows, key=repr)
    new = spark.createDataFrame([(5, 900, "a"), (5, 901, "b"), (5, 901, "a"), (5, 901, "b")], schema)
    for _ in range(2):  # a second time changes nothing
        replace_rows(new, path, ["document_id"], ["id"], parts=8)
        after, found = stored(spark, path)
        assert found == sorted([r for r in rows if r[0] != 5] + [(5, 901, "b")], key=repr)
        gone = {Path(f).parent.name for f in files - after}
        assert len(gone) == 1 and {Path(f).parent.name for f in after - files} == gone
    replace_rows(new.limit(0), path, ["document_id"], ["id"], parts=8)
    assert stored(spark, path)[0] == after
    replace_rows(spark.createDataFrame([(None, 2, "newer")], schema), path, ["document_id"], ["id"], parts=8)
    assert [r for r in stored(spark, path)[1] if r[0] is None] == [(None, 2, "newer")]
    empty = str(tmp_path / "none")
    replace_rows(new.limit(0).withColumn("more", F.lit(1)), empty, ["document_id"], ["id"])
    assert not Path(empty).exists()


def test_tasks_of_chunks_are_numbered_by_rows(spark, monkeypatch):
    # adaptive execution would put these few rows into one task
    assert view(spark, DIR, "chunks_v").select("document_id", "idx").distinct().rdd.getNumPartitions() == 4
    monkeypatch.setattr(shared, "TASK_ROWS", 1000)
    lineitem = spark.read.parquet(f"{DIR}/lineitem.parquet")
    want = -(-lineitem.count() // 1000)
    assert want > 4 and shared.parts_for(lineitem) == want and shared.parts_for(lineitem, 99) == 99
    numbered = view(spark, DIR, "chunks_v")
    assert numbered.rdd.getNumPartitions() == want
    # a bucket is one file of one task, of chunks that weren't moved again
    with chunk_table(numbered, buckets=want) as stored:
        assert len(stored.inputFiles()) <= want
        assert stored.count() == lineitem.count()
