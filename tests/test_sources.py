"""Sources by kind and host, the allowlist that refuses, and a landed table of which few parts are read."""

import re

import pytest
from pyspark.sql import functions as F

from vocatio.operators import courses, planned, reshape, roles
from vocatio.sources import files, registry
from vocatio.streaming import ingest as streaming


def landed(spark, rows):
    df = spark.createDataFrame(rows, "source_id string, url string, fetched_at string, payload string")
    return df.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))


def test_sources_by_kind_and_host(spark):
    job = '{"id": "%s", "title": "Nurse", "content": "x"}'
    rows = landed(spark, [(s, f"u{k}", "2026-01-01", job % s) for k, s in enumerate(["a", "b", "c", "d", "a"])])
    sources = spark.createDataFrame([("a", "ats_api", "https://boards.one.com/x"), ("b", "ats_api", "https://two.com"), ("c", "feed", "https://three.com"), ("a", "ats_api", "https://boards.one.com/x")], "source_id string, source_type string, base_url string")
    registry.register("ats_api", lambda df: files.job_records(df).withColumn("title", F.lit("by host")), "one.com")
    try:
        got = sorted((r.source_id, r.title, r.rejected) for r in registry.dispatched(rows, sources).collect())
        assert registry.parse("ats_api", rows, "https://one.com").first().title == "by host" and registry.parse("ats_api", rows).first().title == "Nurse"
    finally:
        registry.unregister("ats_api", "one.com")
    assert got == [("a", "by host", None), ("a", "by host", None), ("b", "Nurse", None), ("c", None, "no_parser"), ("d", None, "unknown_source")]
    assert registry.dispatched(rows.limit(0), sources).count() == 0


def test_the_allowlist_refuses(spark):
    rows = spark.createDataFrame([(1, " A.com "), (2, "b.com")], "k int, domain string")
    domains = spark.createDataFrame([("a.com",), ("b.com",)], "domain string")
    assert reshape.require_allowed(rows, domains).count() == 2
    for bad in (domains.limit(0), domains.filter("domain = 'a.com'")):
        with pytest.raises(PermissionError, match="b.com"):
            reshape.require_allowed(rows, bad)
    with pytest.raises(PermissionError):
        reshape.require_allowed(rows.withColumn("domain", F.lit(None).cast("string")), domains)


def test_a_batch_opens_the_parts_it_touches(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows = landed(spark, [("s", f"u{k}", "2026-01-01", f"p{k}") for k in range(300)])
    rows.coalesce(1).write.json(source)
    streaming.start_landing(streaming.landed_files(spark, source), table, str(tmp_path / "check")).awaitTermination()
    whole = spark.read.schema(streaming.with_parts(rows).schema).parquet(table)
    assert whole.count() == 300
    more = landed(spark, [("s", "u7", "2026-01-02", "p7"), ("s", "u7", "2026-01-02", "new")])
    more.coalesce(1).write.mode("append").json(source)
    batch = streaming.with_parts(more)
    read = streaming.touched(whole, batch).select(F.input_file_name().alias("f")).distinct().collect()
    parts = {r.part for r in batch.select("part").collect()}
    assert {re.search("part=(..)", r.f)[1] for r in read} <= parts and len(read) < len(whole.inputFiles()) / 20
    streaming.start_landing(streaming.landed_files(spark, source), table, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(table).count() == 301


def test_names_that_hold_a_query(spark, monkeypatch):
    index = [(k, f"{a} {b}", None if k % 3 else [b.upper(), "alt"]) for k, (a, b) in enumerate((a, b) for a in ("Data", "Senior", "Chief") for b in ("Engineer", "Analyst", "nurse", "Ingénieur"))]
    queries = [(0, "data"), (1, "E"), (2, ""), (3, None), (4, "zzz"), (5, "ALT"), (6, "ingé"), (7, "data")]
    q, i = spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(index, "pos int, name string, alternates array<string>")
    got = {r.query_id: r.names for r in roles.local_hits(q, i, limit=3).collect()}
    want = {}
    for k, text in queries:
        names = [n for _, n, alt in index if text is not None and any(text.lower() in f.lower() for f in (n, *(alt or [])))][:3]
        if names:
            want[k] = names
    assert got == want


def test_transcript_courses_in_one_chain(spark):
    labels = [(1, 0, "CS 101 — Intro", "Computer Science"), (1, 1, "ENGL 1301 — Comp", "Computer Science"), (1, 2, "CS 999 — Topics", "Computer Science"), (1, 3, "MATH 251", "Computer Science"), (2, 0, "no code", None), (2, 1, "HIST 4100 — Europe", "Nursing")]
    catalog = [(0, ["CS"], 100, 199, "Programming", "Python, then git and SQL."), (1, ["MATH"], 200, 299, "Calculus", "Uses python and statistics"), (2, ["HIST"], 1, 9999, "History", "SQL")]
    l = spark.createDataFrame(labels, "profile_id int, pos int, label string, major string").withColumn("degree", F.lit(None).cast("string"))
    c = spark.createDataFrame(catalog, "pos int, subjects array<string>, lo int, hi int, title string, description string")
    v = spark.createDataFrame([(0, "SQL"), (1, "Python"), (2, "Statistics"), (3, "Git")], "pos int, phrase string")
    out = courses.processed(l, c, v, spark.createDataFrame([(1, "GIT"), (2, "sql")], "profile_id int, skill string"))
    assert sorted((r.profile_id, r.pos, r.catalog_title) for r in out.relevant.collect()) == [(1, 0, "Programming"), (1, 2, None), (1, 3, "Calculus")]
    assert sorted((r.profile_id, r.pos) for r in out.excluded.collect()) == [(1, 1), (2, 0), (2, 1)] and [r.pos for r in out.unresolved.collect()] == [2]
    assert sorted(tuple(r) for r in out.adopted.collect()) == [(1, 1, "SQL"), (1, 2, "Python"), (1, 3, "Statistics")]


def test_review_items(spark):
    conf = spark.createDataFrame([("posting_occupation", "1", 0.5), ("posting_major", "2", 0.69), ("posting_requirement", "3", 0.5), ("other", "4", 0.0), ("posting_major", "5", None)], "entity_type string, entity_id string, confidence double")
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "entity_id string")
    views = spark.createDataFrame([("11", "a", 3), ("11", "a", 4), ("12", "b", 6), ("13", "c", 1)], "cip_code string, company_id string, n_views int")
    got = planned.review_items(conf, ids("9", "9"), ids("acme"), views, top=2).collect()
    assert sorted((r.entity_type, r.entity_id, r.reason, r.priority, r.status) for r in got) == [
        ("company_merge", "acme", "ambiguous_company", 0.8, "pending"), ("posting_major", "11 a", "high_traffic", 0.5, "pending"), ("posting_major", "12 b", "high_traffic", 0.5, "pending"),
        ("posting_major", "2", "low_confidence", 0.01, "pending"), ("posting_occupation", "1", "low_confidence", 0.1, "pending"), ("posting_requirement", "9", "evidence_offset", 1.0, "pending"),
    ]
