"""Steps whose work has to grow with the input and no faster."""

import re
import time

from pyspark.sql import functions as F

from vocatio.operators import ingest, matching, planned, profiles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_alias_is_settled_before_the_postings_meet_it(spark):
    texts = spark.createDataFrame([(1, "CS"), (1, "cs"), (2, "cs"), (3, "other"), (4, None)], "posting_id int, alias string")
    aliases = spark.createDataFrame([("cs", "11", 1), ("Cs", "12", 2), ("cs", "13", 2), ("x", "9", 0), (None, "8", 0)], "alias string, cip_code string, level int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = planned.explicit_links(texts, aliases)
        assert "SortMergeJoin" not in plan(links)
        assert sorted(map(tuple, links.collect())) == [(1, "13", "explicit"), (2, "13", "explicit")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pairs_of_profile_and_skill_do_not_move(spark):
    profiles = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "none")], "profile_id int, role_key string")
    demand = spark.createDataFrame(
        [(r, i, None, s, 10, 0.5) for r in "ab" for i, s in enumerate(["SQL", "Go", "C++"], 1)], "role_key string, rank int, id string, name string, posting_count int, frequency double"
    )
    evidence = spark.createDataFrame(
        [(1, 3, 0, 0, "x0", "Wrote go and sql"), (1, 1, 0, 0, "skill_0", "sql"), (2, 2, 0, 0, "c0", "Intro to C++")],
        "profile_id int, tier int, source int, pos int, evidence_id string, text string",
    )
    m = matching.match(profiles, evidence, demand)
    assert not re.search(r"Join \[profile_id#\d+, (skill|name)#", plan(m))
    got = {(r.profile_id, r.role_key, r.skill): (r.status, r.evidence) for r in m.collect()}
    assert len(got) == 9 and got[1, "a", "SQL"] == got[1, "b", "SQL"] == ("verified", ["skill_0"])
    assert got[1, "b", "Go"] == ("transferable", ["x0"]) and got[2, "a", "C++"] == ("coursework", ["c0"]) and got[2, "a", "Go"] == ("not_verified", [])
    rows = matching.demand_with_verdict(demand, m)
    assert rows.count() == 9 and not re.search(r"Join \[profile_id#\d+, role_key#\d+, rank#", plan(rows))


def test_long_transcripts(spark):
    lines = ["## Relevant Coursework", *[f"CS {100 + i % 800} Course {i}" for i in range(3000)], "# Technical Skills", "- SQL", "# Awards", "# Licenses", "CPA"]
    rows = spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string")
    for mode, n_courses in (("py", 3000), ("js", 800)):
        began = time.perf_counter()
        [p] = profiles.from_text(rows, mode).collect()
        assert len(p.coursework) == n_courses
        assert (p.skills, p.honors, p.certifications) == (["SQL"], [], ["CPA"])
        assert time.perf_counter() - began < 60


def test_payloads_of_one_small_file_go_to_all_tasks(spark, tmp_path):
    payloads = [("s", f"https://jobs.example.com/{i}", f'{{"id": {i}, "title": "Nurse", "content": "Mail a@acme.com", "location": {{"name": "Boise"}}}}') for i in range(400)]
    rows = spark.createDataFrame(payloads, "source_id string, url string, payload string").withColumn("fetched_at", F.lit("2026-01-05").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed"))
    assert landed.rdd.getNumPartitions() == 1
    got = ingest.prepared(landed)
    n = spark.conf.get("spark.sql.shuffle.partitions")
    assert f"RoundRobinPartitioning({n})" in plan(got)
    # between the parsing and the file there is that exchange
    assert re.search(r"from_json.*RoundRobinPartitioning.*Scan parquet", plan(got), re.DOTALL)
    assert got.filter("rejected IS NULL").count() == 400
