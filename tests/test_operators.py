import random
import re

import pytest
from pyspark.sql import functions as F

from vocatio.operators import courses, evidence, guards, imports, matching, planned, profiles, roles, search
from vocatio.queries import matching as samples
from vocatio.streaming import ingest as streaming


def test_phrases_against_every_pair(spark):
    random.seed(3)
    bits = ["sql", "c++", "c", "rest", "api", "apis", "é", "+", "go", "node.js", "a1"]
    texts = [(i, " ".join(random.choices(bits, k=6))) for i in range(60)] + [(60, None), (61, "")]
    phrases = ["sql", "C++", "rest api", "+", "é", "absent", "go go", "SQL"]
    t, p = spark.createDataFrame(texts + texts[:1], "text_id int, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    rule = lambda t, p: re.search(r"(?<![a-z0-9])" + re.escape(p.lower()) + r"(?![a-z0-9])", t.lower())
    want = sorted((i, p) for i, t in texts + texts[:1] if t for p in phrases if rule(t, p))
    for limit in (1000, 0):  # phrases to every executor, and joined by word
        assert sorted((r.text_id, r.phrase) for r in matching.phrase_matches(t, p, broadcast=limit).collect()) == want


def test_hot_words_are_split(spark, monkeypatch):
    monkeypatch.setattr(matching, "HOT_WORD", 7)
    t = spark.createDataFrame([(i, f"data text {i}") for i in range(50)], "text_id int, text string")
    p = spark.createDataFrame([("data",), ("text 7",)], "phrase string")
    got = matching.phrase_matches(t, p, broadcast=0).groupBy("phrase").count().collect()
    assert {tuple(r) for r in got} == {("data", 50), ("text 7", 1)}


def test_jobs_rank_by_sets(spark):
    jobs = [(k, k, s) for k, s in enumerate([["A", "b"], ["b", "a"], ["c"], ["a"], [], ["a", "a"]])]
    jobs = spark.createDataFrame(jobs, "job_id int, pos int, skills array<string>")
    mine = spark.createDataFrame([(1, ["a", "B"]), (2, ["b", "a", "A"]), (3, []), (4, ["c"])], "profile_id int, skills array<string>")
    got = {(r.profile_id, r.place, r.job_id, r.matched) for r in matching.ranked_jobs(jobs, mine, top=2).collect()}
    assert got == {(1, 1, 0, 2), (1, 2, 1, 2), (2, 1, 0, 2), (2, 2, 1, 2), (4, 1, 2, 1)}
    assert matching.ranked_jobs(jobs, mine).filter("profile_id = 1").count() == 4


def test_phrase_plan_has_no_nested_loop(spark):
    t = spark.createDataFrame([(1, "a b")], "text_id int, text string")
    p = spark.createDataFrame([("a",)], "phrase string")
    for df in (matching.phrase_matches(t, p), matching.skill_frequency(t.withColumnRenamed("text_id", "posting_id"), p)):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def person(spark, **over):
    course = "array<struct<id:string,course_code:string,course_name:string,credits:double,grade:string,term:string>>"
    fields = dict(skills=["Python"], certifications=["AWS"], honors=["Dean's List"], institution="Riverbend University", degree="Bachelor of Science", degree_level=None, major="CS", minor=None, concentration=None, graduation_date=None, expected_graduation_date="May 2026", gpa="3.72") | over
    row = (1, "r", [("c1", "CS 340", "Database Systems", 3.0, "A", "Fall 2024")], *fields.values())
    kinds = ["array<string>"] * 3 + ["string"] * 9
    schema = f"profile_id long, role_key string, coursework {course}, " + ", ".join(f"{k} {t}" for k, t in zip(fields, kinds))
    profiles_ = spark.createDataFrame([row], schema)
    work = spark.createDataFrame([(1, "x1", 0, "Intern", "Acme", "2024", "Cut build time by 30%"), (1, "x2", 1, "Aide", "Lab", None, "Helped")], "profile_id long, id string, pos int, title string, organization string, dates string, description string")
    made = spark.createDataFrame([(1, "p1", 0, "Shop", "Go", "Built a REST API")], "profile_id long, id string, pos int, name string, technologies string, description string")
    demand = spark.createDataFrame([("r", i + 1, None, n, 9, 0.5) for i, n in enumerate(["Python", "Kubernetes", "Go", "REST APIs"])], "role_key string, rank int, id string, name string, posting_count long, frequency double")
    return profiles_, work, made, demand


def judge(spark, *claims):
    profiles_, work, made, demand = person(spark)
    m = matching.match(profiles_, matching.evidence_texts(profiles_, work, made), demand)
    rows = [(str(i), 1, s, o, i, t, e) for i, (s, o, t, e) in enumerate(claims)]
    c = spark.createDataFrame(rows, "claim_id string, profile_id long, section string, owner_id string, pos int, text string, evidence array<string>")
    j = evidence.judged(c, evidence.items(profiles_, work, made), m, profiles_)
    return {r.pos: r.reason for r in j.collect()}, j


def test_claims(spark):
    got, j = judge(
        spark,
        ("summary", None, "A Python person", ["skill_0"]),
        ("summary", None, "Knows Kubernetes", ["skill_0"]),
        ("experience", "x1", "Cut build time by 30%", ["x1"]),
        ("experience", "x1", " CUT build time by 30% ", ["x1"]),
        ("experience", "x2", "Cut build time by 30%", ["x2"]),
        ("experience", "x1", "Cut build time by 40%", ["x1"]),
        ("experience", "x1", "Helped", ["x2"]),
        ("experience", "x1", "Helped", ["x1", "nowhere"]),
        ("experience", "x1", "Helped", []),
        ("skills", None, "Go", ["p1"]),
        ("skills", None, "Go ", ["p1"]),
        ("skills", None, "aws", ["skill_0"]),
        ("skills", None, "Juggling", ["skill_0"]),
        ("coursework", None, "CS 340 Database Systems", ["c1"]),
        ("coursework", None, "Databases", ["c1"]),
        ("honors", None, "dean's list", ["honor_0"]),
        ("coursework_summary", None, "Studied databases", ["c1"]),
        ("coursework_summary", None, "Studied", ["skill_0"]),
        ("projects", "p1", "Built REST APIs", ["p1"]),
        ("summary", None, "  ", ["skill_0"]),
    )
    assert got == {
        0: None, 1: "gap_skill_mentioned", 2: None, 3: "duplicate", 4: "unsupported_number", 5: "unsupported_number", 6: "evidence_out_of_scope",
        7: "unknown_evidence_id", 8: "no_evidence", 9: None, 10: "duplicate", 11: None, 12: "not_verified_skill", 13: None, 14: "verbatim_mismatch",
        15: None, 16: None, 17: "evidence_out_of_scope", 18: "gap_skill_mentioned",
    }
    entries = evidence.surviving_entries(j).collect()
    assert [(r.owner_id, r.bullets) for r in entries] == [("x1", ["Cut build time by 30%"])]
    assert evidence.unknown_owners(spark.createDataFrame([(1, "x1"), (1, "q")], "profile_id long, owner_id string"), person(spark)[1]).count() == 1


def test_a_skill_must_cite_what_the_match_found(spark):
    assert judge(spark, ("skills", None, "Go", ["x1"]))[0] == {0: "not_verified_skill"}


def test_match(spark):
    profiles_, work, made, demand = person(spark)
    m = matching.match(profiles_, matching.evidence_texts(profiles_, work, made), demand)
    assert {r.skill: (r.status, r.evidence) for r in m.collect()} == {
        "Python": ("verified", ["skill_0"]), "Kubernetes": ("not_verified", []), "Go": ("transferable", ["p1"]), "REST APIs": ("not_verified", []),
    }
    s = matching.summary(m).first()
    assert (s.considered, s.supported, s.gaps) == (4, 2, ["Kubernetes", "REST APIs"])
    aliases = spark.createDataFrame([(1, "skill_0", "kubernetes")], "profile_id long, evidence_id string, alias string")
    m = matching.match(profiles_, matching.evidence_texts(profiles_, work, made), demand, aliases, top=2)
    assert [r.status for r in m.orderBy("rank").collect()] == ["verified", "verified"]


def test_guards(spark):
    terms = spark.createDataFrame([("Used Python and SQL. Answered calls; PyTorch, C# Node.js. auto-close",), (None,), ("",)], "t string")
    assert [r.x for r in terms.select(guards.protected_terms("t").alias("x")).collect()] == [["Python", "SQL", "PyTorch", "C#", "Node.js"], [], []]
    assert samples.guarded_rewrites  # statuses are held against SQL with the queries


def test_search(spark):
    titles = spark.createDataFrame([("1", "Software Developers"), ("2", "Registered Nurses"), ("3", "100% Nurse")], "onet_soc_code string, title string")
    other = spark.createDataFrame([("1", "Software Engineer"), ("1", "Applications Developer"), ("2", "Staff Nurse"), ("2", "Café nurse")], "onet_soc_code string, alt_title string")
    q = spark.createDataFrame([("a", "soft"), ("b", "s"), ("c", "1"), ("d", "STAFF"), ("e", "100%"), ("f", "%%")], "query_id string, term string")
    hits = {(r.query_id, r.onet_soc_code, r.matched_on) for r in search.by_prefix(q, titles, other).collect()}
    assert hits == {("a", "1", "title"), ("d", "2", "alt_title"), ("e", "3", "title")}
    index = search.build_index(other.select(F.col("alt_title").alias("doc_key"), F.col("alt_title").alias("text")))
    q = spark.createDataFrame([("a", "DEVELOPER"), ("b", '"applications developer"'), ("c", '"developer applications"'), ("d", "nurse staff"), ("e", "cafe"), ("f", "nurse engineer")], "query_id string, query string")
    hits = {(r.query_id, r.doc_key) for r in search.by_words(q, index).collect()}
    assert hits == {("a", "Applications Developer"), ("b", "Applications Developer"), ("d", "Staff Nurse"), ("e", "Café nurse")}


def test_profiles(spark):
    text = "Riverbend State University\nBachelor of Science\nMajor: Computer Science.\nGPA 3.72/4.00\n\n## Coursework\nCS 340 - Database Systems\nnoise\n### Skills\n* Python\n\n# Skills\n- Late\n# Honors & Awards\nDean's List"
    p = profiles.from_text(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string"))
    a, b, c = p.orderBy("doc_id").collect()
    assert (a.institution, a.degree, a.major, a.gpa) == ("Riverbend State University", "Bachelor of Science", "Computer Science", "3.72/4.00")
    assert [x.course_name for x in a.coursework] == ["Database Systems"] and a.skills == ["Python"] and a.honors == ["Dean's List"] and a.warnings == []
    assert b.skills == c.skills == [] and len(b.warnings) == len(c.warnings) == 4
    js = profiles.from_text(spark.createDataFrame([(1, "RIVERBEND STATE UNIVERSITY\nMS Office\nFall 2024\nCS 340 Database Systems  A\nSkills:\nPython  SQL\n"), (2, "Degree: B.S. in Math"), (3, "interested in PhD programs")], "doc_id int, text string"), "js")
    a, b, c = js.orderBy("doc_id").collect()
    assert (a.institution, a.degree, a.coursework, a.skills) == ("Riverbend State University", None, ["CS 340 — Database Systems"], ["Python", "SQL"])
    assert b.degree == "Bachelor of Science" and c.degree is None


def test_titles_and_roles(spark):
    rows = [("ITSE-1345-002 — Intro ORCL&SQL", None), ("CS 314", "Structures"), ("CS 1", None), ("", None), ("X 100 — Op Sys: python", None)]
    got = spark.createDataFrame(rows, "l string, f string").select(courses.readable_title(F.col("l"), F.col("f"), ["Python", "SQL"]).alias("x"))
    assert [r.x for r in got.collect()] == ["Introduction to Oracle & SQL", "Structures", "CS 1", "", "Operating Systems: Python"]
    assert spark.range(1).select(roles.key_by_pattern(F.lit("hr")).alias("x")).first().x == "hr"


def test_imports(spark):
    rows = [
        ("e", 0, "x/Positions.csv", "junk\nCompany,Position,Company Name\nA,Cook,B\n,,\n" + "C,Chef,D\n" * 250),
        ("e", 1, "Honours.csv", "Title\nPrize\n"),
        ("e", 2, "Honors.csv", "Title\nOther\n"),
        ("e", 3, "skills.csv", "﻿Skill,Other\nSQL,1\n"),
        ("f", 0, "Notes.csv", "a"),
        ("g", 0, "Skills.csv", None),
    ]
    files = spark.createDataFrame(rows, "export_id string, seq int, member_name string, text string")
    work, _, lists, ignored, notes = imports.imported(files)
    first = work.orderBy("row_no").first()
    assert (first.organization, first.title) == ("A", "Cook") and work.count() == 199
    assert {(r.kind, tuple(r.names)) for r in lists.collect()} == {("honors", ("Prize",)), ("skills", ("SQL",))}
    assert {(r.export_id, r.reason) for r in ignored.collect()} == {("f", "not_read"), ("g", "no_known_columns")}
    assert {r.export_id: r.notes for r in notes.collect()} == {"e": ["rows_capped"], "f": ["nothing_read"], "g": ["nothing_read"]}


def test_years(spark):
    rows = [("3-5 years",), ("5+ yrs",), ("2 years",), ("none",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(planned.years(F.col("t")).alias("y")).collect()
    assert [r.y and tuple(r.y) for r in got] == [(3, 5), (5, None), (2, 2), None, None]


def test_streaming(spark, tmp_path):
    src, table, out = (str(tmp_path / n) for n in ("in", "table", "out"))
    rows = [("s", "u1", "2026-01-01 00:00:00", "{}"), ("s", "u1", "2026-01-01 01:00:00", "{}"), ("s", "u2", "2026-01-02 00:00:00", "x")]
    df = spark.createDataFrame(rows, "source_id string, url string, fetched_at string, payload string")
    df.coalesce(1).write.json(src)
    for n in range(2):  # the second start finds nothing new
        landed = streaming.without_repeats(streaming.landed_files(spark, src))
        streaming.start_landing(landed, table, str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(table).count() == 2
    stream = streaming.running_counts(streaming.landed_files(spark, src), "fetched_at", "source_id")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = streaming.running_counts(spark.read.schema(streaming.LANDED).json(src), "fetched_at", "source_id")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
    clean = streaming.clean_postings(streaming.landed_files(spark, src))
    assert clean.isStreaming and "fate" in clean.columns


@pytest.mark.parametrize("least", [0.3, 0.5, 0.7])
def test_fuzzy_titles_lose_no_pair(spark, least):
    """The prefix of each trigram set is enough: the same as comparing every title with every name."""
    names = ["Data Analyst", "Data Engineer", "Software Engineer", "Registered Nurse", "Nurse", "Sales Lead", "Lead Cook", ""]
    titles = [f"{a} {b}".strip() for a in ("", "Senior", "Junior", "Chief") for b in [*names, "Poet", "Data  analysts", "nurses"]]
    grams = lambda t: {f"  {t} "[i : i + 3] for i in range(len(t) + 1)}
    key = lambda t: " ".join(t.lower().split())
    want = {}
    for i, t in enumerate(titles):
        g = grams(key(t))
        found = [(-len(g & grams(key(n))) / len(g | grams(key(n))), n) for n in names]
        if -min(found)[0] >= least:
            want[i] = min(found)[1]
    p = spark.createDataFrame([*enumerate(titles), (99, None)], "posting_id int, title string")
    n = spark.createDataFrame([(x, x) for x in names], "code string, name string")
    assert {r.posting_id: r.code for r in planned.fuzzy_titles(p, n, least).collect()} == want
