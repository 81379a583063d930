"""Operators against brute force or by hand where SQL does not reach them."""

import math
import random
import re

from pyspark.sql import functions as F

from vocatio.functions import redaction
from vocatio.operators import courses, evidence, matching, planned, roles, tables
from vocatio.sources import files


def by_rule(text):
    """Matches of each pattern; by start, then kind, what begins inside a span before it is left out."""
    out = []
    for place, (kind, pattern, led) in enumerate(redaction.RULES):
        for m in re.finditer(pattern, text):
            group = 2 if led else 0
            out.append((m.start(group), place, m.end(group), kind))
    kept = []
    for start, _, end, kind in sorted(out):
        if not kept or start >= kept[-1][1]:
            kept.append((start, end, kind))
    return kept


def test_redaction_against_the_rule(spark):
    random.seed(11)
    bits = ["Contact: ", "Recruiter:", "Jane", " Doe", " ", "a.b@c.org", "@x.com", "415-555-0100", "+1 (415) 555 0100", "é", "\U0001f600", ".", "\n", "Smith@acme.com"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 12))) for _ in range(400)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("t", redaction.spans(F.col("t")).alias("s"), redaction.redacted_by_spans(F.col("t")).alias("r")).collect()
    for text, found, clean in got:
        want = by_rule(text or "")
        assert [(s.start, s.end, s.kind) for s in found] == want, text
        assert all(s.original == text[s.start : s.end] for s in found)
        if text is None:
            assert clean is None
            continue
        out, at = "", 0
        for start, end, kind in want:
            out, at = out + text[at:start] + redaction.TOKENS[kind], end
        assert clean == out + text[at:], text


def test_vectors_to_nearest_reference(spark):
    random.seed(2)
    v = [(i, [random.gauss(0, 1) for _ in range(4)]) for i in range(50)] + [(50, None), (51, [0.0] * 4)]
    r = [(f"c{k}", [random.gauss(0, 1) for _ in range(4)]) for k in range(6)] + [("a", [1.0, 0.0, 0.0, 0.0]), ("b", [2.0, 0.0, 0.0, 0.0]), ("n", None)]
    vectors, known = spark.createDataFrame(v, "posting_id int, vector array<double>"), spark.createDataFrame(r, "code string, reference array<double>")
    got = {x.posting_id: (x.code, x.confidence) for x in planned.cosine_titles(vectors, known, least=0.6).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for i, a in v[:50]:
        best = max(cos(a, b) for _, b in r if b)
        assert (i in got) == (best >= 0.6)
        if i in got:
            code = min(c for c, b in r if b and math.isclose(cos(a, b), best))
            assert got[i][0] == code and math.isclose(got[i][1], min(0.7, 0.5 + 0.2 * (best - 0.6) / 0.4))
    assert not {50, 51} & set(got)
    assert planned.cosine_titles(vectors, known.limit(0)).count() == 0 and planned.cosine_titles(vectors.limit(0), known).count() == 0


def test_local_hits(spark):
    index = spark.createDataFrame([(1, "Nurse", ["RN"]), (0, "Data Engineer", ["ETL developer", "data dev"]), (2, "Developer", None)], "pos int, name string, alternates array<string>")
    q = spark.createDataFrame([("a", "DEV"), ("b", "rn"), ("c", "zzz"), ("d", None)], "query_id string, query string")
    got = {r.query_id: r.names for r in roles.local_hits(q, index).collect()}
    assert got == {"a": ["Data Engineer", "Developer"], "b": ["Nurse"]}
    assert [r.names for r in roles.local_hits(q, index, limit=1).filter("query_id = 'a'").collect()] == [["Data Engineer"]]
    assert roles.local_hits(q, index.limit(0)).count() == 0


def test_analysed_demand(spark):
    postings = spark.createDataFrame([(1, "We use SQL and Go"), (2, "sql only"), (3, None)], "posting_id int, text string")
    skills = spark.createDataFrame([("SQL",), ("Go",), ("Rust",)], "phrase string")
    rows = roles.analysed("data", matching.skill_frequency(postings, skills), n=2).orderBy("rank").collect()
    assert [(r.role_key, r.rank, r.name, r.posting_count, round(r.frequency, 4)) for r in rows] == [("data", 1, "SQL", 2, 0.6667), ("data", 2, "Go", 1, 0.3333)]
    assert matching.skill_frequency(postings.limit(0), skills).filter("frequency <> 0").count() == 0


def test_added_entries(spark):
    have = spark.createDataFrame([(1, "SQL"), (2, "Go")], "profile_id int, skill string")
    more = spark.createDataFrame([(1, " sql "), (1, "Rust"), (1, "RUST"), (2, "SQL")], "profile_id int, skill string")
    got = sorted((r.profile_id, r.skill.lower()) for r in matching.added(have, more, "profile_id", "skill").collect())
    assert got == [(1, "rust"), (2, "sql")]


def test_stored_payloads_and_groups(spark):
    landed = spark.createDataFrame([("x",), ("y",), ("x",)], "payload string")
    rows = tables.payload_rows(landed)
    documents = spark.createDataFrame([(1, "x"), (2, "x"), (3, "z")], "doc int, p string").withColumn("sha256", F.sha2("p", 256))
    assert {(r.doc, r.payload) for r in files.stored_payloads(documents, rows).collect()} == {(1, "x"), (2, "x")}
    items = spark.createDataFrame([(1, "skill", "s1", "SQL"), (1, "skill", "s0", "Go"), (1, "honor", "h", "Prize")], "profile_id int, kind string, evidence_id string, text string")
    got = {r.kind: [tuple(i) for i in r["items"]] for r in evidence.grouped_items(items).collect()}
    assert got == {"skill": [("s0", "Go"), ("s1", "SQL")], "honor": [("h", "Prize")]}


def test_first_title_and_last_zone(spark):
    labels = spark.createDataFrame([(1, 0, "MATH 251")], "profile_id int, pos int, label string")
    looked = spark.createDataFrame([(1, 1, "MATH 25", "Algebra"), (1, 0, "MATH 251", "Zeta Calculus")], "profile_id int, seq int, code string, catalog_title string")
    assert courses.titles(labels, looked, []).first().titles == ["Zeta Calculus"]
    raw = spark.createDataFrame([("11-1011.00", "4", "2024"), ("11-1011.00", "5", "2019")], "`O*NET-SOC Code` string, `Job Zone` string, Date string").coalesce(1)
    assert files.zones(raw).first().job_zone == 5


def test_credentials_and_headings(spark):
    text = "Role.\nRequirements:\n5+ years of SQL.\nAWS Certified or CISSP.\nNice to have\nA master's degree.\nAbout us\nPMP holders smile."
    found = planned.requirements(spark.createDataFrame([(1, text)], "posting_id int, text string"))
    got = {r.excerpt.strip(): (r.strength, r.certifications, r.degree) for r in found.collect()}
    assert got == {
        "5+ years of SQL.": ("required", [], None),
        "AWS Certified or CISSP.": ("required", ["aws_certified", "cissp"], None),
        "A master's degree.": ("preferred", [], "master"),
        "PMP holders smile.": ("unknown", ["pmp"], None),
    }
    good, bad = planned.evidenced(found)
    assert good.count() == 4 and bad.count() == 0
    assert {r.credential for r in planned.asked_credentials(found).collect()} == {"aws_certified", "cissp", "master", "pmp"}
