from pyspark.sql import functions as F

from vocatio.operators import ingest, reference, tables
from vocatio.plans.jobs import build_reference, empty, ingest_and_publish, refresh
from vocatio.sources import files, registry
from vocatio.schemas import TABLES


def now(day=10):
    return F.lit(f"2026-01-{day} 00:00:00").cast("timestamp")


def payload(k, title="Engineer", company="Acme Inc", content="Build things.", place="San Francisco, CA"):
    return f'{{"id": {k}, "title": "{title}", "company_name": "{company}", "content": "{content}", "location": {{"name": "{place}"}}, "first_published": "2026-01-01T00:00:00Z"}}'


def land(spark, *payloads):
    rows = [("s", f"u{i}", i, p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "source_id string, url string, i int, payload string")
    return df.withColumn("fetched_at", F.expr("timestamp'2026-01-05' + make_interval(0, 0, 0, 0, i)")).drop("i")


def run(spark, landed, before=None, day=10):
    names = ("postings", "companies", "raw_documents")
    old = [getattr(before, n) if before else empty(spark, n) for n in names]
    if before:
        old[2] = before.raw_documents
    return ingest.ingest(landed, *old, now(day))


def totals(out):
    return out.counters.filter("source_id IS NULL").first().asDict()


def test_new_excluded_and_failed(spark):
    out = run(spark, land(spark, payload(1), payload(2, place="Dublin, Ireland"), "not json", '{"id": 4}'))
    t = totals(out)
    assert (t["seen"], t["new"], t["excluded_non_us"], t["parse_failed"]) == (4, 1, 1, 2)
    p = out.postings.collect()
    assert len(p) == 1 and p[0].state == "CA" and p[0].status == "active"
    # the excluded posting's payload is landed all the same, its description is not
    assert sorted((r.doc_type, r.url) for r in out.raw_documents.collect()) == [("api_response", f"u{i}") for i in range(4)] + [("posting_description", "u0")]


def test_rerun_change_and_reopening(spark):
    first = run(spark, land(spark, payload(1)))
    again = run(spark, land(spark, payload(1)), first, 11)
    assert totals(again)["unchanged"] == 1 and again.posting_versions.count() == 0 and again.raw_documents.count() == 0
    changed = run(spark, land(spark, payload(1, content="Build more.")), again, 12)
    assert totals(changed)["updated"] == 1
    assert [r.content_hash for r in changed.posting_versions.collect()] == [r.content_hash for r in first.postings.collect()]
    head = changed.postings.first()
    assert (head.first_seen_at.day, head.last_seen_at.day) == (10, 12)
    closed = changed.postings.withColumn("status", F.lit("closed")).withColumn("closed_at", now())
    changed.postings = closed
    back = run(spark, land(spark, payload(1, content="Build more.")), changed, 13).postings.first()
    assert back.status == "active" and back.closed_at is None


def test_a_place_alone_is_no_change(spark):
    first = run(spark, land(spark, payload(1)))
    out = run(spark, land(spark, payload(1, place="Austin")), first, 11)
    assert totals(out)["unchanged"] == 1 and out.postings.first().state == "CA"


def test_personal_data_is_redacted_and_never_fatal(spark):
    out = run(spark, land(spark, payload(1, content="Contact: Jane Smith or jane@acme.com or 415-555-0100."), payload(2)))
    stored = [r.payload for r in out.payloads.collect() if "REDACTED" in r.payload]
    assert stored == ["Contact: [REDACTED_NAME] or [REDACTED_EMAIL] or [REDACTED_PHONE]."]
    exact = ingest.prepared(land(spark, payload(1, content="Contact: Jane.Doe@acme.com"), payload(2)), exact_spans=True)
    assert sorted((r.source_posting_id, r.fate) for r in exact.collect()) == [("1", "quarantined"), ("2", None)]


def test_the_latest_of_a_posting_counts(spark):
    out = run(spark, land(spark, payload(1, title="Old"), payload(1, title="New")))
    assert [r.title for r in out.postings.collect()] == ["New"]


def test_companies(spark):
    old = spark.createDataFrame(
        [("a", "Acme", "acme", None), ("b", "Globex", "globex", "g.com"), ("c", "Globex", "globex", "h.com")],
        "company_id string, canonical_name string, normalized_name string, domain string",
    )
    old = old.withColumn("first_seen_at", now(1)).withColumn("last_seen_at", now(1))
    rows = [("m1", "Acme Inc.", "acme.com", 1), ("m2", "Globex LLC", "h.com", 2), ("m3", "Globex", None, 3), ("m4", "Globex Inc", None, 4), ("m5", "Globex", "x.com", 5), ("m6", "Hooli", None, 6), ("m7", "Hooli Ltd", "hooli.com", 7)]
    mentions = spark.createDataFrame(rows, "mention_id string, name string, domain string, seq int")
    companies, resolved = ingest.resolve_companies(old, mentions, now())
    ids = {r.mention_id: r.company_id for r in resolved.collect()}
    assert ids["m1"] == "a" and ids["m2"] == "c" and len({"a", "b", "c", ids["m3"], ids["m4"], ids["m5"]}) == 6  # nothing says which Globex is meant
    assert ids["m6"] == ids["m7"]
    by = {r.company_id: r for r in companies.collect()}
    assert by["a"].domain == "acme.com" and by["a"].last_seen_at.day == 10 and by["b"].last_seen_at.day == 1
    assert by[ids["m6"]].canonical_name == "Hooli" and by[ids["m6"]].domain == "hooli.com" and len(by) == 7
    again, resolved2 = ingest.resolve_companies(companies, mentions.filter("mention_id IN ('m1', 'm6')"), now(11))
    assert again.count() == 7 and {r.mention_id: r.company_id for r in resolved2.collect()} == {k: ids[k] for k in ("m1", "m6")}
    assert [(r.normalized_name, r.n) for r in ingest.ambiguous_names(companies).collect()] == [("globex", 5)]


def test_upsert_and_absent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, tables.absent(old, new.unionByName(new), ["k"]).collect())) == [(3, "c")]
    assert tables.upsert(old, new.limit(0), ["k"]).count() == 2


def test_split_valid_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (2, None, 1), (3, "x", 9), (4, "x", None)], "k int, v string, p int")
    parents = spark.createDataFrame([(1,), (1,)], "p int")
    good, bad = tables.split_valid(df, {"v": "v = 'x'"}, ["k"], {"p": parents})
    assert [r.k for r in good.collect()] == [4]
    assert sorted((r.k, r.reasons) for r in bad.collect()) == [(1, ["duplicate_key"])] * 2 + [(2, ["check:v"]), (3, ["no_p"])]


def test_change_chain(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "x")], "k string, n int, h string")
    assert [r.n for r in tables.change_chain(df, ["k"], "h", F.col("n")).orderBy("n").collect()] == [1, 3, 4]


def test_reference_build(spark):
    S = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    majors = S(
        [('="01"', None, "Farm", "d"), ('="01.01"', "", "Farm b", ""), ('="01.0101"', "Moved from", "Farm c", None), ('="99.0101"', "Deleted", "Lost", None), ('="1.1"', None, "Bad", None), ('="01"', None, "Farming", "d")],
        ["CIPCode", "Action", "CIPTitle", "CIPDefinition"],
    )
    occ = S([("15-1252.00", "Software Developers", "x"), ("29-1141.00", "Registered Nurses", ""), ("15-1252.01", "Other", None)], ["O*NET-SOC Code", "Title", "Description"])
    titles = S([("15-1252.00", "T", "Software Engineer", "", "x"), ("29-1141.00", "T", "Staff Nurse", "RN", None), ("00-0000.00", "T", "Nobody", "", "")], ["O*NET-SOC Code", "Title", "Job Title", "Short Title", "Source(s)"])
    zones = S([("15-1252.00", "T", "4", "2024", "a"), ("15-1252.00", "T", "5", "2025", "a")], ["O*NET-SOC Code", "Title", "Job Zone", "Date", "Domain Source"])
    links = S([("01.0101", "x", "15-1252", "y"), ("01.0101", "x", "15-1252", "y"), ("01.01", "x", "99-9999", "y"), ("99.9999", "x", "29-1141", "y")], ["CIP2020Code", "CIP2020Title", "SOC2018Code", "SOC2018Title"])
    out = build_reference(majors, occ, titles, zones, links)
    got = {r.cip_code: r for r in out["cip_codes"].collect()}
    assert set(got) == {"01", "01.01", "01.0101", "99.0101"} and got["01"].cip_title == "Farming"
    assert got["99.0101"].parent_cip_code is None and not got["99.0101"].is_active and got["01.0101"].parent_cip_code == "01.01"
    assert {(r.onet_soc_code, r.job_zone) for r in out["occupations"].collect()} == {("15-1252.00", 5), ("29-1141.00", None), ("15-1252.01", None)}
    assert {tuple(r) for r in out["crosswalk"].collect()} == {("01.0101", "15-1252.00"), ("01.0101", "15-1252.01")}
    assert out["alt_titles"].count() == 2 and out["title_index"].count() == 4
    assert {r.soc_2018_code for r in reference.unmatched(files.crosswalk_rows(links), out["occupations"]).collect()} == {"99-9999"}
    assert refresh(out["cip_codes"], out["cip_codes"], "cip_codes").count() == 4
    c = reference.coverage(out["occupations"], out["crosswalk"], "onet_soc_code", "o").first()
    assert (c.total, c.covered, c.percent) == (3, 2, 66.7)
    assert reference.coverage(out["occupations"].limit(0), out["crosswalk"], "onet_soc_code", "o").first().percent == 0.0


def test_csv_reading(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes('﻿CIPCode,CIPTitle,CIPDefinition,Action\n="01.0101","A ""b""","two\nlines",\n'.encode())
    r = files.majors(files.read_csv(spark, str(tmp_path / "m.csv"))).first()
    assert (r.cip_code, r.cip_title, r.cip_definition, r.level) == ("01.0101", 'A "b"', "two\nlines", 6)


def test_small_sources(spark):
    seed = spark.createDataFrame([("ats_api", "A", "u", "none", "TRUE", "", "1.5", "x"), ("feed", "B", "u", "none", "no", "2026", "", "60")], "source_type string, name string, base_url string, auth_mode string, enabled string, terms_reviewed_at string, crawl_delay_seconds string, rate_limit_per_minute string")
    reg = {r.name: r for r in files.registry(seed).collect()}
    assert reg["A"].politeness == {"crawl_delay_seconds": 1.5} and reg["A"].enabled and not reg["B"].enabled
    assert [r.name for r in files.enabled_sources(files.registry(seed)).collect()] == ["A"]
    allowed = spark.createDataFrame([(" A.com ",), ("a.com",), ("",)], "domain string")
    assert [r.domain for r in files.allowed_domains(allowed).collect()] == ["a.com"]
    listing = spark.createDataFrame([("s", '{"jobs": [{"id": 7, "absolute_url": "u"}]}'), ("s", "{}"), ("s", "x")], "source_id string, payload string")
    assert [tuple(r) for r in files.listed_jobs(listing).collect()] == [("s", "7", "u")]
    good, bad = files.transcripts(spark.createDataFrame([(1, "x" * 40), (2, " " * 60), (3, None)], "doc_id int, text string"))
    assert [r.doc_id for r in good.collect()] == [1] and bad.count() == 2
    assert [r.rejected for r in registry.parse("feed", land(spark, payload(1))).collect()] == ["no_parser"] and registry.parse("ats_api", land(spark, payload(1))).count() == 1


def test_triage(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    got = files.triaged(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted((r.path[-5:], r.refused) for r in got.collect()) == [("a.pdf", None), ("b.pdf", "signature"), ("c.txt", "extension")]


def test_publish(spark, tmp_path):
    got = ingest_and_publish(spark, land(spark, payload(1), payload(2)), f"file://{tmp_path}/t", now())
    assert {r.table: r.n_rows for r in got.collect()}["postings"] == 2
    assert set(TABLES) >= {"postings", "companies"}
