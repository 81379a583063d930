"""Publishing batch after batch, changes within a batch, companies in order, phrases in one pass."""

import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vocatio.operators import ingest, matching, phrases, tables
from vocatio.plans import stored
from vocatio.plans.jobs import ingest_and_publish
from vocatio.plans.snapshots import Snapshots
from vocatio.schemas import TABLES
from vocatio.sources import files


def now(day=10):
    return F.lit(f"2026-01-{day} 00:00:00").cast("timestamp")


def payload(k, title="Engineer", company="Acme Inc", content="Build things.", place="San Francisco, CA"):
    return json.dumps({"id": k, "title": title, "company_name": company, "content": content, "location": {"name": place}, "first_published": "2026-01-01T00:00:00Z"})


def land(spark, *payloads):
    rows = [("s", f"u{i}", i, p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "source_id string, url string, i int, payload string")
    return df.withColumn("fetched_at", F.expr("timestamp'2026-01-05' + make_interval(0, 0, 0, 0, i)")).drop("i")


def files_under(path):
    return {str(p) for p in Path(path).rglob("*") if p.is_file()}


def test_three_batches_keep_everything(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    ingest_and_publish(spark, land(spark, payload(1), payload(2), "not json"), root, now(10))
    ingest_and_publish(spark, land(spark, payload(2, content="Build more."), payload(3, company="Globex")), root, now(11))
    got = ingest_and_publish(spark, land(spark, payload(1, content="a"), payload(1, content="b"), payload(4, place="Dublin, Ireland")), root, now(12))
    assert {r.table: (r.n_rows, r.total) for r in got.collect()} == {
        "postings": (3, 3), "companies": (2, 2), "raw_documents": (5, 13), "payloads": (5, 12), "posting_versions": (2, 3), "rejected": (1, 2), "counters": (2, 6),
    }
    store = Snapshots(spark, root)
    assert store.version == 3 and store.versions() == [1, 2, 3]
    heads = {r.source_posting_id: r for r in store.read("postings").collect()}
    assert set(heads) == {"1", "2", "3"} and heads["3"].first_seen_at.day == 11 and heads["1"].last_seen_at.day == 12
    documents, payloads = store.read("raw_documents"), store.read("payloads")
    assert documents.select("sha256").distinct().join(payloads, "sha256", "left_anti").count() == 0
    assert payloads.groupBy("sha256").count().filter("count > 1").count() == 0
    chain = store.read("posting_versions").filter("source_posting_id = '1'").orderBy("change_no").collect()
    first = Snapshots(spark, root, version=1).read("postings").filter("source_posting_id = '1'").first()
    assert [v.change_no for v in chain] == [1, 2] and chain[0].content_hash == first.content_hash
    by_hash = {r.sha256: r.payload for r in payloads.collect()}
    assert [by_hash[v.description_sha256] for v in chain] == ["Build things.", "a"] and by_hash[heads["1"].description_sha256] == "b"
    assert sorted(r.fate for r in store.read("rejected").collect()) == ["excluded_non_us", "parse_failed"]
    assert [r.seen for r in store.read("counters").filter("source_id IS NULL").orderBy("at").collect()] == [3, 2, 3]


def test_a_rerun_adds_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    landed = land(spark, payload(1), payload(2))
    ingest_and_publish(spark, landed, root, now(10))
    before = files_under(f"{tmp_path}/t/data/payloads")
    got = {r.table: (r.n_rows, r.total) for r in ingest_and_publish(spark, landed, root, now(10)).collect()}
    assert got["payloads"] == (0, 3) and got["raw_documents"] == (0, 4) and got["posting_versions"] == (0, 0) and got["postings"] == (2, 2)
    assert files_under(f"{tmp_path}/t/data/payloads") == before  # a second put writes no file


def test_a_crash_between_writes_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    ingest_and_publish(spark, land(spark, payload(1)), root, now(10))
    write, written = Snapshots._write, []

    def dies(self, name, df, by):
        if len(written) == 3:
            raise RuntimeError("lost")
        written.append(name)
        return write(self, name, df, by)

    monkeypatch.setattr(Snapshots, "_write", dies)
    with pytest.raises(RuntimeError):
        ingest_and_publish(spark, land(spark, payload(1, title="New"), payload(2)), root, now(11))
    monkeypatch.undo()
    store = Snapshots(spark, root)
    assert store.version == 1 and [r.title for r in store.read("postings").collect()] == ["Engineer"] and store.read("payloads").count() == 2
    again = {r.table: r.total for r in ingest_and_publish(spark, land(spark, payload(1, title="New"), payload(2)), root, now(11)).collect()}
    assert again["postings"] == 2 and again["posting_versions"] == 1 and again["payloads"] == 4
    gone = Snapshots(spark, root).expire(keep=1)
    assert len([g for g in gone if g.split("/")[0] in written]) >= 3
    store = Snapshots(spark, root)
    assert store.versions() == [2] and store.read("postings").count() == 2 and store.read("payloads").count() == 4


def test_two_writers_cannot_make_one_version(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1,)], "k int")
    first, second = Snapshots(spark, root), Snapshots(spark, root)
    first.commit({"a": one}, {"b": one})
    with pytest.raises(Exception, match="(?i)exist"):
        second.commit({"a": one.limit(0)}, {"b": one})
    store = Snapshots(spark, root)
    assert store.version == 1 and store.read("a").count() == 1 and store.read("b").count() == 1
    store.commit({"a": one.limit(0)}, {"b": one})
    store = Snapshots(spark, root)
    assert store.read("a").count() == 0 and store.read("b").count() == 2 and store.read("c", "x int").columns == ["x"]
    with pytest.raises(KeyError):
        store.read("c")
    with pytest.raises(ValueError):
        store.commit({}, {"b": spark.createDataFrame([("x",)], "k string")})


def test_payloads_are_read_by_partition(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = tables.payload_rows(spark.createDataFrame([(f"text {k}",) for k in range(400)], "payload string"))
    names = [c.split()[0] for c in TABLES["payloads"].schema.split(", ")]
    Snapshots(spark, root).commit({}, {"payloads": rows.select(*names)}, {"payloads": ["prefix"]})
    store = Snapshots(spark, root).read("payloads")
    asked = spark.createDataFrame([("text 7",), ("new",)], "payload string")
    fresh = tables.fresh_payloads(tables.payload_rows(asked), store)
    assert [r.payload for r in fresh.collect()] == ["new"]
    plan = re.sub(r"#\d+", "", fresh._jdf.queryExecution().executedPlan().toString())
    touched = [r.prefix for r in tables.payload_rows(asked).collect()]
    filters = re.search(r"PartitionFilters: \[prefix IN \(([^)]*)\)", plan)
    assert set(filters[1].replace(" ", "").split(",")) == set(touched)
    read = store.filter(F.col("prefix").isin(touched)).select(F.input_file_name().alias("f")).distinct().collect()
    assert {re.search("prefix=(..)", r.f)[1] for r in read} == set(touched) & {r.prefix for r in rows.collect()}
    documents = spark.createDataFrame([(k, f"text {k}") for k in range(400)], "doc int, p string").withColumn("sha256", F.sha2("p", 256))
    documents.write.parquet(f"file://{tmp_path}/documents")
    some = spark.read.parquet(f"file://{tmp_path}/documents").filter("doc = 7")
    found = files.stored_payloads(some, store)
    assert [(r.doc, r.payload) for r in found.collect()] == [(7, "text 7")]
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()


def folded(head, batch):
    """Rows one after the other: next heads, versions, outcomes."""
    heads, versions, outcomes = {k: dict(v) for k, v in head.items()}, [], []
    for key, _, company, title, place in batch:
        h = hash_of(title)
        if key not in heads:
            heads[key] = {"company_id": company, "title": title, "location_raw": place, "content_hash": h}
            outcomes.append((key, "new"))
        elif heads[key]["content_hash"] == h:
            outcomes.append((key, "unchanged"))
        else:
            n = sum(v[0] == key for v in versions) + 1
            versions.append((key, heads[key]["title"], n))
            heads[key] |= {"title": title, "location_raw": place, "content_hash": h}
            outcomes.append((key, "updated"))
    return heads, versions, outcomes


def hash_of(title):
    return f"h{title}"


def test_changes_in_a_batch_against_one_after_the_other(spark):
    random.seed(5)
    head = {k: {"company_id": f"c{k}", "title": random.choice("abc"), "location_raw": "x"} for k in range(0, 12)}
    for h in head.values():
        h["content_hash"] = hash_of(h["title"])
    batch = [(random.randrange(20), n, f"n{n}", random.choice("abc"), f"p{n}") for n in range(90)]
    schema = "source_posting_id long, at int, company_id string, title string, location_raw string"
    rows = spark.createDataFrame(batch, schema).withColumn("content_hash", F.concat(F.lit("h"), "title")).withColumn("source_id", F.lit("s"))
    heads = spark.createDataFrame([(k, v["company_id"], v["title"], v["location_raw"], v["content_hash"]) for k, v in head.items()], "source_posting_id long, company_id string, title string, location_raw string, content_hash string")
    heads = heads.withColumn("source_id", F.lit("s")).withColumn("status", F.lit("closed")).withColumn("first_seen_at", now(1)).withColumn("last_seen_at", now(1)).withColumn("closed_at", now(2))
    content = ["company_id", "title", "location_raw", "content_hash"]
    got, versions, outcomes = tables.versioned_fold(heads, rows.repartition(4), ["source_id", "source_posting_id"], content, "content_hash", [F.col("at")], now())
    want_heads, want_versions, want_outcomes = folded(head, batch)
    assert {r.source_posting_id: {c: r[c] for c in content} for r in got.collect()} == want_heads
    assert sorted((r.source_posting_id, r.title, r.change_no) for r in versions.collect()) == sorted(want_versions)
    assert sorted((r.source_posting_id, r.outcome) for r in outcomes.collect()) == sorted(want_outcomes)
    seen = {b[0] for b in batch}
    for r in got.collect():
        assert (r.status, r.closed_at is None) == (("active", True) if r.source_posting_id in seen else ("closed", False))
        assert r.last_seen_at.day == (10 if r.source_posting_id in seen else 1) and r.first_seen_at.day == (1 if r.source_posting_id in head else 10)


def one_by_one(existing, mentions):
    """Companies and each mention's, going through the mentions in order."""
    companies = [dict(zip(("id", "name", "domain"), c)) for c in existing]
    of = {}
    for mention, name, domain, _ in mentions:
        same = [c for c in companies if c["name"] == name]
        hit = next((c for c in same if domain and c["domain"] == domain), same[0] if len(same) == 1 else None)
        if hit is None:
            hit = {"id": f"new {len(companies)}", "name": name, "domain": domain or None}
            companies.append(hit)
        elif domain and hit["domain"] is None:
            hit["domain"] = domain
        of[mention] = hit["id"]
    return companies, of


def test_companies_against_one_after_the_other(spark):
    random.seed(8)
    for _ in range(3):
        existing = [(f"e{k}", random.choice("abcd"), random.choice([None, "x", "y", "z"])) for k in range(6)]
        existing = [e for n, e in enumerate(existing) if e[1:] not in [x[1:] for x in existing[:n]]]
        mentions = [(f"m{n}", random.choice("abcdef"), random.choice([None, "", "x", "y", "w"]), n) for n in range(40)]
        table = spark.createDataFrame([(i, n, n, d) for i, n, d in existing], "company_id string, canonical_name string, normalized_name string, domain string")
        table = table.withColumn("first_seen_at", now(1)).withColumn("last_seen_at", now(1))
        companies, resolved = ingest.resolve_companies(table, spark.createDataFrame(mentions, "mention_id string, name string, domain string, seq int"), now())
        want, of = one_by_one(existing, mentions)
        got = {r.mention_id: r.company_id for r in resolved.collect()}
        same = {}
        for mention, company in got.items():  # the same classes, by whatever new ids
            assert same.setdefault(company, of[mention]) == of[mention]
        assert len(set(same.values())) == len(same)
        assert sorted((r.normalized_name, r.domain or "") for r in companies.collect()) == sorted((c["name"], c["domain"] or "") for c in want)
        assert {same[r.company_id]: r.domain for r in companies.collect() if r.company_id in same} == {c["id"]: c["domain"] for c in want if c["id"] in same.values()}


def stands(text, phrase):
    return bool(phrase) and re.search(rf"(?<![a-z0-9]){re.escape(phrase.lower())}(?![a-z0-9])", (text or "").lower()) is not None


@pytest.mark.parametrize("most", [100_000, 3])
def test_phrases_in_one_pass_against_the_rule(spark, most):
    random.seed(3)
    bits = ["go", "C++", "c", "node.js", "Node", " ", ".", "GO lang", "é", "1", "++", "data", "data science", "\n", "日本"]
    texts = [(n, "".join(random.choices(bits, k=random.randint(0, 14)))) for n in range(300)] + [(300, None), (301, "")]
    known = ["Go", "go lang", "C++", "C", "node.js", "js", "++", "Data Science", "data", "science", "é", "日本", ""]
    t, p = spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame([(k, n) for n, k in enumerate(known)], "phrase string, pos int")
    want = sorted((i, k) for i, x in texts for k in known if stands(x, k))
    assert sorted((r.text_id, r.phrase) for r in matching.named_phrases(t, p, broadcast=most).collect()) == want
    assert sorted((r.text_id, r.phrase) for r in matching.phrase_matches(t, p, broadcast=most).collect()) == want
    got = {r.text_id: r.skills for r in matching.tagged(t, p).collect()}
    assert got == {i: [k for k in known if stands(x, k)] for i, x in texts}
    assert matching.named_phrases(t, p.limit(0)).count() == 0 and matching.named_phrases(t.limit(0), p).count() == 0


def test_longest_spans():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in ("data", "data science", "science fiction", "science"):
        a.add_word(word, word)
    a.make_automaton()
    assert phrases.longest(list(phrases.places(a, "data science fiction, data"))) == [(0, 12, "data science"), (5, 20, "science fiction"), (22, 26, "data")]


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        stored.root(Session())
