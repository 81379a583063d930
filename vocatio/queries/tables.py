"""Queries over table writes and reference data."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocatio.operators import ingest, reference, tables
from vocatio.plans.jobs import ingest_and_publish
from vocatio.plans.snapshots import Snapshots
from vocatio.plans.stored import new_path
from vocatio.queries import text
from vocatio.queries.adapters import LANDED, LOCATIONS, TITLES, derived, pick, plain, table
from vocatio.sources import files

def now():
    return F.lit("2026-01-10 00:00:00").cast("timestamp")


def row_counts(spark, sf_dir):
    names = ("customer", "orders", "part", "supplier", "documents", "pages")
    counts = [table(spark, sf_dir, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


ROW_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in ("customer", "orders", "part", "supplier", "documents", "pages"))

INCOMING = """
SELECT c_custkey + CASE WHEN c_custkey % 7 = 0 THEN 1000000 ELSE 0 END AS c_custkey, c_name, c_nationkey, -c_acctbal AS c_acctbal, c_mktsegment
FROM @customer WHERE c_custkey % 3 = 0
"""


def upserted_customers(spark, sf_dir):
    return tables.upsert(table(spark, sf_dir, "customer"), derived(spark, sf_dir, INCOMING), ["c_custkey"])


UPSERTED_CUSTOMERS = f"""
WITH i AS ({plain(INCOMING)})
SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM i) UNION ALL SELECT * FROM i
"""


def absent_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha256"))
    old = d.filter("source IN ('src0', 'src1')").select(F.col("sha256")).distinct()
    return tables.absent(old, d.select("sha256"), ["sha256"])


ABSENT_DOCUMENTS = """
SELECT DISTINCT sha256(text) AS sha256 FROM documents
WHERE text NOT IN (SELECT text FROM documents WHERE source IN ('src0', 'src1'))
"""


def payload_store(spark, sf_dir):
    rows = tables.payload_rows(table(spark, sf_dir, "pages").select(F.col("html").alias("payload")))
    return rows.select("prefix", "key", "sha256", "n_bytes")


PAYLOAD_STORE = """
SELECT DISTINCT substr(sha256(html), 1, 2) AS prefix, concat('raw/', substr(sha256(html), 1, 2), '/', sha256(html)) AS key,
  sha256(html) AS sha256, strlen(html)::BIGINT AS n_bytes FROM pages
"""

_HEAD = """
SELECT CAST(o_custkey % 5 AS STRING) AS source_id, CAST(o_orderkey AS STRING) AS source_posting_id, CAST(o_custkey AS STRING) AS company_id,
  o_orderpriority AS title, sha256(o_orderpriority) AS content_hash,
  CASE WHEN o_orderkey % 9 = 0 THEN 'closed' ELSE 'active' END AS status,
  TIMESTAMP '2026-01-01 00:00:00' AS first_seen_at, TIMESTAMP '2026-01-02 00:00:00' AS last_seen_at
FROM @orders WHERE o_orderkey % 4 <> 0
"""
_BATCH = """
SELECT CAST(o_custkey % 5 AS STRING) AS source_id, CAST(o_orderkey AS STRING) AS source_posting_id, CAST(o_custkey + 1 AS STRING) AS company_id,
  title, sha256(title) AS content_hash
FROM (SELECT *, CASE WHEN o_orderkey % 6 = 0 THEN concat(o_orderpriority, ' new') ELSE o_orderpriority END AS title FROM @orders WHERE o_orderkey % 2 = 0) x
"""


def _versioned(spark, sf_dir):
    head = derived(spark, sf_dir, _HEAD.replace("sha256(o_orderpriority)", "sha2(o_orderpriority, 256)"))
    batch = derived(spark, sf_dir, _BATCH.replace("sha256(title)", "sha2(title, 256)"))
    return tables.versioned_upsert(head, batch, ["source_id", "source_posting_id"], ["company_id", "title", "content_hash"], "content_hash", now())


_BOTH = f"""
h AS ({plain(_HEAD)}), b AS ({plain(_BATCH)}),
j AS (SELECT coalesce(h.source_id, b.source_id) AS source_id, coalesce(h.source_posting_id, b.source_posting_id) AS source_posting_id,
  h.company_id AS hc, b.company_id AS bc, h.title AS ht, b.title AS bt, h.content_hash AS hh, b.content_hash AS bh, h.status AS hs, h.first_seen_at AS f, h.last_seen_at AS l,
  CASE WHEN b.title IS NULL THEN NULL WHEN h.title IS NULL THEN 'new' WHEN h.content_hash = b.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome
  FROM h FULL JOIN b ON h.source_id = b.source_id AND h.source_posting_id = b.source_posting_id)
"""


def versioned_heads(spark, sf_dir):
    h = _versioned(spark, sf_dir)[0]
    return h.withColumn("first_seen_at", F.date_format("first_seen_at", "yyyy-MM-dd")).withColumn("last_seen_at", F.date_format("last_seen_at", "yyyy-MM-dd"))


VERSIONED_HEADS = f"""
WITH {_BOTH}
SELECT source_id, source_posting_id, CASE WHEN outcome = 'new' THEN bc ELSE hc END AS company_id,
  CASE WHEN outcome IN ('new', 'updated') THEN bt ELSE ht END AS title, CASE WHEN outcome IN ('new', 'updated') THEN bh ELSE hh END AS content_hash,
  CASE WHEN outcome IS NULL THEN hs ELSE 'active' END AS status,
  strftime(CASE WHEN outcome = 'new' THEN TIMESTAMP '2026-01-10' ELSE f END, '%Y-%m-%d') AS first_seen_at,
  strftime(CASE WHEN outcome IS NULL THEN l ELSE TIMESTAMP '2026-01-10' END, '%Y-%m-%d') AS last_seen_at
FROM j
"""


def posting_versions(spark, sf_dir):
    return _versioned(spark, sf_dir)[1].drop("recorded_at")


POSTING_VERSIONS = f"WITH {_BOTH} SELECT source_id, source_posting_id, ht AS title, hh AS content_hash FROM j WHERE outcome = 'updated'"


def outcome_counters(spark, sf_dir):
    return tables.outcome_counts(_versioned(spark, sf_dir)[2], "source_id", ["new", "updated", "unchanged"])


OUTCOME_COUNTERS = f"""
WITH {_BOTH}
SELECT source_id, count(*) AS seen, count(*) FILTER (outcome = 'new') AS new, count(*) FILTER (outcome = 'updated') AS updated,
  count(*) FILTER (outcome = 'unchanged') AS unchanged
FROM j WHERE outcome IS NOT NULL GROUP BY ROLLUP (source_id)
"""


_USERS = "SELECT DISTINCT user_id AS k, 'view' AS title, 'u' AS content_hash FROM @events WHERE user_id % 3 <> 0"


def folded_changes(spark, sf_dir):
    """The events of a user one after the other, against the head of two users of three."""
    head = derived(spark, sf_dir, _USERS).withColumn("content_hash", F.sha2("title", 256)).withColumn("status", F.lit("closed"))
    batch = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("title"), F.sha2("event_type", 256).alias("content_hash"), "event_id")
    heads, versions, outcomes = tables.versioned_fold(head, batch, ["k"], ["title", "content_hash"], "content_hash", [F.col("event_id")], now())
    told = versions.select("k", "title", "change_no", F.lit("version").alias("kind"))
    told = told.unionByName(heads.select("k", "title", F.lit(0).alias("change_no"), F.lit("head").alias("kind")))
    counts = outcomes.groupBy("k", "outcome").agg(F.count("*").cast("int").alias("change_no"))
    return told.unionByName(counts.select("k", F.col("outcome").alias("title"), "change_no", F.lit("outcomes").alias("kind")))


FOLDED_CHANGES = """
WITH e AS (
  SELECT user_id AS k, event_id, event_type AS title,
    coalesce(lag(event_type) OVER w, CASE WHEN user_id % 3 <> 0 THEN 'view' END) AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
o AS (SELECT *, CASE WHEN was IS NULL THEN 'new' WHEN was = title THEN 'unchanged' ELSE 'updated' END AS outcome FROM e)
SELECT k, was AS title, row_number() OVER (PARTITION BY k ORDER BY event_id)::INT AS change_no, 'version' AS kind FROM o WHERE outcome = 'updated'
UNION ALL SELECT k, max_by(title, event_id), 0, 'head' FROM o GROUP BY k
UNION ALL SELECT k, outcome, count(*)::INT, 'outcomes' FROM o GROUP BY k, outcome
"""


def change_chains(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return tables.change_chain(e, ["user_id"], "event_type", F.col("event_id"))


CHANGE_CHAINS = """
SELECT * FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
WHERE previous IS NULL OR previous <> event_type
"""


def first_and_last_seen(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"))


FIRST_AND_LAST_SEEN = "SELECT user_id, event_type, min(event_id) AS first_seen, max(event_id) AS last_seen FROM events GROUP BY ALL"


def rejected_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    o = o.unionByName(o.filter("o_orderkey % 50 = 0"))
    parents = table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("o_custkey"))
    checks = {"status": "o_orderstatus IN ('O', 'F')", "price": "o_totalprice > 1000"}
    _, bad = tables.split_valid(o, checks, ["o_orderkey"], {"o_custkey": parents})
    return bad.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


REJECTED_ORDERS = """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders UNION ALL
           SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 50 = 0),
r AS (SELECT o_orderkey, concat_ws(',', CASE WHEN NOT coalesce(o_orderstatus IN ('O', 'F'), false) THEN 'check:status' END,
        CASE WHEN NOT coalesce(o_totalprice > 1000, false) THEN 'check:price' END,
        CASE WHEN count(*) OVER (PARTITION BY o_orderkey) > 1 THEN 'duplicate_key' END,
        CASE WHEN o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) THEN 'no_o_custkey' END) AS reasons
      FROM o)
SELECT * FROM r WHERE reasons <> ''
"""


def capped_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return tables.capped(o, "o_custkey", [F.col("o_orderkey")], 3)


CAPPED_ORDERS = "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3"


def last_order_of_a_customer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return tables.keep_last(o, ["o_custkey"], [F.col("o_orderkey")])


LAST_ORDER_OF_A_CUSTOMER = "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey"

_MAJOR_CODES = """
SELECT CASE p_partkey % 4 WHEN 0 THEN concat('="', lpad(CAST(p_partkey % 90 AS STRING), 2, '0'), '"')
  WHEN 1 THEN concat('="', lpad(CAST(p_partkey % 90 AS STRING), 2, '0'), '.0', CAST(p_partkey % 9 AS STRING), '"')
  WHEN 2 THEN concat(' ', lpad(CAST(p_partkey % 97 AS STRING), 2, '0'), '.0', CAST(p_partkey % 9 AS STRING), '01 ') ELSE '="1.1"' END AS CIPCode,
  CASE p_partkey % 5 WHEN 0 THEN 'Moved from' WHEN 1 THEN 'Deleted' WHEN 2 THEN NULL ELSE 'New' END AS Action, p_name AS CIPTitle,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS CIPDefinition
FROM @part
"""


def major_codes(spark, sf_dir):
    m = files.majors(derived(spark, sf_dir, _MAJOR_CODES)).dropDuplicates(["cip_code"])
    return reference.without_orphans(m).select("cip_code", "level", "parent_cip_code", "orphan")


MAJOR_CODES = rf"""
WITH c AS (SELECT DISTINCT regexp_replace(trim(CIPCode), '^="(.*)"$', '\1') AS cip_code FROM ({plain(_MAJOR_CODES)})),
v AS (SELECT cip_code, CASE WHEN regexp_matches(cip_code, '^\d{{2}}$') THEN 2 WHEN regexp_matches(cip_code, '^\d{{2}}\.\d{{2}}$') THEN 4
  WHEN regexp_matches(cip_code, '^\d{{2}}\.\d{{4}}$') THEN 6 END AS level FROM c),
p AS (SELECT *, CASE level WHEN 4 THEN split_part(cip_code, '.', 1) WHEN 6 THEN substr(cip_code, 1, 5) END AS parent FROM v WHERE level IS NOT NULL)
SELECT cip_code, level, CASE WHEN parent IN (SELECT cip_code FROM p) THEN parent END AS parent_cip_code,
  parent IS NOT NULL AND parent NOT IN (SELECT cip_code FROM p) AS orphan FROM p
"""


def major_activity(spark, sf_dir):
    m = files.majors(derived(spark, sf_dir, _MAJOR_CODES))
    return m.groupBy("is_active", "crosswalk_notes").agg(F.count("*").alias("n"), F.count("cip_definition").alias("n_defined"))


MAJOR_ACTIVITY = rf"""
SELECT coalesce(Action, '') NOT IN ('Moved from', 'Deleted') AS is_active, nullif(trim(Action), '') AS crosswalk_notes, count(*) AS n,
  count(nullif(CIPDefinition, '')) AS n_defined
FROM ({plain(_MAJOR_CODES)}) WHERE regexp_matches(regexp_replace(trim(CIPCode), '^="(.*)"$', '\1'), '^\d{{2}}(\.\d{{2}}(\d{{2}})?)?$') GROUP BY ALL
"""

_OCCUPATIONS = "SELECT concat(p_brand, '.', lpad(CAST(p_partkey % 40 AS STRING), 2, '0')) AS `O*NET-SOC Code`, min(p_name) AS Title, '' AS Description FROM @part GROUP BY 1"
_OCC_SQL = "SELECT concat(p_brand, '.', lpad(CAST(p_partkey % 40 AS STRING), 2, '0')) AS code, p_brand AS soc, min(p_name) AS title FROM part GROUP BY ALL"
_LINKS = "SELECT DISTINCT CAST(c_nationkey AS STRING) AS CIP2020Code, CASE WHEN c_custkey % 11 = 0 THEN 'none' ELSE concat('Brand#', CAST(c_custkey % 60 AS STRING)) END AS SOC2018Code FROM @customer"


def _occupations(spark, sf_dir):
    raw = derived(spark, sf_dir, _OCCUPATIONS)
    z = raw.select("`O*NET-SOC Code`", (F.length("Title") % 5).alias("Job Zone"), F.lit("2026").alias("Date")).filter("`Job Zone` > 1")
    return files.occupations(raw, files.zones(z))


def _pairs(spark, sf_dir):
    return reference.fan_out(files.crosswalk_rows(derived(spark, sf_dir, _LINKS)), _occupations(spark, sf_dir))


def occupation_zones(spark, sf_dir):
    return _occupations(spark, sf_dir).select("onet_soc_code", "soc_2018_code", "job_zone")


OCCUPATION_ZONES = f"SELECT code AS onet_soc_code, soc AS soc_2018_code, CASE WHEN length(title) % 5 > 1 THEN (length(title) % 5)::INT END AS job_zone FROM ({_OCC_SQL})"


def crosswalk_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


_PAIRS_SQL = f"SELECT DISTINCT CIP2020Code AS cip_code, code AS onet_soc_code FROM ({plain(_LINKS)}) l JOIN ({_OCC_SQL}) o ON l.SOC2018Code = o.soc"


def crosswalk_unmatched(spark, sf_dir):
    return reference.unmatched(files.crosswalk_rows(derived(spark, sf_dir, _LINKS)), _occupations(spark, sf_dir))


CROSSWALK_UNMATCHED = f"SELECT CIP2020Code AS cip_code, SOC2018Code AS soc_2018_code FROM ({plain(_LINKS)}) WHERE SOC2018Code NOT IN (SELECT p_brand FROM part)"


def crosswalk_coverage(spark, sf_dir):
    pairs, occ = _pairs(spark, sf_dir), _occupations(spark, sf_dir)
    majors = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("cip_code"))
    return reference.coverage(majors, pairs, "cip_code", "majors").unionByName(reference.coverage(occ, pairs, "onet_soc_code", "occupations"))


CROSSWALK_COVERAGE = f"""
WITH p AS ({_PAIRS_SQL}), m AS (SELECT DISTINCT n_nationkey::VARCHAR AS k FROM nation), o AS (SELECT DISTINCT code AS k FROM ({_OCC_SQL}))
SELECT 'majors' AS side, count(*) AS total, count(*) FILTER (k IN (SELECT cip_code FROM p)) AS covered,
  round(100.0::DOUBLE * count(*) FILTER (k IN (SELECT cip_code FROM p)) / count(*), 1) AS percent FROM m
UNION ALL
SELECT 'occupations', count(*), count(*) FILTER (k IN (SELECT onet_soc_code FROM p)),
  round(100.0::DOUBLE * count(*) FILTER (k IN (SELECT onet_soc_code FROM p)) / count(*), 1) FROM o
"""


def crosswalk_uncovered(spark, sf_dir):
    return reference.uncovered(_occupations(spark, sf_dir), _pairs(spark, sf_dir), "onet_soc_code")


CROSSWALK_UNCOVERED = f"SELECT code AS onet_soc_code FROM ({_OCC_SQL}) WHERE code NOT IN (SELECT onet_soc_code FROM ({_PAIRS_SQL}))"


def crosswalk_fan_out(spark, sf_dir):
    return reference.fan_out_counts(_pairs(spark, sf_dir), "onet_soc_code", "cip_code")


CROSSWALK_FAN_OUT = f"SELECT onet_soc_code, count(DISTINCT cip_code) AS n_links FROM ({_PAIRS_SQL}) GROUP BY 1"

_NODES = """
SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, CAST(NULL AS STRING) AS parent FROM @region
UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM @nation
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)) FROM @customer
"""


def hierarchy_rollup(spark, sf_dir):
    up = reference.ancestors(derived(spark, sf_dir, _NODES), "id", "parent")
    spent = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"))
    return spent.join(up, "id").groupBy("ancestor", "distance").agg(F.count("*").alias("n_orders"))


HIERARCHY_ROLLUP = f"""
WITH RECURSIVE n AS ({plain(_NODES)}),
u AS (SELECT id, id AS ancestor, 0 AS distance FROM n UNION ALL SELECT u.id, n.parent, distance + 1 FROM u JOIN n ON n.id = u.ancestor WHERE n.parent IS NOT NULL)
SELECT ancestor, distance, count(*) AS n_orders FROM orders JOIN u ON u.id = concat('c', o_custkey::VARCHAR) GROUP BY ALL
"""


def referential_pairs(spark, sf_dir):
    occ = _occupations(spark, sf_dir).filter("job_zone IS NOT NULL")
    majors = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("cip_code"))
    return reference.referential(_pairs(spark, sf_dir), majors, occ)


REFERENTIAL_PAIRS = f"""
SELECT * FROM ({_PAIRS_SQL}) WHERE cip_code IN (SELECT n_nationkey::VARCHAR FROM nation WHERE n_regionkey < 3)
  AND onet_soc_code IN (SELECT code FROM ({_OCC_SQL}) WHERE length(title) % 5 > 1)
"""

_SEED = """
SELECT CASE s_suppkey % 3 WHEN 0 THEN 'ats_api' WHEN 1 THEN 'feed' ELSE 'other' END AS source_type, s_name AS name,
  concat('https://boards.example.com/v1/', CAST(s_suppkey AS STRING), '/') AS base_url, 'none' AS auth_mode,
  CASE s_suppkey % 4 WHEN 0 THEN ' TRUE' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' END AS enabled, '' AS terms_reviewed_at,
  CASE WHEN s_suppkey % 2 = 0 THEN '1.5' ELSE '' END AS crawl_delay_seconds, CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE '60' END AS rate_limit_per_minute
FROM @supplier
"""


def source_registry(spark, sf_dir):
    s = files.enabled_sources(files.registry(derived(spark, sf_dir, _SEED)))
    return s.select("name", "base_url", F.col("politeness")["crawl_delay_seconds"].alias("delay"), F.col("politeness")["rate_limit_per_minute"].alias("rate"), "terms_reviewed_at")


SOURCE_REGISTRY = f"""
SELECT name, base_url, try_cast(nullif(crawl_delay_seconds, '') AS DOUBLE) AS delay, try_cast(nullif(rate_limit_per_minute, '') AS DOUBLE) AS rate,
  nullif(terms_reviewed_at, '') AS terms_reviewed_at
FROM ({plain(_SEED)}) WHERE source_type = 'ats_api' AND lower(trim(enabled)) IN ('true', '1', 'yes')
"""


def job_records(spark, sf_dir):
    r = files.job_records(derived(spark, sf_dir, LANDED))
    return r.select("url", "source_posting_id", "company_name", "title", "description", "location_raw", F.unix_timestamp("posted_at").alias("posted_at"), "rejected")


_COMPANIES = ["Acme Inc", "Acme", "Globex Corporation", "Initech LLC"]
_JOBS = f"""
SELECT c_custkey AS k, c_mktsegment AS source_id, concat('https://jobs.example.com/', c_custkey::VARCHAR) AS url,
  CASE WHEN c_custkey % 37 = 0 THEN 'invalid_json' WHEN c_custkey % 41 = 0 THEN 'missing_required_field' END AS rejected,
  {pick(TITLES, 'c_custkey')} AS title, {pick(_COMPANIES, 'c_custkey')} AS company, {pick(LOCATIONS, 'c_custkey')} AS place, c_custkey % 5 AS a, c_custkey % 9 AS d
FROM customer
"""
JOB_RECORDS = f"""
SELECT url, CASE WHEN rejected = 'invalid_json' THEN NULL ELSE k::VARCHAR END AS source_posting_id, CASE WHEN rejected IS NULL THEN company ELSE '' END AS company_name,
  CASE WHEN rejected IS NULL THEN title END AS title,
  CASE WHEN rejected IS NULL THEN concat('Build &amp; run things. Mail a', a::VARCHAR, '@acme.com') ELSE '' END AS description,
  CASE WHEN rejected IS NULL THEN place END AS location_raw,
  CASE WHEN rejected IS NULL THEN epoch(TIMESTAMP '2026-01-01 08:00:00' + to_days(d::INT))::BIGINT END AS posted_at, rejected
FROM ({_JOBS})
"""
_FATES = f"""
SELECT source_id, CASE WHEN rejected IS NOT NULL THEN 'parse_failed' WHEN NOT is_us THEN 'excluded_non_us' END AS fate
FROM ({_JOBS}) j JOIN ({text.QUERIES['location_scope'][1]}) l ON j.k = l.id
"""
INGEST_FATES = f"SELECT source_id, fate, count(*) AS n, count(*) FILTER (fate IS DISTINCT FROM 'parse_failed') AS n_redacted FROM ({_FATES}) GROUP BY ALL"
INGEST_RERUN = f"""
SELECT source_id, count(*) AS seen, 0::BIGINT AS new, 0::BIGINT AS updated, count(*) FILTER (fate IS NULL) AS unchanged,
  count(*) FILTER (fate = 'excluded_non_us') AS excluded_non_us, count(*) FILTER (fate = 'parse_failed') AS parse_failed, 0::BIGINT AS quarantined
FROM ({_FATES}) GROUP BY ROLLUP (source_id)
"""


def ingest_fates(spark, sf_dir):
    p = ingest.prepared(derived(spark, sf_dir, LANDED))
    return p.groupBy("source_id", "fate").agg(F.count("*").alias("n"), F.count_if(F.contains("clean", F.lit("[REDACTED_EMAIL]"))).alias("n_redacted"))


def ingested_postings(spark, sf_dir):
    """A batch into empty tables, and the same batch again into what that gave."""
    from vocatio.plans.jobs import empty

    landed = derived(spark, sf_dir, LANDED)
    first = ingest.ingest(landed, empty(spark, "postings"), empty(spark, "companies"), empty(spark, "raw_documents"), now())
    again = ingest.ingest(landed, first.postings, first.companies, first.raw_documents, now())
    return again.postings.groupBy("source_id", "employment_type", "scope_reason", "status").agg(
        F.count("*").alias("n"), F.count_distinct("company_id").alias("n_companies")
    )


def ingest_rerun(spark, sf_dir):
    """Counters of the second run of one batch: all unchanged."""
    from vocatio.plans.jobs import empty

    landed = derived(spark, sf_dir, LANDED)
    first = ingest.ingest(landed, empty(spark, "postings"), empty(spark, "companies"), empty(spark, "raw_documents"), now())
    return ingest.ingest(landed, first.postings, first.companies, first.raw_documents, now()).counters


INGESTED_POSTINGS = f"""
SELECT j.source_id, employment_type, reason AS scope_reason, 'active' AS status, count(*) AS n,
  count(DISTINCT split_part(company, ' ', 1)) AS n_companies
FROM ({_JOBS}) j JOIN ({text.QUERIES['location_scope'][1]}) l ON j.k = l.id JOIN ({text.QUERIES['employment'][1]}) e ON j.k = e.posting_id
WHERE rejected IS NULL AND is_us GROUP BY ALL
"""

_SECOND = f"""
SELECT source_id, url, TIMESTAMP '2026-01-06 00:00:00' AS fetched_at, replace(payload, '"title": "', CASE WHEN length(url) % 2 = 0 THEN '"title": "Senior ' ELSE '"title": "' END) AS payload
FROM ({LANDED}) x WHERE CAST(substr(url, 26) AS INT) % 3 = 0
"""


def published_tables(spark, sf_dir):
    """Two batches published one after the other and read back from disk: the second holds a third of
    the postings, some with another title.  Rows of each table, and of the postings by title."""
    root = new_path(spark, "published")
    ingest_and_publish(spark, derived(spark, sf_dir, LANDED), root, now())
    ingest_and_publish(spark, derived(spark, sf_dir, _SECOND), root, F.lit("2026-01-11 00:00:00").cast("timestamp"))
    store = Snapshots(spark, root)
    out = None
    for name in sorted(store.tables):
        one = store.read(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    titles = store.read("postings").groupBy("title").agg(F.count("*").alias("n")).select(F.concat(F.lit("title "), "title").alias("name"), "n")
    seen = store.read("postings").groupBy("last_seen_at").agg(F.count("*").alias("n")).select(F.concat(F.lit("seen "), F.date_format("last_seen_at", "yyyy-MM-dd")).alias("name"), "n")
    return out.unionByName(titles).unionByName(seen)


PUBLISHED_TABLES = f"""
WITH j AS (SELECT j.*, rejected IS NULL AND is_us AS fits, k % 3 = 0 AS again, k % 3 = 0 AND length(url) % 2 = 0 AND rejected IS NULL AS changed
  FROM ({_JOBS}) j JOIN ({text.QUERIES['location_scope'][1]}) l ON j.k = l.id),
p AS (SELECT count(*) FILTER (fits) AS ok, count(*) FILTER (fits AND changed) AS turned, count(*) FILTER (changed) AS changed, count(*) AS n,
  count(*) FILTER (rejected = 'invalid_json') AS broken, count(DISTINCT a) FILTER (fits) AS texts, count(DISTINCT split_part(company, ' ', 1)) FILTER (fits) AS companies,
  count(*) FILTER (NOT fits) + count(*) FILTER (NOT fits AND again) AS refused, count(DISTINCT source_id) + 1 + count(DISTINCT source_id) FILTER (again) + 1 AS counters FROM j)
SELECT 'postings' AS name, ok AS n FROM p UNION ALL SELECT 'companies', companies FROM p UNION ALL SELECT 'posting_versions', turned FROM p
UNION ALL SELECT 'raw_documents', n + ok + changed FROM p
UNION ALL SELECT 'payloads', n - greatest(broken - 1, 0) + changed + 1 FROM p
UNION ALL SELECT 'rejected', refused FROM p UNION ALL SELECT 'counters', counters FROM p
UNION ALL SELECT 'title ' || CASE WHEN changed THEN 'Senior ' ELSE '' END || title, count(*) FROM j WHERE fits GROUP BY 1
UNION ALL SELECT CASE WHEN again THEN 'seen 2026-01-11' ELSE 'seen 2026-01-10' END, count(*) FROM j WHERE fits GROUP BY 1
"""


def resolved_companies(spark, sf_dir):
    """Suppliers as companies, customers' names as mentions."""
    old = derived(spark, sf_dir, f"SELECT concat('id', CAST(s_suppkey AS STRING)) AS company_id, {pick(_COMPANIES, 's_suppkey')} AS canonical_name, CAST(CASE WHEN s_suppkey < 4 THEN NULL ELSE concat('d', CAST(s_suppkey AS STRING), '.com') END AS STRING) AS domain, TIMESTAMP '2026-01-01 00:00:00' AS first_seen_at, TIMESTAMP '2026-01-01 00:00:00' AS last_seen_at FROM @supplier WHERE s_suppkey < 6 AND s_suppkey <> 2")
    from vocatio.functions.text import company_key

    old = old.withColumn("normalized_name", company_key(F.col("canonical_name"))).select("company_id", "canonical_name", "normalized_name", "domain", "first_seen_at", "last_seen_at")
    names = derived(spark, sf_dir, f"SELECT CAST(c_custkey AS STRING) AS mention_id, {pick([*_COMPANIES, 'Hooli Ltd'], 'c_custkey')} AS name, CASE WHEN c_custkey % 7 = 0 THEN concat('d', CAST(c_custkey % 9 AS STRING), '.com') END AS domain, c_custkey AS seq FROM @customer")
    companies, resolved = ingest.resolve_companies(old, names, now())
    n = resolved.groupBy("company_id").agg(F.count("*").alias("n_mentions"), F.count_if("ambiguous").alias("n_ambiguous"))
    return companies.join(n, "company_id").select("canonical_name", "normalized_name", "domain", "n_mentions", "n_ambiguous")


_KEYED = "CASE split_part({0}, ' ', 1) WHEN 'Acme' THEN 'acme' WHEN 'Globex' THEN 'globex' WHEN 'Initech' THEN 'initech' ELSE 'hooli' END"
RESOLVED_COMPANIES = f"""
WITH e AS (SELECT 'id' || s_suppkey AS id, {pick(_COMPANIES, 's_suppkey')} AS canonical_name, {_KEYED.format(pick(_COMPANIES, 's_suppkey'))} AS key,
  CASE WHEN s_suppkey >= 4 THEN 'd' || s_suppkey || '.com' END AS domain FROM supplier WHERE s_suppkey < 6 AND s_suppkey <> 2),
m AS (SELECT c_custkey AS seq, {pick([*_COMPANIES, 'Hooli Ltd'], 'c_custkey')} AS name, {_KEYED.format(pick([*_COMPANIES, 'Hooli Ltd'], 'c_custkey'))} AS key,
  CASE WHEN c_custkey % 7 = 0 THEN 'd' || (c_custkey % 9) || '.com' END AS domain FROM customer),
n AS (SELECT key, count(*) AS n, min(id) AS only_id FROM e GROUP BY key),
r AS (SELECT m.*, coalesce(n, 0) AS n, x.id AS exact, CASE WHEN n = 1 THEN only_id END AS single FROM m LEFT JOIN n USING (key) LEFT JOIN e x ON x.key = m.key AND x.domain = m.domain),
c AS (SELECT *, coalesce(exact, single, CASE WHEN n = 0 THEN 'new ' || key WHEN domain IS NOT NULL THEN 'new ' || key || ' ' || domain ELSE 'new ' || seq END) AS id FROM r)
SELECT coalesce(min(e.canonical_name), min_by(name, seq)) AS canonical_name, min(c.key) AS normalized_name,
  coalesce(min(e.domain), min_by(c.domain, seq) FILTER (c.domain IS NOT NULL)) AS domain, count(*) AS n_mentions, count(*) FILTER (n > 1 AND exact IS NULL) AS n_ambiguous
FROM c LEFT JOIN e ON c.id = e.id GROUP BY c.id
"""


QUERIES = {
    "row_counts": (row_counts, ROW_COUNTS),
    "upserted_customers": (upserted_customers, UPSERTED_CUSTOMERS),
    "absent_documents": (absent_documents, ABSENT_DOCUMENTS),
    "payload_store": (payload_store, PAYLOAD_STORE),
    "versioned_heads": (versioned_heads, VERSIONED_HEADS),
    "posting_versions": (posting_versions, POSTING_VERSIONS),
    "outcome_counters": (outcome_counters, OUTCOME_COUNTERS),
    "change_chains": (change_chains, CHANGE_CHAINS),
    "first_and_last_seen": (first_and_last_seen, FIRST_AND_LAST_SEEN),
    "rejected_orders": (rejected_orders, REJECTED_ORDERS),
    "capped_orders": (capped_orders, CAPPED_ORDERS),
    "last_order_of_a_customer": (last_order_of_a_customer, LAST_ORDER_OF_A_CUSTOMER),
    "major_codes": (major_codes, MAJOR_CODES),
    "major_activity": (major_activity, MAJOR_ACTIVITY),
    "occupation_zones": (occupation_zones, OCCUPATION_ZONES),
    "crosswalk_pairs": (crosswalk_pairs, _PAIRS_SQL),
    "crosswalk_unmatched": (crosswalk_unmatched, CROSSWALK_UNMATCHED),
    "crosswalk_coverage": (crosswalk_coverage, CROSSWALK_COVERAGE),
    "crosswalk_uncovered": (crosswalk_uncovered, CROSSWALK_UNCOVERED),
    "crosswalk_fan_out": (crosswalk_fan_out, CROSSWALK_FAN_OUT),
    "hierarchy_rollup": (hierarchy_rollup, HIERARCHY_ROLLUP),
    "referential_pairs": (referential_pairs, REFERENTIAL_PAIRS),
    "source_registry": (source_registry, SOURCE_REGISTRY),
    "job_records": (job_records, JOB_RECORDS),
    "ingest_fates": (ingest_fates, INGEST_FATES),
    "ingested_postings": (ingested_postings, INGESTED_POSTINGS),
    "folded_changes": (folded_changes, FOLDED_CHANGES),
    "published_tables": (published_tables, PUBLISHED_TABLES),
    "ingest_rerun": (ingest_rerun, INGEST_RERUN),
    "resolved_companies": (resolved_companies, RESOLVED_COMPANIES),
}
