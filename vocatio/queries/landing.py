"""Queries over reference files, landed payloads, uploads, and operators on sets and owners."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocatio.functions.text import canonical_json
from vocatio.operators import evidence, ingest, matching, roles, tables
from vocatio.plans.jobs import build_reference
from vocatio.queries.adapters import derived, plain, table
from vocatio.queries.matching import PHRASE_FREQUENCY, phrase_frequency
from vocatio.sources import files


def alternate_titles(spark, sf_dir):
    """Parts as rows of the alternate-title file."""
    raw = table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".00 ")).alias("O*NET-SOC Code"),
        F.col("p_name").alias("Job Title"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("  ").alias("Short Title"),
        F.col("p_type").alias("Source(s)"),
    )
    return files.alternate_titles(raw)


ALTERNATE_TITLES = """
SELECT concat(p_partkey::VARCHAR, '.00') AS onet_soc_code, p_name AS alt_title, CASE WHEN p_size % 2 = 0 THEN p_brand END AS short_title, p_type AS source FROM part
"""

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1))"


def page_hosts(spark, sf_dir):
    """The hosts of all pages as an allowlist file."""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("h"))
    return files.allowed_domains(hosts.select(F.concat(F.lit("  "), F.upper("h"), F.lit(" ")).alias("domain")))


PAGE_HOSTS = f"SELECT DISTINCT {_HOST} AS domain FROM pages WHERE {_HOST} <> ''"


def listed_stubs(spark, sf_dir):
    """A listing of all orders of each customer, some of them broken, as stubs."""
    job = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("https://jobs.example.com/"), "o_orderkey").alias("absolute_url"))
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(job).alias("jobs"))
    payload = F.when(F.col("o_custkey") % 50 == 0, "not json").otherwise(F.to_json(F.struct("jobs")))
    return files.listed_jobs(lists.select(F.col("o_custkey").alias("source_id"), payload.alias("payload")))


LISTED_STUBS = """
SELECT o_custkey AS source_id, o_orderkey::VARCHAR AS source_posting_id, concat('https://jobs.example.com/', o_orderkey::VARCHAR) AS url
FROM orders WHERE o_custkey % 50 <> 0
"""


def transcript_layers(spark, sf_dir):
    """Which documents have a text layer, and which look scanned."""
    good, scanned = files.transcripts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return good.select("doc_id", F.lit(True).alias("readable")).unionByName(scanned.select("doc_id", F.lit(False).alias("readable")))


TRANSCRIPT_LAYERS = r"SELECT doc_id, coalesce(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 40, false) AS readable FROM documents"

_UPLOADED = """
SELECT *, concat('/up/', CAST(doc_id AS STRING), CASE WHEN doc_id % 7 = 0 THEN '.PDF' WHEN doc_id % 11 = 0 THEN '.txt' ELSE '.pdf' END) AS path,
  CASE WHEN doc_id % 5 = 0 THEN text ELSE concat('%PDF-', text) END AS body
FROM @documents
"""


def triaged_uploads(spark, sf_dir):
    rows = derived(spark, sf_dir, _UPLOADED).withColumn("content", F.col("body").cast("binary"))
    return files.triaged(rows.withColumn("length", F.octet_length("content").cast("long")), most=20_000)


TRIAGED_UPLOADS = f"""
SELECT path, strlen(body)::BIGINT AS length,
  CASE WHEN NOT ends_with(lower(path), '.pdf') THEN 'extension' WHEN strlen(body) < 1 THEN 'empty' WHEN strlen(body) > 20000 THEN 'too_large'
    WHEN NOT starts_with(body, '%PDF-') THEN 'signature' END AS refused
FROM ({plain(_UPLOADED)})
"""


def payload_reads(spark, sf_dir):
    """Every page read back from the store of contents by its hash."""
    pages = table(spark, sf_dir, "pages")
    store = tables.payload_rows(pages.select(F.col("html").alias("payload")))
    read = files.stored_payloads(pages.select("page_id", F.sha2("html", 256).alias("sha256")), store)
    return read.select("page_id", "sha256", F.length("payload").cast("long").alias("n_chars"))


PAYLOAD_READS = "SELECT page_id, sha256(html) AS sha256, length(html) AS n_chars FROM pages WHERE html IS NOT NULL"


def unknown_owners(spark, sf_dir):
    """Lines of suppliers for orders of which they had no return."""
    lines = table(spark, sf_dir, "lineitem")
    entries = lines.select(F.col("l_suppkey").alias("profile_id"), F.col("l_orderkey").alias("owner_id"))
    owners = lines.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("profile_id"), F.col("l_orderkey").alias("id"))
    return evidence.unknown_owners(entries, owners)


UNKNOWN_OWNERS = """
SELECT l_suppkey AS profile_id, l_orderkey AS owner_id FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_suppkey = l.l_suppkey AND r.l_orderkey = l.l_orderkey)
"""

_JUDGED = """
SELECT l_orderkey % 100 AS profile_id, CASE l_partkey % 3 WHEN 0 THEN 'experience' WHEN 1 THEN 'projects' ELSE 'skills' END AS section, l_orderkey AS owner_id,
  l_linenumber AS pos, concat('Moved part ', CAST(l_partkey AS STRING)) AS text, CASE WHEN l_returnflag = 'R' THEN 'no_evidence' END AS reason
FROM @lineitem
"""


def surviving_entries(spark, sf_dir):
    """Orders as work, their lines as claims."""
    return evidence.surviving_entries(derived(spark, sf_dir, _JUDGED)).withColumn("bullets", F.array_join("bullets", "|"))


SURVIVING_ENTRIES = f"""
SELECT profile_id, section, owner_id, string_agg(text, '|' ORDER BY pos, text) AS bullets FROM ({plain(_JUDGED)})
WHERE reason IS NULL AND section <> 'skills' GROUP BY ALL
"""


def evidence_groups(spark, sf_dir):
    """Orders as items of their customer, by status."""
    items = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("profile_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").cast("string").alias("evidence_id"), F.col("o_orderpriority").alias("text")
    )
    told = F.transform("items", lambda x: F.concat_ws("=", x["evidence_id"], x["text"]))
    return evidence.grouped_items(items).select("profile_id", "kind", F.array_join(told, "|").alias("items"))


EVIDENCE_GROUPS = """
SELECT o_custkey AS profile_id, o_orderstatus AS kind,
  string_agg(concat(o_orderkey::VARCHAR, '=', o_orderpriority), '|' ORDER BY o_orderkey::VARCHAR, o_orderpriority) AS items
FROM orders GROUP BY ALL
"""


def ambiguous_companies(spark, sf_dir):
    """Customers as companies that share the name of their segment and nation."""
    companies = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("company_id"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("normalized_name")
    )
    return ingest.ambiguous_names(companies).withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), "|"))


AMBIGUOUS_COMPANIES = """
SELECT concat(c_mktsegment, ' ', c_nationkey::VARCHAR) AS normalized_name, count(*) AS n, string_agg(c_custkey::VARCHAR, '|' ORDER BY c_custkey) AS candidates
FROM customer GROUP BY 1 HAVING count(*) > 1
"""

_INDEX = "SELECT p_partkey AS pos, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name, p_brand AS other FROM @part"
_ASKED = """
SELECT p_partkey AS query_id,
  CASE p_partkey % 4 WHEN 0 THEN upper(substr(p_name, 2, 4)) WHEN 1 THEN p_brand WHEN 2 THEN CAST(p_partkey AS STRING) ELSE '' END AS query
FROM @part
"""


def role_hits(spark, sf_dir):
    """Parts as the index of roles, asked by pieces of names, brands, numbers, and by nothing."""
    index = derived(spark, sf_dir, _INDEX).select("pos", "name", F.array("other").alias("alternates"))
    hits = roles.local_hits(derived(spark, sf_dir, _ASKED), index)
    return hits.select("query_id", F.array_join("names", "|").alias("names"))


ROLE_HITS = f"""
WITH q AS (SELECT DISTINCT lower(query) AS asked FROM ({plain(_ASKED)})),
h AS (SELECT asked, name, pos, row_number() OVER (PARTITION BY asked ORDER BY pos, name) AS n FROM q, ({plain(_INDEX)})
  WHERE contains(lower(name), asked) OR contains(lower(other), asked)),
a AS (SELECT asked, string_agg(name, '|' ORDER BY pos, name) AS names FROM h WHERE n <= 8 GROUP BY 1)
SELECT query_id, names FROM ({plain(_ASKED)}) JOIN a ON asked = lower(query)
"""


def role_market(spark, sf_dir):
    """The phrases that documents name most, as the market of one role."""
    return roles.analysed("writer", phrase_frequency(spark, sf_dir))


ROLE_MARKET = f"""
SELECT 'writer' AS role_key, rank, phrase AS name, n_postings AS posting_count, frequency FROM ({PHRASE_FREQUENCY}) WHERE rank <= 10
"""

_HAVE = "SELECT o_custkey AS k, o_orderpriority AS v FROM @orders WHERE o_orderkey % 5 = 0"
_MORE = """
SELECT o_custkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE concat(' ', o_orderpriority) END AS v, o_orderkey AS pos
FROM @orders WHERE o_orderkey % 5 <> 0
"""


def added_values(spark, sf_dir):
    """Priorities that a customer's other orders add to those of every fifth order."""
    return matching.added(derived(spark, sf_dir, _HAVE), derived(spark, sf_dir, _MORE), "k", "v", "pos")


ADDED_VALUES = f"""
SELECT k, min_by(v, pos) AS v, min(pos) AS pos FROM ({plain(_MORE)}) m
WHERE NOT EXISTS (SELECT 1 FROM ({plain(_HAVE)}) h WHERE h.k = m.k AND lower(trim(h.v)) = lower(trim(m.v))) GROUP BY k, lower(trim(v))
"""


def canonical_objects(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    made = canonical_json(segment=F.col("c_mktsegment"), id=F.col("c_custkey"), name=F.col("c_name"))
    return c.select(F.col("c_custkey").alias("id"), made.alias("object"))


CANONICAL_OBJECTS = "SELECT c_custkey AS id, json_object('id', c_custkey, 'name', c_name, 'segment', c_mktsegment)::VARCHAR AS object FROM customer"

_SOC = "concat(CAST(10 + {k} % 80 AS STRING), '-', lpad(CAST({k} AS STRING), 6, '0'))"
_CIP = "concat(CAST(10 + {k} % 30 AS STRING), '.', lpad(CAST({k} % 100 AS STRING), 2, '0'))"
_SUPPLIED = f"SELECT s_suppkey AS k, {_SOC.format(k='s_suppkey')} AS soc, {_CIP.format(k='s_suppkey')} AS cip, s_name AS title, s_nationkey AS nation FROM @supplier"
_NAMED = f"SELECT p_partkey AS k, concat({_SOC.format(k='(p_partkey % 2000)')}, '.00') AS code, {_CIP.format(k='p_partkey')} AS cip, p_name, p_brand, p_type FROM @part"


def reference_build(spark, sf_dir):
    """Nations and parts as majors, suppliers as occupations and links, parts as their titles."""
    suppliers, parts = derived(spark, sf_dir, _SUPPLIED), derived(spark, sf_dir, _NAMED)
    code = F.concat(F.lit(" "), "soc", F.lit(".00 ")).alias("O*NET-SOC Code")
    quoted = lambda c: F.concat(F.lit('="'), c, F.lit('"')).alias("CIPCode")
    families = table(spark, sf_dir, "nation").select(
        quoted((10 + F.col("n_nationkey")).cast("string")), F.col("n_name").alias("CIPTitle"), F.lit("").alias("CIPDefinition"), F.lit("").alias("Action")
    )
    groups = parts.select(
        quoted(F.col("cip")), F.col("p_name").alias("CIPTitle"), F.lit("").alias("CIPDefinition"), F.when(F.col("k") % 300 < 20, "Deleted").otherwise("").alias("Action")
    )
    occupations = suppliers.select(code, F.col("title").alias("Title"), F.lit("").alias("Description"))
    titles = parts.select(F.col("code").alias("O*NET-SOC Code"), F.col("p_name").alias("Job Title"), F.col("p_brand").alias("Short Title"), F.col("p_type").alias("Source(s)"))
    zone = F.when(F.col("nation") % 6 == 5, "n/a").otherwise((F.col("nation") % 5 + 1).cast("string"))
    zones = suppliers.select(code, zone.alias("Job Zone"))
    links = suppliers.select(F.col("cip").alias("CIP2020Code"), F.when(F.col("k") % 7 == 0, "99-9").otherwise(F.col("soc")).alias("SOC2018Code"))
    made = build_reference(families.unionByName(groups), occupations, titles, zones, links)
    none = F.lit(None).cast("string")
    told = [
        made["cip_codes"].select(F.lit("major").alias("kind"), F.col("cip_code").alias("a"), F.col("parent_cip_code").alias("b"), F.col("is_active").cast("string").alias("c")),
        made["occupations"].select(F.lit("occupation"), "onet_soc_code", "soc_2018_code", F.col("job_zone").cast("string")),
        made["alt_titles"].select(F.lit("title"), "onet_soc_code", "alt_title", none),
        made["crosswalk"].select(F.lit("link"), "cip_code", "onet_soc_code", none),
    ]
    return told[0].union(told[1]).union(told[2]).union(told[3])


REFERENCE_BUILD = f"""
WITH s AS ({plain(_SUPPLIED)}), p AS ({plain(_NAMED)}),
m AS (SELECT (10 + n_nationkey)::VARCHAR AS code, NULL::VARCHAR AS parent, true AS active FROM nation UNION SELECT cip, substr(cip, 1, 2), k % 300 >= 20 FROM p)
SELECT 'major' AS kind, code AS a, CASE WHEN parent IN (SELECT code FROM m) THEN parent END AS b, active::VARCHAR AS c FROM m
UNION ALL SELECT 'occupation', concat(soc, '.00'), soc, CASE WHEN nation % 6 <> 5 THEN (nation % 5 + 1)::VARCHAR END FROM s
UNION ALL SELECT DISTINCT 'title', code, p_name, NULL FROM p WHERE code IN (SELECT concat(soc, '.00') FROM s)
UNION ALL SELECT DISTINCT 'link', cip, concat(soc, '.00'), NULL FROM s WHERE k % 7 <> 0 AND cip IN (SELECT code FROM m)
"""

QUERIES = {
    "reference_build": (reference_build, REFERENCE_BUILD),
    "alternate_titles": (alternate_titles, ALTERNATE_TITLES),
    "page_hosts": (page_hosts, PAGE_HOSTS),
    "listed_stubs": (listed_stubs, LISTED_STUBS),
    "transcript_layers": (transcript_layers, TRANSCRIPT_LAYERS),
    "triaged_uploads": (triaged_uploads, TRIAGED_UPLOADS),
    "payload_reads": (payload_reads, PAYLOAD_READS),
    "unknown_owners": (unknown_owners, UNKNOWN_OWNERS),
    "surviving_entries": (surviving_entries, SURVIVING_ENTRIES),
    "evidence_groups": (evidence_groups, EVIDENCE_GROUPS),
    "ambiguous_companies": (ambiguous_companies, AMBIGUOUS_COMPANIES),
    "role_hits": (role_hits, ROLE_HITS),
    "role_market": (role_market, ROLE_MARKET),
    "added_values": (added_values, ADDED_VALUES),
    "canonical_objects": (canonical_objects, CANONICAL_OBJECTS),
}
