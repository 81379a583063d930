"""SPEC: queries of the later phases, and the streaming operators run over a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocatio.operators import planned
from vocatio.queries.adapters import derived, pick, plain, table
from vocatio.streaming.ingest import running_counts

_NAMES = ["Software Engineer", "Registered Nurse", "Account Executive", "Mechanical Engineer", "Data Analyst"]
_ASKED = ["software engineer!", "Registered Nurses", "Account Executives", "mechanical  engineer", "Data Analyst II", "Poet"]
_POSTINGS = f"SELECT c_custkey AS posting_id, {pick(_ASKED, 'c_custkey')} AS title FROM @customer"


def _classified(spark, sf_dir):
    postings = derived(spark, sf_dir, _POSTINGS)
    names = spark.createDataFrame([(f"n{i}", n) for i, n in enumerate(_NAMES)], "code string, name string")
    return planned.cascade(planned.exact_titles(postings, names), planned.fuzzy_titles(postings, names))


def classified_titles(spark, sf_dir):
    return _classified(spark, sf_dir)


_GRAMS = "list_distinct(list_transform(range(1, greatest(length('  ' || {k} || ' ') - 2, 1) + 1), lambda i: substr('  ' || {k} || ' ', i, 3)))"
_KEY = r"trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"
_VALUES = ", ".join(f"('n{i}', '{n}')" for i, n in enumerate(_NAMES))
_CLASSIFIED = f"""
p AS (SELECT posting_id, {_KEY.format(t='title')} AS key FROM ({plain(_POSTINGS)})),
n AS (SELECT code, {_KEY.format(t='name')} AS key FROM (VALUES {_VALUES}) v(code, name)),
k AS (SELECT DISTINCT key FROM p),
s AS (SELECT k.key, code, len(list_intersect({_GRAMS.format(k='k.key')}, {_GRAMS.format(k='n.key')})) / len(list_distinct(list_concat({_GRAMS.format(k='k.key')}, {_GRAMS.format(k='n.key')}))) AS sim FROM k, n),
f AS (SELECT key, code, sim FROM s WHERE sim >= 0.5 QUALIFY row_number() OVER (PARTITION BY key ORDER BY sim DESC, code) = 1),
t AS (SELECT posting_id, code, 0.9::DOUBLE AS confidence, 'exact' AS method FROM p JOIN n USING (key)
      UNION ALL SELECT posting_id, code, round(0.7::DOUBLE + 0.15::DOUBLE * (sim - 0.5::DOUBLE) / 0.5::DOUBLE, 6), 'fuzzy' FROM p JOIN f USING (key)),
c AS (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY confidence DESC, code) = 1 AS is_primary FROM t)
"""
CLASSIFIED_TITLES = f"WITH {_CLASSIFIED} SELECT * FROM c"

_TRUTH = f"SELECT c_custkey AS posting_id, {pick(['n0', 'n1', 'n2', 'n3', 'n0', 'n9'], 'c_custkey')} AS code FROM @customer"


def title_quality(spark, sf_dir):
    return planned.tier_quality(_classified(spark, sf_dir), derived(spark, sf_dir, _TRUTH))


TITLE_QUALITY = f"""
WITH {_CLASSIFIED}, g AS ({plain(_TRUTH)})
SELECT method, count(*) AS n, count(*) FILTER (c.code = g.code) AS correct, round(count(*) FILTER (c.code = g.code) / count(*), 6) AS precision,
  round(count(*) FILTER (c.code = g.code) / (SELECT count(*) FROM g), 6) AS recall FROM c JOIN g USING (posting_id) GROUP BY method
"""


def title_confusion(spark, sf_dir):
    return planned.confusion(_classified(spark, sf_dir), derived(spark, sf_dir, _TRUTH))


TITLE_CONFUSION = f"WITH {_CLASSIFIED}, g AS ({plain(_TRUTH)}) SELECT c.code, g.code AS truth, count(*) AS n FROM c JOIN g USING (posting_id) WHERE c.code <> g.code GROUP BY ALL"

_SENTENCES = [
    ("3-5 years of SQL required.", 3, 5, None, "required"),
    ("Bachelor degree preferred.", None, None, "bachelor", "preferred"),
    ("At least 7+ years and a Master of Arts.", 7, None, "master", "unknown"),
    ("You must hold a clearance.", None, None, None, "required"),
    ("A CISSP is desired.", None, None, None, "preferred"),
    ("Free lunch.", None, None, None, None),
]
_ADS = f"SELECT p_partkey AS posting_id, concat('About us.', {pick([s[0] for s in _SENTENCES], 'p_partkey')}, ' Bye.') AS text FROM @part"


def requirements(spark, sf_dir):
    good, _ = planned.evidenced(planned.requirements(derived(spark, sf_dir, _ADS)))
    return good.select("posting_id", "start", "excerpt", F.col("years.min_years").alias("min_years"), F.col("years.max_years").alias("max_years"), "degree", "clearance", "strength")


_ROWS = ", ".join(
    f"({i}, '{s}', {'NULL' if a is None else a}::INT, {'NULL' if b is None else b}::INT, {'NULL' if d is None else repr(d)}::VARCHAR, '{g}')"
    for i, (s, a, b, d, g) in enumerate(_SENTENCES)
    if g
)
REQUIREMENTS = f"""
SELECT p_partkey AS posting_id, 10 AS start, s AS excerpt, a AS min_years, b AS max_years, d AS degree, s LIKE '%clearance%' AS clearance, g AS strength
FROM part JOIN (VALUES {_ROWS}) v(i, s, a, b, d, g) ON p_partkey % {len(_SENTENCES)} = i
"""


def years_by_degree(spark, sf_dir):
    found = planned.requirements(derived(spark, sf_dir, _ADS))
    return planned.years_by_degree(found.select("degree", F.col("years.min_years").alias("min_years")))


YEARS_BY_DEGREE = f"SELECT degree, min_years, count(*) AS n FROM ({REQUIREMENTS}) GROUP BY ALL"


def top_credentials(spark, sf_dir):
    return planned.top_credentials(planned.asked_credentials(planned.requirements(derived(spark, sf_dir, _ADS))))


TOP_CREDENTIALS = f"""
SELECT credential, count(*) AS n, min_by(excerpt, posting_id) AS example
FROM (SELECT degree AS credential, posting_id, excerpt FROM ({REQUIREMENTS}) WHERE degree IS NOT NULL
      UNION ALL SELECT 'cissp', posting_id, excerpt FROM ({REQUIREMENTS}) WHERE excerpt LIKE '%CISSP%') GROUP BY 1
"""


_SECTIONED = """
SELECT p_partkey AS posting_id, concat(p_name, '.', chr(10), CASE WHEN p_size % 2 = 0 THEN 'Preferred Qualifications:' ELSE 'Requirements' END, chr(10),
  CAST(1 + p_size % 20 AS STRING), '+ years with ', p_type, '.', chr(10), 'Six Sigma or ServSafe.', chr(10), 'About us', chr(10), 'PMP welcome.') AS text FROM @part
"""


def sectioned_requirements(spark, sf_dir):
    """Requirements below headings, in texts made of the parts' own words."""
    found = planned.requirements(derived(spark, sf_dir, _SECTIONED))
    return found.select("posting_id", "excerpt", "strength", F.col("years.min_years").alias("min_years"), F.array_join("certifications", ",").alias("certifications"))


SECTIONED_REQUIREMENTS = f"""
WITH s AS (SELECT p_partkey AS posting_id, p_size, p_type, CASE WHEN p_size % 2 = 0 THEN 'preferred' ELSE 'required' END AS strength FROM part)
SELECT posting_id, concat((1 + p_size % 20)::VARCHAR, '+ years with ', p_type, '.') AS excerpt, strength, (1 + p_size % 20)::INT AS min_years, '' AS certifications FROM s
UNION ALL SELECT posting_id, 'Six Sigma or ServSafe.', strength, NULL, 'six_sigma,servsafe' FROM s
UNION ALL SELECT posting_id, 'PMP welcome.', 'unknown', NULL, 'pmp' FROM s
"""


def years_percentiles(spark, sf_dir):
    found = planned.requirements(derived(spark, sf_dir, _SECTIONED))
    return planned.years_percentiles(found.select(F.col("strength").alias("degree"), F.col("years.min_years").alias("min_years")))


YEARS_PERCENTILES = f"""
SELECT strength AS degree, count(min_years) AS n, quantile_cont(min_years, 0.25) AS p25, quantile_cont(min_years, 0.5) AS p50, quantile_cont(min_years, 0.75) AS p75
FROM ({SECTIONED_REQUIREMENTS}) WHERE min_years IS NOT NULL GROUP BY 1
"""

_ENTRIES = [
    ("- Bachelor's degree", None, "bachelor", ""),
    ("MS Office", None, None, None),
    ("* 3 yrs in a lab", 3, None, ""),
    ("2. Doctorate or CISSP", None, "doctorate", "cissp"),
    ("Scrum Master with 5 ms latency", None, None, None),
    ("Juris Doctor", None, "professional", ""),
    ("High school diploma", None, "hs_diploma", ""),
]
_LISTED_ADS = f"""
SELECT p_partkey AS posting_id, concat(p_name, chr(10), CASE WHEN p_size % 2 = 0 THEN 'Nice to have' ELSE 'Minimum Qualifications:' END, chr(10),
  {pick([e[0].replace("'", "''") for e in _ENTRIES], 'p_partkey')}, chr(10), 'About us', chr(10), 'We pay an MBA', chr(10)) AS text FROM @part
"""


def listed_requirements(spark, sf_dir):
    """Requirements in lists whose lines end without a full stop."""
    found, _ = planned.evidenced(planned.requirements(derived(spark, sf_dir, _LISTED_ADS)))
    return found.select("posting_id", "start", "excerpt", F.col("years.min_years").alias("min_years"), "degree", F.array_join("certifications", ",").alias("certifications"), "strength")


def _listed_oracle() -> str:
    bare = [e[0].split(" ", 1)[1] if e[0][0] in "-*2" else e[0] for e in _ENTRIES]
    rows = ", ".join(
        f"({i}, {len(e[0]) - len(b)}, '{b.replace(chr(39), chr(39) * 2)}', {'NULL' if e[1] is None else e[1]}::INT, {'NULL' if e[2] is None else repr(e[2])}::VARCHAR, '{e[3]}')"
        for i, (e, b) in enumerate(zip(_ENTRIES, bare))
        if e[3] is not None
    )
    return f"""
WITH p AS (SELECT p_partkey, p_partkey % {len(_ENTRIES)} AS i, CASE WHEN p_size % 2 = 0 THEN 'preferred' ELSE 'required' END AS strength,
  length(p_name) + 1 + CASE WHEN p_size % 2 = 0 THEN 12 ELSE 23 END + 2 AS line, {pick([str(len(e[0])) for e in _ENTRIES], 'p_partkey')}::INT AS width FROM part)
SELECT p_partkey AS posting_id, (line + lead)::INT AS start, excerpt, years AS min_years, degree, certifications, strength FROM p JOIN (VALUES {rows}) v(i, lead, excerpt, years, degree, certifications) USING (i)
UNION ALL SELECT p_partkey, (line + width + 1 + 8 + 1)::INT, 'We pay an MBA', NULL, 'master', '', 'unknown' FROM p
"""


LISTED_REQUIREMENTS = _listed_oracle()

# each language's documents name the words of the benchmark's items as majors
_MAJOR_ALIASES = """
SELECT DISTINCT lower(split_part(text, ' ', 1)) AS alias, concat(substr(CAST(100 + item_id % 7 AS STRING), 2, 2), '.', CASE WHEN item_id % 3 = 0 THEN '01' ELSE CAST(1000 + item_id % 9000 AS STRING) END) AS cip_code FROM @benchmark
UNION ALL SELECT DISTINCT lower(concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2))), concat(substr(CAST(100 + item_id % 11 AS STRING), 2, 2), '.0101') FROM @benchmark WHERE split_part(text, ' ', 1) <> split_part(text, ' ', 2)
"""


def named_majors(spark, sf_dir):
    """Majors by the longest alias in whole documents, where the aliases are words of the benchmark."""
    d = table(spark, sf_dir, "documents")
    found = planned.majors_named(d.select(F.col("doc_id").alias("posting_id"), "text"), derived(spark, sf_dir, _MAJOR_ALIASES))
    return found.groupBy("posting_id", "cip_code").agg(F.count("*").alias("n_places"))


NAMED_MAJORS = rf"""
WITH a AS (SELECT DISTINCT alias, cip_code FROM ({plain(_MAJOR_ALIASES)}) WHERE alias <> ''),
deep AS (SELECT alias, cip_code FROM a QUALIFY length(cip_code) = max(length(cip_code)) OVER (PARTITION BY alias)),
c AS (
  SELECT alias, CASE WHEN count(*) = 1 THEN min(cip_code) WHEN count(DISTINCT substr(cip_code, 1, 5)) = 1 THEN min(substr(cip_code, 1, 5))
    WHEN count(DISTINCT substr(cip_code, 1, 2)) = 1 THEN min(substr(cip_code, 1, 2)) END AS cip_code FROM deep GROUP BY alias),
w AS (SELECT * FROM c WHERE cip_code IS NOT NULL),
t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
k AS (SELECT doc_id, t, alias, cip_code, string_split(t, alias) AS parts FROM t JOIN w ON contains(t, alias)),
p AS (SELECT doc_id, t, alias, cip_code, i, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(alias))::BIGINT AS pos FROM k, unnest(range(1, len(parts))) u(i)),
h AS (SELECT doc_id, alias, cip_code, pos, pos + length(alias) AS stop FROM p
  WHERE NOT regexp_matches(substr(t, pos, CASE WHEN pos = 0 THEN 0 ELSE 1 END), '[a-z0-9]') AND NOT regexp_matches(substr(t, pos + length(alias) + 1, 1), '[a-z0-9]')),
s AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY pos, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
f AS (SELECT * FROM s WHERE before IS NULL OR stop > before),
low AS (SELECT DISTINCT doc_id, unnest([substr(cip_code, 1, 2), substr(cip_code, 1, 5)]) AS above, cip_code FROM f)
SELECT doc_id AS posting_id, cip_code, count(*) AS n_places FROM f
WHERE NOT EXISTS (SELECT 1 FROM low WHERE low.doc_id = f.doc_id AND above = f.cip_code AND low.cip_code <> f.cip_code) GROUP BY ALL
"""

_CROSS = "SELECT DISTINCT CAST(c_nationkey AS STRING) AS cip_code, concat('n', CAST((c_nationkey + c_custkey % (1 + c_nationkey % 3)) % 5 AS STRING)) AS code FROM @customer"


def inferred_links(spark, sf_dir):
    primary = _classified(spark, sf_dir).filter("is_primary").select("posting_id", "code", "confidence")
    return planned.inferred_links(primary, derived(spark, sf_dir, _CROSS))


INFERRED_LINKS = f"""
WITH {_CLASSIFIED}, x AS ({plain(_CROSS)}), fans AS (SELECT code, count(DISTINCT cip_code) AS fan FROM x GROUP BY 1)
SELECT posting_id, cip_code, max(round(least(0.6::DOUBLE, confidence / log2(2.0::DOUBLE + fan)), 6)) AS confidence, 'inferred' AS link_type
FROM c JOIN x USING (code) JOIN fans USING (code) WHERE is_primary GROUP BY ALL
"""


def explicit_links(spark, sf_dir):
    texts = derived(spark, sf_dir, "SELECT c_custkey AS posting_id, upper(c_mktsegment) AS alias FROM @customer")
    aliases = derived(spark, sf_dir, "SELECT DISTINCT lower(c_mktsegment) AS alias, CAST(c_nationkey AS STRING) AS cip_code, c_nationkey % 3 AS level FROM @customer")
    return planned.explicit_links(texts, aliases)


EXPLICIT_LINKS = """
WITH a AS (SELECT lower(c_mktsegment) AS alias, max_by(c_nationkey::VARCHAR, (c_nationkey % 3, c_nationkey::VARCHAR)) AS cip_code FROM customer GROUP BY 1)
SELECT c_custkey AS posting_id, cip_code, 'explicit' AS link_type FROM customer JOIN a ON lower(c_mktsegment) = alias
"""


def link_counts(spark, sf_dir):
    both = explicit_links(spark, sf_dir).unionByName(inferred_links(spark, sf_dir).drop("confidence"))
    return planned.link_counts(both)


LINK_COUNTS = f"""
SELECT cip_code, count(*) FILTER (link_type = 'explicit') AS explicit, count(*) FILTER (link_type = 'inferred') AS inferred
FROM (({EXPLICIT_LINKS}) UNION ALL SELECT posting_id, cip_code, link_type FROM ({INFERRED_LINKS})) GROUP BY 1
"""

_HEADS = """
SELECT CAST(o_custkey % 4 AS STRING) AS source_id, o_orderkey AS source_posting_id, CASE WHEN o_orderkey % 6 = 0 THEN 'closed' ELSE 'active' END AS status,
  CASE WHEN o_orderkey % 10 = 0 THEN TIMESTAMP '2025-10-01 00:00:00' ELSE TIMESTAMP '2026-01-01 00:00:00' END AS last_seen_at, o_orderkey % 3 AS misses FROM @orders
"""
_LISTED = "SELECT CAST(o_custkey % 4 AS STRING) AS source_id, o_orderkey AS source_posting_id FROM @orders WHERE o_orderkey % 5 < 2"


def _refreshed(spark, sf_dir):
    heads = derived(spark, sf_dir, _HEADS)
    crawled = spark.createDataFrame([("0", True), ("1", True), ("2", False)], "source_id string, ok boolean")
    now = F.lit("2026-01-10").cast("timestamp")
    return heads, planned.refreshed(heads, derived(spark, sf_dir, _LISTED), crawled, now)


def refreshed_postings(spark, sf_dir):
    return _refreshed(spark, sf_dir)[1].withColumn("last_seen_at", F.date_format("last_seen_at", "yyyy-MM-dd"))


_REFRESHED = f"""
r AS (SELECT h.source_id, h.source_posting_id, h.status AS was, h.misses AS m, h.last_seen_at AS l, h.source_id IN ('0', '1') AS ok, h.source_posting_id % 5 < 2 AS seen FROM ({plain(_HEADS)}) h),
q AS (SELECT source_id, source_posting_id, was, CASE WHEN ok AND seen THEN TIMESTAMP '2026-01-10' ELSE l END AS last_seen_at,
  CASE WHEN NOT ok THEN m WHEN seen THEN 0 ELSE m + 1 END AS misses, ok, seen FROM r),
z AS (SELECT source_id, source_posting_id, was, CASE WHEN ok AND seen THEN 'active' WHEN ok AND misses >= 2 THEN 'closed'
  WHEN was = 'active' AND date_diff('day', last_seen_at, TIMESTAMP '2026-01-10') > 45 THEN 'stale' ELSE was END AS status, last_seen_at, misses FROM q)
"""
REFRESHED_POSTINGS = f"WITH {_REFRESHED} SELECT source_id, source_posting_id, status, strftime(last_seen_at, '%Y-%m-%d') AS last_seen_at, misses FROM z"


def run_ledger(spark, sf_dir):
    return planned.ledger(*_refreshed(spark, sf_dir))


RUN_LEDGER = f"""
WITH {_REFRESHED} SELECT source_id, count(*) AS n, count(*) FILTER (status = 'active' AND was <> 'active') AS became_active,
  count(*) FILTER (status = 'stale' AND was <> 'stale') AS became_stale, count(*) FILTER (status = 'closed' AND was <> 'closed') AS became_closed FROM z GROUP BY 1
"""


def review_queue(spark, sf_dir):
    views = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("posting_id"), (F.col("c_custkey") % 1000).alias("n_views"))
    failed = table(spark, sf_dir, "pages").filter("page_id % 50 = 0").select("url")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("normalized_name"))
    return planned.review_queue(_classified(spark, sf_dir), failed, names, views, below=0.78)


REVIEW_QUEUE = f"""
WITH {_CLASSIFIED}
SELECT DISTINCT posting_id::VARCHAR AS subject, 'low_confidence' AS reason FROM c WHERE is_primary AND confidence < 0.78
UNION SELECT url, 'failed' FROM pages WHERE page_id % 50 = 0 UNION SELECT n_name, 'ambiguous' FROM nation
UNION SELECT * FROM (SELECT c_custkey::VARCHAR, 'top_viewed' FROM customer ORDER BY c_custkey % 1000 DESC, c_custkey LIMIT 20)
"""


_CONFIDENCES = """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'posting_occupation' WHEN 1 THEN 'posting_major' WHEN 2 THEN 'posting_requirement' ELSE 'company_merge' END AS entity_type,
  CAST(o_orderkey AS STRING) AS entity_id, CAST(o_custkey % 100 AS DOUBLE) / 100 AS confidence FROM @orders
"""
_VIEWS = "SELECT CAST(o_custkey % 50 AS STRING) AS cip_code, o_orderpriority AS company_id, o_orderkey % 10 AS n_views FROM @orders"


def review_items(spark, sf_dir):
    misplaced = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").cast("string").alias("entity_id"))
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity_id"))
    return planned.review_items(derived(spark, sf_dir, _CONFIDENCES), misplaced, names, derived(spark, sf_dir, _VIEWS))


REVIEW_ITEMS = f"""
WITH v AS (SELECT cip_code || ' ' || company_id AS id, sum(n_views) AS n, cip_code, company_id FROM ({plain(_VIEWS)}) GROUP BY ALL ORDER BY n DESC, cip_code, company_id LIMIT 20),
b AS (SELECT * FROM (VALUES ('posting_occupation', 0.6::DOUBLE), ('posting_major', 0.7::DOUBLE), ('posting_requirement', 0.5::DOUBLE)) b(entity_type, below))
SELECT *, 'pending' AS status FROM (
  SELECT entity_type, entity_id, 'low_confidence' AS reason, round(below - confidence, 6) AS priority FROM ({plain(_CONFIDENCES)}) JOIN b USING (entity_type) WHERE confidence < below
  UNION ALL SELECT DISTINCT 'posting_requirement', l_orderkey::VARCHAR, 'evidence_offset', 1.0::DOUBLE FROM lineitem WHERE l_quantity > 49
  UNION ALL SELECT 'company_merge', n_name, 'ambiguous_company', 0.8::DOUBLE FROM nation UNION ALL SELECT 'posting_major', id, 'high_traffic', 0.5::DOUBLE FROM v)
"""


def corrected_titles(spark, sf_dir):
    fixes = derived(spark, sf_dir, "SELECT c_custkey AS posting_id, 'n7' AS code, 'r1' AS reviewer FROM @customer WHERE c_custkey % 9 = 0")
    rows, _ = planned.corrected(_classified(spark, sf_dir), fixes, F.lit("2026-01-10").cast("timestamp"))
    return rows.groupBy("code", "method").agg(F.count("*").alias("n"))


CORRECTED_TITLES = f"""
WITH {_CLASSIFIED} SELECT CASE WHEN posting_id % 9 = 0 THEN 'n7' ELSE code END AS code, CASE WHEN posting_id % 9 = 0 THEN 'review' ELSE method END AS method, count(*) AS n FROM c GROUP BY ALL
"""

def corrected_log(spark, sf_dir):
    """What the reviewers' corrections add to the log."""
    fixes = derived(spark, sf_dir, "SELECT c_custkey AS posting_id, 'n7' AS code, 'r1' AS reviewer FROM @customer WHERE c_custkey % 9 = 0")
    _, log = planned.corrected(_classified(spark, sf_dir), fixes, F.lit("2026-01-10").cast("timestamp"))
    return log.drop("at")


CORRECTED_LOG = f"WITH {_CLASSIFIED} SELECT posting_id, code AS old_code, 'n7' AS new_code, 'r1' AS reviewer FROM c WHERE is_primary AND posting_id % 9 = 0"

_ACTIVE = "SELECT c_custkey AS posting_id, CAST(c_custkey % 13 AS STRING) AS company_id, CASE WHEN c_custkey % 4 = 0 THEN 'closed' ELSE 'active' END AS status, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2025-01-01 00:00:00' ELSE TIMESTAMP '2026-01-01 00:00:00' END AS posted_at FROM @customer"


def hiring_companies(spark, sf_dir):
    return planned.hiring_companies(explicit_links(spark, sf_dir), derived(spark, sf_dir, _ACTIVE), F.lit("2026-01-10").cast("timestamp"))


HIRING_COMPANIES = f"""
SELECT cip_code, company_id, count(DISTINCT posting_id) AS n_postings FROM ({EXPLICIT_LINKS}) JOIN ({plain(_ACTIVE)}) USING (posting_id)
WHERE status = 'active' AND date_diff('day', posted_at, TIMESTAMP '2026-01-10') <= 90 GROUP BY ALL
"""


def naming_postings(spark, sf_dir):
    said = derived(spark, sf_dir, "SELECT c_custkey AS posting_id, lower(c_mktsegment) AS alias, CASE WHEN c_custkey % 2 = 0 THEN concat('We want ', c_mktsegment, ' people.') ELSE 'Apply.' END AS sentence FROM @customer")
    return planned.naming_postings(explicit_links(spark, sf_dir), said).select("posting_id", "cip_code", "sentence")


NAMING_POSTINGS = f"SELECT posting_id, cip_code, concat('We want ', c_mktsegment, ' people.') AS sentence FROM ({EXPLICIT_LINKS}) JOIN customer ON c_custkey = posting_id WHERE posting_id % 2 = 0"


def vector_titles(spark, sf_dir):
    """Every vector to the nearest of the labels' mean vectors."""
    e = table(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p"))
    known = means.select(F.col("label").cast("string").alias("code"), F.transform("p", lambda x: x["x"]).alias("reference"))
    found = planned.cosine_titles(e.select(F.col("vec_id").alias("posting_id"), F.col("embedding").alias("vector")), known, least=0.2)
    return found.select("posting_id", "code", F.round("confidence", 5).alias("confidence"))


VECTOR_TITLES = """
WITH u AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i) GROUP BY ALL),
r AS (SELECT label::VARCHAR AS code, list(x ORDER BY i) AS reference FROM u GROUP BY label),
p AS (SELECT vec_id AS posting_id, code, list_cosine_similarity(embedding::DOUBLE[], reference) AS c FROM embeddings, r)
SELECT posting_id, code, round(least(0.5::DOUBLE + 0.2::DOUBLE * (c - 0.2::DOUBLE) / (1 - 0.2::DOUBLE), 0.7::DOUBLE), 5) AS confidence FROM p WHERE c >= 0.2
QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY c DESC, code) = 1
"""


def event_counts(spark, sf_dir):
    """The running count of the stream, over the whole table at once."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = running_counts(e, "ts", "event_type")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


EVENT_COUNTS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"

QUERIES = {
    "classified_titles": (classified_titles, CLASSIFIED_TITLES),
    "title_quality": (title_quality, TITLE_QUALITY),
    "title_confusion": (title_confusion, TITLE_CONFUSION),
    "requirements": (requirements, REQUIREMENTS),
    "years_by_degree": (years_by_degree, YEARS_BY_DEGREE),
    "sectioned_requirements": (sectioned_requirements, SECTIONED_REQUIREMENTS),
    "listed_requirements": (listed_requirements, LISTED_REQUIREMENTS),
    "named_majors": (named_majors, NAMED_MAJORS),
    "years_percentiles": (years_percentiles, YEARS_PERCENTILES),
    "top_credentials": (top_credentials, TOP_CREDENTIALS),
    "inferred_links": (inferred_links, INFERRED_LINKS),
    "explicit_links": (explicit_links, EXPLICIT_LINKS),
    "link_counts": (link_counts, LINK_COUNTS),
    "refreshed_postings": (refreshed_postings, REFRESHED_POSTINGS),
    "run_ledger": (run_ledger, RUN_LEDGER),
    "review_items": (review_items, REVIEW_ITEMS),
    "review_queue": (review_queue, REVIEW_QUEUE),
    "corrected_titles": (corrected_titles, CORRECTED_TITLES),
    "corrected_log": (corrected_log, CORRECTED_LOG),
    "hiring_companies": (hiring_companies, HIRING_COMPANIES),
    "naming_postings": (naming_postings, NAMING_POSTINGS),
    "vector_titles": (vector_titles, VECTOR_TITLES),
    "event_counts": (event_counts, EVENT_COUNTS),
}
