"""Queries that match profiles, texts and demand, and check claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocatio.operators import evidence, guards, matching, search
from vocatio.queries.adapters import DEMAND, PROFILES, SKILLS, derived, plain, table

_BOUND = r"'(^|[^a-z0-9])' || regexp_replace(lower({p}), '([.*+?^$(){{}}|\[\]\\])', '\\\1', 'g') || '($|[^a-z0-9])'"


def _stands(text: str, phrase: str) -> str:
    return f"regexp_matches(lower({text}), {_BOUND.format(p=phrase)})"


_PHRASES = "SELECT DISTINCT lower(concat_ws(' ', split_part(text, ' ', 1), split_part(text, ' ', 2))) AS phrase FROM @benchmark"


def phrase_tags(spark, sf_dir):
    """Which opening word pairs of the benchmark each document names."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    phrases = derived(spark, sf_dir, _PHRASES).withColumn("pos", F.hash("phrase"))
    return matching.tagged(texts, phrases).select("text_id", F.array_join(F.array_sort("skills"), "|").alias("skills"))


PHRASE_TAGS = f"""
WITH h AS (SELECT doc_id, phrase FROM documents, ({plain(_PHRASES)}) p WHERE {_stands('text', 'phrase')})
SELECT d.doc_id AS text_id, coalesce(string_agg(phrase, '|' ORDER BY phrase), '') AS skills FROM documents d LEFT JOIN h USING (doc_id) GROUP BY 1
"""


def phrase_frequency(spark, sf_dir):
    postings = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("posting_id"), "text")
    return matching.skill_frequency(postings, derived(spark, sf_dir, _PHRASES))


PHRASE_FREQUENCY = f"""
WITH c AS (SELECT phrase, (SELECT count(*) FROM documents WHERE {_stands('text', 'phrase')}) AS n_postings FROM ({plain(_PHRASES)}))
SELECT phrase, n_postings, round(n_postings / (SELECT count(DISTINCT doc_id) FROM documents), 6) AS frequency,
  row_number() OVER (ORDER BY n_postings DESC, phrase)::INT AS rank FROM c
"""


def _people(spark, sf_dir):
    p = derived(spark, sf_dir, PROFILES)
    course = F.struct(
        F.concat(F.lit("c"), F.col("profile_id").cast("string")).alias("id"), "course_code", "course_name",
        F.lit(3.0).alias("credits"), F.lit("A").alias("grade"), F.lit("Fall 2024").alias("term"),
    )
    none = F.lit(None).cast("string")
    profiles = p.select(
        "profile_id", "role_key", F.array("skill0", F.lit(""), "skill1").alias("skills"), F.array("cert0").alias("certifications"),
        F.array(F.lit("Dean list")).alias("honors"), F.array(course).alias("coursework"), F.lit("Riverbend University").alias("institution"),
        F.lit("Bachelor of Science").alias("degree"), F.lit("Bachelor's").alias("degree_level"), F.lit("Computer Science").alias("major"),
        none.alias("minor"), none.alias("concentration"), none.alias("graduation_date"), F.lit("May 2026").alias("expected_graduation_date"), F.lit("3.72").alias("gpa"),
    )
    work = p.select("profile_id", F.lit("x0").alias("id"), F.lit(0).alias("pos"), F.lit("Intern").alias("title"), F.lit("Acme").alias("organization"), F.lit("2024").alias("dates"), F.col("work").alias("description"))
    made = p.select("profile_id", F.lit("p0").alias("id"), F.lit(0).alias("pos"), F.lit("Site").alias("name"), F.col("tools").alias("technologies"), F.col("project").alias("description"))
    return profiles, work, made


def _matches(spark, sf_dir):
    profiles, work, made = _people(spark, sf_dir)
    return matching.match(profiles, matching.evidence_texts(profiles, work, made), derived(spark, sf_dir, DEMAND))


def market_matches(spark, sf_dir):
    m = _matches(spark, sf_dir)
    return m.select("profile_id", "rank", "skill_id", "skill", "status", F.array_join("evidence", ",").alias("evidence"))


MARKET_MATCHES = f"""
WITH m AS (SELECT p.*, d.rank, d.name AS skill FROM ({plain(PROFILES)}) p JOIN ({DEMAND}) d USING (role_key) WHERE d.rank <= 10),
t AS (
  SELECT *, CASE WHEN lower(skill0) = lower(skill) THEN 'skill_0' WHEN lower(skill1) = lower(skill) THEN 'skill_2' WHEN lower(cert0) = lower(skill) THEN 'cert_0' END AS v,
    CASE WHEN {_stands('course_name', 'skill')} OR {_stands('course_code', 'skill')} THEN 'c' || profile_id::VARCHAR END AS c,
    CASE WHEN {_stands('work', 'skill')} THEN 'x0' WHEN {_stands("tools || ' ' || project", 'skill')} THEN 'p0' END AS x
  FROM m)
SELECT profile_id, rank, trim(regexp_replace(lower(skill), '[^a-z0-9]+', '_', 'g'), '_') AS skill_id, skill,
  CASE WHEN v IS NOT NULL THEN 'verified' WHEN c IS NOT NULL THEN 'coursework' WHEN x IS NOT NULL THEN 'transferable' ELSE 'not_verified' END AS status,
  coalesce(v, c, x, '') AS evidence FROM t
"""


def market_summary(spark, sf_dir):
    s = matching.summary(_matches(spark, sf_dir))
    return s.withColumn("gaps", F.array_join("gaps", "|"))


MARKET_SUMMARY = f"""
SELECT profile_id, any_value(p.role_key) AS role_key, count(*) AS considered, count(*) FILTER (status <> 'not_verified') AS supported,
  coalesce(string_agg(skill, '|' ORDER BY rank) FILTER (status = 'not_verified'), '') AS gaps
FROM ({MARKET_MATCHES}) m JOIN ({plain(PROFILES)}) p USING (profile_id) GROUP BY profile_id
"""


def demand_verdicts(spark, sf_dir):
    rows = matching.demand_with_verdict(derived(spark, sf_dir, DEMAND), _matches(spark, sf_dir))
    return rows.groupBy("role_key", "rank", "name", "status").agg(F.count("*").alias("n"))


DEMAND_VERDICTS = f"""
SELECT d.role_key, d.rank, d.name, coalesce(m.status, 'not_verified') AS status, count(*) AS n
FROM ({plain(PROFILES)}) p JOIN ({DEMAND}) d USING (role_key) LEFT JOIN ({MARKET_MATCHES}) m ON m.profile_id = p.profile_id AND m.rank = d.rank GROUP BY ALL
"""

_JOBS = """
SELECT p_partkey AS job_id, p_partkey AS pos, p_partkey % 12 AS a, (p_partkey * 7 + 3) % 12 AS b FROM @part
"""


def job_ranking(spark, sf_dir):
    names = F.array(*map(F.lit, SKILLS))
    jobs = derived(spark, sf_dir, _JOBS).select("job_id", "pos", F.array(F.upper(F.get(names, F.col("a").cast("int"))), F.get(names, F.col("b").cast("int"))).alias("skills"))
    mine = _matches(spark, sf_dir).filter("status <> 'not_verified'").groupBy("profile_id").agg(F.collect_list("skill").alias("skills"))
    return matching.ranked_jobs(jobs, mine, top=5).select("profile_id", "place", "job_id", "asked", "matched")


_LIST = "[" + ", ".join(f"'{s}'" for s in SKILLS) + "]"
JOB_RANKING = f"""
WITH j AS (SELECT job_id, pos, lower(unnest([{_LIST}[a::INT + 1], {_LIST}[b::INT + 1]])) AS s FROM ({plain(_JOBS)})),
h AS (SELECT m.profile_id, job_id, pos, count(*) AS matched FROM j JOIN (SELECT DISTINCT profile_id, lower(skill) AS s FROM ({MARKET_MATCHES}) WHERE status <> 'not_verified') m USING (s) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY matched DESC, pos)::INT AS place FROM h)
SELECT profile_id, place, job_id, 2 AS asked, matched FROM r WHERE place <= 5
"""


def evidence_items(spark, sf_dir):
    items = evidence.items(*_people(spark, sf_dir))
    return items.select("profile_id", "evidence_id", "kind", "text", F.array_join("forms", "|").alias("forms"))


EVIDENCE_ITEMS = f"""
WITH p AS ({plain(PROFILES)})
SELECT profile_id, 'c' || profile_id::VARCHAR AS evidence_id, 'coursework' AS kind, concat_ws(' ', course_code, course_name, 'A', 'Fall 2024', '3.0') AS text,
  concat_ws('|', course_name, course_code, course_code || ' ' || course_name) AS forms FROM p
UNION ALL SELECT profile_id, 'skill_0', 'skill', skill0, skill0 FROM p UNION ALL SELECT profile_id, 'skill_1', 'skill', '', '' FROM p
UNION ALL SELECT profile_id, 'skill_2', 'skill', skill1, skill1 FROM p UNION ALL SELECT profile_id, 'cert_0', 'certification', cert0, cert0 FROM p
UNION ALL SELECT profile_id, 'honor_0', 'honor', 'Dean list', 'Dean list' FROM p
UNION ALL SELECT profile_id, 'x0', 'experience', concat_ws(' ', 'Intern', 'Acme', '2024', work), '' FROM p
UNION ALL SELECT profile_id, 'p0', 'project', concat_ws(' ', 'Site', nullif(tools, ''), project), '' FROM p
UNION ALL SELECT profile_id, k, 'education', v, v FROM p, (VALUES ('edu_institution', 'Riverbend University'), ('edu_degree', 'Bachelor of Science'),
  ('edu_degree_level', 'Bachelor''s'), ('edu_major', 'Computer Science'), ('edu_expected_graduation_date', 'May 2026'), ('edu_gpa', '3.72')) e(k, v)
"""

#: A claim of each kind of fault per profile: section, owner, text, cited ids.
_CLAIMS = [
    ("experience", "x0", "work", ["x0"]),
    ("experience", "x0", "work", ["x0"]),
    ("experience", "x0", "'Cut cost by 40 percent'", ["x0"]),
    ("experience", "x0", "'Led a team'", ["p0"]),
    ("projects", "p0", "project", ["p0", "nowhere"]),
    ("projects", "p0", "project", []),
    ("skills", None, "skill0", ["skill_0"]),
    ("skills", None, "'Juggling'", ["skill_0"]),
    ("coursework", None, "course_name", ["course"]),
    ("coursework", None, "'Advanced everything'", ["course"]),
    ("honors", None, "'dean LIST '", ["honor_0"]),
    ("coursework_summary", None, "'Studied computing'", ["course"]),
    ("coursework_summary", None, "'Studied much'", ["skill_0"]),
    ("summary", None, "'  '", ["skill_0"]),
]


def _claims(spark, sf_dir):
    p = derived(spark, sf_dir, PROFILES)
    own = F.concat(F.lit("c"), F.col("profile_id").cast("string"))
    claims = [
        F.struct(
            F.lit(i).alias("pos"), F.lit(s).alias("section"), F.lit(o).cast("string").alias("owner_id"), F.expr(t).alias("text"),
            F.array(*[own if e == "course" else F.lit(e) for e in ids]).cast("array<string>").alias("evidence"),
        )
        for i, (s, o, t, ids) in enumerate(_CLAIMS)
    ]
    rows = p.select("profile_id", F.explode(F.array(*claims)).alias("c")).select("profile_id", "c.*")
    return rows.withColumn("claim_id", F.concat_ws("-", "profile_id", "pos"))


def judged_claims(spark, sf_dir):
    profiles, work, made = _people(spark, sf_dir)
    j = evidence.judged(_claims(spark, sf_dir), evidence.items(profiles, work, made), _matches(spark, sf_dir), profiles)
    return j.select("profile_id", "pos", "section", "reason")


# the first three texts of _CLAIMS may name a missing skill; their own evidence always names it too
JUDGED_CLAIMS = f"""
WITH p AS ({plain(PROFILES)})
SELECT profile_id, pos, section, reason FROM p, (VALUES (0, 'experience', NULL), (1, 'experience', 'duplicate'), (2, 'experience', 'unsupported_number'),
  (3, 'experience', 'evidence_out_of_scope'), (4, 'projects', 'unknown_evidence_id'), (5, 'projects', 'no_evidence'), (6, 'skills', NULL),
  (7, 'skills', 'not_verified_skill'), (8, 'coursework', NULL), (9, 'coursework', 'verbatim_mismatch'), (10, 'honors', NULL),
  (11, 'coursework_summary', NULL), (12, 'coursework_summary', 'evidence_out_of_scope')) v(pos, section, reason)
"""


def dropped_reasons(spark, sf_dir):
    profiles, work, made = _people(spark, sf_dir)
    return evidence.reasons(evidence.judged(_claims(spark, sf_dir), evidence.items(profiles, work, made), _matches(spark, sf_dir), profiles))


DROPPED_REASONS = f"SELECT reason, count(*) AS n FROM ({JUDGED_CLAIMS}) WHERE reason IS NOT NULL GROUP BY reason"


def education_blocks(spark, sf_dir):
    profiles, _, _ = _people(spark, sf_dir)
    k = F.col("profile_id")
    blocks = profiles.select(
        "profile_id", F.when(k % 2 == 0, " riverbend UNIVERSITY").otherwise("Elsewhere").alias("institution"), F.lit("Bachelor of Science").alias("degree_line"),
        F.when(k % 3 == 0, "May 2026").alias("graduation_date"), F.when(k % 5 == 0, "4.0").otherwise("3.72").alias("gpa"),
    )
    return evidence.education(blocks, profiles).withColumn("dropped", F.array_join("dropped", ","))


EDUCATION_BLOCKS = """
SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 2 = 0 THEN 'Riverbend University' END AS institution, 'Bachelor of Science' AS degree_line,
  CASE WHEN c_custkey % 3 = 0 THEN 'May 2026' END AS graduation_date, CASE WHEN c_custkey % 5 <> 0 THEN '3.72' END AS gpa,
  concat_ws(',', CASE WHEN c_custkey % 2 <> 0 THEN 'institution' END, CASE WHEN c_custkey % 5 = 0 THEN 'gpa' END) AS dropped
FROM customer
"""


def guarded_rewrites(spark, sf_dir):
    k = F.col("c_custkey")
    lines = (
        F.when(k % 5 == 0, F.array(F.lit("- Used Python and PyTorch"), F.lit("Saved 40 hours")))
        .when(k % 5 == 1, F.array(F.lit("Saved 40 hours")))
        .when(k % 5 == 2, F.array(F.lit("Built pipelines in 2024")))
        .when(k % 5 == 3, F.array(F.lit(" ")))
    )
    r = table(spark, sf_dir, "customer").select(k.alias("item_id"), F.lit("Intern Jun 2024").alias("card"), F.lit("Wrote ETL jobs with Python. used PyTorch").alias("description"), lines.alias("lines"))
    r = r.withColumn("lines", F.when(F.col("item_id") % 5 == 0, F.array_append("lines", F.lit("Ran ETL"))).otherwise(F.col("lines")))
    g = guards.guarded(r)
    return g.select("item_id", "status", F.array_join("kept", "|").alias("kept"), "n_invented", F.array_join("lost", "|").alias("lost"))


GUARDED_REWRITES = """
SELECT c_custkey AS item_id, CASE c_custkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'rejected_figures' WHEN 2 THEN 'rejected_names' ELSE 'too_thin' END AS status,
  CASE c_custkey % 5 WHEN 0 THEN 'Used Python and PyTorch|Ran ETL' WHEN 2 THEN 'Built pipelines in 2024' ELSE '' END AS kept,
  CASE WHEN c_custkey % 5 < 2 THEN 1 ELSE 0 END AS n_invented, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'ETL|Python|PyTorch' END AS lost
FROM customer
"""

_QUERIES = "SELECT DISTINCT substring(p_name, 1, 3) AS term FROM @part UNION SELECT DISTINCT upper(substring(p_type, 1, 4)) FROM @part"


def prefix_search(spark, sf_dir):
    q = derived(spark, sf_dir, _QUERIES).select(F.col("term").alias("query_id"), "term")
    p = table(spark, sf_dir, "part")
    titles = p.select(F.col("p_partkey").alias("onet_soc_code"), F.col("p_name").alias("title"))
    other = p.select(F.col("p_partkey").alias("onet_soc_code"), F.col("p_type").alias("alt_title"))
    return search.by_prefix(q, titles, other)


PREFIX_SEARCH = f"""
WITH q AS ({plain(_QUERIES)}),
h AS (SELECT term, p_partkey, p_name, 0 AS tier FROM q JOIN part ON starts_with(lower(p_name), lower(trim(term))) WHERE length(trim(term)) >= 2
      UNION ALL SELECT term, p_partkey, p_name, 1 FROM q JOIN part ON starts_with(lower(p_type), lower(trim(term))) WHERE length(trim(term)) >= 2),
b AS (SELECT term, p_partkey, p_name, min(tier) AS tier FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tier, p_name, p_partkey)::INT AS place FROM b)
SELECT term AS query_id, place, p_partkey AS onet_soc_code, p_name AS title, CASE tier WHEN 0 THEN 'title' ELSE 'alt_title' END AS matched_on FROM r WHERE place <= 8
"""

_WORDS = "SELECT DISTINCT p_type AS query FROM @part"


def word_search(spark, sf_dir):
    """Types as queries over names and types, words in any order and case."""
    titles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_key"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    q = derived(spark, sf_dir, _WORDS).select(F.col("query").alias("query_id"), F.upper("query").alias("query"))
    return search.by_words(q, search.build_index(titles), limit=1 << 30).select("query_id", "doc_key", F.round("score", 6).alias("score"))


WORD_SEARCH = rf"""
WITH d AS (SELECT p_partkey AS k, regexp_extract_all(lower(concat_ws(' ', p_name, p_type)), '[\p{{L}}\p{{N}}]+') AS w FROM part),
t AS (SELECT k, len(w) AS n, unnest(w) AS token FROM d),
tf AS (SELECT k, n, token, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
a AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d WHERE len(w) > 0),
q AS (SELECT query, unnest(list_distinct(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+'))) AS token, len(list_distinct(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+'))) AS m FROM ({plain(_WORDS)})),
s AS (SELECT query, m, k, count(*) AS found, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))) AS score
      FROM q JOIN tf USING (token) JOIN df USING (token), a GROUP BY ALL)
SELECT query AS query_id, k AS doc_key, round(score, 6) AS score FROM s WHERE found = m
"""


def title_index(spark, sf_dir):
    titles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_key"), F.col("p_name").alias("text"))
    i = search.build_index(titles)
    return i.select("token", "doc_key", "length", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


TITLE_INDEX = r"""
WITH d AS (SELECT p_partkey AS k, regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+') AS w FROM part),
t AS (SELECT k, len(w)::INT AS n, unnest(w) AS token, unnest(range(len(w))) AS pos FROM d)
SELECT token, k AS doc_key, n AS length, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM t GROUP BY ALL
"""

QUERIES = {
    "phrase_tags": (phrase_tags, PHRASE_TAGS),
    "phrase_frequency": (phrase_frequency, PHRASE_FREQUENCY),
    "market_matches": (market_matches, MARKET_MATCHES),
    "market_summary": (market_summary, MARKET_SUMMARY),
    "demand_verdicts": (demand_verdicts, DEMAND_VERDICTS),
    "job_ranking": (job_ranking, JOB_RANKING),
    "evidence_items": (evidence_items, EVIDENCE_ITEMS),
    "judged_claims": (judged_claims, JUDGED_CLAIMS),
    "dropped_reasons": (dropped_reasons, DROPPED_REASONS),
    "education_blocks": (education_blocks, EDUCATION_BLOCKS),
    "guarded_rewrites": (guarded_rewrites, GUARDED_REWRITES),
    "prefix_search": (prefix_search, PREFIX_SEARCH),
    "word_search": (word_search, WORD_SEARCH),
    "title_index": (title_index, TITLE_INDEX),
}
