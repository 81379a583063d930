"""Queries over the shapes of profiles, work and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocatio.operators import reshape
from vocatio.queries.adapters import COURSES, SKILLS, derived, pick, plain, table

_FORMS = f"""
SELECT c_custkey AS profile_id, c_name AS institution, '' AS degree, CAST(NULL AS STRING) AS degree_level, 'CS' AS major, '' AS minor, '' AS concentration, '3.5' AS gpa,
  CASE WHEN c_custkey % 2 = 0 THEN 'May 2026' ELSE '' END AS graduation, {pick(COURSES, 'c_custkey')} AS label, {pick(SKILLS, 'c_custkey')} AS s0, {pick(SKILLS, 'c_custkey + 1')} AS s1 FROM @customer
"""


def wire_profiles(spark, sf_dir):
    f = derived(spark, sf_dir, _FORMS).withColumn("coursework", F.array("label", F.lit(" "))).withColumn("skills", F.array(F.lit(""), "s0"))
    none = F.array().cast("array<string>")
    f = f.withColumn("activity_skills", F.array("s1")).withColumn("certifications", none).withColumn("activity_certifications", none).withColumn("honors", none)
    p = reshape.wire_profiles(f)
    c = F.col("coursework")[0]
    return p.select("profile_id", "degree", "expected_graduation_date", c["id"].alias("course_id"), c["course_code"].alias("code"), c["course_name"].alias("name"), F.array_join("skills", "|").alias("skills"))


WIRE_PROFILES = f"""
SELECT profile_id, NULL::VARCHAR AS degree, nullif(graduation, '') AS expected_graduation_date, 'course_0' AS course_id,
  CASE WHEN contains(label, ' — ') THEN split_part(label, ' — ', 1) END AS code, CASE WHEN contains(label, ' — ') THEN split_part(label, ' — ', 2) ELSE label END AS name,
  s0 || '|' || s1 AS skills FROM ({plain(_FORMS)})
"""


def form_profiles(spark, sf_dir):
    """There and back: the form that a profile made from it shows."""
    f = derived(spark, sf_dir, _FORMS).withColumn("coursework", F.array("label")).withColumn("skills", F.array("s0"))
    none = F.array().cast("array<string>")
    f = f.withColumn("activity_skills", none).withColumn("certifications", none).withColumn("activity_certifications", none).withColumn("honors", none)
    back = reshape.form_profiles(reshape.wire_profiles(f).withColumn("graduation_date", F.lit(None).cast("string")))
    return back.select("profile_id", "institution", "degree", "graduation", F.array_join("coursework", "|").alias("coursework"), F.array_join("skills", "|").alias("skills"))


FORM_PROFILES = f"SELECT profile_id, institution, '' AS degree, graduation, label AS coursework, s0 AS skills FROM ({plain(_FORMS)})"


def skills_lines(spark, sf_dir):
    f = derived(spark, sf_dir, _FORMS)
    line = reshape.skills_line(F.array("s0"), F.array(F.upper("s0"), "s1", "s1"))
    return f.select("profile_id", line.alias("line"), reshape.model_version(F.when(F.col("profile_id") % 3 == 0, "llm").otherwise("rules"), "m1").alias("model_version"))


SKILLS_LINES = f"SELECT profile_id, s0 || ' · ' || s1 AS line, CASE WHEN profile_id % 3 = 0 THEN 'm1' END AS model_version FROM ({plain(_FORMS)})"


def allowed_pages(spark, sf_dir):
    """Pages of domains on the allowlist, and the others, counted."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("domain"))
    known = pages.filter("page_id % 10 = 0").select(F.lower("domain").alias("domain")).distinct()
    yes, no = reshape.allowed(pages, known)
    one = lambda df, v: df.agg(F.count("*").alias("n")).select(F.lit(v).alias("allowed"), "n")
    return one(yes, True).unionByName(one(no, False))


ALLOWED_PAGES = """
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS d FROM pages), k AS (SELECT DISTINCT d FROM p WHERE page_id % 10 = 0)
SELECT true AS allowed, count(*) FILTER (d IN (SELECT d FROM k)) AS n FROM p UNION ALL SELECT false, count(*) FILTER (d NOT IN (SELECT d FROM k)) FROM p
"""


def bounded_documents(spark, sf_dir):
    d = reshape.bounded(table(spark, sf_dir, "documents"), 1000)
    return d.select("doc_id", F.length("text").alias("n"), "was_cut", reshape.card_text(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b")).alias("card"))


BOUNDED_DOCUMENTS = "SELECT doc_id, least(length(text), 1000)::INT AS n, length(text) > 1000 AS was_cut, 'a b' AS card FROM documents"


def whole_documents(spark, sf_dir):
    """With the reader's own limit of 400,000 characters, and a hash of all the text."""
    d = reshape.bounded(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.length("text").alias("n"), "was_cut", F.sha2(F.col("text"), 256).alias("text_sha256"))


WHOLE_DOCUMENTS = "SELECT doc_id, least(length(text), 400000)::INT AS n, length(text) > 400000 AS was_cut, sha256(substr(text, 1, 400000)) AS text_sha256 FROM documents"

QUERIES = {
    "wire_profiles": (wire_profiles, WIRE_PROFILES),
    "form_profiles": (form_profiles, FORM_PROFILES),
    "skills_lines": (skills_lines, SKILLS_LINES),
    "allowed_pages": (allowed_pages, ALLOWED_PAGES),
    "bounded_documents": (bounded_documents, BOUNDED_DOCUMENTS),
    "whole_documents": (whole_documents, WHOLE_DOCUMENTS),
}
