"""Queries over transcripts, courses and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocatio.functions import text
from vocatio.operators import courses, imports, matching, profiles, roles
from vocatio.queries.adapters import COURSES, MAJORS, SKILLS, TRANSCRIPTS, derived, pick, plain, table


def transcript_profiles(spark, sf_dir):
    p = profiles.from_text(derived(spark, sf_dir, TRANSCRIPTS))
    c = F.col("coursework")[0]
    return p.select(
        "doc_id", "institution", "degree", "degree_level", "major", "minor", "gpa", F.size("coursework").cast("long").alias("n_courses"),
        c["course_code"].alias("code"), c["course_name"].alias("course"), c["credits"].alias("credits"), c["grade"].alias("grade"), c["term"].alias("term"),
        F.array_join("skills", "|").alias("skills"), F.array_join("honors", "|").alias("honors"), F.array_join("warnings", "|").alias("warnings"),
    )


_DEGREE = "CASE c_custkey % 4 WHEN 0 THEN 'Bachelor of Science' WHEN 1 THEN 'Master of Arts' WHEN 2 THEN 'Bachelor of Arts' END"
_INSTITUTION = f"concat('Riverbend ', {pick(['State', 'Valley', 'Tech'], 'c_custkey')}, ' University')"
_GPA = "concat('3.', (c_custkey % 90 + 10)::VARCHAR, CASE WHEN c_custkey % 2 = 0 THEN '/4.00' ELSE '' END)"
# the course name runs as far as its letters, digits and signs do, so it takes in what follows
TRANSCRIPT_PROFILES = f"""
SELECT c_custkey AS doc_id, {_INSTITUTION} AS institution, {_DEGREE} AS degree,
  CASE c_custkey % 4 WHEN 0 THEN 'Bachelor''s' WHEN 1 THEN 'Master''s' WHEN 2 THEN 'Bachelor''s' END AS degree_level,
  {pick(MAJORS, 'c_custkey')} AS major, {pick(MAJORS, 'c_custkey + 1')} AS minor, {_GPA} AS gpa, 1::BIGINT AS n_courses,
  concat('CS ', (c_custkey % 800 + 100)::VARCHAR) AS code, 'Data Structures 3 credits Grade' AS course, NULL::DOUBLE AS credits, NULL::VARCHAR AS grade,
  'Fall 2024' AS term, concat({pick(SKILLS, 'c_custkey')}, '|Git') AS skills, 'Dean list' AS honors,
  CASE WHEN c_custkey % 4 = 3 THEN 'missing_degree' ELSE '' END AS warnings
FROM customer
"""


def transcript_profiles_by_labels(spark, sf_dir):
    p = profiles.from_text(derived(spark, sf_dir, TRANSCRIPTS), mode="js")
    return p.select("doc_id", "institution", "degree", "major", "minor", "gpa", F.array_join("coursework", "|").alias("coursework"), F.array_join("skills", "|").alias("skills"))


TRANSCRIPT_PROFILES_BY_LABELS = f"""
SELECT c_custkey AS doc_id, {_INSTITUTION} AS institution, CASE WHEN c_custkey % 4 < 2 THEN {_DEGREE} END AS degree, {pick(MAJORS, 'c_custkey')} AS major,
  {pick(MAJORS, 'c_custkey + 1')} AS minor, {_GPA} AS gpa, concat('CS ', (c_custkey % 800 + 100)::VARCHAR, ' — Data Structures') AS coursework,
  CASE WHEN {pick(SKILLS, 'c_custkey')} = 'R' THEN 'Git' ELSE concat({pick(SKILLS, 'c_custkey')}, '|Git') END AS skills
FROM customer
"""


def profile_tables(spark, sf_dir):
    """Attribute rows of the extracted profiles."""
    p = profiles.from_text(derived(spark, sf_dir, TRANSCRIPTS)).withColumnRenamed("doc_id", "profile_id")
    return profiles.to_tables(p)[2]


PROFILE_TABLES = f"""
SELECT c_custkey AS profile_id, 'skill' AS attribute_type, 0 AS position, {pick(SKILLS, 'c_custkey')} AS value FROM customer
UNION ALL SELECT c_custkey, 'skill', 1, 'Git' FROM customer UNION ALL SELECT c_custkey, 'honor', 0, 'Dean list' FROM customer
"""


def cleaned_profiles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    course = lambda code, name, n: F.struct(F.lit(code).alias("course_code"), F.lit(name).alias("course_name"), n.cast("double").alias("credits"), F.lit("A").alias("grade"), F.lit(" Fall\t2024 ").alias("term"))
    k = F.col("c_custkey")
    rows = c.select(
        k.alias("profile_id"), F.concat(F.lit(" "), "c_name", F.lit("\x07  ")).alias("institution"), F.repeat(F.lit("x"), 400).alias("degree"),
        *[F.lit(None).cast("string").alias(f) for f in ("degree_level", "major", "minor", "concentration", "graduation_date", "expected_graduation_date")], F.lit("3.5").alias("gpa"),
        F.array(course("CS 1", " Logic  one", k % 40), course(" ", None, k), course(None, "Art", k * 0 - 1)).alias("coursework"),
        F.array(F.lit("SQL "), F.lit("sql"), F.lit(""), F.lit("Go")).alias("skills"), F.array().cast("array<string>").alias("honors"), F.lit(None).cast("array<string>").alias("certifications"),
    )
    p = profiles.cleaned_profile(rows)
    names = F.array_join(F.transform("coursework", lambda x: F.coalesce(x["course_name"], F.lit("-"))), "|")
    return p.select("profile_id", "institution", F.length("degree").alias("n_degree"), names.alias("courses"), F.col("coursework")[0]["credits"].alias("credits"), F.array_join("skills", "|").alias("skills"), F.size("certifications").alias("n_certifications"))


CLEANED_PROFILES = """
SELECT c_custkey AS profile_id, c_name AS institution, 300 AS n_degree, 'Logic one|Art' AS courses, CASE WHEN c_custkey % 40 BETWEEN 1 AND 30 THEN (c_custkey % 40)::DOUBLE END AS credits,
  'SQL|Go' AS skills, 0 AS n_certifications FROM customer
"""

_LABELS = f"SELECT c_custkey AS profile_id, 0 AS pos, {pick(COURSES, 'c_custkey')} AS label, {pick(MAJORS, 'c_custkey')} AS major, 'BS' AS degree FROM @customer"
_CATALOG = [
    (0, ["CS", "CSCE"], 300, 399, "Data Structures and Algorithms", "Trees, graphs, and Git in Python."),
    (1, ["ITSE"], 1000, 1999, "Database Programming", "SQL for applications."),
    (2, ["MATH", "M"], 200, 299, "Calculus", "Limits; some Statistics."),
    (3, ["CS"], 300, 320, "Shadowed", "Never the first."),
]


def _catalog(spark):
    return spark.createDataFrame(_CATALOG, "pos int, subjects array<string>, lo int, hi int, title string, description string")


def relevant_courses(spark, sf_dir):
    r = courses.relevance(derived(spark, sf_dir, _LABELS))
    return r.select("profile_id", "label", "relevant", F.col("parsed.code").alias("code"), courses.level(F.col("parsed.number")).alias("level"))


def _families() -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(major || ' ' || degree), '{p}') THEN '{' '.join(s)}'" for p, s in courses.FAMILIES)
    return f"(CASE {cases} ELSE '' END)"


_PARSED = rf"""
SELECT *, upper(regexp_extract(label, '(?i)([A-Z]{{1,5}})\s?-?\s?(\d{{3,4}})', 1)) AS subject,
  try_cast(regexp_extract(label, '(?i)([A-Z]{{1,5}})\s?-?\s?(\d{{3,4}})', 2) AS INT) AS number FROM ({plain(_LABELS)})
"""
RELEVANT_COURSES = f"""
SELECT profile_id, label, coalesce(number IS NOT NULL AND (list_contains(string_split({_families()}, ' '), subject)
    OR (level >= 3 AND subject NOT IN ({', '.join(f"'{c}'" for c in courses.CORE)}))), false) AS relevant,
  CASE WHEN number IS NOT NULL THEN concat(subject, ' ', number::VARCHAR) END AS code, level
FROM (SELECT *, (CASE WHEN number >= 1000 THEN number // 1000 ELSE number // 100 END)::INT AS level FROM ({_PARSED}))
"""


def catalog_courses(spark, sf_dir):
    """Courses with their catalog title and the skills its description names."""
    labels = derived(spark, sf_dir, _LABELS).withColumn("parsed", courses.parsed_code(F.col("label")))
    found = courses.resolved(labels, _catalog(spark))
    names = [(i, s) for i, s in enumerate(SKILLS)]
    vocabulary = spark.createDataFrame(names, "pos int, phrase string")
    texts = found.select(F.col("profile_id").alias("text_id"), "label", "catalog_title", F.coalesce("description", F.lit("")).alias("text"))
    return matching.tagged(texts, vocabulary).select(F.col("text_id").alias("profile_id"), "label", "catalog_title", F.array_join("skills", "|").alias("skills"))


CATALOG_COURSES = f"""
SELECT profile_id, label, CASE WHEN subject = 'CS' AND number BETWEEN 300 AND 399 THEN 'Data Structures and Algorithms' WHEN subject = 'ITSE' THEN 'Database Programming'
    WHEN subject = 'MATH' AND number BETWEEN 200 AND 299 THEN 'Calculus' END AS catalog_title,
  CASE WHEN subject = 'CS' AND number BETWEEN 300 AND 399 THEN 'Python|Git' WHEN subject = 'ITSE' THEN 'SQL' WHEN subject = 'MATH' AND number BETWEEN 200 AND 299 THEN 'Statistics' ELSE '' END AS skills
FROM ({_PARSED})
"""


def course_titles(spark, sf_dir):
    labels = derived(spark, sf_dir, _LABELS)
    looked = labels.select("profile_id").withColumn("seq", F.lit(0)).withColumn("code", F.lit("MATH 251")).withColumn("catalog_title", F.lit("Calculus II"))
    t = courses.titles(labels.select("profile_id", "pos", "label"), looked, SKILLS)
    return t.select("profile_id", F.array_join("titles", "|").alias("titles"))


_TITLES = [
    "Data Structures", "Introduction to Oracle & XML", "Comp I", "Calculus II", "Patient Care", "Logic", "Europe", "Principles Acct",
    "Introduction to Programming: Python", "no code here",
]
COURSE_TITLES = f"SELECT c_custkey AS profile_id, {pick(_TITLES, 'c_custkey')} AS titles FROM customer"


def suggested_skills(spark, sf_dir):
    rows = derived(spark, sf_dir, f"SELECT c_custkey AS profile_id, 0 AS pos, {pick(['Applied SQL', 'Python and Statistics', 'Seminar'], 'c_custkey')} AS text, {pick(['python', 'SQL'], 'c_custkey')} AS skill FROM @customer")
    vocabulary = spark.createDataFrame([(s,) for s in SKILLS], "phrase string")
    return matching.suggestions(rows.select("profile_id", "pos", "text"), vocabulary, rows.select("profile_id", "skill"))


SUGGESTED_SKILLS = """
SELECT c_custkey AS profile_id, s AS skill, t AS source FROM customer, (VALUES (0, 'SQL', 'Applied SQL'), (1, 'Python', 'Python and Statistics'), (1, 'Statistics', 'Python and Statistics')) v(k, s, t)
WHERE c_custkey % 3 = k AND NOT (s = 'Python' AND c_custkey % 2 = 0) AND NOT (s = 'SQL' AND c_custkey % 2 = 1)
"""

_ROLES = ["Software Developer", "Registered Nurse", "HR partner", "Reservoir Engineer", "UX designer", "Poet", "Financial Analyst", "Data analytics lead", "Lead teacher"]
_ROLE_KEYS = ["swe", "nursing", "hr", "petroleum", "design", "special", "finance", "data", "teaching"]


def role_keys(spark, sf_dir):
    index = spark.createDataFrame([(0, "special", "Poet", ["bard"]), (1, "other", "poet", [])], "pos int, key string, name string, alternates array<string>")
    return roles.keyed(derived(spark, sf_dir, f"SELECT c_custkey AS id, {pick(_ROLES, 'c_custkey')} AS role FROM @customer"), index)


ROLE_KEYS = f"SELECT c_custkey AS id, {pick(_ROLES, 'c_custkey')} AS role, {pick(_ROLE_KEYS, 'c_custkey')} AS role_key FROM customer"

_EXPORTS = f"""
SELECT c_custkey AS export_id, 0 AS seq, 'Basic/Positions.csv' AS member_name,
  concat('Notes:', chr(10), 'Company Name,Title,Description,Started On,Extra', chr(10), '"', c_name, ', Inc",Engineer,"did', chr(10), 'things",Jan 2024,x', chr(10), ',,,,', chr(10)) AS text FROM @customer
UNION ALL SELECT c_custkey, 1, 'Skills.csv', concat('Name', chr(10), {pick(SKILLS, 'c_custkey')}, chr(10), 'GIT', chr(10), 'Git', chr(10)) FROM @customer
UNION ALL SELECT c_custkey, 2, 'HONOURS.CSV', concat('Wrong,Header', chr(10), 'a,b', chr(10)) FROM @customer
UNION ALL SELECT c_custkey, 3, 'Connections.csv', 'a,b' FROM @customer WHERE c_custkey % 2 = 0
"""


def imported_experience(spark, sf_dir):
    return imports.imported(derived(spark, sf_dir, _EXPORTS))[0]


IMPORTED_EXPERIENCE = """
SELECT c_custkey AS export_id, 0 AS row_no, 'Engineer' AS title, concat(c_name, ', Inc') AS organization, NULL::VARCHAR AS location, 'Jan 2024' AS started_on,
  NULL::VARCHAR AS finished_on, concat('did', chr(10), 'things') AS description, false AS was_cut FROM customer
"""


def imported_lists(spark, sf_dir):
    return imports.imported(derived(spark, sf_dir, _EXPORTS))[2].withColumn("names", F.array_join("names", "|"))


IMPORTED_LISTS = f"SELECT c_custkey AS export_id, 'skills' AS kind, CASE WHEN {pick(SKILLS, 'c_custkey')} = 'Git' THEN 'Git' ELSE concat({pick(SKILLS, 'c_custkey')}, '|GIT') END AS names FROM customer"


def import_notes(spark, sf_dir):
    _, _, _, ignored, notes = imports.imported(derived(spark, sf_dir, _EXPORTS))
    n = ignored.groupBy("export_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "member_name", "reason"))), "|").alias("ignored"))
    return notes.join(n, "export_id").select("export_id", "n_files_read", F.array_join("notes", "|").alias("notes"), "ignored")


IMPORT_NOTES = """
SELECT c_custkey AS export_id, 2::BIGINT AS n_files_read, '' AS notes,
  CASE WHEN c_custkey % 2 = 0 THEN 'Connections.csv:not_read|HONOURS.CSV:no_known_columns' ELSE 'HONOURS.CSV:no_known_columns' END AS ignored FROM customer
"""


def reshaped_dates(spark, sf_dir):
    """Date lines of imported work: a start without an end is present."""
    c = table(spark, sf_dir, "customer")
    started = F.when(F.col("c_custkey") % 3 > 0, "Jan 2024")
    finished = F.when(F.col("c_custkey") % 3 == 2, "May 2024")
    end = F.coalesce(finished, F.when(started.isNotNull(), "Present"), F.lit(""))
    return c.select("c_custkey", F.concat_ws(" – ", started, text.blank_to_null(end)).alias("dates"))


RESHAPED_DATES = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Jan 2024 – Present' ELSE 'Jan 2024 – May 2024' END AS dates FROM customer"

QUERIES = {
    "transcript_profiles": (transcript_profiles, TRANSCRIPT_PROFILES),
    "transcript_profiles_by_labels": (transcript_profiles_by_labels, TRANSCRIPT_PROFILES_BY_LABELS),
    "profile_tables": (profile_tables, PROFILE_TABLES),
    "cleaned_profiles": (cleaned_profiles, CLEANED_PROFILES),
    "relevant_courses": (relevant_courses, RELEVANT_COURSES),
    "catalog_courses": (catalog_courses, CATALOG_COURSES),
    "course_titles": (course_titles, COURSE_TITLES),
    "suggested_skills": (suggested_skills, SUGGESTED_SKILLS),
    "role_keys": (role_keys, ROLE_KEYS),
    "imported_experience": (imported_experience, IMPORTED_EXPERIENCE),
    "imported_lists": (imported_lists, IMPORTED_LISTS),
    "import_notes": (import_notes, IMPORT_NOTES),
    "reshaped_dates": (reshaped_dates, RESHAPED_DATES),
}
