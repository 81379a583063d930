"""The driver's tables seen as hiring data.

``@name`` in an adapter's SQL is a table of the driver; the same text runs on Spark and on DuckDB,
so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(re.sub(r"(?<=\s)@(\w+)", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def plain(sql: str) -> str:
    return re.sub(r"(?<=\s)@(\w+)", r"\1", sql)


def pick(values: list[str], key: str) -> str:
    """SQL for one of ``values`` by ``key``."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE CAST(({key}) % {len(values)} AS INT) {cases} END)"


LOCATIONS = [
    "Birmingham, AL", "Birmingham, England", "US-Anywhere", "Remote - US, any state", "Remote - Mexico: all offices", "remote", "Seattle",
    "US-Boston, US-Denver", "CA-Ottawa, CA-Calgary", "CA-Fresno, CA-San Jose", "On campus", "Ottawa, ON, Albany, NY", "Omaha",
    "District office, DC", "Greater Los Angeles", "Paris or Berlin", "Across the United States", "any town, USA", "Plant OH", "  ",
    "ZZ-Springfield", "Boise; Tucson",
]
TITLES = [
    "Software Engineer", "Software Engineering Intern", "Staff Nurse", "Part-time Barista", "Data Analyst (Contract)",
    "Temporary Office Helper", "Account Executive", "Mechanical Engineer", "Recruiter", "Registered Nurse",
]
SUFFIXES = [", Inc.", " LLC", "", " Co", " Corporation", " Group", " L.L.C.", " Ltd."]
MAJORS = ["Computer Science", "Nursing", "Accounting", "Philosophy", "Mechanical Engineering", "Data Science"]
SKILLS = ["Python", "SQL", "Kubernetes", "C++", "Excel", "Go", "Machine Learning", "Git", "Node.js", "REST APIs", "Tableau", "Statistics"]
COURSES = [
    "CS 314 — Data Structures", "ITSE-1420-011 — Intro ORCL&XML", "ENGL 1301 — Comp I", "MATH-251", "NURS 3310 — Patient Care",
    "PHIL 4100 — Logic", "HIST 3000 — Europe", "ACCT 2301 — Prin Acct", "CS 101 — Intro to Progr: Python", "no code here",
]

LOCATED = f"SELECT c_custkey AS id, {pick(LOCATIONS, 'c_custkey')} AS location_raw FROM @customer"
NAMED = f"SELECT c_custkey AS id, concat(c_name, {pick(SUFFIXES, 'c_custkey')}) AS name FROM @customer"
TITLED = f"SELECT c_custkey AS posting_id, {pick(TITLES, 'c_custkey')} AS title FROM @customer"

LANDED = f"""
SELECT c_mktsegment AS source_id, concat('https://jobs.example.com/', CAST(c_custkey AS STRING)) AS url,
       TIMESTAMP '2026-01-05 00:00:00' AS fetched_at,
       CASE WHEN c_custkey % 37 = 0 THEN 'not json'
            WHEN c_custkey % 41 = 0 THEN concat('{{"id": ', CAST(c_custkey AS STRING), '}}')
            ELSE concat('{{"id": ', CAST(c_custkey AS STRING), ', "title": "', {pick(TITLES, 'c_custkey')},
                        '", "company_name": "', {pick(['Acme Inc', 'Acme', 'Globex Corporation', 'Initech LLC'], 'c_custkey')},
                        '", "content": "&lt;p&gt;Build &amp;amp; run things.&lt;/p&gt; Mail a', CAST(c_custkey % 5 AS STRING),
                        '@acme.com", "location": {{"name": "', {pick(LOCATIONS, 'c_custkey')},
                        '"}}, "first_published": "2026-01-0', CAST(c_custkey % 9 + 1 AS STRING), 'T10:00:00+02:00"}}') END AS payload
FROM @customer
"""

PROFILES = f"""
SELECT c_custkey AS profile_id, c_mktsegment AS role_key,
       {pick(SKILLS, 'c_custkey')} AS skill0, {pick(SKILLS, 'c_custkey + 5')} AS skill1, {pick(SKILLS, 'c_custkey + 7')} AS cert0,
       {pick(['Applied SQL', 'Intro to Business', 'Python Programming', 'Statistics', 'Seminar'], 'c_custkey')} AS course_name,
       concat('CS ', CAST(c_custkey % 400 + 100 AS STRING)) AS course_code,
       {pick(['Wrote ETL jobs in Python', 'Answered tickets', 'Ran Kubernetes on 3 clusters', 'Used Excel, Git and sql daily'], 'c_custkey')} AS work,
       {pick(['Go, C++', 'Node.js', '', 'Tableau'], 'c_custkey')} AS tools,
       {pick(['A REST API in 2024', 'Machine learning model', 'Web page'], 'c_custkey')} AS project
FROM @customer
"""

DEMAND = " UNION ALL ".join(
    f"SELECT '{segment}' AS role_key, {r + 1} AS rank, CAST(NULL AS STRING) AS id, '{SKILLS[(r * 5 + k) % len(SKILLS)]}' AS name, "
    f"CAST({100 - r} AS BIGINT) AS posting_count, CAST({(100 - r) / 200} AS DOUBLE) AS frequency"
    for k, segment in enumerate(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    for r in range(12)
)

TRANSCRIPTS = f"""
SELECT c_custkey AS doc_id, concat_ws(chr(10),
  concat('Riverbend ', {pick(['State', 'Valley', 'Tech'], 'c_custkey')}, ' University'),
  concat({pick(['Bachelor of Science', 'Master of Arts', 'B.A.', 'Diploma'], 'c_custkey')}, ' awarded'),
  concat('Major: ', {pick(MAJORS, 'c_custkey')}, '.'),
  concat('Minor - ', {pick(MAJORS, 'c_custkey + 1')}),
  concat('GPA: 3.', CAST(c_custkey % 90 + 10 AS STRING), CASE WHEN c_custkey % 2 = 0 THEN ' / 4.00' ELSE '' END),
  '## Relevant Coursework',
  concat('CS ', CAST(c_custkey % 800 + 100 AS STRING), ' Data Structures 3 credits Grade: A- Fall 2024'),
  'just a remark',
  '', '# Technical Skills', concat('- ', {pick(SKILLS, 'c_custkey')}), '2. Git', '# Honors', 'Dean list') AS text
FROM @customer
"""
