"""Courses: codes, relevance to a major, catalog look-up, and titles a reader understands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio.functions.text import trimmed
from vocatio.operators import matching

CODE = r"(?i)([A-Z]{1,5})\s?-?\s?(\d{3,4})"

# Subjects of general education.
CORE = [
    "ENGL", "ENG", "RHET", "WRIT", "HIST", "HIS", "GOV", "POLS", "PSCI", "PHIL", "RELS", "SOCI", "SOC", "ANTH", "MUSC",
    "MUS", "ART", "ARTS", "THEA", "DANC", "SPAN", "FREN", "GERM", "CHIN", "JAPN", "LATN", "KINE", "PHED", "HLTH",
    "UNIV", "FYS", "SEM", "COLL", "LIBS", "GEOG", "ASTR", "ENVS", "NUTR", "SPCH",
]

# Families of majors by pattern, in order, and their subjects.
FAMILIES = [
    (r"computer science|comp\.? ?sci|software|softw|computing|informatics|computer programming", ["CS", "CSCE", "COSC", "CPSC", "ECEN", "EE", "ECE", "MATH", "M", "STAT", "MIS", "ITEC", "INFO", "ITSE", "ITNW", "ITSC", "ITSY", "INEW", "IMED"]),
    (r"data science|analytics|statistics", ["STAT", "STA", "DATA", "CS", "CSCE", "MATH", "M", "BANA", "MIS", "ISQS", "INFO"]),
    (r"mechanical engineer", ["MEEN", "ME", "MECH", "MATH", "M", "PHYS", "MSEN", "AERO"]),
    (r"civil engineer|construction", ["CVEN", "CE", "CIVE", "COSC", "ARCH", "MATH", "M", "MEEN"]),
    (r"electrical|computer engineer", ["ECEN", "EE", "ECE", "CS", "CSCE", "MATH", "M", "PHYS"]),
    (r"petroleum|energy engineer", ["PETE", "PGE", "GEOL", "MATH", "M", "MEEN", "CHEN"]),
    (r"chemical engineer", ["CHEN", "CHE", "CHEM", "CH", "MATH", "M"]),
    (r"industrial|systems engineer", ["ISEN", "IE", "MEEN", "STAT", "MATH", "M"]),
    (r"accounting", ["ACCT", "ACC", "ACCY", "FIN", "FINC", "BUSI", "MGMT", "ECON"]),
    (r"finance", ["FIN", "FINC", "ACCT", "ACC", "ECON", "BANA", "MATH", "M"]),
    (r"marketing", ["MKTG", "MKT", "BUSI", "MGMT", "COMM", "BANA"]),
    (r"supply chain|logistics|operations", ["SCMT", "SCM", "ISQS", "MGMT", "BUSI", "STAT"]),
    (r"management|business administration|entrepreneur", ["MGMT", "BUSI", "BUAD", "ACCT", "FIN", "MKTG", "SCMT", "ECON"]),
    (r"economics", ["ECON", "ECO", "MATH", "M", "STAT", "FIN"]),
    (r"management information|information systems", ["MIS", "ITEC", "INFO", "ISQS", "CS", "CSCE", "BANA"]),
    (r"nursing", ["NURS", "NUR", "BIOL", "BIO", "CHEM", "CH", "ANAT", "PHYS"]),
    (r"biology|pre-?med|pre-?health|biomedical", ["BIOL", "BIO", "CHEM", "CH", "BICH", "GENE", "MICR", "PHYS", "MATH", "M"]),
    (r"chemistry", ["CHEM", "CH", "BICH", "PHYS", "MATH", "M"]),
    (r"kinesiology|exercise science|athletic training", ["KINE", "KIN", "HLTH", "BIOL", "BIO", "NUTR"]),
    (r"psychology", ["PSYC", "PSY", "STAT", "BIOL", "SOCI"]),
    (r"education|teaching", ["EDUC", "EDCI", "TEED", "EPSY", "READ", "SPED"]),
    (r"communication|journalism|public relations", ["COMM", "JOUR", "PR", "ADV", "MDIA"]),
    (r"criminal justice|criminology|forensic", ["CRIJ", "CJ", "SOCI", "PSYC", "FORS"]),
    (r"agricultur|animal science|agribusiness|soil|crop", ["AGEC", "AGRI", "ANSC", "SCSC", "POSC", "HORT", "RENR"]),
    (r"architecture", ["ARCH", "ARCC", "ENDS", "COSC", "ARTS"]),
    (r"design|graphic|visualization", ["ARTS", "DSGN", "VIZA", "ARCH", "COMM"]),
    (r"mathematics", ["MATH", "M", "STAT", "CS", "CSCE"]),
    (r"physics", ["PHYS", "MATH", "M", "ASTR"]),
]

# What abbreviated words of course titles stand for.
ABBREVIATIONS = {
    "adv": "Advanced", "beg": "Beginning", "comput": "Computing", "db": "Database", "dev": "Development",
    "fund": "Fundamentals", "fundamentals": "Fundamentals", "info": "Information", "intro": "Introduction",
    "lang": "Languages", "mgmt": "Management", "oop": "Object-Oriented Programming", "orcl": "Oracle",
    "prin": "Principles", "prog": "Programming", "progr": "Programming", "sci": "Science", "script": "Scripting",
    "softw": "Software", "sys": "Systems",
}


def parsed_code(label: Column) -> Column:
    """Struct subject, number, code of the first course code in a label; null if it has none."""
    subject, number = F.upper(F.regexp_extract(label, CODE, 1)), F.regexp_extract(label, CODE, 2)
    parsed = F.struct(subject.alias("subject"), number.cast("int").alias("number"), F.concat_ws(" ", subject, number).alias("code"))
    return F.when(label.rlike(CODE), parsed)


def level(number: Column) -> Column:
    """Year in the sequence: thousands of a four-digit number, hundreds of a three-digit one."""
    return F.when(number >= 1000, F.floor(number / 1000)).otherwise(F.floor(number / 100)).cast("int")


def subjects_of(major: Column, degree: Column) -> Column:
    """Subjects of the first family that fits a major and degree; none if no family does."""
    field = F.concat_ws(" ", F.coalesce(major, F.lit("")), F.coalesce(degree, F.lit("")))
    out = F.when(F.lit(False), F.array(F.lit("")))
    for pattern, subjects in FAMILIES:
        out = out.when(field.rlike("(?i)" + pattern), F.array(*map(F.lit, subjects)))
    return F.coalesce(out, F.array().cast("array<string>"))


def relevance(labels: DataFrame) -> DataFrame:
    """Course labels (profile_id, pos, label, major, degree) with ``relevant``: of the major's
    family, or third year and up outside general education."""
    p = parsed_code(F.col("label"))
    rows = labels.withColumn("parsed", p).withColumn("family", subjects_of(F.col("major"), F.col("degree")))
    inside = F.array_contains("family", F.col("parsed.subject"))
    upper = (level(F.col("parsed.number")) >= 3) & ~F.col("parsed.subject").isin(CORE)
    return rows.withColumn("relevant", F.coalesce(inside | upper, F.lit(False))).drop("family")


def resolved(labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """Labels (…, parsed) with the first catalog entry (pos, subjects, lo, hi, title, description)
    whose subjects and number range hold their code; ``title`` is null where there is none."""
    entry = catalog.select(F.col("pos").alias("entry"), F.explode("subjects").alias("subject"), "lo", "hi", F.col("title").alias("catalog_title"), "description")
    key = ["profile_id", "pos"]
    rows = labels.withColumn("subject", F.col("parsed.subject"))
    met = rows.select(*key, "subject", F.col("parsed.number").alias("number")).join(entry, "subject").filter("number BETWEEN lo AND hi")
    first = met.groupBy(*key).agg(F.min_by(F.struct("catalog_title", "description"), "entry").alias("e"))
    return rows.drop("subject").join(first, key, "left").select(*labels.columns, "e.catalog_title", "e.description")


def readable_title(label: Column, fallback: Column, technologies: list[str]) -> Column:
    """What to print for a course label: the title after its code, abbreviations written out; the
    fallback, or the label whole, if it has none."""
    text = trimmed(label)
    parts = F.split(text, " — ", 2)
    title = trimmed(F.get(parts, F.lit(1)))
    t = F.regexp_replace(title, r"(?i)\bop\s+sys\b", "Operating Systems")
    t = F.regexp_replace(t, r"(?i)\bintro\s+to\b", "Introduction to")
    long = ABBREVIATIONS | {s.lower(): s for s in technologies}
    words = F.create_map(*[F.lit(x) for pair in long.items() for x in pair])
    # words and what stands between them take turns
    tokens = F.regexp_extract_all(t, F.lit(r"[A-Za-z][A-Za-z+#.]*|[^A-Za-z]+"), F.lit(0))
    t = F.array_join(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(words, F.lower(w)), w)), "")
    t = F.regexp_replace(t, r"\bIntroduction\s+(?!to\b)(?=[A-Za-z])", "Introduction to ")
    t = F.regexp_replace(t, r"([A-Za-z0-9])\s*&\s*([A-Za-z0-9])", "$1 & $2")
    t = trimmed(F.regexp_replace(F.regexp_replace(t, r"\s*:\s*", ": "), r"\s{2,}", " "))
    return F.when(text == "", "").when(F.coalesce(title, F.lit("")) == "", F.coalesce(fallback, text)).otherwise(t)


def bare_code(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def titles(labels: DataFrame, looked_up: DataFrame, technologies: list[str]) -> DataFrame:
    """profile_id and the printable course titles in order, each once.  ``looked_up`` (profile_id, seq,
    code, catalog_title) holds where label and code begin alike; the first by seq counts."""
    l = labels.withColumn("bare", bare_code(F.col("label"))).withColumn("lead", F.regexp_extract("bare", "^[A-Z]*", 0))
    c = looked_up.select("profile_id", bare_code(F.col("code")).alias("bare_code"), F.regexp_extract(bare_code(F.col("code")), "^[A-Z]*", 0).alias("lead"), "seq", "catalog_title")
    met = l.join(c, ["profile_id", "lead"], "left")
    alike = F.startswith("bare", F.col("bare_code")) | F.startswith("bare_code", F.col("bare"))
    best = met.groupBy("profile_id", "pos", "label").agg(F.min_by(F.when(alike, F.col("catalog_title")), F.when(alike, F.col("seq"))).alias("catalog_title"))
    made = best.select("profile_id", "pos", readable_title(F.col("label"), F.col("catalog_title"), technologies).alias("title")).filter("title <> ''")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"])
    return made.groupBy("profile_id").agg(F.array_distinct(ordered).alias("titles"))


@dataclass
class Coursework:
    """What a transcript's courses come to: labels that bear on the major, those that do not, those of
    the first that the catalog lacks, and the skills to take over (profile_id, place, skill)."""

    relevant: DataFrame
    excluded: DataFrame
    unresolved: DataFrame
    adopted: DataFrame


def processed(labels: DataFrame, catalog: DataFrame, vocabulary: DataFrame, claimed: DataFrame) -> Coursework:
    """Labels (profile_id, pos, label, major, degree) filtered by relevance, looked up in the catalog
    (``resolved``), their official descriptions searched for the vocabulary (pos, phrase), and each
    skill found that a profile does not claim (profile_id, skill) in any case adopted once, in the
    order of its courses and then of the vocabulary."""
    marked = relevance(labels)
    kept = resolved(marked.filter("relevant"), catalog)
    texts = kept.filter("description IS NOT NULL").select(F.struct("profile_id", "pos").alias("text_id"), F.col("description").alias("text"))
    found = matching.named_phrases(texts, vocabulary.select("phrase")).join(vocabulary.groupBy("phrase").agg(F.min("pos").alias("entry")), "phrase")
    lower = F.lower("phrase").alias("lower")
    first = found.groupBy(F.col("text_id.profile_id").alias("profile_id"), lower).agg(
        F.min(F.struct(F.col("text_id.pos").alias("course"), "entry", "phrase")).alias("x")
    )
    mine = claimed.select("profile_id", F.lower("skill").alias("lower"))
    new = first.join(mine, ["profile_id", "lower"], "left_anti")
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy("x.course", "x.entry"))
    adopted = new.select("profile_id", place.alias("place"), F.col("x.phrase").alias("skill"))
    return Coursework(kept, marked.filter(~F.col("relevant")), kept.filter("catalog_title IS NULL"), adopted)
