"""Academic profiles from transcript text, in two dialects, and the cleaning of extracted ones.

A text is split to lines once; sections and fields are array and regex expressions over them.  That is
far more work than reading the rows, so texts are first dealt out to all tasks: a small file may hold
very many of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio.functions.text import cleaned, cleaned_list, distinct_ci, in_credit_range, trimmed

# Degree patterns in order of precedence, with names and levels.
DEGREES = [
    (r"\bBachelor of Science\b", "Bachelor of Science", "Bachelor's"),
    (r"\bBachelor of Arts\b", "Bachelor of Arts", "Bachelor's"),
    (r"\bB\.?S\.?\b", "Bachelor of Science", "Bachelor's"),
    (r"\bB\.?A\.?\b", "Bachelor of Arts", "Bachelor's"),
    (r"\bMaster of Science\b", "Master of Science", "Master's"),
    (r"\bMaster of Arts\b", "Master of Arts", "Master's"),
    (r"\bM\.?S\.?\b", "Master of Science", "Master's"),
    (r"\bAssociate of (Arts|Science)\b", "Associate Degree", "Associate"),
    (r"\bDoctor of Philosophy\b|\bPh\.?D\.?\b", "Doctor of Philosophy", "Doctorate"),
]
# Degrees written out, and their levels.
SPELLED = [
    (r"(?i)\bBachelor\s+of\s+Science\s+in\s+Engineering\b", "Bachelor of Science in Engineering", "Bachelor's"),
    (r"(?i)\bBachelor\s+of\s+Science\b", "Bachelor of Science", "Bachelor's"),
    (r"(?i)\bBachelor\s+of\s+Arts\b", "Bachelor of Arts", "Bachelor's"),
    (r"(?i)\bBachelor\s+of\s+Business\s+Administration\b", "Bachelor of Business Administration", "Bachelor's"),
    (r"(?i)\bBachelor\s+of\s+Fine\s+Arts\b", "Bachelor of Fine Arts", "Bachelor's"),
    (r"(?i)\bBachelor\s+of\s+Engineering\b", "Bachelor of Engineering", "Bachelor's"),
    (r"(?i)\bMaster\s+of\s+Science\b", "Master of Science", "Master's"),
    (r"(?i)\bMaster\s+of\s+Arts\b", "Master of Arts", "Master's"),
    (r"(?i)\bMaster\s+of\s+Business\s+Administration\b", "Master of Business Administration", "Master's"),
    (r"(?i)\bAssociate\s+of\s+(?:Arts|Science|Applied Science)\b", "Associate Degree", "Associate"),
    (r"(?i)\bDoctor\s+of\s+Philosophy\b", "Doctor of Philosophy", "Doctorate"),
]
# Degrees by their letters, and their levels.
ABBREVIATED = [
    ("BBA", "Bachelor of Business Administration", "Bachelor's"),
    ("BFA", "Bachelor of Fine Arts", "Bachelor's"),
    ("BSE", "Bachelor of Science in Engineering", "Bachelor's"),
    ("BS", "Bachelor of Science", "Bachelor's"),
    ("BA", "Bachelor of Arts", "Bachelor's"),
    ("MBA", "Master of Business Administration", "Master's"),
    ("MS", "Master of Science", "Master's"),
    ("MA", "Master of Arts", "Master's"),
    ("PHD", "Doctor of Philosophy", "Doctorate"),
    ("BACHELORS", "Bachelor's Degree", "Bachelor's"),
    ("BACHELOR", "Bachelor's Degree", "Bachelor's"),
    ("MASTERS", "Master's Degree", "Master's"),
    ("MASTER", "Master's Degree", "Master's"),
]
# What stands before and behind a degree's letters.
CUE_BEFORE = r"(?:degree|program(?:\s+of\s+study)?|major|awarded|conferred|candidate\s+for|pursuing)\s*[:\-]?\s*"
CUE_AFTER = r"\s*(?:in\b|degree\b|,\s*[A-Z])"
# Labels and shapes of fields.
INSTITUTION = r"([A-Z][A-Za-z&.,'\- ]{2,80}?\b(?:University|College|Institute of Technology|Institute))\b"
INSTITUTIONS = [
    r"\b((?:[A-Z][\w&.'\-]*\s+){0,4}(?:University|College|Institute of Technology|Polytechnic|Institute)"
    r"(?:\s+(?:of|at)\s+[A-Z][\w&.'\-]*(?:\s+[A-Z][\w&.'\-]*){0,3})?)\b",
    r"\b([A-Z][A-Z&.'\- ]{3,50}?\s(?:UNIVERSITY|COLLEGE|INSTITUTE))\b",
    r"\b((?:UNIVERSITY|COLLEGE|INSTITUTE)(?:\s+(?:OF|AT)\s+[A-Z][A-Z&.'\- ]{2,40})?)\b",
]
LABELS = {
    "major": r"(?i)(?:Major|Program of Study)\s*[:\-]\s*(.+)",
    "minor": r"(?i)Minor\s*[:\-]\s*(.+)",
    "concentration": r"(?i)Concentration\s*[:\-]\s*(.+)",
    "expected_graduation_date": r"(?i)Expected\s+Graduation(?:\s+Date)?\s*[:\-]\s*([A-Za-z0-9 ,/]+)",
    "graduation_date": r"(?i)(?:Graduation Date|Date Conferred|Conferred)\s*[:\-]\s*([A-Za-z0-9 ,/]+)",
}
# How grade averages are written.
GPA = r"(?i)GPA\s*[:\-]?\s*(\d\.\d{1,2})\s*(?:/\s*(\d\.\d{1,2}))?"
GPA_JS = r"(?i)\b(?:cumulative\s+)?(?:gpa|grade\s+point\s+average)\b[^\d]{0,12}(\d\.\d{1,3})\s*(?:/\s*(\d\.\d{1,2}))?"
# Course lines.
COURSE = (
    r"(?i)^\s*([A-Z]{2,5}\s?-?\d{3,4})\s*[-:]?\s*([A-Za-z][A-Za-z0-9 &,/'\-]{2,80})"
    r"(?:.*?(\d(?:\.\d)?)\s*(?:cr|credits?))?(?:.*?\bGrade\s*[:\-]?\s*([A-F][+-]?))?"
    r"(?:.*?\b((?:Fall|Spring|Summer|Winter)\s?\d{4}))?"
)
COURSE_JS = r"^\s*([A-Z]{1,5}\s?-?\s?\d{3,4}[A-Z]?)\s*[-:.\s]\s*([A-Za-z][A-Za-z0-9 &,/'\-.]{2,70}?)(?=\s{2,}|\s+\d|\s*$)"
# Headings of sections.
SECTIONS = {
    "coursework": r"(?i)coursework|courses taken|relevant courses",
    "skills": r"(?i)technical skills|skills(?:\s*&\s*technologies)?",
    "honors": r"(?i)honors|awards|dean'?s list",
    "certifications": r"(?i)certifications?|licenses?",
}
# Headings of sections, the wider set.
SECTIONS_JS = {
    "coursework": r"coursework|courses? taken|relevant courses|course history|academic record",
    "skills": r"technical skills|skills(?:\s*(?:&|and)\s*(?:technologies|tools))?|competencies|proficiencies",
    "honors": r"honors|awards|distinctions|honors\s*(?:&|and)\s*awards",
    "certifications": r"certifications?|licenses?|credentials",
}
HEAD = r"^#{1,6}\s*(.+)$"
HEAD_JS = r"^#{1,6}\s*(.+?)\s*$"
COLON_JS = r"^([A-Za-z][A-Za-z '&/]{2,40})\s*:\s*$"
KNOWN_JS = "(?i)^(?:" + "|".join(SECTIONS_JS.values()) + r")\s*:?\s*$"


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def heading(line: Column, mode: str) -> Column:
    """Text of a line that is a heading, else null."""
    if mode == "py":
        return F.when(line.rlike(HEAD), F.regexp_extract(line, HEAD, 1))
    return (
        F.when(line.rlike(HEAD_JS), F.regexp_extract(line, HEAD_JS, 1))
        .when(line.rlike(COLON_JS), F.regexp_extract(line, COLON_JS, 1))
        .when(line.rlike(KNOWN_JS), F.regexp_replace(line, r":\s*$", ""))
    )


def heading_at(lines: Column, pattern: str) -> Column:
    """Place (from 1) of the first heading that matches, 0 if there is none.  ``lines``: array of
    structs line (trimmed, not blank) and head."""
    return F.array_position(F.transform(lines, lambda x: F.coalesce(x["head"].rlike(pattern), F.lit(False))), True)


def section(lines: Column, heads: Column, at: Column) -> Column:
    """Lines under the heading at place ``at`` (from 1), up to the next of ``heads`` (from 0); none for
    place 0.  Both should be columns that are there already: here every line asks for them."""
    # the line after the heading is at ``at`` when counted from 0
    until = F.coalesce(F.get(F.filter(heads, lambda h: h >= at), F.lit(0)), F.size(lines))
    body = F.transform(F.slice(lines, at.cast("int") + 1, (until - at).cast("int")), lambda x: x["line"])
    return F.when(at > 0, body).otherwise(F.array().cast("array<string>"))


def degree(text: Column, mode: str = "py") -> Column:
    """Struct of degree and level; the first pattern wins.  In mode ``js`` an abbreviation needs a
    cue just before or after it."""
    kinds = [(p, n, lv) for p, n, lv in (DEGREES if mode == "py" else SPELLED)]
    if mode == "js":
        for short, name, level in ABBREVIATED:
            letters = r"\.?\s?".join(short) + r"\.?"
            kinds.append((rf"(?i)(?:{CUE_BEFORE}\b{letters}\b)|(?:\b{letters}(?<=\w)\b{CUE_AFTER})|(?:\b{letters}{CUE_AFTER})", name, level))
    out = F.when(F.lit(False), F.struct(F.lit("").alias("degree"), F.lit("").alias("level")))
    for pattern, name, level in kinds:
        out = out.when(text.rlike(pattern), F.struct(F.lit(name).alias("degree"), F.lit(level).alias("level")))
    return out


def title_case_if_shouting(value: Column) -> Column:
    """ALL-CAPS names in title case, small words kept small."""
    small = ("of", "at", "and", "the", "in")
    words = F.split(F.lower(value), r"\s+")
    cased = F.transform(
        words, lambda w, i: F.when((i > 0) & w.isin(*small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))
    )
    return F.when(value == F.upper(value), F.array_join(cased, " ")).otherwise(value)


def institution(text: Column, mode: str = "py") -> Column:
    if mode == "py":
        return _some(trimmed(F.regexp_extract(text, INSTITUTION, 1)))
    found = F.coalesce(*[_some(F.regexp_extract(text, p, 1)) for p in INSTITUTIONS])
    return title_case_if_shouting(trimmed(found))


def labelled(text: Column, pattern: str, mode: str = "py") -> Column:
    value = trimmed(F.regexp_extract(text, pattern, 1))
    ends = r"\.+$" if mode == "py" else r"[.,;]$"
    return _some(F.regexp_replace(value, ends, ""))


def gpa(text: Column, mode: str = "py") -> Column:
    pattern = GPA if mode == "py" else GPA_JS
    value, scale = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(value != "", F.when(scale != "", F.concat_ws("/", value, scale)).otherwise(value))


def courses(lines: Column) -> Column:
    """Course lines as structs; other lines are left out."""
    part = lambda v, k: _some(trimmed(F.regexp_extract(v, COURSE, k)))
    rows = F.filter(lines, lambda v: v.rlike(COURSE))
    return F.transform(
        rows,
        lambda v: F.struct(
            part(v, 1).alias("course_code"),
            part(v, 2).alias("course_name"),
            part(v, 3).cast("double").alias("credits"),
            part(v, 4).alias("grade"),
            part(v, 5).alias("term"),
        ),
    )


def course_labels(lines: Column) -> Column:
    """``code — name`` of course lines, the first of those that differ in case only."""
    rows = F.filter(lines, lambda v: v.rlike(COURSE_JS))
    code = lambda v: trimmed(F.regexp_replace(F.regexp_extract(v, COURSE_JS, 1), r"\s+", " "))
    name = lambda v: F.regexp_replace(trimmed(F.regexp_extract(v, COURSE_JS, 2)), r"[.\s]+$", "")
    return distinct_ci(F.transform(rows, lambda v: F.concat_ws(" — ", code(v), name(v))))


def listed(lines: Column, mode: str = "py") -> Column:
    """Entries of a list section without bullets and numbering."""
    if mode == "py":
        plain = F.transform(lines, lambda v: trimmed(F.regexp_replace(v, r"^[-*•\d.)]+\s*", "")))
        return F.filter(plain, lambda v: v != "")
    parts = F.flatten(F.transform(lines, lambda v: F.split(v, r"\s{2,}|[•·|]")))
    plain = F.transform(parts, lambda v: trimmed(F.regexp_replace(v, r"^[-*•\d.)\s]+", "")))
    return F.filter(plain, lambda v: (F.length(v) > 1) & (F.length(v) < 60))


def warnings(p: dict[str, Column]) -> Column:
    """Fields that still need the reader's attention."""
    absent = {k: p[k].isNull() for k in ("institution", "degree", "major")} | {"coursework": F.size(p["coursework"]) == 0}
    return F.array_compact(F.array(*[F.when(c, F.lit(f"missing_{k}")) for k, c in absent.items()]))


def from_text(texts: DataFrame, mode: str = "py") -> DataFrame:
    """Profiles of ``texts`` (doc_id, text): no value that the text does not state.  ``mode``: ``py``
    reads Markdown headings only; ``js`` also takes label lines and known names for headings, scans
    the whole text for courses if it has no such section, and asks for a cue beside an abbreviated
    degree."""
    names = SECTIONS if mode == "py" else {k: "(?i)" + v for k, v in SECTIONS_JS.items()}
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.transform(F.split(t, r"\r\n|\n|\r"), lambda v: trimmed(v)), lambda v: v != "")
    dealt = texts.select("doc_id", "text").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.select("doc_id", t.alias("t"), F.transform(lines, lambda v: F.struct(v.alias("line"), heading(v, mode).alias("head"))).alias("lines"))
    # what many lines or fields ask for is a column first, so that it is evaluated once for a text
    heads = F.filter(F.transform("lines", lambda x, i: F.when(x["head"].isNotNull(), i)), lambda i: i.isNotNull())
    places = {k: heading_at(F.col("lines"), p) for k, p in names.items()}
    rows = rows.select("*", heads.alias("heads"), degree(F.col("t"), mode).alias("d"), *[at.alias(f"at_{k}") for k, at in places.items()])
    parts = {k: section(F.col("lines"), F.col("heads"), F.col(f"at_{k}")) for k in names}
    d = F.col("d")
    fields = {
        "institution": institution(F.col("t"), mode),
        "degree": d["degree"],
        "degree_level": d["level"],
        **{k: labelled(F.col("t"), p if mode == "py" else p.replace("Program of Study)", "Program of Study|Degree Program)"), mode) for k, p in LABELS.items()},
        "gpa": gpa(F.col("t"), mode),
    }
    if mode == "py":
        fields["coursework"] = courses(parts["coursework"])
    else:
        whole = F.transform("lines", lambda x: x["line"])
        rows = rows.withColumn("courses", parts["coursework"])
        fields["coursework"] = course_labels(F.when(F.size("courses") > 0, F.col("courses")).otherwise(whole))
    fields |= {k: listed(parts[k], mode) for k in ("skills", "honors", "certifications")}
    out = rows.select("doc_id", *[c.alias(k) for k, c in fields.items()])
    return out.withColumn("warnings", warnings({k: F.col(k) for k in fields}))


def cleaned_profile(extracted: DataFrame) -> DataFrame:
    """Extracted profiles (profile_id and the profile's fields) bounded, stripped of control
    characters and repetitions; courses without code and name go, at most 400 are kept."""
    limits = {"institution": 300, "degree": 300, "degree_level": 40, "major": 300, "minor": 300, "concentration": 300, "graduation_date": 60, "expected_graduation_date": 60, "gpa": 20}
    course = F.transform(
        F.slice("coursework", 1, 400),
        lambda c: F.struct(
            cleaned(c["course_code"], 40).alias("course_code"),
            cleaned(c["course_name"], 200).alias("course_name"),
            in_credit_range(c["credits"]).alias("credits"),
            cleaned(c["grade"], 10).alias("grade"),
            cleaned(c["term"], 40).alias("term"),
            F.lit(False).alias("student_approved"),
        ),
    )
    kept = F.filter(course, lambda c: c["course_code"].isNotNull() | c["course_name"].isNotNull())
    return extracted.select(
        "profile_id",
        *[cleaned(F.col(k), n).alias(k) for k, n in limits.items()],
        kept.alias("coursework"),
        *[cleaned_list(F.col(k)).alias(k) for k in ("skills", "honors", "certifications")],
    )


def to_tables(profiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A profile table, course rows with positions, and attribute rows (skill, honor,
    certification), blank values skipped but counted in the positions."""
    parent = profiles.drop("coursework", "skills", "honors", "certifications")
    rows = profiles.select("profile_id", F.posexplode("coursework").alias("position", "c")).select("profile_id", "position", "c.*")
    kinds = (("skills", "skill"), ("honors", "honor"), ("certifications", "certification"))

    def entries(column: str, kind: str) -> Column:
        return F.transform(column, lambda v, i: F.struct(F.lit(kind).alias("attribute_type"), i.alias("position"), v.alias("value")))

    arrays = [entries(c, k) for c, k in kinds]
    attributes = profiles.select("profile_id", F.explode(F.concat(*arrays)).alias("a")).select("profile_id", "a.*").filter("trim(value) <> ''")
    return parent, rows, attributes
