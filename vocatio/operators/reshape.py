"""Profiles, work and imports between the shapes that forms, services and the matcher use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio.functions.text import present, trimmed, truncated

_NONE = "array<string>"


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(_NONE))


def _null_if_blank(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def split_label(label: Column) -> Column:
    """``code — name`` to its parts; a label without the dash is a name."""
    parts = F.split(label, " — ", 2)
    code = F.when(F.size(parts) > 1, trimmed(F.get(parts, F.lit(0))))
    name = F.when(F.size(parts) > 1, trimmed(F.get(parts, F.lit(1)))).otherwise(trimmed(F.get(parts, F.lit(0))))
    return F.struct(code.alias("course_code"), name.alias("course_name"))


def wire_profiles(forms: DataFrame) -> DataFrame:
    """Form rows (profile_id, fields, coursework as labels, skills and certifications of the
    transcript, and those of activities) to profiles.  Transcript entries come before activities:
    that order gives the positional ids."""
    labels = present(_list("coursework"))
    course = F.transform(
        labels,
        lambda v, i: F.struct(
            F.concat(F.lit("course_"), i.cast("string")).alias("id"),
            split_label(v)["course_code"].alias("course_code"),
            split_label(v)["course_name"].alias("course_name"),
            F.lit(True).alias("student_approved"),
        ),
    )
    fields = ("institution", "degree", "degree_level", "major", "minor", "concentration", "gpa")
    return forms.select(
        "profile_id",
        *[_null_if_blank(c).alias(c) for c in fields],
        _null_if_blank("graduation").alias("expected_graduation_date"),
        course.alias("coursework"),
        F.concat(present(_list("skills")), present(_list("activity_skills"))).alias("skills"),
        F.concat(present(_list("certifications")), present(_list("activity_certifications"))).alias("certifications"),
        present(_list("honors")).alias("honors"),
    )


def form_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles to form rows: null as blank, one graduation date, courses as labels."""
    label = F.transform("coursework", lambda c: F.array_join(F.array(c["course_code"], c["course_name"]), " — "))
    fields = ("institution", "degree", "degree_level", "major", "minor", "concentration", "gpa")
    graduation = F.coalesce(_null_if_blank("expected_graduation_date"), _null_if_blank("graduation_date"), F.lit(""))
    return profiles.select(
        "profile_id",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields],
        graduation.alias("graduation"),
        F.filter(F.coalesce(label, F.array().cast(_NONE)), lambda v: v != "").alias("coursework"),
        *[_list(c).alias(c) for c in ("skills", "certifications", "honors")],
    )


def imported_work(experience: DataFrame) -> DataFrame:
    """Imported positions as work rows: a start without an end is present; dates as one line."""
    end = F.coalesce(_null_if_blank("finished_on"), F.when(F.col("started_on") != "", "Present"))
    dates = F.concat_ws(" – ", _null_if_blank("started_on"), end)
    return experience.select(
        "export_id", "row_no", "title", "organization", F.when(dates != "", dates).alias("dates"), F.coalesce("description", F.lit("")).alias("description")
    )


def model_version(method: Column, version: str) -> Column:
    """Recorded only where a model did the extraction."""
    return F.when(method == "llm", F.lit(version))


def card_text(*fields: Column) -> Column:
    """The fields of a card that are filled, as one text."""
    return F.array_join(F.filter(F.array(*fields), lambda v: v.isNotNull() & (v != "")), " ")


def bounded(documents: DataFrame, limit: int = 400_000) -> DataFrame:
    """Documents (doc_id, text) cut to what a reader takes, with a flag."""
    return documents.withColumn("t", truncated(F.col("text"), limit)).select("doc_id", F.col("t.value").alias("text"), "t.was_cut")


def skills_line(verified: Column, claimed: Column) -> Column:
    """Verified skills, then the claimed ones that none of them is in any case."""
    lower = F.transform(verified, lambda v: F.lower(v))
    extra = F.filter(F.array_distinct(claimed), lambda v: ~F.array_contains(lower, F.lower(v)))
    return F.array_join(F.concat(verified, extra), " · ")


def require_allowed(rows: DataFrame, domains: DataFrame, column: str = "domain") -> DataFrame:
    """``rows`` if all their domains are allowed; raises, naming some, if one is not.  A null domain is
    not allowed."""
    _, others = allowed(rows, domains, column)
    some = [r[0] for r in others.select(column).distinct().limit(5).collect()]
    if some:
        raise PermissionError(f"not on the allowlist: {', '.join(map(repr, some))}")
    return rows


def allowed(rows: DataFrame, domains: DataFrame, column: str = "domain") -> tuple[DataFrame, DataFrame]:
    """Rows of an allowed domain, and the others."""
    key = F.lower(trimmed(F.col(column)))
    known = domains.select(F.col("domain").alias("_d"))
    return rows.join(known, key == F.col("_d"), "left_semi"), rows.join(known, key == F.col("_d"), "left_anti")
