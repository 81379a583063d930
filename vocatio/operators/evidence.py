"""Claims against the evidence they cite: what holds is kept, the rest is dropped with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio.functions.text import norm, stands_alone, trimmed, unsupported_numbers
from vocatio.operators.matching import phrase_matches
from vocatio.plans.stored import written

EDUCATION = ("institution", "degree", "degree_level", "major", "minor", "concentration", "graduation_date", "expected_graduation_date", "gpa")


def _joined(*columns: Column) -> Column:
    return F.array_join(F.filter(F.array(*columns), lambda v: v.isNotNull() & (v != "")), " ")


def _forms(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda v: v.isNotNull() & (v != ""))


def items(profiles: DataFrame, experience: DataFrame, projects: DataFrame) -> DataFrame:
    """(profile_id, evidence_id, kind, text, forms): everything that a claim of the profile may cite.
    Skills, certifications and honors get positional ids, blank entries included; courses and work
    keep theirs, and those without one are left out."""
    none = F.array().cast("array<string>")
    c = F.col("c")
    both = F.when((c["course_code"] != "") & (c["course_name"] != ""), F.concat_ws(" ", c["course_code"], c["course_name"]))
    courses = profiles.select("profile_id", F.explode("coursework").alias("c")).filter("c.id <> ''").select(
        "profile_id",
        c["id"].alias("evidence_id"),
        F.lit("coursework").alias("kind"),
        _joined(c["course_code"], c["course_name"], c["grade"], c["term"], c["credits"].cast("string")).alias("text"),
        _forms(c["course_name"], c["course_code"], both).alias("forms"),
    )
    out = courses
    for column, prefix, kind in (("skills", "skill", "skill"), ("certifications", "cert", "certification"), ("honors", "honor", "honor")):
        v = F.col("v")
        out = out.unionByName(
            profiles.select("profile_id", F.posexplode(column).alias("pos", "v")).select(
                "profile_id",
                F.concat(F.lit(prefix + "_"), F.col("pos")).alias("evidence_id"),
                F.lit(kind).alias("kind"),
                F.coalesce(v, F.lit("")).alias("text"),
                _forms(v).alias("forms"),
            )
        )
    for table, kind, fields in ((experience, "experience", ("title", "organization", "dates", "description")), (projects, "project", ("name", "technologies", "description"))):
        out = out.unionByName(
            table.filter("id <> ''").select(
                "profile_id", F.col("id").alias("evidence_id"), F.lit(kind).alias("kind"), _joined(*[F.col(f) for f in fields]).alias("text"), none.alias("forms")
            )
        )
    fields = F.array(*[F.struct(F.lit(f"edu_{f}").alias("id"), F.col(f).alias("v")) for f in EDUCATION])
    education = profiles.select("profile_id", F.explode(fields).alias("e")).filter("e.v <> ''")
    return out.unionByName(
        education.select("profile_id", F.col("e.id").alias("evidence_id"), F.lit("education").alias("kind"), F.col("e.v").alias("text"), F.array("e.v").alias("forms"))
    )


def _claimed(profiles: DataFrame) -> DataFrame:
    both = F.concat(F.coalesce("skills", F.array().cast("array<string>")), F.coalesce("certifications", F.array().cast("array<string>")))
    return profiles.select("profile_id", F.explode(both).alias("s")).filter("s <> ''").select("profile_id", norm(F.col("s")).alias("key")).distinct()


def judged(claims: DataFrame, evidence: DataFrame, matches: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every claim (claim_id, profile_id, section, owner_id, pos, text, evidence) with ``reason``,
    null for those that hold; claims without text are left out.

    Sections: summary, skills, experience, projects, coursework, honors, coursework_summary.  The
    first failing check is the reason: evidence cited, known, and of the claim's own owner; no
    missing skill that the cited evidence does not name; no figure that it does not state; then, by
    section, the exact wording, the admissible skill, and no repetition of an earlier kept claim.
    """
    matches = written(matches.select("profile_id", "rank", "skill", "status", "evidence"), "matches")
    c = claims.filter(trimmed(F.coalesce("text", F.lit(""))) != "").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    cited = c.select("claim_id", "profile_id", F.posexplode("evidence").alias("n", "evidence_id"))
    looked = cited.join(evidence, ["profile_id", "evidence_id"], "left")
    by = looked.groupBy("claim_id").agg(
        F.count_if(F.col("kind").isNull()).alias("unknown"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("n", "text")))), lambda x: x["text"]), " ").alias("evidence_text"),
        F.flatten(F.collect_list(F.coalesce("forms", F.array().cast("array<string>")))).alias("forms"),
    )
    c = written(c.join(by, "claim_id", "left"), "cited-claims")
    gaps = matches.filter("status = 'not_verified'").select("profile_id", F.col("skill").alias("phrase")).distinct()
    named = phrase_matches(c.select("claim_id", "profile_id", "text", "evidence_text"), gaps, ["profile_id"])
    leaks = named.filter(~stands_alone(F.col("evidence_text"), F.col("phrase"))).select("claim_id", F.lit(True).alias("leak")).distinct()
    c = c.join(leaks, "claim_id", "left")

    key = norm(F.col("text"))
    listed = _claimed(profiles).withColumn("listed", F.lit(True))
    supported = matches.filter("status <> 'not_verified'").groupBy("profile_id", norm(F.col("skill")).alias("key")).agg(F.max_by("evidence", "rank").alias("accepted"))
    c = c.withColumn("key", key).join(listed, ["profile_id", "key"], "left").join(supported, ["profile_id", "key"], "left")

    owned = F.col("section").isin("experience", "projects")
    common = (
        F.when(F.size("evidence") == 0, "no_evidence")
        .when(F.col("unknown") > 0, "unknown_evidence_id")
        .when(owned & ~F.coalesce(F.array_contains("evidence", F.col("owner_id")), F.lit(False)), "evidence_out_of_scope")
        .when(F.col("leak"), "gap_skill_mentioned")
        .when(F.size(unsupported_numbers(F.col("text"), F.col("evidence_text"))) > 0, "unsupported_number")
    )
    verbatim = F.col("section").isin("coursework", "honors") & ~F.exists("forms", lambda f: norm(f) == F.col("key"))
    reason = common.when(verbatim, "verbatim_mismatch")
    c = c.withColumn("reason", reason)
    # a repetition is judged among claims that passed so far; for skills it comes before admission
    skill = F.col("section") == "skills"
    outside = ~F.coalesce(F.forall("evidence", lambda e: F.array_contains("accepted", e)), F.lit(False))
    inadmissible = skill & F.col("listed").isNull() & (F.col("accepted").isNull() | outside)
    c = c.withColumn("inadmissible", inadmissible)
    deduped = F.col("section").isin("skills", "experience", "projects")
    good = F.col("reason").isNull() & ~F.col("inadmissible")
    scope = Window.partitionBy("profile_id", "section", F.coalesce("owner_id", F.lit("")), "key").orderBy("pos")
    earlier = F.coalesce(F.max(good).over(scope.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    c = c.withColumn("earlier", earlier)
    final = F.coalesce("reason", F.when(deduped & F.col("earlier"), "duplicate").when(F.col("inadmissible"), "not_verified_skill"))
    c = c.withColumn("reason", final)
    # the sentence about courses may cite only courses whose own line was kept
    kept = c.filter("section = 'coursework' AND reason IS NULL").groupBy("profile_id").agg(F.array_distinct(F.flatten(F.collect_list("evidence"))).alias("courses"))
    c = c.join(kept, "profile_id", "left")
    stale = (F.col("section") == "coursework_summary") & (F.size(F.array_except("evidence", F.coalesce("courses", F.array().cast("array<string>")))) > 0)
    c = c.withColumn("reason", F.when(stale, "evidence_out_of_scope").otherwise(F.col("reason")))
    return c.select("claim_id", "profile_id", "section", "owner_id", "pos", "text", "evidence", "reason")


def unknown_owners(entries: DataFrame, owners: DataFrame) -> DataFrame:
    """Entries (profile_id, owner_id) for work that the profile does not have."""
    return entries.join(owners.select("profile_id", F.col("id").alias("owner_id")), ["profile_id", "owner_id"], "left_anti")


def surviving_entries(judged_claims: DataFrame) -> DataFrame:
    """Owners of at least one kept claim, with their kept claims in order."""
    kept = judged_claims.filter("reason IS NULL AND section IN ('experience', 'projects')")
    bullets = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"])
    return kept.groupBy("profile_id", "section", "owner_id").agg(bullets.alias("bullets"))


def education(blocks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Education blocks (profile_id, institution, degree_line, graduation_date, gpa) with fields that
    differ from the profile's set to null and named in ``dropped``; those that agree take the
    profile's spelling."""
    graduation = F.coalesce(F.when(F.col("p.graduation_date") != "", F.col("p.graduation_date")), F.col("p.expected_graduation_date"))
    expected = {"institution": F.col("p.institution"), "degree_line": F.col("p.degree"), "graduation_date": graduation, "gpa": F.col("p.gpa")}
    joined = blocks.alias("b").join(profiles.alias("p"), "profile_id", "left")
    values, dropped = [], []
    for name, want in expected.items():
        made = F.col(f"b.{name}")
        same = F.coalesce(norm(made) == norm(want), F.lit(False)) & want.isNotNull()
        values.append(F.when(made.isNotNull() & same, want).alias(name))
        dropped.append(F.when(made.isNotNull() & ~same, F.lit(name)))
    return joined.select("profile_id", *values, F.array_compact(F.array(*dropped)).alias("dropped"))


def reasons(judged_claims: DataFrame) -> DataFrame:
    return judged_claims.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def grouped_items(evidence: DataFrame) -> DataFrame:
    """Items of each kind of a profile as a sorted list of (id, text)."""
    pairs = F.sort_array(F.collect_list(F.struct("evidence_id", "text")))
    return evidence.groupBy("profile_id", "kind").agg(pairs.alias("items"))
