"""Profiles against demand: which asked-for skills a profile supports, and by what.

Phrases meet texts in one pass over each text, by an automaton over all phrases (``phrases``).  More
phrases than one automaton holds meet texts on words: a phrase is keyed by one of its words, a text
by all of its different ones, and only pairs that share a key are verified.  A verified phrase always
has its key in the text, so nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio.functions.text import slug, stands_alone, trimmed
from vocatio.operators import phrases as scan

WORD = r"[a-z0-9]+"
TIERS = ("verified", "coursework", "transferable", "not_verified")
BROADCAST_PHRASES = 100_000
HOT_WORD = 1_000_000


def _parts(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)))


def words_of(text: Column) -> Column:
    return _parts(text, WORD)


def phrase_matches(texts: DataFrame, phrases: DataFrame, on: list[str] | None = None, broadcast: int = BROADCAST_PHRASES) -> DataFrame:
    """Pairs of ``texts`` (text, ...) and ``phrases`` (phrase, ...) where the phrase stands alone in
    the text; all columns of both.  The empty phrase and null text match nothing.

    ``on``: columns that must be equal besides; a value of theirs has few phrases (the skills that a
    role asks for), so each text meets all of them.  Without it, up to ``broadcast`` phrases become
    one automaton, and texts are read once and never move.  More of them are joined by word with the texts' hashes,
    hot words split over several tasks; a text moves once, to its candidates.
    """
    phrases = phrases.filter("phrase <> ''")
    # the plain search comes first: most candidates end there, before a pattern is made for them
    named = F.when(F.contains(F.lower("text"), F.lower("phrase")), stands_alone(F.col("text"), F.col("phrase"))).otherwise(False)
    if on:
        return texts.join(phrases, on).filter(named)
    known = scan.collected(phrases, most=broadcast)
    if known is not None:
        hits = scan.scanned(texts, known).withColumn("_hit", F.explode("hits")).drop("hits")
        lower = phrases.withColumn("_hit", F.lower("phrase"))
        return hits.join(F.broadcast(lower) if lower.count() <= broadcast else lower, "_hit").drop("_hit")
    # a phrase without a letter or digit meets texts on its first sign
    keys = F.explode(_parts(F.col("text"), WORD + "|[^a-z0-9]"))
    first_sign = F.substring(F.lower("phrase"), 1, 1)
    own = words_of(F.col("phrase"))
    parts = phrases.select("phrase", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(first_sign))).alias("_word")).distinct()
    hashed = texts.withColumn("_text", F.xxhash64("text"))
    ids = hashed.select("_text", keys.alias("_word")).distinct()
    # only words of phrases are counted, so that a text's other words stop before the shuffle
    known = ids.join(parts.select("_word").distinct(), "_word", "left_semi")
    df = known.groupBy("_word").agg(F.count("*").alias("df"))
    rarest = parts.join(df, "_word", "left").groupBy("phrase").agg(F.min_by("_word", F.struct(F.coalesce("df", F.lit(0)), "_word")).alias("_word"))
    salts = F.broadcast(df.filter(F.col("df") > HOT_WORD).select("_word", F.ceil(F.col("df") / HOT_WORD).cast("int").alias("_salts")))
    n = F.coalesce("_salts", F.lit(1))
    left = ids.join(salts, "_word", "left").withColumn("_salt", F.pmod(F.col("_text"), n).cast("int"))
    right = rarest.join(salts, "_word", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    pairs = left.join(right, ["_word", "_salt"]).select("_text", "phrase")
    met = hashed.join(pairs, "_text").filter(named).drop("_text")
    return met.join(phrases, "phrase")


def evidence_texts(profiles: DataFrame, experience: DataFrame, projects: DataFrame) -> DataFrame:
    """(profile_id, tier, source, pos, evidence_id, text): what each tier of the match reads.  Tier 1
    is exact names, 2 course names and codes, 3 experience and then projects."""
    names = [("skills", "skill", 0), ("certifications", "cert", 1)]
    out = None
    for column, prefix, source in names:
        one = profiles.select("profile_id", F.posexplode(column).alias("pos", "text")).filter("text <> ''").select(
            "profile_id", F.lit(1).alias("tier"), F.lit(source).alias("source"), "pos",
            F.concat(F.lit(prefix + "_"), F.col("pos")).alias("evidence_id"), "text",
        )
        out = one if out is None else out.unionByName(one)
    course = profiles.select("profile_id", F.posexplode("coursework").alias("pos", "c")).filter("c.id <> ''")
    for field, source in (("course_name", 0), ("course_code", 1)):
        out = out.unionByName(
            course.select("profile_id", F.lit(2).alias("tier"), F.lit(source).alias("source"), "pos", F.col("c.id").alias("evidence_id"), F.col(f"c.{field}").alias("text"))
        )
    work = experience.filter("id <> ''").select(
        "profile_id", F.lit(3).alias("tier"), F.lit(0).alias("source"), "pos", F.col("id").alias("evidence_id"), F.col("description").alias("text")
    )
    made = projects.filter("id <> ''").select(
        "profile_id", F.lit(3).alias("tier"), F.lit(1).alias("source"), "pos", F.col("id").alias("evidence_id"),
        F.concat_ws(" ", F.coalesce("technologies", F.lit("")), F.coalesce("description", F.lit(""))).alias("text"),
    )
    return out.unionByName(work).unionByName(made).filter("text IS NOT NULL")


def match(profiles: DataFrame, evidence: DataFrame, demand: DataFrame, aliases: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Every profile (profile_id, role_key) against the ``top`` demanded skills of its role
    (role_key, rank, id, name, posting_count, frequency).

    ``evidence`` as ``evidence_texts`` gives it; ``aliases`` (profile_id, evidence_id, alias) are
    other exact names.  The first tier with a hit decides, and its first item in profile order is
    the evidence.
    """
    asked = demand.filter(F.col("rank") <= top).select(
        "role_key", "rank", F.coalesce("id", slug(F.col("name"))).alias("skill_id"), F.col("name").alias("skill"), "posting_count", "frequency"
    )
    # a profile's evidence, hits and verdicts stay in one partition, by profile; a role's skills come to
    # them, so that pairs of profile and skill never move
    roles = profiles.select("profile_id", "role_key")
    wanted = asked.select("role_key", F.col("skill").alias("phrase")).distinct()
    exact = evidence.filter("tier = 1").withColumn("name", F.lower("text"))
    if aliases is not None:
        named = exact.drop("name", "text").join(aliases, ["profile_id", "evidence_id"])
        exact = exact.unionByName(named.withColumn("name", F.lower("alias")).withColumnRenamed("alias", "text"))
    exact = exact.join(roles, "profile_id").join(scan.sent(wanted.withColumn("name", F.lower("phrase"))), ["role_key", "name"])
    loose = phrase_matches(evidence.filter("tier > 1").join(roles, "profile_id"), scan.sent(wanted), ["role_key"])
    hits = exact.select("profile_id", "phrase", "tier", "source", "pos", "evidence_id").unionByName(
        loose.select("profile_id", "phrase", "tier", "source", "pos", "evidence_id")
    )
    # within a tier: experience before projects, but one course by name or code counts by position
    order = F.struct("tier", F.when(F.col("tier") == 2, 0).otherwise(F.col("source")), "pos", "source")
    best = hits.groupBy("profile_id", "phrase").agg(F.min_by(F.struct("tier", "evidence_id"), order).alias("b"))
    best = best.groupBy("profile_id").agg(F.collect_list(F.struct("phrase", "b")).alias("best"))
    joined = roles.join(best, "profile_id", "left").join(scan.sent(asked), "role_key")
    joined = joined.withColumn("b", F.get(F.filter("best", lambda x: x["phrase"] == F.col("skill")), F.lit(0))["b"])
    status = F.coalesce(F.get(F.array(*map(F.lit, TIERS)), F.col("b.tier") - 1), F.lit("not_verified"))
    found = F.when(F.col("b").isNull(), F.array().cast("array<string>")).otherwise(F.array("b.evidence_id"))
    return joined.select(
        "profile_id", "role_key", "rank", "skill_id", "skill", "posting_count", "frequency", status.alias("status"), found.alias("evidence")
    )


def summary(matches: DataFrame) -> DataFrame:
    """Per profile and role: skills considered, supported, and the gaps in the order of demand."""
    gap = F.when(F.col("status") == "not_verified", F.struct("rank", "skill"))
    return matches.groupBy("profile_id", "role_key").agg(
        F.count("*").alias("considered"),
        F.count_if(F.col("status") != "not_verified").alias("supported"),
        F.transform(F.sort_array(F.collect_list(gap)), lambda g: g["skill"]).alias("gaps"),
    )


def demand_with_verdict(demand: DataFrame, matches: DataFrame) -> DataFrame:
    """All demand rows of a profile's role, with the verdict where there is one."""
    people = matches.groupBy("profile_id", "role_key").agg(F.collect_list(F.struct("rank", "status")).alias("_v"))
    rows = people.join(scan.sent(demand), "role_key")
    verdicts = F.transform(F.filter("_v", lambda v: v["rank"] == F.col("rank")), lambda v: v["status"])
    rows = rows.select("profile_id", *demand.columns, F.explode_outer(verdicts).alias("status"))
    return rows.withColumn("status", F.coalesce("status", F.lit("not_verified")))


def ranked_jobs(jobs: DataFrame, supported: DataFrame, top: int | None = None) -> DataFrame:
    """Jobs (job_id, pos, skills) for each profile by how many of their skills it supports
    (profile_id, skills); ties by pos.  ``top``: only the first so many of each profile.

    Profiles with equal skills get equal answers, and jobs with equal needs rank by pos, so sets of
    skills are compared, not profiles and jobs: each different set of either side counts once, and
    of jobs with one set only the ``top`` first are ranked.
    """

    def as_set(skills: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.transform(skills, lambda s: F.lower(s)), lambda s: s.isNotNull())))

    mine = supported.select("profile_id", as_set(F.col("skills")).alias("mine"))
    need = jobs.select("job_id", "pos", F.size("skills").alias("asked"), F.sort_array(F.transform("skills", lambda s: F.lower(s))).alias("need"))
    if top is not None:
        in_set = Window.partitionBy("need").orderBy("pos", "job_id")
        need = need.withColumn("_n", F.row_number().over(in_set)).filter(F.col("_n") <= top).drop("_n")
    sets = mine.select("mine").distinct().select("mine", F.explode("mine").alias("skill"))
    asks = need.select("need").distinct().select("need", F.posexplode("need").alias("n", "skill"))
    met = sets.join(asks, "skill").groupBy("mine", "need").agg(F.count("*").alias("matched"))
    hits = met.join(need, "need")
    order = Window.partitionBy("mine").orderBy(F.desc("matched"), "pos", "job_id")
    hits = hits.withColumn("place", F.row_number().over(order))
    if top is not None:
        hits = hits.filter(F.col("place") <= top)
    return mine.join(hits, "mine").select("profile_id", "job_id", "pos", "asked", "matched", "place")


def named_phrases(texts: DataFrame, phrases: DataFrame, broadcast: int = BROADCAST_PHRASES) -> DataFrame:
    """(text_id, phrase), each once, of ``texts`` (text_id, text) and ``phrases`` (phrase) that stand
    alone in them.  Texts are not carried along; beyond ``broadcast`` phrases they are read once for
    each part of the phrases."""
    out = None
    for part in scan.parts(phrases, broadcast):
        hits = scan.scanned(texts, part, ["text_id"]).select("text_id", F.explode("hits").alias("_hit"))
        out = hits if out is None else out.unionByName(hits)
    lower = phrases.select("phrase", F.lower("phrase").alias("_hit")).distinct()
    return out.join(lower, "_hit").select("text_id", "phrase").distinct()


def skill_frequency(postings: DataFrame, skills: DataFrame) -> DataFrame:
    """Share of ``postings`` (posting_id, text) that name each skill (phrase), ranked."""
    texts = postings.select(F.col("posting_id").alias("text_id"), "text")
    hits = named_phrases(texts, skills.select("phrase")).groupBy("phrase").agg(F.count("*").alias("n_postings"))
    total = postings.agg(F.count_distinct("posting_id")).first()[0]
    share = F.round(F.col("n_postings") / total, 6) if total else F.lit(0.0)
    every = skills.select("phrase").distinct().join(hits, "phrase", "left").fillna(0, ["n_postings"])
    rank = F.row_number().over(Window.orderBy(F.desc("n_postings"), "phrase"))  # a row per skill
    return every.select("phrase", "n_postings", share.alias("frequency"), rank.alias("rank"))


def tagged(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``texts`` with the array of vocabulary entries (pos, phrase) they name, in vocabulary order."""
    found = named_phrases(texts, vocabulary).join(vocabulary.select("pos", "phrase"), "phrase")
    hits = found.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("pos", "phrase"))).alias("t"))
    rows = texts.join(hits, "text_id", "left")
    return rows.withColumn("skills", F.coalesce(F.transform("t", lambda x: x["phrase"]), F.array().cast("array<string>"))).drop("t")


def suggestions(titles: DataFrame, vocabulary: DataFrame, claimed: DataFrame) -> DataFrame:
    """Skills that a profile's course titles (profile_id, pos, text) name and it does not claim
    (profile_id, skill), each with the first title that names it."""
    rows = titles.withColumn("text_id", F.struct("profile_id", "pos"))
    hits = phrase_matches(rows, vocabulary.select("phrase"))
    first = hits.groupBy("profile_id", F.col("phrase").alias("skill")).agg(F.min_by("text", "pos").alias("source"))
    mine = claimed.select("profile_id", F.lower("skill").alias("_s"))
    return first.join(mine, (first.profile_id == mine.profile_id) & (F.lower("skill") == mine["_s"]), "left_anti")


def added(values: DataFrame, more: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """Entries of ``more`` that ``values`` lacks in any case, each once: the first by ``order``, by its
    spelling without it."""
    first = F.struct(*[F.col(c) for c in (order, value) if c])
    rows = more.groupBy(key, F.lower(trimmed(F.col(value))).alias("_l")).agg(F.min_by(F.struct(*more.columns), first).alias("_r"))
    have = values.select(key, F.lower(trimmed(F.col(value))).alias("_l"))
    return rows.select("_r.*", "_l").join(have, [key, "_l"], "left_anti").drop("_l")
