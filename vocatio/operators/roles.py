"""Role texts to the keys under which demand is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio.operators import phrases as scan

SALTS = 32

# Patterns of role texts in order of precedence, and their keys.
ROLE_KEYS = [
    (r"petroleum|reservoir|drilling|upstream energy", "petroleum"),
    (r"electrical engineer|computer engineer|embedded", "electrical_engineering"),
    (r"supply chain|logistics|procurement", "supply_chain"),
    (r"construction", "construction"),
    (r"agricultur|agribusiness|ranch|farm", "agriculture"),
    (r"kinesiology|exercise science|athletic train|personal train", "kinesiology"),
    (r"criminal justice|law enforcement|corrections|forensic", "criminal_justice"),
    (r"communications|public relations|\bpr\b|journalism", "communications"),
    (r"biology|pre-health|pre-med|biomedical science", "biology_prehealth"),
    (r"nurs|rn\b|clinical|patient care", "nursing"),
    (r"mechanical|civil|structural|manufactur", "mech_engineering"),
    (r"accountant|accounting|bookkeep|audit", "accounting"),
    (r"human resources|^hr\b| hr |recruit", "hr"),
    (r"sales|account executive|business development", "sales"),
    (r"teach|educat|instructor", "teaching"),
    (r"design|ux|ui|product design", "design"),
    (r"market", "marketing"),
    (r"financ", "finance"),
    (r"data analy|analytics", "data"),
    (r"software|develop|engineer|program", "swe"),
]


def key_by_pattern(role: Column) -> Column:
    r = F.lower(F.coalesce(role, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for pattern, key in ROLE_KEYS:
        out = out.when(r.rlike(pattern), key)
    return out.otherwise("general")


def keyed(roles: DataFrame, index: DataFrame) -> DataFrame:
    """``roles`` (role) with role_key: the first index entry (pos, key, name, alternates) that has
    the role as its name or an alternate in any case, else the first pattern, else ``general``."""
    names = index.select("pos", "key", F.explode(F.concat(F.array(F.lower("name")), F.transform("alternates", lambda a: F.lower(a)))).alias("r"))
    best = names.groupBy("r").agg(F.min_by("key", "pos").alias("key"))
    rows = roles.withColumn("r", F.lower("role")).join(best, "r", "left")
    return rows.withColumn("role_key", F.coalesce("key", key_by_pattern(F.col("role")))).drop("r", "key")


def local_hits(queries: DataFrame, index: DataFrame, limit: int = 8) -> DataFrame:
    """First ``limit`` index entries (pos, name, alternates), in index order, whose name or alternate
    contains the query in any case; the empty query is in all of them.

    An automaton over the different queries reads each name once, so neither side has a limit; a
    query's entries are ranked once for all who ask it, first in ``SALTS`` parts."""
    forms = F.concat(F.array("name"), F.coalesce("alternates", F.array().cast("array<string>")))
    entries = index.select("pos", "name", F.explode(forms).alias("text"))
    asked = queries.select("query_id", F.lower("query").alias("asked")).filter("asked IS NOT NULL")
    found = index.select("pos", "name", F.lit("").alias("asked"))
    for part in scan.parts(asked.select(F.col("asked").alias("phrase"))):
        hits = scan.scanned(entries, part, ["pos", "name"], alone=False)
        found = found.unionByName(hits.select("pos", "name", F.explode("hits").alias("asked")))
    found = found.distinct()
    some = Window.partitionBy("asked", F.pmod(F.xxhash64("pos", "name"), F.lit(SALTS))).orderBy("pos", "name")
    found = found.withColumn("place", F.row_number().over(some)).filter(F.col("place") <= limit)
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy("pos", "name"))).filter(F.col("place") <= limit)
    names = found.groupBy("asked").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))
    return asked.join(names, "asked").select("query_id", "names")


def analysed(role_key: str, frequencies: DataFrame, n: int = 10) -> DataFrame:
    """Market profile of a role from its skill frequencies: the first ``n`` by rank."""
    return frequencies.filter(F.col("rank") <= n).select(F.lit(role_key).alias("role_key"), "rank", F.col("phrase").alias("name"), F.col("n_postings").alias("posting_count"), "frequency")
