"""Majors, occupations and the many-to-many links between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_out(links: DataFrame, occupations: DataFrame) -> DataFrame:
    """(cip_code, six-digit code) to every detailed occupation, each pair once."""
    detailed = occupations.select("soc_2018_code", "onet_soc_code")
    return links.join(detailed, "soc_2018_code").select("cip_code", "onet_soc_code").distinct()


def unmatched(links: DataFrame, occupations: DataFrame) -> DataFrame:
    """Links whose six-digit code no occupation has."""
    return links.join(occupations.select("soc_2018_code"), "soc_2018_code", "left_anti")


def referential(pairs: DataFrame, majors: DataFrame, occupations: DataFrame) -> DataFrame:
    """Pairs both of whose ends exist."""
    pairs = pairs.join(majors.select("cip_code"), "cip_code", "left_semi")
    pairs = pairs.join(occupations.select("onet_soc_code"), "onet_soc_code", "left_semi")
    return pairs.select("cip_code", "onet_soc_code")


def without_orphans(majors: DataFrame) -> DataFrame:
    """Majors with parents that do not exist set to null, and ``orphan`` to say so."""
    parents = majors.select(F.col("cip_code").alias("parent_cip_code"), F.lit(True).alias("found")).distinct()
    joined = majors.join(parents, "parent_cip_code", "left")
    lost = F.col("parent_cip_code").isNotNull() & F.col("found").isNull()
    out = [F.when(~lost, F.col(c)).alias(c) if c == "parent_cip_code" else F.col(c) for c in majors.columns]
    return joined.select(*out, lost.alias("orphan"))


def ancestors(nodes: DataFrame, key: str, parent: str, depth: int = 2) -> DataFrame:
    """(key, ancestor, distance) closure of a tree of at most ``depth`` levels above a leaf."""
    edges = nodes.select(F.col(key), F.col(parent).alias("up"))
    reached = nodes.select(F.col(key), F.col(key).alias("ancestor"), F.lit(0).alias("distance"))
    step = reached
    for d in range(1, depth + 1):
        up = edges.select(F.col(key).alias("ancestor"), "up")
        step = step.join(up, "ancestor").filter("up IS NOT NULL").select(key, F.col("up").alias("ancestor"), F.lit(d).alias("distance"))
        reached = reached.unionByName(step)
    return reached


def coverage(ids: DataFrame, pairs: DataFrame, key: str, side: str) -> DataFrame:
    """side, total, covered and percent of the ids that ``pairs`` mentions."""
    used = pairs.select(key, F.lit(True).alias("used")).distinct()
    counts = ids.select(key).distinct().join(used, key, "left")
    counts = counts.agg(F.count("*").alias("total"), F.count("used").alias("covered"))
    percent = F.when(F.col("total") > 0, F.round(100.0 * F.col("covered") / F.col("total"), 1)).otherwise(0.0)
    return counts.select(F.lit(side).alias("side"), "total", "covered", percent.alias("percent"))


def uncovered(ids: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    return ids.select(key).distinct().join(pairs.select(key), key, "left_anti")


def fan_out_counts(pairs: DataFrame, key: str, other: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.count_distinct(other).alias("n_links"))
