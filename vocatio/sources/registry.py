"""Parsers by kind of source and host: a new job board is a function from landed payloads to records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocatio.sources.files import job_records

Parser = Callable[[DataFrame], DataFrame]
#: By kind, then by a part of the base URL; the empty part fits every host that no other fits.
_parsers: dict[str, dict[str, Parser]] = {"ats_api": {"": job_records}}


def register(source_type: str, parser: Parser, host: str = "") -> None:
    _parsers.setdefault(source_type, {})[host] = parser


def unregister(source_type: str, host: str = "") -> None:
    _parsers.get(source_type, {}).pop(host, None)


def refused(landed: DataFrame, reason: str) -> DataFrame:
    """Landed rows that no parser reads, as records that say so."""
    kind = job_records(landed).schema
    known = {"source_id", "url", "fetched_at"}
    columns = [F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in kind if f.name != "rejected"]
    return landed.select(*columns, F.lit(reason).alias("rejected"))


def parse(source_type: str, landed: DataFrame, base_url: str = "") -> DataFrame:
    """Records of ``landed`` by the parser of its kind and host; rejected ones if there is none."""
    fitting = [host for host in _parsers.get(source_type, {}) if host in base_url]
    return _parsers[source_type][max(fitting, key=len)](landed) if fitting else refused(landed, "no_parser")


def dispatched(landed: DataFrame, sources: DataFrame) -> DataFrame:
    """Records of ``landed`` from many sources (source_id, source_type, base_url), each by the parser of
    its kind and the longest host that fits; no row is lost: those of a source that is not listed, or
    that no parser reads, come out rejected.  A pass for each parser, over its own rows."""
    choices = sorted(((kind, host) for kind, hosts in _parsers.items() for host in hosts), key=lambda c: (-len(c[1]), c))
    which = F.when(F.col("source_type").isNull(), F.lit(-1))
    for n, (kind, host) in enumerate(choices):
        which = which.when((F.col("source_type") == kind) & F.contains(F.coalesce("base_url", F.lit("")), F.lit(host)), F.lit(n))
    known = sources.groupBy("source_id").agg(F.max(F.struct("source_type", "base_url")).alias("s")).select("source_id", "s.*")
    rows = landed.join(known, "source_id", "left").withColumn("_parser", which.otherwise(F.lit(-2))).drop("source_type", "base_url")
    of = lambda n: rows.filter(F.col("_parser") == n).select(*landed.columns)
    out = refused(of(-1), "unknown_source").unionByName(refused(of(-2), "no_parser"))
    for n, (kind, host) in enumerate(choices):
        out = out.unionByName(_parsers[kind][host](of(n)))
    return out
