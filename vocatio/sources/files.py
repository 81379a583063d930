"""Reference files to typed DataFrames, and landed payloads to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.functions.text import base_name, blank_to_null, html_to_text, instant, trimmed, truthy, unwrapped

JOB = (
    "struct<id:string,title:string,company_name:string,content:string,location:struct<name:string>,"
    "first_published:string,absolute_url:string>"
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header: quoted newlines, doubled quotes and a byte-order mark are handled;
    every column is a string."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def majors(raw: DataFrame) -> DataFrame:
    """Rows of the major-code export: levels by format, unknown formats skipped, parents named, the
    last of repeated codes kept by the upsert that follows."""
    code = unwrapped(F.col("CIPCode"))
    level = F.when(code.rlike(r"^\d{2}$"), 2).when(code.rlike(r"^\d{2}\.\d{2}$"), 4).when(code.rlike(r"^\d{2}\.\d{4}$"), 6)
    action = trimmed(F.coalesce(F.col("Action"), F.lit("")))
    parent = F.when(level == 4, F.substring_index(code, ".", 1)).when(level == 6, F.substring(code, 1, 5))
    return raw.select(
        code.alias("cip_code"),
        trimmed(F.col("CIPTitle")).alias("cip_title"),
        F.when(F.col("CIPDefinition") != "", F.col("CIPDefinition")).alias("cip_definition"),
        level.alias("level"),
        parent.alias("parent_cip_code"),
        (~action.isin("Moved from", "Deleted")).alias("is_active"),
        F.when(action != "", action).alias("crosswalk_notes"),
    ).filter("level IS NOT NULL")


def zones(raw: DataFrame) -> DataFrame:
    """Job zone per occupation code; of repeated codes the last row in file order counts."""
    rows = raw.select(trimmed(F.col("O*NET-SOC Code")).alias("onet_soc_code"), F.expr("try_cast(`Job Zone` AS int)").alias("zone"), F.monotonically_increasing_id().alias("row_no"))
    return rows.groupBy("onet_soc_code").agg(F.max_by("zone", "row_no").alias("job_zone"))


def occupations(raw: DataFrame, job_zones: DataFrame) -> DataFrame:
    """Occupations with their six-digit code and, where known, their job zone."""
    code = trimmed(F.col("O*NET-SOC Code"))
    rows = raw.select(
        code.alias("onet_soc_code"),
        F.col("Title").alias("title"),
        F.when(F.col("Description") != "", F.col("Description")).alias("description"),
        F.substring_index(code, ".", 1).alias("soc_2018_code"),
    )
    return rows.join(job_zones, "onet_soc_code", "left")


def alternate_titles(raw: DataFrame) -> DataFrame:
    return raw.select(
        trimmed(F.col("O*NET-SOC Code")).alias("onet_soc_code"),
        F.col("Job Title").alias("alt_title"),
        blank_to_null(F.col("Short Title")).alias("short_title"),
        blank_to_null(F.col("Source(s)")).alias("source"),
    )


def crosswalk_rows(raw: DataFrame) -> DataFrame:
    return raw.select(
        trimmed(F.col("CIP2020Code")).alias("cip_code"), trimmed(F.col("SOC2018Code")).alias("soc_2018_code")
    )


def registry(raw: DataFrame) -> DataFrame:
    """Job boards: settings only from cells that are filled."""
    number = lambda c: F.expr(f"try_cast(nullif({c}, '') AS double)")
    names = ("crawl_delay_seconds", "rate_limit_per_minute")
    settings = F.create_map(*[x for c in names for x in (F.lit(c), number(c))])
    return raw.select(
        "source_type",
        "name",
        "base_url",
        "auth_mode",
        truthy(F.col("enabled")).alias("enabled"),
        F.map_filter(settings, lambda k, v: v.isNotNull()).alias("politeness"),
        blank_to_null(F.col("terms_reviewed_at")).alias("terms_reviewed_at"),
    )


def allowed_domains(raw: DataFrame) -> DataFrame:
    domain = F.lower(trimmed(F.col("domain")))
    return raw.select(domain.alias("domain")).filter("domain <> ''").distinct()


def enabled_sources(sources: DataFrame, kind: str = "ats_api", name: str | None = None) -> DataFrame:
    rows = sources.filter(F.col("enabled") & (F.col("source_type") == kind))
    return rows if name is None else rows.filter(F.col("name") == name)


def listed_jobs(landed: DataFrame) -> DataFrame:
    """Listing payloads to one stub per job."""
    jobs = F.from_json("payload", "struct<jobs:array<struct<id:string,absolute_url:string>>>")["jobs"]
    one = landed.select("source_id", F.explode(jobs).alias("j"))
    return one.select("source_id", F.col("j.id").alias("source_posting_id"), F.col("j.absolute_url").alias("url"))


def job_records(landed: DataFrame, full_entities: bool = True) -> DataFrame:
    """Landed job payloads (source_id, url, payload, fetched_at) as records; ``rejected`` says why a
    payload gives none."""
    job = F.from_json("payload", JOB)
    j = F.col("j")
    missing = lambda c: F.coalesce(c == "", F.lit(True))
    broken = ~F.coalesce(F.expr("try_parse_json(payload) IS NOT NULL"), F.lit(False))
    rejected = F.when(broken, "invalid_json").when(missing(j["id"]) | missing(j["title"]), "missing_required_field")
    return landed.select("source_id", "url", "fetched_at", "payload", job.alias("j")).select(
        "source_id",
        F.coalesce(j["absolute_url"], F.col("url")).alias("url"),
        "fetched_at",
        j["id"].alias("source_posting_id"),
        F.coalesce(j["company_name"], F.lit("")).alias("company_name"),
        j["title"].alias("title"),
        html_to_text(j["content"], full_entities).alias("description"),
        j["location"]["name"].alias("location_raw"),
        instant(j["first_published"]).alias("posted_at"),
        rejected.alias("rejected"),
    )


def transcripts(texts: DataFrame, least: int = 40) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, text) that have a text layer, and those that look scanned."""
    enough = F.coalesce(F.length(trimmed(F.col("text"))) >= least, F.lit(False))
    return texts.filter(enough), texts.filter(~enough)


def triaged(files: DataFrame, least: int = 1, most: int = 15 * 1024 * 1024) -> DataFrame:
    """``binaryFile`` rows with the first reason to refuse an upload, or null.  (The reader itself
    skips files without a byte.)"""
    name = F.col("path")
    magic = F.substring(F.col("content"), 1, 5).cast("string")
    reason: Column = (
        F.when(~base_name(name).endswith(".pdf"), "extension")
        .when(F.col("length") < least, "empty")
        .when(F.col("length") > most, "too_large")
        .when(magic != "%PDF-", "signature")
    )
    return files.select("path", "length", reason.alias("refused"))


def stored_payloads(documents: DataFrame, payloads: DataFrame) -> DataFrame:
    """Documents with their payloads, read by content hash.  Of a store that is partitioned by
    prefix only the partitions of the documents asked for are read."""
    if "prefix" not in payloads.columns:
        return documents.join(payloads.select("sha256", "payload"), "sha256")
    prefix = F.substring("sha256", 1, 2)
    asked = documents.drop("prefix").withColumn("prefix", prefix)
    return asked.join(payloads.select("prefix", "sha256", "payload"), ["prefix", "sha256"]).drop("prefix")
