"""Postings: landed payloads to clean, scoped, company-resolved, versioned tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio.functions.location import classify
from vocatio.functions.redaction import redacted, redacted_by_spans, still_personal
from vocatio.functions.text import company_key, content_hash, employment_type
from vocatio.operators.tables import absent, outcome_counts, payload_rows, versioned_fold
from vocatio.plans.stored import written
from vocatio.sources.files import job_records


def company_id(name: Column, domain: Column) -> Column:
    """The same id for the same natural key, so that reruns agree."""
    return F.sha2(F.concat_ws("\n", name, F.coalesce(domain, F.lit("-"))), 256)


def resolve_companies(existing: DataFrame, mentions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Next companies, and (mention_id, company_id, ambiguous) for ``mentions`` (mention_id, name,
    domain, in the order of ``seq``).

    Each mention sees what those before it made.  A name that one company has is that company, whose
    missing domain is filled in; among several the exact domain decides; a name that none has, or a
    domain that none of several has, makes a company; a mention without a domain makes one of its own
    where there are several, as nothing says which is meant.  No name has to be gone through in order
    for that: one that no company had gets one company from its first mention and keeps to it, one
    that a single company had never gets a second, and among several only domains and the mentions
    without one matter, which do not depend on each other.
    """
    m = mentions.withColumn("normalized_name", company_key(F.col("name"))).withColumn("domain", F.nullif("domain", F.lit("")))
    counts = existing.groupBy("normalized_name").agg(
        F.count("*").alias("n"), F.min("company_id").alias("only")
    )
    exact = existing.filter("domain IS NOT NULL").groupBy("normalized_name", "domain").agg(F.min("company_id").alias("exact"))
    m = m.join(counts, "normalized_name", "left").join(exact, ["normalized_name", "domain"], "left")
    several = F.coalesce(F.col("n"), F.lit(0)) > 1
    alone = F.concat(F.lit("?"), F.col("mention_id").cast("string"))  # a blank domain is none
    made = company_id(F.col("normalized_name"), F.when(several, F.coalesce("domain", alone)))
    found = F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")))
    m = m.withColumn("company_id", F.coalesce(found, made)).withColumn("is_new", found.isNull())
    m = m.withColumn("ambiguous", several & F.col("exact").isNull())
    by = m.groupBy("company_id").agg(
        F.min_by("name", "seq").alias("canonical_name"),
        F.first("normalized_name").alias("normalized_name"),
        F.min_by(F.col("domain"), F.when(F.col("domain").isNotNull(), F.col("seq"))).alias("domain"),
        F.first("is_new").alias("is_new"),
    )
    new = by.filter("is_new").join(existing.select("company_id"), "company_id", "left_anti")
    new = new.select("company_id", "canonical_name", "normalized_name", "domain", now.alias("first_seen_at"), now.alias("last_seen_at"))
    seen = by.select("company_id", F.col("domain").alias("_d"), F.lit(True).alias("_seen"))
    kept = existing.join(seen, "company_id", "left").select(
        "company_id",
        "canonical_name",
        "normalized_name",
        F.coalesce("domain", "_d").alias("domain"),
        "first_seen_at",
        F.when(F.col("_seen"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )
    return kept.unionByName(new), m.select("mention_id", "company_id", "ambiguous")


def ambiguous_names(companies: DataFrame) -> DataFrame:
    """Names that more than one company has, with the candidates in order."""
    by = companies.groupBy("normalized_name").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("company_id")).alias("candidates"))
    return by.filter("n > 1")


def prepared(landed: DataFrame, exact_spans: bool = True) -> DataFrame:
    """Records of landed payloads, redacted and located, each with its ``fate``: parse_failed,
    quarantined (personal data survived redaction), excluded_non_us, or null.

    Parsing, redacting and locating a payload is far more work than reading it, so payloads are first
    dealt out to all tasks: a small file may hold very many of them."""
    r = job_records(landed.repartition(int(landed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    r = r.withColumn("clean", redacted_by_spans(F.col("description")) if exact_spans else redacted(F.col("description")))
    r = r.withColumn("loc", classify(F.col("location_raw")))
    fate = (
        F.when(F.col("rejected").isNotNull(), "parse_failed")
        .when(still_personal(F.col("clean")), "quarantined")
        .when(~F.col("loc.is_us"), "excluded_non_us")
    )
    return r.withColumn("fate", fate).drop("description")


@dataclass
class Ingested:
    """Tables after a batch: snapshots (companies, postings), rows to append (raw_documents,
    payloads, posting_versions), and the counters."""

    companies: DataFrame
    postings: DataFrame
    posting_versions: DataFrame
    raw_documents: DataFrame
    payloads: DataFrame
    rejected: DataFrame
    counters: DataFrame


def ingest(
    landed: DataFrame, postings: DataFrame, companies: DataFrame, raw_documents: DataFrame, now: Column
) -> Ingested:
    """One batch of landed payloads (source_id, url, fetched_at, payload).  Several payloads of a
    posting count one after the other, as they were fetched, so every change writes a version; a row
    that fails never stops the others."""
    p = written(prepared(landed), "prepared")  # parsed and redacted once for all tables
    fit = p.filter("fate IS NULL")
    # a posting names its company once a batch and by one id, so that a rerun finds what it made
    mention = F.concat_ws("\n", "source_id", "source_posting_id", company_key(F.col("company_name")))
    order = F.struct("fetched_at", "source_posting_id", "company_name")
    mentions = fit.groupBy(mention.alias("mention_id")).agg(
        F.min_by("company_name", order).alias("name"), F.lit(None).cast("string").alias("domain"), F.min(order).alias("seq")
    )
    next_companies, resolved = resolve_companies(companies, mentions, now)
    batch = fit.withColumn("mention_id", mention).join(resolved.select("mention_id", "company_id"), "mention_id").select(
        "source_id",
        "source_posting_id",
        "company_id",
        "title",
        F.sha2("clean", 256).alias("description_sha256"),
        employment_type(F.col("title")).alias("employment_type"),
        F.col("loc.is_remote").alias("is_remote"),
        "location_raw",
        F.col("loc.city").alias("city"),
        F.col("loc.state").alias("state"),
        F.col("loc.country").alias("country"),
        F.col("loc.reason").alias("scope_reason"),
        "posted_at",
        content_hash(F.col("title"), F.col("clean")).alias("content_hash"),
        "fetched_at",
    )
    keys = ["source_id", "source_posting_id"]
    content = [c for c in batch.columns if c not in (*keys, "fetched_at")]
    in_order = [F.col("fetched_at"), F.col("content_hash"), F.hash(*content)]
    head, versions, outcomes = versioned_fold(postings, batch, keys, content, "content_hash", in_order, now)
    api = landed.select("source_id", "url", F.lit("api_response").alias("doc_type"), "payload", "fetched_at")
    clean = fit.select("source_id", "url", F.lit("posting_description").alias("doc_type"), F.col("clean").alias("payload"), now.alias("fetched_at"))
    both = api.unionByName(clean)
    stored = both.select(
        "source_id",
        "url",
        "doc_type",
        F.sha2("payload", 256).alias("sha256"),
        F.octet_length("payload").cast("long").alias("n_bytes"),
        "fetched_at",
    )
    new_documents = absent(raw_documents, stored, ["source_id", "url", "doc_type", "sha256"])
    fates = p.filter("fate IS NOT NULL").select("source_id", F.col("fate").alias("outcome"))
    counters = outcome_counts(
        fates.unionByName(outcomes.select("source_id", "outcome")),
        "source_id",
        ["new", "updated", "unchanged", "excluded_non_us", "parse_failed", "quarantined"],
    )
    rejected = p.filter("fate IS NOT NULL").select("source_id", "url", "fate", "rejected", "loc.reason")
    return Ingested(next_companies, head, versions, new_documents, payload_rows(both.select("payload")), rejected, counters)
