"""End-to-end jobs over tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.operators import reference
from vocatio.operators.ingest import Ingested, ingest
from vocatio.operators.search import build_index
from vocatio.operators.tables import fresh_payloads, keep_last, split_valid, upsert
from vocatio.plans.snapshots import Snapshots
from vocatio.schemas import TABLES
from vocatio.sources import files


def last_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the last in the order of the input."""
    return keep_last(rows.withColumn("row_no", F.monotonically_increasing_id()), keys, [F.col("row_no")]).drop("row_no")


def build_reference(majors_csv: DataFrame, occupations_csv: DataFrame, titles_csv: DataFrame, zones_csv: DataFrame, crosswalk_csv: DataFrame) -> dict[str, DataFrame]:
    """All reference tables from their raw rows, and the rows that were refused."""
    majors = last_of(files.majors(majors_csv), ["cip_code"])
    valid, refused = split_valid(majors, TABLES["cip_codes"].checks, ["cip_code"])
    majors = reference.without_orphans(valid).drop("orphan")
    occupations = last_of(files.occupations(occupations_csv, files.zones(zones_csv)), ["onet_soc_code"])
    titles = last_of(files.alternate_titles(titles_csv), ["onet_soc_code", "alt_title"])
    titles = titles.join(occupations.select("onet_soc_code"), "onet_soc_code", "left_semi")
    links = files.crosswalk_rows(crosswalk_csv)
    pairs = reference.referential(reference.fan_out(links, occupations), majors, occupations)
    index = build_index(titles.select(F.concat_ws("\n", "onet_soc_code", "alt_title").alias("doc_key"), F.col("alt_title").alias("text")))
    return {"cip_codes": majors, "refused": refused, "occupations": occupations, "alt_titles": titles, "crosswalk": pairs, "title_index": index}


def refresh(target: DataFrame, incoming: DataFrame, name: str) -> DataFrame:
    """Next snapshot of a table of ``TABLES``; of repeated keys in the batch the last row counts."""
    keys = list(TABLES[name].keys)
    return upsert(target, last_of(incoming, keys), keys)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name].schema)


def ingest_and_publish(spark: SparkSession, landed: DataFrame, root: str, now) -> DataFrame:
    """Ingest a batch into the tables under ``root`` (``Snapshots``; empty ones at first) and publish
    the next version of all of them at once: postings and companies are replaced, documents,
    payloads, versions, rejects and counters are added to.  Returns table, n_rows, total.

    A batch that fails leaves the version before it in place and can be run again: what it had
    written belongs to no version, and its rows are found to be missing once more.
    """
    store = Snapshots(spark, root)

    def table(name: str) -> DataFrame:
        return store.read(name, TABLES[name].schema)

    out: Ingested = ingest(landed, table("postings"), table("companies"), table("raw_documents"), now)
    names = lambda name: [c.split()[0] for c in TABLES[name].schema.split(", ")]
    return store.commit(
        {"postings": out.postings, "companies": out.companies},
        {
            "raw_documents": out.raw_documents,
            "payloads": fresh_payloads(out.payloads, table("payloads")).select(*names("payloads")),
            "posting_versions": out.posting_versions,
            "rejected": out.rejected.withColumn("at", now),
            "counters": out.counters.withColumn("at", now),
        },
        {"payloads": ["prefix"]},
    )
