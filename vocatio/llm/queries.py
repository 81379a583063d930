"""The registered queries of this subpackage, thin over its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.llm import (
    collocations,
    hmm,
    itq,
    langid,
    license_scan,
    mixing,
    oracles,
    packing,
    pii,
    quality,
    scratch,
    simhash,
    spelling,
    topk,
    wavelet,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def _residue(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = (_residue(10) == 0).alias("held_out")
    return hmm.scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_documents(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [count(k) for k in pii.BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.train(docs.filter(_residue(4) != 2).select("lang", "text"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_residue(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = mixing.queued(_documents(spark, sf_dir).select("doc_id", "source", "text"), keep=["doc_id"])
    return queued.select("row.doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(_documents(spark, sf_dir))
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", fingerprint, "component_id")


def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "wavelet")
    wavelet.write_tokens(_documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = wavelet.read_documents(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(_documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_hmm": op2_hmm,
        "op3_license_scan": op3_license_scan,
        "op4_pii": op4_pii,
        "op5_language": op5_language,
        "op6_quality_rules": op6_quality_rules,
        "op7_mixing": op7_mixing,
        "op8_simhash": op8_simhash,
        "op9_wavelet_tokens": op9_wavelet_tokens,
        "op10_top_k": op10_top_k,
        "op11_itq": op11_itq,
        "op12_collocations": op12_collocations,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": oracles.license_scan(),
        "op6_quality_rules": oracles.QUALITY,
        "op7_mixing": oracles.MIXING,
        "op10_top_k": oracles.TOP_K,
        "op11_itq": oracles.NEAR_VECTORS,
        "op12_collocations": oracles.COLLOCATIONS,
        "op13_spelling": oracles.spelling(),
    }
