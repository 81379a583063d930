"""The pipeline stage by stage against brute force."""

import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vocatio.llm import pii, quality
from tests.llm.test_ops import DOCS, base_spans, slow_components, slow_fingerprint


def corpus():
    random.seed(11)
    say = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    rows = [(i, say(random.randint(15, 80)), random.choice(["en", "de"]), random.choice(["a", "b", "c"])) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "b") for i in range(20)]  # exact copies
    rows += [(300 + i, rows[i][1] + " more", "en", "a") for i in range(20)]  # near copies
    rows += [(400 + i, say(20) + f" mail x{i}@acme.com or +1 (555) 010-99{i:02d} " + say(20), "en", "a") for i in range(10)]
    rows += [(500, "too short", "en", "a"), (501, None, "en", "a"), (502, "", None, None), (503, "again and again " * 40, "en", "a")]
    rows += [(600, rows[0][1], "en", "a"), (600, rows[0][1], "en", "a")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), DOCS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "retrieval_packing":
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]

    # every document with enough words and no repetition is clean here
    want = [r for r in corpus() if r[1] and len(r[1].split()) >= 10 and r[0] != 503]
    assert Counter(map(tuple, kept["quality_rules"])) == Counter(want)

    rows = kept["quality_rules"]
    of = slow_components({slow_fingerprint(r.text) for r in rows})
    first = {}
    for r in rows:
        k = of[slow_fingerprint(r.text)]
        first[k] = min(first.get(k, r.doc_id), r.doc_id)
    assert Counter(r.doc_id for r in kept["near_duplicates"]) == Counter(first.values())

    by = {r.doc_id: r for r in kept["near_duplicates"]}
    for r in kept["personal_data"]:
        before = by[r.doc_id].text
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == before) == (not base_spans(before)) and r.text == pii.masked(before, pii.find_spans(before))
    assert len(kept["personal_data"]) == len(by)

    words = lambda rows: Counter({s: sum(len(r.text.split()) for r in rows if r.source == s) for s in "abc"})
    size, mixed = words(kept["personal_data"]), words(kept["source_mix"])
    share = sum(size.values()) / 6
    if all(share * w <= 3 * size[s] for s, w in zip("abc", (1, 2, 3))):
        assert all(abs(mixed[s] - share * w) <= 1 for s, w in zip("abc", (1, 2, 3)))
    assert all(n <= 3 for n in Counter(r.doc_id for r in kept["source_mix"]).values())

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter()
    for r in kept["source_mix"]:
        ids[r.doc_id] += len(whole.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in kept["retrieval_packing"]:
        got[r.doc_id] += r.length
    assert got == ids


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame(corpus()[:30], DOCS).withColumn("f", F.lit(1)).withColumn("row", F.lit(2)).withColumn("fence_lang", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0, name
    assert quality.keep(docs).filter("f = 1 AND row = 2").count() == quality.keep(docs).count()
