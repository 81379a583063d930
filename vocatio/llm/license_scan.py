"""License scan, in DataFrame functions only.

Texts are reduced to lower-case letters and digits and cut to shingles of five words.  Templates
are retrieved by MinHash bands over windows of shingles and verified by exact containment of their
shingles in the text.

Windows come in five sizes (``SIZES``); a text has those that start at every half size, a template
those at all its offsets, in the size that fits its length.  A run of one and a half windows that
text and template share holds one whole window of the text, which collides with certainty.
Templates of 24 shingles or more have windows of 16 with ``BANDS`` bands; a window that agrees with
theirs in three fifths of the shingles collides with probability 1 - 0.4 ** BANDS.  Shorter ones have
one band and the largest window that fits the run which ``least`` leaves of them (``window_of``), so
that they are missed only in a text that scatters their shingles by saying four words twice at each
break.  Only templates of one shingle, those of which ``least`` leaves no run of two, and short ones
that repeat a shingle go by single shingles.

Null text counts as empty.  A template shorter than five words is one shingle of all its words, and
is found only in a text that is exactly that.  Repeated and null ids keep their rows.  No match, or
an empty table, gives no row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.llm import scratch
from vocatio.llm.license_notices import STANDARD
from vocatio.llm.quality import SPACE, _let

SHINGLE, BLOCK, BANDS = 5, 8, 8
SIZES = (1, 2, 4, 8, 2 * BLOCK)
LEAST = 0.8
MAX_KEYS = 100_000

# Notices by which files and pages state their license.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "mit-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "gpl-grant",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
]
NOTICES += [n for n in STANDARD if re.findall(r"\w+", n[1].lower()) not in [re.findall(r"\w+", t.lower()) for _, t in NOTICES]]


def notices(spark: SparkSession) -> DataFrame:
    """The default templates: name, text."""
    return spark.createDataFrame(NOTICES, "name string, text string")


def shingle_words(text: Column) -> Column:
    """Words of letters and digits, A-Z in lower case.  White space becomes blanks, so that a plain
    split cuts the words and the text goes through one pattern, once."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    even = F.translate(F.coalesce(text, F.lit("")), upper + SPACE, lower + " " * len(SPACE))
    return F.array_remove(F.split(F.regexp_replace(even, r"[^\p{L}\p{N} ]+", ""), " "), "")


def _each(w: Column, make) -> Column:
    """``make`` of the words of each shingle; fewer words than a shingle make one."""
    whole = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))),
        lambda x, i: make([x, *[F.get(w, i + k) for k in range(1, SHINGLE)]]),
    )
    short = F.array(make([F.get(w, F.lit(k)) for k in range(SHINGLE)]))
    return F.when(F.size(w) >= SHINGLE, whole).when(F.size(w) > 0, short).otherwise(F.slice(whole, 1, 0))


def hashes(words: Column) -> Column:
    return _let(words, lambda w: _each(w, lambda x: F.xxhash64(*x)))


def strings(words: Column) -> Column:
    return _let(words, lambda w: _each(w, lambda x: F.concat_ws(" ", *x)))


def _bands(of: Column) -> list[Column]:
    """Per band, the MinHash of an array of shingle hashes, marked by its band."""

    def smallest(band: int) -> Column:
        return F.array_min(F.transform(of, lambda x: F.xxhash64(x, F.lit(band))))

    return [smallest(b) for b in range(BANDS)]


def text_keys(h: Column) -> Column:
    """Band values of the windows of 16 of a text: the smaller ones of each two neighbouring blocks."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(F.size(h) / BLOCK).cast("int") - 1, F.lit(0))),
        lambda j: F.array(*_bands(F.slice(h, j * BLOCK + 1, F.lit(BLOCK)))),
    )
    pairs = _let(
        blocks,
        lambda m: F.transform(
            m, lambda x, j: F.array(*[F.least(x[b], F.coalesce(F.get(F.get(m, j + 1), F.lit(b)), x[b])) for b in range(BANDS)])
        ),
    )
    return F.when(F.size(h) >= 2 * BLOCK, F.flatten(pairs)).otherwise(F.array().cast("array<bigint>"))


def _pairs(m: Column) -> Column:
    """The smaller one of each two neighbours (``least`` skips the null behind the last)."""
    return F.transform(m, lambda x, i: F.least(x, F.get(m, i + 1)))


def _halved(m: Column) -> Column:
    """The smaller one of elements 0 and 1, of 2 and 3, and so on; an odd last one is left out."""
    at = F.slice(F.sequence(F.lit(0), F.floor(F.size(m) / 2).cast("int")), 1, F.floor(F.size(m) / 2).cast("int"))
    return F.transform(at, lambda j: F.least(F.get(m, 2 * j), F.get(m, 2 * j + 1)))


def window_of(n: int, different: int, least: float) -> int:
    """The window size of a template of ``n`` shingles.  At most n - kept shingles may be missing;
    fewer than SHINGLE - 1 can only be missing at the ends, as a change inside costs that many."""
    if n >= 3 * BLOCK:
        return 2 * BLOCK
    if different < n:
        return 1
    kept = min(n, max(1, math.ceil(least * n)))
    run = math.ceil(kept / ((n - kept) // (SHINGLE - 1) + 1))
    return max(w for w in SIZES[:-1] if w == 1 or w + w // 2 - 1 <= run)


def template_keys(h: Column, size: int) -> Column:
    """Band values of a template's windows of ``size`` shingles at all offsets."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(1)))
    window = lambda s: F.slice(h, s, F.lit(size))
    if size == SIZES[-1]:
        return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(*_bands(window(s))))))
    return F.array_distinct(F.transform(starts, lambda s: F.array_min(window(s))))


def scan(docs: DataFrame, templates: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, name, shingles (different ones of the template), found and containment, for each
    template of which a text contains ``least`` or more and that no other one explains better
    (``explained``).  ``templates`` (name, text) are looked up in one pass over ``docs`` for every
    ``MAX_KEYS`` of their index keys."""
    known = notices(docs.sparkSession) if templates is None else templates
    known = known.select("name", shingle_words(F.col("text")).alias("w"))
    known = known.select("name", hashes(F.col("w")).alias("h"), F.array_distinct(strings(F.col("w"))).alias("s"))
    known = known.filter("size(s) > 0").select("name", "s", F.size("h").alias("n"), *[template_keys(F.col("h"), w).alias(f"k{w}") for w in SIZES])
    known = scratch.written(known.withColumn("part", F.lit(0)), "templates")
    n_keys = known.agg(F.sum(sum((F.size(f"k{w}") for w in SIZES[1:]), F.size(f"k{SIZES[0]}")))).first()[0] or 0
    parts = -(-n_keys // MAX_KEYS)
    if parts > 1:
        known = scratch.written(known.withColumn("part", F.pmod(F.xxhash64("name", "s"), F.lit(parts)).cast("int")), "templates")
    out = None
    for part in range(max(1, parts)):
        found = _scanned(docs, known.filter(F.col("part") == part), least)
        out = found if out is None else out.unionByName(found)
    return explained(out)


def explained(found: DataFrame) -> DataFrame:
    """Matches without those that are an echo of another template in the same text: all their shingles
    found there belong to the other one too, of which at least as large a share is there, and more
    shingles or a larger share.  So a notice that names version 3 is not the one of version 2 with its
    last word changed, and a phrase within a longer notice is not a second one."""
    key = ["doc_id", "tie"]
    match = F.struct("name", "shingles", "found", "hit", "times")
    # equal rows count once, so that a document's list is no longer than the templates
    counted = found.groupBy(*key, "name", "shingles", "found", "hit").agg(F.count("*").cast("int").alias("times"))
    lists = counted.groupBy(*key).agg(F.collect_list(match).alias("m"))

    def better(t: Column, u: Column) -> Column:
        share = u["found"] * t["shingles"] - t["found"] * u["shingles"]
        return (share >= 0) & ((share > 0) | (u["found"] > t["found"])) & (F.size(F.array_except(t["hit"], u["hit"])) == 0)

    kept = F.filter("m", lambda t: ~F.exists("m", lambda u: better(t, u)))
    rows = lists.select("doc_id", F.explode(kept).alias("t")).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("t.times"))))
    return rows.select("doc_id", "t.name", "t.shingles", "t.found", (F.col("t.found") / F.col("t.shingles")).alias("containment"))


def _scanned(docs: DataFrame, keyed: DataFrame, least: float) -> DataFrame:
    spark = docs.sparkSession
    rows = [(r["name"], list(r["s"]), w, set(r[f"k{w}"])) for r in keyed.collect() for w in [window_of(r["n"], len(r["s"]), least)]]
    keys = {w: sorted({k for _, _, of, ks in rows if of == w for k in ks}) for w in SIZES}

    def met_in(own: Column, size: int) -> Column:
        # a literal set: looked up in each text's row, without one row per shingle
        return F.filter(own, lambda x: x.isin(keys[size])) if keys[size] else F.array().cast("array<bigint>")

    def hits(h: Column) -> Column:
        def fours(two: Column) -> Column:
            four = _let(_halved(two), lambda m: met_in(_pairs(m), 8))
            return F.concat(met_in(_pairs(two), 4), four)

        small = [met_in(h, 1), met_in(_pairs(h), 2), _let(_halved(h), fours)]
        return F.array_distinct(F.concat(*small, met_in(text_keys(h), SIZES[-1])))

    words = shingle_words(F.col("text"))
    met = docs.select("doc_id", "text", _let(hashes(words), hits).alias("hits"))
    met = met.filter("size(hits) > 0").withColumn("row", F.monotonically_increasing_id())
    index = spark.createDataFrame([(k, i) for i, (_, _, _, ks) in enumerate(rows) for k in ks], "key long, at int")
    texts = spark.createDataFrame([(i, name, s) for i, (name, s, *_) in enumerate(rows)], "at int, name string, s array<string>")
    retrieved = met.select("row", "doc_id", "text", F.explode("hits").alias("key")).join(F.broadcast(index), "key")
    retrieved = retrieved.groupBy("row", "at").agg(*[F.first(c).alias(c) for c in ("doc_id", "text")])
    retrieved = retrieved.join(F.broadcast(texts), "at").select("doc_id", F.xxhash64("text").alias("tie"), "name", "s", strings(words).alias("own"))
    verified = retrieved.select("doc_id", "tie", "name", F.size("s").cast("long").alias("shingles"), F.array_intersect("s", "own").alias("hit"))
    verified = verified.withColumn("found", F.size("hit").cast("long"))
    return verified.filter(F.col("found") >= least * F.col("shingles"))
