"""Quality rules with adaptive thresholds, in DataFrame functions only.

Base rules look at one document.  The adaptive ones compare it with its group: quantile sketches
of symbols per word, share of repeated lines and mean word length are built per language and
source (Spark's mergeable rank sketch, summed map-side), rolled up to language and to all for
groups of fewer than ``min_docs`` documents, and turned into fences
``top + spread * (top - q25) + room``.  ``top`` is an upper quantile for the two ratios, of which
most documents have none, and q75 for the word length, which has a fence below too.  A group's fence
is never wider than its language's, so that a source of junk cannot lift its own limit.  Features are
then joined with their group's fences; a document has ``noise / sqrt(n)`` besides, what a mean of its
n words or lines strays by chance, so that short documents are not rejected for one odd word.

Null text counts as no words.  Null language or source is a group of its own.  Rows are judged one
by one, so repeated ids and rows each get their verdict.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio.llm import scratch

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Fences by ratio: top quantile, spread, room, noise, what the ratio is a mean of, whether there is a fence below.
FENCES = {
    "symbol_ratio": (0.85, 2.0, 0.05, 0.5, "n_words", False),
    "dup_line_ratio": (0.85, 2.0, 0.1, 0.75, "n_lines", False),
    "mean_chars": (0.75, 3.0, 0.5, 15.0, "n_words", True),
}
BROADCAST_GROUPS = 20_000
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def _removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def repeated_words(found: Column) -> Column:
    """Words that lie in a window of five words which occurs twice or more in the text."""

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]),
        )

    def at_repeats(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = F.size(F.array_distinct(h)) < F.size(h)
        return F.when(some, _let(_let(placed, at_repeats), covered)).otherwise(0)

    return _let(windows(found), counted)


def features(text: Column) -> Column:
    """Struct of the counts of ``NAMES`` (long) and ``n_lines``, the lines with a word."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: _removed(x, SPACE) != "")

    def of(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))

    by_word = _let(words(text), of)
    by_line = _let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")
        ),
    )
    return _let(
        F.struct(by_word.alias("w"), by_line.alias("l")),
        lambda b: F.struct(
            b["w"]["n_words"].alias("n_words"),
            F.length(_removed(text, SPACE)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(_removed(text, SYMBOLS))).cast("long").alias("n_symbols"),
            b["l"]["dup"].alias("n_dup_lines"),
            b["w"]["n_repeat_words"].alias("n_repeat_words"),
            b["l"]["n_lines"].alias("n_lines"),
        ),
    )


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def _ratios(f: Column) -> dict[str, Column]:
    n = F.greatest(f["n_words"], F.lit(1))
    return {
        "symbol_ratio": f["n_symbols"] / n,
        "dup_line_ratio": f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(1)),
        "mean_chars": f["word_chars"] / n,
    }


def fences(measured: DataFrame, min_docs: int = 30, accuracy: int = 5000) -> DataFrame:
    """One row per (lang, source) with a low and a high fence per ratio.  ``measured`` has lang,
    source and the struct f."""
    passed = measured.filter(~base_failed(F.col("f")))
    ratios = passed.select("lang", "source", *[c.alias(k) for k, c in _ratios(F.col("f")).items()])
    sketches = ratios.rollup("lang", "source").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("n"),
        *[F.percentile_approx(k, [0.25, top], accuracy).alias(k) for k, (top, *_) in FENCES.items()],
    )
    limits = []
    for k, (_, spread, room, _, _, below) in FENCES.items():
        q25, top = F.col(k)[0], F.col(k)[1]
        low = q25 - spread * (top - q25) - room if below else F.lit(None).cast("double")
        limits += [low.alias(f"{k}_low"), (top + spread * (top - q25) + room).alias(f"{k}_high")]
    sketches = sketches.select("lang", "source", "level", "n", F.struct(*limits).alias("own"))

    def level(value: int, name: str) -> DataFrame:
        kept = [F.when(F.col("n") >= min_docs, F.col("own")).alias(name)]
        return sketches.filter(F.col("level") == value).select("lang", "source", *kept)

    by_lang = level(1, "b").select(F.col("lang").alias("lang_b"), "b")
    whole = level(3, "c").select("c")
    group = sketches.filter(F.col("level") == 0).select("lang", "source", "n", "own")
    joined = group.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_b")), "left").join(F.broadcast(whole), how="left")
    use = F.coalesce(F.when(F.col("n") >= min_docs, F.col("own")), F.col("b"), F.col("c"), F.col("own"))
    joined = joined.select("lang", "source", use.alias("q"), "b")
    columns = []
    for k in FENCES:  # greatest and least skip a null
        columns.append(F.greatest(F.col("q")[f"{k}_low"], F.col("b")[f"{k}_low"]).alias(f"{k}_low"))
        columns.append(F.least(F.col("q")[f"{k}_high"], F.col("b")[f"{k}_high"]).alias(f"{k}_high"))
    return joined.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), *columns)


def _fenced(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (lang, source, ...) with the fences of their group; ``limits`` is a written table."""
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    on = F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source"))
    return rows.join(limits, on, "left")


def _passes(f: Column) -> Column:
    inside = ~base_failed(f)
    for k, value in _ratios(f).items():
        _, _, _, noise, of, _ = FENCES[k]
        stray = noise / F.sqrt(F.greatest(f[of], F.lit(1)))
        above, below = value <= F.col(f"{k}_high") + stray, value >= F.col(f"{k}_low") - stray
        inside &= F.coalesce(above, F.lit(True)) & F.coalesce(below, F.lit(True))
    return inside


def judge(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """doc_id, the counts of ``NAMES``, base_failed and kept, one row per row of ``docs``."""
    measured = docs.select("doc_id", "lang", "source", features(F.col("text")).alias("f"))
    measured = scratch.written(measured, "quality-features")
    limits = scratch.written(fences(measured, min_docs), "quality-fences")
    f = F.col("f")
    verdicts = [base_failed(f).alias("base_failed"), _passes(f).alias("kept")]
    return _fenced(measured, limits).select("doc_id", *[f[k].alias(k) for k in NAMES], *verdicts)


def keep(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.  Rows are written once with their
    features beside them, which costs less than computing the features twice or moving texts."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measured = scratch.written(docs.select(row, "lang", "source", features(F.col("text")).alias("f")), "quality-features")
    limits = scratch.written(fences(measured.select("lang", "source", "f"), min_docs), "quality-fences")
    return _fenced(measured, limits).filter(_passes(F.col("f"))).select("row.*")
