"""Search over job titles: by prefix in two tiers, and by words with a rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
SALTS, BROADCAST_TERMS = 64, 200_000
# Letters with marks and their base letters.
MARKED, PLAIN = "áàâäãåāçéèêëēíìîïñóòôöõøúùûüýÿ", "aaaaaaaceeeeeiiiinoooooouuuuyy"


def by_prefix(queries: DataFrame, titles: DataFrame, alternates: DataFrame, limit: int = 8) -> DataFrame:
    """For each query (query_id, term): occupations whose title, or else an alternate title, starts
    with the term in any case.  Terms under two characters find nothing.  An occupation appears
    once, by its best tier; order: tier, title, code.

    Names are keyed by their beginnings of the lengths that terms have, so a key holds the term's
    own hits and nothing to verify.  A term's hits are ranked once for all queries that ask for it,
    first in ``SALTS`` parts by occupation, so at most ``SALTS * limit`` of them meet in one task."""
    q = queries.select("query_id", F.lower(F.trim("term")).alias("term")).filter(F.length("term") >= 2)
    own = titles.select("onet_soc_code", "title", F.col("title").alias("text"), F.lit("title").alias("matched_on"), F.lit(0).alias("tier"))
    other = alternates.join(titles.select("onet_soc_code", "title"), "onet_soc_code").select(
        "onet_soc_code", "title", F.col("alt_title").alias("text"), F.lit("alt_title").alias("matched_on"), F.lit(1).alias("tier")
    )
    names = own.unionByName(other).withColumn("text", F.lower("text"))
    terms = q.select("term").distinct()
    lengths = sorted(r.n for r in terms.select(F.length("term").alias("n")).distinct().collect())  # not terms: a few numbers
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("text"))
    heads = names.withColumn("term", F.explode(F.transform(fitting, lambda n: F.substring("text", F.lit(1), n))))
    hits = heads.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term")
    best = hits.groupBy("term", "onet_soc_code", "title").agg(F.min("tier").alias("tier"), F.min_by("matched_on", "tier").alias("matched_on"))
    order = ("tier", "title", "onet_soc_code")
    some = Window.partitionBy("term", F.pmod(F.xxhash64("onet_soc_code"), F.lit(SALTS))).orderBy(*order)
    best = best.withColumn("place", F.row_number().over(some)).filter(F.col("place") <= limit)
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(*order))).filter(F.col("place") <= limit)
    return q.join(best, "term").select("query_id", "place", "onet_soc_code", "title", "matched_on")


def tokens(text: Column) -> Column:
    """Lower-case words without marks."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def build_index(titles: DataFrame) -> DataFrame:
    """``titles`` (doc_key, text) to postings (token, doc_key, tf, positions, length)."""
    words = titles.select("doc_key", tokens(F.col("text")).alias("w"))
    rows = words.select("doc_key", F.size("w").alias("length"), F.posexplode("w").alias("pos", "token"))
    return rows.groupBy("token", "doc_key", "length").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def by_words(queries: DataFrame, index: DataFrame, limit: int = 8) -> DataFrame:
    """For each query (query_id, query): documents that have all its words; words in double quotes
    must follow each other.  Ranked by BM25, then key.

    A query opens the list of its rarest word alone; its other words are looked up for the documents
    found there, so that a frequent word's list is never multiplied by the queries that hold it."""
    lengths = index.select("doc_key", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    plain = F.regexp_replace("query", r'"[^"]*"', " ")
    phrases = F.transform(F.regexp_extract_all("query", F.lit(r'"([^"]*)"'), F.lit(1)), lambda p: tokens(p))
    phrases = F.filter(phrases, lambda p: F.size(p) > 0)
    q = queries.select("query_id", phrases.alias("phrases"), F.array_distinct(F.concat(tokens(plain), F.flatten(phrases))).alias("all"))
    want = q.select("query_id", "phrases", F.size("all").alias("n_words"), F.explode("all").alias("token"))
    asked = want.select("token").distinct()
    known = index.join(F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked, "token", "left_semi")
    df = known.groupBy("token").agg(F.count("*").alias("df"))
    want = want.join(df, "token")
    rarest = want.groupBy("query_id", "n_words").agg(F.count("*").alias("_n"), F.min_by("token", F.struct("df", "token")).alias("token"))
    rarest = rarest.filter("_n = n_words")  # a word that no document has ends the query
    opened = rarest.join(known.select("token", "doc_key"), "token").select("query_id", "doc_key")
    hits = opened.join(want, "query_id").join(known, ["token", "doc_key"])
    hits = hits.withColumn("_k", F.lit(1)).join(F.broadcast(lengths.withColumn("_k", F.lit(1))), "_k")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    found = hits.groupBy("query_id", "phrases", "n_words", "doc_key").agg(
        F.count("*").alias("n_found"), F.sum(part).alias("score"), F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("at")
    ).filter("n_found = n_words")

    def follows(phrase: Column) -> Column:
        return F.exists(
            F.col("at")[phrase[0]],
            lambda s: F.forall(F.sequence(F.lit(0), F.size(phrase) - 1), lambda k: F.array_contains(F.col("at")[F.get(phrase, k)], s + k)),
        )

    found = found.filter(F.forall("phrases", follows))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_key"))
    return found.withColumn("place", place).filter(F.col("place") <= limit).select("query_id", "place", "doc_key", "score")
