"""Phrases of two to four words that stand together more often than their parts, by stripes.

Every prefix of one to three words keys a stripe: an associative counter of its next words, with
``END`` for a word that ends its piece or goes on with a word that cannot be part of a phrase.
Stripes of a batch are built in one pass over its tokens, dealt out by prefix and merged
elementwise.  A merged stripe holds all three things that scoring needs: the frequent extensions
(the phrases themselves, and so the totals of longer prefixes), its own total (a word's count) and
its largest extension (which may subsume the prefix on its right; the mirror image, by suffix, is
taken from the extensions).

Three passes read the texts: words, stripes of one word, stripes of two and three.  A phrase as
frequent as ``least`` has only words, and only neighbouring pairs, that are as frequent; the others
are kept out of the stripes by bitmaps of bounded size (``bitmaps``), which lose nothing.  Words
have 64-bit hashes; whether two words of a language share one is looked up in the vocabulary, and if
so the words are counted anew with another seed, so results are exact.  Up to ``MOST_WORDS`` frequent
words are numbered (their sorted hashes are broadcast) and travel as four bytes, beyond that as their
hashes, with the same result.  The stripe of a
prefix that makes up a thousandth of all words is cut by next word into ``SEGMENTS`` rows, so that
no task merges a hot prefix alone.

Texts are lower-cased from A to Z and cut at ``.,;:!?`` and line breaks into pieces, which phrases
never cross.  Null texts are empty, null languages are ``und``; a language's rows are told by its
name alone, repeated rows count each time, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio.llm import bitmaps, scratch

LEAST, TOP = 30, 2000
SUBSUMED = 80
END = 0
SEGMENTS = 64
HOT = 1000
SLICE_BYTES = 6 << 20
BROADCAST_ROWS = 500_000
SALTS = 64
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MOST_WORDS = 8_000_000
STRIPE = "lang string, p1 {0}, p2 {0}, p3 {0}, segment int, nexts array<{0}>, counts array<int>"
MERGED = "lang string, p1 {0}, p2 {0}, p3 {0}, total long, best long, nexts array<{0}>, counts array<long>, keys array<long>"
KEY = ["lang", "p1", "p2", "p3"]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Languages and texts of each batch, in slices of about ``SLICE_BYTES`` (one text at least)."""
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1).cast(pa.large_binary()).cast(pa.large_string())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        part = np.concatenate([[-1], ends // SLICE_BYTES]) if len(ends) else np.zeros(1)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)[1:]) + 1, [batch.num_rows]])
        for a, b in pairwise(cuts.tolist()):
            if b > a:
                yield langs[a:b], texts[a:b]


class Words:
    """The words of some texts: ``word`` (position in ``hashes``, ``langs`` and ``names``) and ``piece`` of each."""

    def __init__(self, langs: pa.Array, texts: pa.Array, seed: int):
        from xxhash import xxh64_intdigest

        cut = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[.,;:!?\n-\r]", " \n ")
        parts = pc.split_pattern(pc.replace_substring(cut, "\t", " "), " ")
        flat = parts.flatten().dictionary_encode()
        names, code = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        known = langs.dictionary_encode()
        lang = np.repeat(known.indices.to_numpy(zero_copy_only=False), np.diff(parts.offsets.to_numpy()))
        doc = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
        place = {name: at for at, name in enumerate(names)}
        full = code != place.get("", -1)
        code, lang, doc = code[full], lang[full], doc[full]
        cuts = code == place.get("\n", -1)
        piece = np.cumsum(cuts | (np.diff(doc, prepend=-1) != 0))
        self.piece = piece[~cuts]
        both, self.word = np.unique(lang[~cuts].astype(np.int64) << 32 | code[~cuts], return_inverse=True)
        languages = known.dictionary.to_pylist()
        seeds = [xxh64_intdigest(x or "", seed) for x in languages]
        self.lang = both >> 32
        self.languages = languages
        self.names = [names[c] for c in (both & 0xFFFFFFFF).tolist()]
        self.hashes = np.fromiter(
            (xxh64_intdigest(w, seeds[x]) or 1 for w, x in zip(self.names, self.lang.tolist())), np.uint64, len(both)
        )


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def vocabulary(docs: DataFrame, seed: int = 0) -> DataFrame:
    """lang, word, h, n and seed (that of the hashes) of every word; h is one word's alone within its
    language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _slices(batches):
            w = Words(langs, texts, seed)
            count = np.bincount(w.word, minlength=len(w.names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.languages[x] for x in w.lang.tolist()], pa.string()), pa.array(w.names, pa.string()), pa.array(w.hashes.view(np.int64)), pa.array(count)],
                names=["lang", "word", "h", "n"],
            )

    found = _read(docs).mapInArrow(run, "lang string, word string, h long, n long")
    words = scratch.written(found.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n")), "words")
    return vocabulary(docs, seed + 1) if clash(words) else words.withColumn("seed", F.lit(seed))


def clash(words: DataFrame) -> bool:
    """Whether two words of a language share a hash."""
    return not words.groupBy("lang", "h").count().filter("count > 1").isEmpty()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unsigned key of the pair of two hashes."""
    return (a * MIX[0] + b) * MIX[1]


class Numbers:
    """Words as numbers: places in the sorted hashes of all frequent words from 1 on, or their hashes
    where there are more of them than ``MOST_WORDS``.  ``END`` for a word that is not frequent."""

    def __init__(self, often: DataFrame) -> None:
        self.context = often.sparkSession.sparkContext
        self.placed = often.count() <= MOST_WORDS
        self.kind = "int" if self.placed else "long"
        if self.placed:
            found = often.select("h").toArrow().column("h").to_numpy().view(np.uint64)
            self.known = self.context.broadcast(np.unique(found))
        else:
            self.known = bitmaps.shared(often, "h")

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not self.placed:
            return np.where(bitmaps.perhaps(self.known.value, hashes), hashes, np.uint64(END)).view(np.int64)
        known = self.known.value
        if not len(known):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at + 1, END).astype(np.int32)

    def named(self, words: DataFrame) -> DataFrame:
        """``words`` (lang, h, word) with their numbers as h."""
        of = self.of

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = pa.array(of(batch.column(1).to_numpy().view(np.uint64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), h, batch.column(2)], names=["lang", "h", "word"])

        return words.select("lang", "h", "word").mapInArrow(run, f"lang string, h {self.kind}, word string")

    def __getstate__(self) -> dict:  # tasks have no context
        return {k: v for k, v in self.__dict__.items() if k != "context"}


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unsigned key of a pair of numbers."""
    return _mixed(a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64))


def _stripes(w: Words, number: np.ndarray, prefix: list[np.ndarray], following: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Stripes of prefixes (a row of word positions each) with their next word's position, or -1."""
    start = prefix[0].astype(np.int64)
    for more in prefix[1:]:  # number the different prefixes
        start = np.unique(start << 32 | more, return_inverse=True)[1]
    numbers = np.append(number, number.dtype.type(END))
    segment = np.where(hot, numbers[following] % SEGMENTS, 0).astype(np.int64)
    row = np.unique(start * SEGMENTS + segment, return_inverse=True)[1]
    entry, first, count = np.unique(row << 32 | (following + 1), return_index=True, return_counts=True)
    heads = np.flatnonzero(np.diff(entry >> 32, prepend=-1))
    offsets = pa.array(np.append(heads, len(entry)), pa.int32())
    of = first[heads]
    columns = [number[p[of]] for p in prefix] + [np.zeros(len(of), number.dtype)] * (3 - len(prefix))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([w.languages[x] for x in w.lang[prefix[0][of]].tolist()], pa.string()),
            *map(pa.array, columns),
            pa.array(segment[of].astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(numbers[following[first]])),
            pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32))),
        ],
        names=["lang", "p1", "p2", "p3", "segment", "nexts", "counts"],
    )


def _merge(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes of equal prefix and segment, merged elementwise (``MERGED``); extensions below ``least`` only count in totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            rows = rows.combine_chunks()
            names = rows.column("lang").combine_chunks().dictionary_encode()
            keys = [names.indices.to_numpy(), *(rows.column(c).to_numpy() for c in ("p1", "p2", "p3", "segment"))]
            new = np.ones(rows.num_rows, bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            group = np.cumsum(new) - 1
            flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy()
            size = pc.list_value_length(rows.column("nexts")).to_numpy()
            owner, following, count = np.repeat(group, size), flat("nexts"), flat("counts").astype(np.int64)
            order = np.lexsort((following, owner))
            owner, following, count = owner[order], following[order], count[order]
            differs = (owner[1:] != owner[:-1]) | (following[1:] != following[:-1])
            start = np.flatnonzero(np.append(True, differs))
            owner, following, count = owner[start], following[start], np.add.reduceat(count, start)
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            groups = rows.take(pa.array(np.flatnonzero(new)))
            kept = None
            if not last:  # the last prefix may go on in the next batch
                at = heads[-1]
                kept = groups.slice(groups.num_rows - 1).select(KEY + ["segment"])
                kept = kept.append_column("nexts", pa.array([following[at:]], rows.schema.field("nexts").type))
                kept = kept.append_column("counts", pa.array([count[at:]], pa.list_(pa.int64())))
                owner, following, count, heads = owner[:at], following[:at], count[:at], heads[:-1]
                groups = groups.slice(0, groups.num_rows - 1)
            total = np.add.reduceat(count, heads) if len(heads) else np.zeros(0, np.int64)
            often = (following != END) & (count >= least)
            owner, following, count = owner[often], following[often], count[often]
            best = np.zeros(len(total), np.int64)
            np.maximum.at(best, owner, count)
            cuts = pa.array(np.searchsorted(owner, np.arange(len(total) + 1)), pa.int32())
            key = _key(groups.column("p1").to_numpy()[owner], following).view(np.int64)
            arrays = [groups.column(c).combine_chunks() if groups.num_rows else pa.array([], groups.schema.field(c).type) for c in KEY]
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (following, count, key)]
            found = pa.RecordBatch.from_arrays([*arrays, pa.array(total), pa.array(best), *lists], names=[*KEY, "total", "best", "nexts", "counts", "keys"])
            return found, kept

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = rows.set_column(6, "counts", rows.column("counts").cast(pa.list_(pa.int64())))
                rows = pa.concat_tables([held, rows]) if held is not None else rows
                found, held = out(rows, last=False)
                yield found
        if held is not None:
            yield out(held, last=True)[0]

    kind = stripes.schema["p1"].dataType.simpleString()
    dealt = stripes.repartition(*KEY, "segment").sortWithinPartitions(*KEY, "segment")
    return dealt.mapInArrow(run, MERGED.format(kind))


def _small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast where it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _columns(words: Column, names: str) -> list[Column]:
    """An array of one to three hashes as three columns, ``END`` where there is none."""
    return [F.coalesce(F.get(words, k), F.lit(END)).alias(f"{names}{k + 1}") for k in range(3)]


def stripes(docs: DataFrame, words: DataFrame, number: Numbers, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Merged stripes (``MERGED``) of prefixes of one word, and of two and three."""
    context = docs.sparkSession.sparkContext
    first = words.select("seed").first()
    seed = first.seed if first else 0
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = words.filter(F.col("n") * HOT >= total).select("h").collect()  # HOT words at most
    hot_words = context.broadcast(np.array([r.h for r in hot], np.int64).view(np.uint64))
    kind = number.kind

    def of_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _slices(batches):
            w = Words(langs, texts, seed)
            numbers = number.of(w.hashes)
            frequent = (numbers != END)[w.word]
            goes_on = np.append((w.piece[1:] == w.piece[:-1]) & frequent[1:], False)[: len(frequent)]
            at = np.flatnonzero(frequent)
            if len(at):
                following = np.where(goes_on[at], np.append(w.word, -1)[at + 1], -1)
                yield _stripes(w, numbers, [w.word[at]], following, np.isin(w.hashes, hot_words.value)[w.word[at]])

    singles = scratch.written(_merge(_read(docs).mapInArrow(of_one, STRIPE.format(kind)), least), "stripes-of-one")
    pairs = singles.select(F.explode(F.arrays_zip("counts", "keys")).alias("x")).select("x.counts", "x.keys")
    pairs = scratch.written(pairs, "pairs")
    joined = bitmaps.shared(pairs, "keys")
    hot = pairs.filter(F.col("counts") * HOT >= total).select("keys").collect()  # HOT pairs at most
    hot_pairs = context.broadcast(np.array([r["keys"] for r in hot], np.int64).view(np.uint64))

    def of_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _slices(batches):
            w = Words(langs, texts, seed)
            if len(w.word) < 3:
                continue
            numbers = number.of(w.hashes)
            one = numbers[w.word]
            key = _key(one[:-1], one[1:])
            pair = bitmaps.perhaps(joined.value, key) & (w.piece[1:] == w.piece[:-1]) & (one[:-1] != END) & (one[1:] != END)
            three = np.flatnonzero(pair[:-1] & pair[1:])  # where three words go on, and four
            four = np.flatnonzero(pair[:-2] & pair[1:-1] & pair[2:])
            for at, size in ((three, 2), (four, 3)):
                if len(at):
                    prefix = [w.word[at + k] for k in range(size)]
                    yield _stripes(w, numbers, prefix, w.word[at + size], np.isin(key[at], hot_pairs.value))

    longer = scratch.written(_merge(_read(docs).mapInArrow(of_more, STRIPE.format(kind)), least), "longer-stripes")
    return singles, longer


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases: those of ``least``
    occurrences or more that no longer one with ``subsumed`` percent of theirs contains, by the score
    of their weakest cut."""
    words = vocabulary(docs)
    often = words.filter(F.col("n") >= least)
    number = Numbers(often)
    singles, longer = stripes(docs, words, number, least)
    both = singles.unionByName(longer)
    entry = both.select(*KEY, F.explode(F.arrays_zip("nexts", "counts")).alias("x"))
    own = F.filter(F.array("p1", "p2", "p3", "x.nexts"), lambda h: h != END)
    found = scratch.written(entry.select("lang", own.alias("w"), F.col("x.counts").alias("a")), "phrases")
    totals = singles.groupBy(*KEY).agg(F.sum("total").alias("f")).filter(F.col("f") >= least)
    parts = found.filter(F.size("w") < 4).select("lang", *_columns(F.col("w"), "p"), F.col("a").alias("f"))
    parts = scratch.written(totals.unionByName(parts), "parts")
    rights = both.filter("best > 0").groupBy(*KEY).agg(F.max("best").alias("best"))
    rights = scratch.written(rights, "prefixes")

    def exact(of: str, by: str) -> Column:
        return F.col(of).cast("decimal(20,0)") * F.lit(by).cast("decimal(8,0)")

    def named(table: DataFrame, names: str, **columns: str) -> DataFrame:
        return table.select("lang", *[F.col(f"p{k}").alias(f"{names}{k}") for k in (1, 2, 3)], *[F.col(c).alias(a) for a, c in columns.items()])

    lefts = found.filter(F.size("w") > 2).select("lang", *_columns(F.slice("w", 2, 3), "o"), "a")
    lefts = scratch.written(lefts.groupBy("lang", "o1", "o2", "o3").agg(F.max("a").alias("left_best")), "suffixes")
    small_parts = _small(parts)
    whole = found.filter(F.size("w") == 4).select("lang", "w", "a")
    inner = found.filter(F.size("w") < 4).select("lang", "w", "a", *_columns(F.col("w"), "o"))
    inner = inner.join(named(_small(rights), "o", right_best="best"), ["lang", "o1", "o2", "o3"], "left")
    inner = inner.join(_small(lefts), ["lang", "o1", "o2", "o3"], "left")
    largest = F.greatest(F.coalesce("right_best", F.lit(0)), F.coalesce("left_best", F.lit(0)))
    inner = inner.withColumn("largest", largest).filter(exact("largest", "100") < exact("a", str(subsumed)))
    kept = whole.unionByName(inner.select("lang", "w", "a"))

    cut = kept.select("lang", "w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    first, rest = F.slice("w", F.lit(1), F.col("k")), F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))
    cut = cut.select("*", *_columns(first, "l"), *_columns(rest, "r"))
    cut = cut.join(named(small_parts, "l", l="f"), ["lang", "l1", "l2", "l3"]).join(named(small_parts, "r", r="f"), ["lang", "r1", "r2", "r3"])
    both = F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")
    cut = cut.withColumn("twice", exact("a", "2000000")).withColumn("both", both).withColumn("score", F.expr("twice div both"))
    scored = cut.groupBy("lang", "w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("weakest"))
    scored = scratch.written(scored.select("lang", "w", "a", "weakest.l", "weakest.r", "weakest.score"), "scored")

    name = _small(scratch.written(number.named(often), "frequent-words"))
    part = scored.select("lang", "w", F.posexplode("w").alias("at", "h")).join(name, ["lang", "h"])
    text = part.groupBy("lang", "w").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("x"))
    text = text.select("lang", "w", F.array_join("x.word", " ").alias("phrase"))
    named_phrases = scored.join(text, ["lang", "w"]).withColumn("salt", F.pmod(F.xxhash64("w"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = named_phrases.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    best = best.filter(F.col("place") <= top)  # SALTS * top rows a language go on
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.filter(F.col("rank") <= top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
