"""Spelling variants: words one edit apart, met through the neighbourhoods of reduced words.

Letters are hashed to a few symbols.  Two words that differ by one inserted, deleted or replaced
letter have reduced words that are equal or differ by one such edit, so each distinct reduced word
generates itself and its full one-edit neighbourhood, the neighbourhood is joined with the reduced
vocabulary, and the words behind both ends are verified on their original letters.  Reduced words
travel as 64-bit polynomial hashes, from which every neighbour's hash follows by arithmetic;
neighbours that are certainly no reduced word are dropped before the join by a bitmap of bounded
size.  A collision only adds a pair to verify.  The number of symbols follows the vocabulary, so
that words of a length have four times as many reduced forms as there are words and the pairs to
verify grow with the vocabulary, not with its square.

Texts give maximal runs of letters, lower-cased from A to Z; by crc32 of ``<id>:<run>`` every
``noise``-th run of a document loses a letter.  That checksum is linear, so it is combined from
those of id and run for all runs of a batch at once.  Null texts have no words, a null id counts as
the empty text, repeated rows count each time, and an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocatio.llm import bitmaps, scratch

NOISE, LETTERS, LEAST, RATIO = 97, 5, 3, 2
SLICE_BYTES = 24 << 20
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
LEAST_SYMBOLS, SPREAD = 6, 4


def _operator(length: int) -> np.ndarray:
    """Four tables that move a checksum past ``length`` zero bytes, byte by byte of its state."""
    zeros, full = bytes(length), 0xFFFFFFFF
    return np.array([[zlib.crc32(zeros, b << 8 * k ^ full) ^ full for b in range(256)] for k in range(4)], np.uint32)


class Checksums:
    """crc32 of the concatenation of two byte strings, from their checksums and the second's length."""

    def __init__(self) -> None:
        self.known: dict[int, np.ndarray] = {}

    def joined(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), np.uint32)
        order = np.argsort(lengths, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(lengths[order], prepend=-1)), len(order))
        for a, b in pairwise(cuts.tolist()):
            at, size = order[a:b], int(lengths[order[a]])
            if size not in self.known:
                if len(self.known) > 256:
                    self.known.clear()
                self.known[size] = _operator(size)
            state, table = first[at], self.known[size]
            moved = table[0][state & 255] ^ table[1][state >> 8 & 255] ^ table[2][state >> 16 & 255] ^ table[3][state >> 24]
            out[at] = moved ^ second[at]
        return out


def counted(docs: DataFrame, noise: int = NOISE, letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """word and n of the words of ``letters`` letters and ``least`` occurrences or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checksums = Checksums()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES, prepend=0)) if len(ends) else np.zeros(0, int)
            for a, b in pairwise(np.unique([0, *cuts, batch.num_rows]).tolist()):
                yield words(batch.column(0)[a:b], texts[a:b], checksums)

    def words(ids: pa.Array, texts: pa.Array, checksums: Checksums) -> pa.RecordBatch:
        spaced = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[^a-z\x{C0}-\x{FF}]+", " ")
        parts = pc.split_pattern(spaced, " ")
        flat = parts.flatten().dictionary_encode()
        known = flat.dictionary
        doc = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
        both, times = np.unique(doc << 32 | flat.indices.to_numpy(), return_counts=True)
        doc, code = both >> 32, both & 0xFFFFFFFF
        names = known.to_pylist()
        size = pc.utf8_length(known).to_numpy()
        full = size[code] > 0
        doc, code, times = doc[full], code[full], times[full]
        heads = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids.to_pylist()], np.uint32)
        tails = np.array([zlib.crc32(x.encode()) for x in names], np.uint32)
        h = checksums.joined(heads[doc], tails[code], pc.binary_length(known).to_numpy()[code].astype(np.int64))
        cut = h % noise == 0 if noise else np.zeros(len(h), bool)
        count = np.bincount(code[~cut], times[~cut], len(names)).astype(np.int64)
        there = np.flatnonzero((count > 0) & (size >= letters))
        shorter: dict[str, int] = {}
        for c, n, at in zip(code[cut].tolist(), times[cut].tolist(), (h[cut] % np.maximum(size[code[cut]], 1)).tolist()):
            word = names[c][:at] + names[c][at + 1 :]
            if len(word) >= letters:
                shorter[word] = shorter.get(word, 0) + n
        word = pa.concat_arrays([known.take(pa.array(there)).cast(pa.string()), pa.array(list(shorter), pa.string())])
        n = np.concatenate([count[there], np.fromiter(shorter.values(), np.int64, len(shorter))])
        return pa.RecordBatch.from_arrays([word, pa.array(n)], names=["word", "n"])

    read = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = read.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Reduction:
    """Words over ``symbols`` symbols, as sums of symbol * BASE^place modulo 2^64."""

    def __init__(self, symbols: int) -> None:
        self.symbols = symbols
        self.powers = np.ones(64, np.uint64)
        self._grow(64)
        self.inverse = np.uint64(pow(BASE, -1, 1 << 64))

    def _grow(self, size: int) -> None:
        if len(self.powers) < size or size == 64:
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(size, BASE, np.uint64)), dtype=np.uint64)

    def terms(self, letters: np.ndarray) -> np.ndarray:
        """Symbols (from 1), by a hash of code points, times their places' powers; a word a row."""
        self._grow(letters.shape[1] + 2)
        mixed = (letters.astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(7)
        return (mixed % np.uint64(self.symbols) + np.uint64(1)) * self.powers[: letters.shape[1]]

    def of(self, letters: np.ndarray) -> np.ndarray:
        return self.terms(letters).sum(1, dtype=np.uint64) * MIX

    def neighbours(self, letters: np.ndarray) -> np.ndarray:
        """Keys of the words themselves and of all their one-edit neighbours, with repeats."""
        term, size = self.terms(letters), letters.shape[1]
        power = self.powers
        before = np.cumsum(np.pad(term, ((0, 0), (1, 0))), 1, dtype=np.uint64)  # before[p]: places below p
        whole = before[:, -1:]
        after = whole - before  # after[p]: places from p on
        symbols = np.arange(1, self.symbols + 1, dtype=np.uint64)
        deleted = before[:, :-1] + after[:, 1:] * self.inverse
        replaced = (before[:, :-1] + after[:, 1:])[:, :, None] + (symbols[None, :] * power[:size, None])[None]
        inserted = (before + after * np.uint64(BASE))[:, :, None] + (symbols[None, :] * power[: size + 1, None])[None]
        n = len(letters)
        return np.concatenate([whole, deleted, replaced.reshape(n, -1), inserted.reshape(n, -1)], 1) * MIX


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and code points (a word a row) of the words of each length."""
    size = pc.utf8_length(words).to_numpy()
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
    start = np.cumsum(size) - size
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        for k in range(0, len(at), max(1, 200_000 // (length + 1) ** 2)):
            part = at[k : k + max(1, 200_000 // (length + 1) ** 2)]
            yield part, points[start[part][:, None] + np.arange(length)]


def alphabet(words: DataFrame) -> int:
    """Symbols that give the words of every length ``SPREAD`` times as many reduced forms."""
    sizes = words.groupBy(F.char_length("word").alias("length")).count()
    most = sizes.select(F.max(F.pow(F.col("count") * SPREAD, F.lit(1.0) / F.col("length"))).alias("most")).first().most
    return max(LEAST_SYMBOLS, int(np.ceil(most or 0)))


def _shuffled(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join that sends neither side through the driver.  All tables here grow with the vocabulary,
    and Spark sizes them too low: by compressed files, and edits by the words that they come from."""
    return left.join(right.hint("merge"), key, how)


def near(words: DataFrame) -> DataFrame:
    """word, n, near and near_n for every word of ``words`` (word, n) and each word one edit away."""
    reduction = Reduction(alphabet(words))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(batch.num_rows, np.uint64)
            for at, letters in _by_length(batch.column(0)):
                key[at] = reduction.of(letters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], names=["word", "n", "form"])

    reduced = scratch.written(words.select("word", "n").mapInArrow(reduce, "word string, n long, form long"), "reduced-words")
    forms = scratch.written(reduced.groupBy("form").agg(F.min("word").alias("word")), "reduced-forms")
    there = bitmaps.shared(forms, "form")

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = batch.column(0).to_numpy()
            for at, letters in _by_length(batch.column(1)):
                keys = reduction.neighbours(letters)
                row, place = np.nonzero(bitmaps.perhaps(there.value, keys.ravel()).reshape(keys.shape))
                pairs = np.unique(np.stack([form[at[row]], keys[row, place].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["form", "other"])

    met = forms.mapInArrow(edits, "form long, other long")
    other = reduced.select(F.col("form").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = _shuffled(_shuffled(met, other, "other"), reduced, "form")
    close = (F.abs(F.char_length("word") - F.char_length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    return pairs.filter(close).select("word", "n", "near", "near_n")


def _roots(form: DataFrame) -> DataFrame:
    """word and root: where the chain of forms (word, form) ends, by pointers that double."""
    at = scratch.written(form.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = scratch.written(_shuffled(at, ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), "ahead"), "roots")
        at = moved.select("word", "root")
        if moved.filter("ahead is not null").isEmpty():
            return at


def variants(docs: DataFrame, ratio: int = RATIO, **kinds: int) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that ``counted`` gives.  A word's form is
    its most frequent near word (the smaller word of equals), if that is ``ratio`` times as frequent."""
    words = scratch.written(counted(docs, **kinds), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = near(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = _shuffled(words, found, "word", "left")
    has = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    found = found.select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n")
    )
    found = scratch.written(found, "forms")
    roots = _roots(found.filter("form is not null"))
    return _shuffled(found, roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
