"""Language identification by prediction by partial matching.

Each language has a context tree over bytes of depth ``ORDER``; a byte is coded in its longest
known context, escaping to shorter ones with probability d / (n + d) (d different bytes seen there
in n) down to 8 bits a byte.  The code length of the whole text under the frozen statistics decides.

Counts cover every training text: tasks count 4-byte strings, Spark sums them by language.  A node
stays in the tree if it has at least ``RATE`` of its language's bytes, which bounds a tree by
1 / RATE nodes an order whatever the corpus; only such a model is collected and broadcast.

Null text, and text without a letter, is ``und`` with score 0; so is every text if nothing was
learned.  Ties go to the language first by code point.  Texts with null lang teach nothing.
Repeated and null ids keep their rows.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocatio.llm import scratch

ORDER = 3
RATE = 2e-6
PAD = b" " * ORDER
CHUNK = 1 << 20


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte strings that end at each byte of the texts (padded in front), as unsigned ints,
    and the start of each text in them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(x for t in texts for x in (PAD, t)), np.uint8).astype(np.uint32)
    code = data[3:] | data[2:-1] << np.uint32(8) | data[1:-2] << np.uint32(16) | data[:-3] << np.uint32(24)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.ones(len(code), bool)
    for k in range(ORDER):  # what ends in the padding of a later text
        at = starts[1:-1] + ORDER * np.arange(len(sizes) - 1) + k
        inside[at[at < len(code)]] = False
    return code[inside], starts


def count(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                code, n = np.unique(grams(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"],
                )

    some = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    rows = some.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Code lengths in bits of every retained string, for all languages side by side."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``tables``: for each order, language index, string and count."""
        self.langs = langs
        below_keys, below = np.arange(256, dtype=np.int64), np.full((256, len(langs)), 8.0)
        self.keys, self.cost, self.contexts, self.escape = [], [], [], []
        for order, (lang, gram, n) in enumerate(tables):
            keys = np.unique(gram) if order else np.arange(256, dtype=np.int64)
            seen = np.zeros((len(keys), len(langs)))
            seen[np.searchsorted(keys, gram), lang] = n
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total = np.zeros((len(contexts), len(langs)))
            distinct = np.zeros_like(total)
            np.add.at(total, of, seen)
            np.add.at(distinct, of, seen > 0)
            known = distinct > 0
            escape = np.where(known, np.log2(np.where(known, total + distinct, 1) / np.where(known, distinct, 1)), 0.0)
            shorter = below[np.searchsorted(below_keys, keys & ((1 << 8 * max(order, 1)) - 1))]
            coded = np.log2(np.where(seen > 0, (total + distinct)[of], 1) / np.where(seen > 0, seen, 1))
            cost = np.where(seen > 0, coded, escape[of] + shorter)
            self.keys.append(keys)
            self.cost.append(cost)
            self.contexts.append(contexts)
            self.escape.append(escape)
            below_keys, below = keys, cost
        self._index()

    def _index(self) -> None:
        """A table from the two halves of a 4-byte string to its row, where it is not too large."""
        keys = self.keys[ORDER]
        self.halves = None
        high, low = np.unique(keys >> 16), np.unique(keys & 0xFFFF)
        if len(high) * len(low) <= 1 << 25:
            at_high, at_low = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
            at_high[high], at_low[low] = np.arange(1, len(high) + 1), np.arange(1, len(low) + 1)
            table = np.full((len(high) + 1) * (len(low) + 1), -1, np.int32)
            width = len(low) + 1
            table[at_high[keys >> 16] * width + at_low[keys & 0xFFFF]] = np.arange(len(keys))
            self.halves = at_high * np.int32(width), at_low, table

    def __getstate__(self) -> dict:
        return self.__dict__ | {"halves": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._index()

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Row of each wanted key, -1 if there is none."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def _longest(self, code: np.ndarray) -> np.ndarray:
        if self.halves is None:
            return self._find(self.keys[ORDER], code.astype(np.int64))
        high, low, table = self.halves
        return table[high[code >> np.uint32(16)] + low[code & np.uint32(0xFFFF)]]

    def _shorter(self, code: np.ndarray, order: int) -> np.ndarray:
        """Bits of strings that the tables of higher orders lack."""
        at = self._find(self.keys[order], code)
        bits = self.cost[order][np.maximum(at, 0)] if len(self.keys[order]) else np.zeros((len(code), len(self.langs)))
        if len(lacking := np.flatnonzero(at < 0)):
            bits[lacking] = self._escaped(code[lacking], order)
        return bits

    def _escaped(self, code: np.ndarray, order: int) -> np.ndarray:
        at = self._find(self.contexts[order], code >> 8)
        esc = self.escape[order][np.maximum(at, 0)] * (at >= 0)[:, None] if len(self.contexts[order]) else 0.0
        return esc + self._shorter(code & ((1 << 8 * order) - 1), order - 1)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        code, starts = grams(texts)
        for at in range(0, len(code), CHUNK):
            part = code[at : at + CHUNK]
            row = self._longest(part)
            cost = self.cost[ORDER][np.maximum(row, 0)] if len(self.keys[ORDER]) else np.zeros((len(part), len(self.langs)))
            if len(lacking := np.flatnonzero(row < 0)):
                cost[lacking] = self._escaped(part[lacking].astype(np.int64), ORDER)
            first = np.searchsorted(starts, at, side="right") - 1
            last = np.searchsorted(starts, at + len(part), side="left")
            cuts = np.maximum(starts[first:last], at) - at
            filled = np.flatnonzero(np.diff(np.append(cuts, len(part))) > 0)
            out[first + filled] += np.add.reduceat(cost, cuts[filled], axis=0)
        return out


def train(docs: DataFrame, rate: float = RATE) -> Model:
    """Context trees from all ``docs`` (lang, text)."""
    counts = scratch.written(count(docs), "ppm-counts")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # a row per language
    langs, tables = sorted(r["lang"] for r in total.select("lang").toLocalIterator()), []
    total = F.broadcast(total)
    for order in range(ORDER + 1):
        gram = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("gram")
        some = counts.groupBy("lang", gram).agg(F.sum("n").alias("n")).join(total, "lang")
        got = some.filter(F.col("n") >= rate * F.col("total")).select("lang", "gram", "n").toArrow()
        names = got.column("lang").combine_chunks().dictionary_encode()
        of = {lang: k for k, lang in enumerate(langs)}
        at = np.array([of[x] for x in names.dictionary.to_pylist()], np.int64)
        index = names.indices.to_numpy() if len(names) else np.zeros(0, np.int64)
        tables.append((at[index], got.column("gram").to_numpy(), got.column("n").to_numpy()))
    return Model(langs, tables)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score: the share of the best language if all are likely before the
    text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                n = piece.num_rows
                lang, score = ["und"] * n, np.zeros(n)
                bits = m.bits([t or b"" for t in piece.column(1).to_pylist()]) if m.langs else None
                for k, letter in enumerate(piece.column(2).to_pylist()):
                    if letter and m.langs:
                        best = int(bits[k].argmin())
                        lang[k] = m.langs[best]
                        score[k] = 1 / np.exp2(np.maximum(bits[k][best] - bits[k], -1000)).sum()
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
                )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), letter)
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")
