"""Hidden Markov language model.

Symbols are the most frequent words, the text end and one class for all other words; a word of
that class is further coded by its smoothed share of the class.  Baum-Welch trains the latent
states: in each of ``rounds`` passes every task runs scaled forward-backward over its whole texts
and sends its expected counts, Spark sums them by symbol, and the driver normalizes the bounded
model.  Every pass covers every training text.  Scoring is the exact scaled forward recursion over
the whole text.

A text is worked on in segments of at most ``SEGMENT`` symbols.  The state probabilities before and
after each segment are exact: products of the segment's step matrices, taken for all segments side
by side, carry them over the borders.  So one very long text is no serial loop, and no step across a
border is lost.

Counts of the ``HEAD`` most frequent words are broadcast; every other word of a text, once per text,
is joined with the full count table.  Such words are rare by construction, so no key of that join is
hot.  A word of over ``LONGEST`` bytes (a separator line, an address) goes by a hash of 128 bits, so
that it is held and sent like any other.

Words and counts are bytes, so any text is scored.  Null and empty texts are the end alone.  With no
training text every count is 0.  Repeated and null ids keep their rows.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocatio.llm import scratch

HEAD = 400_000
LONGEST = 64
SYMBOLS = 16_384
SEGMENT = 1024
RESCALE = 8  # steps between two scalings of a product
ADD = 0.1
CHUNK = 1 << 20  # words that a task works on at once


def tokens(text: bytes | None) -> list[bytes]:
    found = (text or b"").lower().split()
    if found and len(max(found, key=len)) > LONGEST:
        return [w if len(w) <= LONGEST else b"\n" + blake2b(w, digest_size=16).digest() for w in found]  # no word has a \n
    return found


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                if len(held) > HEAD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Counts of the head words by rank, and totals; symbol 0 is the end, 1 the class of the rest."""

    words: list[bytes]
    counts: np.ndarray
    texts: int
    total: int
    distinct: int
    symbols: int

    def __post_init__(self):
        # the shares of the class of words that are no symbols
        named = int(self.counts[: self.symbols].sum())
        self.rest_total = self.total - self.texts - named
        self.rest_distinct = self.distinct - min(self.symbols, len(self.words)) - (self.texts > 0)
        self.base = np.log10(self.counts + ADD) - self.base_norm
        self.share = np.log10(self.counts + ADD) - self.rest_norm
        self.share[: self.symbols] = 0
        self.end = float(np.log10(self.texts + ADD) - self.base_norm)

    @property
    def base_norm(self) -> float:
        return float(np.log10(self.total + ADD * (self.distinct + 1)))

    @property
    def rest_norm(self) -> float:
        return float(np.log10(self.rest_total + ADD * (self.rest_distinct + 1)))

    def unigram(self) -> np.ndarray:
        """Smoothed probabilities of the symbols."""
        named = self.counts[: self.symbols]
        p = np.concatenate([[self.texts, self.rest_total], named]).astype(np.float64) + ADD
        return p / p.sum()


class _Ranks(dict):
    """Rank of a head word, -1 for any other."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))

    def __missing__(self, word: bytes) -> int:
        return -1


def lexicon(counts: DataFrame, texts: int, head: int = HEAD, symbols: int = SYMBOLS) -> Lexicon:
    """The ``head`` words first by count, then by bytes.  Words are first counted by the size class of
    their counts, so that only the class in which the head ends is ordered, and no task meets all
    words."""
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    sized = counts.withColumn("class", F.floor(16 * F.log2("n")).cast("int"))
    classes = sorted(sized.groupBy("class").count().collect(), key=lambda r: -r["class"])  # 16 an octave
    whole, last, room = [], None, head
    for c, n in classes:
        if n > room:
            last = c
            break
        whole.append(c)
        room -= n
    rows = []
    if whole:
        rows.append(sized.filter(F.col("class") >= whole[-1]).select("word", "n").toArrow())
    if last is not None and room:
        rows.append(sized.filter(F.col("class") == last).orderBy(F.desc("n"), "word").limit(room).select("word", "n").toArrow())
    words = [w for t in rows for w in t.column("word").to_pylist()]
    n = np.concatenate([np.zeros(0, np.int64), *(t.column("n").to_numpy() for t in rows)])
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    distinct = sums[1] + (texts > 0)
    return Lexicon([words[k] for k in order], n[order], texts, (sums[0] or 0) + texts, distinct, symbols)


ENCODED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, "
    "obs binary, tail array<binary>, tail_n array<long>"
)


def encoded(docs: DataFrame, lex: Broadcast) -> DataFrame:
    """``docs`` (doc_id, held_out, text) as symbols (``ENCODED``): sums over the head words, and the
    other words with their counts in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Lexicon = lex.value
        ranks = _Ranks(x.words)
        row = TaskContext.get().partitionId() << 33
        schema = pa.schema(
            [
                ("row", pa.int64()),
                ("doc_id", pa.int64()),
                ("held_out", pa.bool_()),
                ("n_tokens", pa.int64()),
                ("n_known", pa.int64()),
                ("base", pa.float64()),
                ("share", pa.float64()),
                ("obs", pa.binary()),
                ("tail", pa.list_(pa.binary())),
                ("tail_n", pa.list_(pa.int64())),
            ]
        )
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                out = []
                for doc_id, held_out, text in zip(*(c.to_pylist() for c in piece.columns)):
                    found = tokens(text)
                    rank = np.fromiter(map(ranks.__getitem__, found), np.int64, len(found))
                    head = rank[rank >= 0]
                    obs = np.zeros(len(found) + 1, "<u2")
                    obs[:-1] = np.where((rank >= 0) & (rank < x.symbols), rank + 2, 1)
                    tail = Counter(found[k] for k in np.flatnonzero(rank < 0))
                    sums = float(x.base[head].sum()) + x.end, float(x.share[head].sum())
                    known = len(head) + (x.texts > 0)
                    out.append((row, doc_id, held_out, len(obs), known, *sums, obs.tobytes(), [*tail], [*tail.values()]))
                    row += 1
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(run, ENCODED)


class Segments:
    """Texts (sequences of symbols) cut to segments of at most ``size`` symbols."""

    def __init__(self, texts: list[np.ndarray], size: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.flat = np.concatenate(texts).astype(np.int64)
        n = -(-lengths // size)
        self.text = np.repeat(np.arange(len(texts)), n)
        inside = np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)
        self.start = np.repeat(np.cumsum(lengths) - lengths, n) + inside * size
        self.size = np.minimum(size, np.repeat(lengths, n) - inside * size)
        self.opens = inside == 0
        self.closes = np.append(self.opens[1:], True)

    def blocks(self, some: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Segments ``some`` in blocks of about ``limit`` symbols, longest first, each with the number
        of its segments that are still running at every step."""
        some = some[np.argsort(-self.size[some], kind="stable")]
        at = 0
        while at < len(some):
            longest = int(self.size[some[at]])
            block = some[at : at + max(1, limit // longest)]
            yield block, np.searchsorted(-self.size[block], -np.arange(longest), side="left")
            at += len(block)


@dataclass
class Hmm:
    first: np.ndarray  # state probabilities at the start
    step: np.ndarray  # from row to column
    emit: np.ndarray  # symbol by state

    def _borders(self, s: Segments) -> tuple[np.ndarray, np.ndarray]:
        """Per segment, the state probabilities before it given all before, and the (scaled)
        likelihoods of all behind it by the state at its end."""
        k = len(self.first)
        before, behind = np.zeros((len(s.text), k)), np.ones((len(s.text), k))
        some = np.flatnonzero(~(s.opens & s.closes))
        product = np.zeros((len(s.text) if len(some) else 0, k, k))
        for block, live in s.blocks(some, CHUNK // 4):
            emitted = self.emit[s.flat[s.start[block]]]
            now = np.where(s.opens[block, None, None], np.eye(k), self.step) * emitted[:, None, :]
            for t in range(1, len(live)):
                m = live[t]
                ahead = (now[:m].reshape(-1, k) @ self.step).reshape(m, k, k)
                np.multiply(ahead, self.emit[s.flat[s.start[block[:m]] + t]][:, None, :], out=now[:m])
                if not t % RESCALE:
                    now[:m] /= now[:m].sum((1, 2), keepdims=True)
            product[block] = now / now.sum((1, 2), keepdims=True)
        for j in some:
            if not s.closes[j]:
                reached = (self.first if s.opens[j] else before[j]) @ product[j]
                before[j + 1] = reached / reached.sum()
        for j in some[::-1]:
            if not s.opens[j]:
                reached = product[j] @ behind[j]
                behind[j - 1] = reached / reached.sum()
        return before, behind

    def score(self, texts: list[np.ndarray], segment: int | None = None) -> np.ndarray:
        """Exact log10 likelihood of each sequence of symbols by the scaled forward recursion, all
        segments in step."""
        if not texts:
            return np.zeros(0)
        s = Segments(texts, segment or SEGMENT)
        before, _ = self._borders(s)
        logs = np.zeros(len(s.text))
        for block, live in s.blocks(np.arange(len(s.text)), CHUNK):
            now = np.where(s.opens[block, None], self.first, before[block] @ self.step)
            for t, m in enumerate(live):
                now = (now[:m] @ self.step if t else now) * self.emit[s.flat[s.start[block[:m]] + t]]
                scale = now.sum(1)
                now /= scale[:, None]
                logs[block[:m]] += np.log10(scale)
        return np.bincount(s.text, logs, len(texts))

    def expected(self, texts: list[np.ndarray], segment: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of first states, steps, and symbols by state (Baum-Welch)."""
        k, v = len(self.first), len(self.emit)
        firsts, steps, counts = np.zeros(k), np.zeros((k, k)), np.zeros((v, k))
        s = Segments(texts, segment or SEGMENT)
        before, behind = self._borders(s)
        step, emit = self.step.astype(np.float32), self.emit.astype(np.float32)
        for block, live in s.blocks(np.arange(len(s.text)), CHUNK // 2):
            n, longest, sizes, opens = len(block), len(live), s.size[block], s.opens[block]
            obs = np.zeros((longest, n), np.int64)
            for t, m in enumerate(live):
                obs[t, :m] = s.flat[s.start[block[:m]] + t]
            alpha = np.zeros((longest, n, k), np.float32)
            scale = np.ones((longest, n), np.float32)
            now = np.where(opens[:, None], self.first, before[block] @ self.step).astype(np.float32)
            for t, m in enumerate(live):
                now = (now[:m] @ step if t else now) * emit[obs[t, :m]]
                scale[t, :m] = now.sum(1)
                now /= scale[t, :m, None]
                alpha[t, :m] = now
            beta = behind[block].astype(np.float32)
            beta /= (alpha[sizes - 1, np.arange(n)] * beta).sum(1, keepdims=True)
            for t in range(longest - 1, -1, -1):
                m = live[t]
                if t + 1 < longest and live[t + 1]:
                    r = live[t + 1]
                    out = emit[obs[t + 1, :r]] * beta[:r] / scale[t + 1, :r, None]
                    steps += alpha[t, :r].T @ out
                    beta[:r] = out @ step.T
                alpha[t, :m] *= beta[:m]  # now the posterior of the states
            out = emit[obs[0]] * beta / scale[0][:, None]
            steps += before[block[~opens]].T @ out[~opens]
            used = np.arange(n)[None, :] < live[:, None]
            posterior, symbol = alpha[used], obs[used]
            counts += np.stack([np.bincount(symbol, posterior[:, j], v) for j in range(k)], 1)
            firsts += alpha[0][opens].sum(0, dtype=np.float64)
        return firsts, steps * self.step, counts


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list]:
    """Rows of the batches in lists of about ``limit`` symbols."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append((*row[:-1], np.frombuffer(row[-1], "<u2")))
            size += len(held[-1][-1])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def re_estimated(model: Hmm, unigram: np.ndarray, firsts: np.ndarray, steps: np.ndarray, counts: np.ndarray) -> Hmm:
    """The model from expected counts; every state keeps a small share of the unigram."""
    share = 5.0 + 0.002 * counts.sum(0)
    emit = counts + unigram[:, None] * share[None, :]
    firsts, steps = firsts + 1.0, steps + 1.0
    return Hmm(firsts / firsts.sum(), steps / steps.sum(1, keepdims=True), emit / emit.sum(0))


def _sum_counts(obs: DataFrame, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all rows of ``obs``, one row per symbol and task to the shuffle and one
    per symbol (a bounded number) to the driver."""
    shared = obs.sparkSession.sparkContext.broadcast(model)
    k, v = len(model.first), len(model.emit)
    names = [f"c{s}" for s in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((v + k + 1, k))
        for group in _groups(batches, CHUNK):
            firsts, steps, counts = shared.value.expected([g[0] for g in group])
            total[:v] += counts
            total[v : v + k] += steps
            total[v + k] += firsts
        some = np.flatnonzero(total.any(1))
        columns = [pa.array(some), *(pa.array(total[some, s]) for s in range(k))]
        yield pa.RecordBatch.from_arrays(columns, names=["symbol", *names])

    rows = obs.mapInArrow(run, "symbol long, " + ", ".join(f"{c} double" for c in names))
    got = rows.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    total = np.zeros((v + k + 1, k))
    if got.num_rows:
        total[got.column("symbol").to_numpy()] = np.stack([got.column(c).to_numpy() for c in names], 1)
    shared.destroy()
    return total[v + k], total[v : v + k], total[:v]


def first_guess(unigram: np.ndarray, states: int, stay: float = 0.95, seed: int = 7) -> Hmm:
    """Random emissions around the unigram, and states that mostly stay: texts then draw the states
    apart within a few passes, where free steps would need dozens."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * (rng.exponential(1.0, (len(unigram), states)) + 0.05)
    step = np.full((states, states), (1.0 - stay) / states) + stay * np.eye(states)
    return Hmm(np.full(states, 1.0 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def train(obs: DataFrame, lex: Lexicon, states: int = 8, rounds: int = 4) -> Hmm:
    """Baum-Welch over all rows of ``obs`` (obs), ``rounds`` times."""
    unigram = lex.unigram()
    model = first_guess(unigram, states)
    for _ in range(rounds if lex.total else 0):
        model = re_estimated(model, unigram, *_sum_counts(obs, model))
    return model


def scored(docs: DataFrame, states: int = 8, rounds: int = 4) -> DataFrame:
    """Every row of ``docs`` (doc_id, held_out, text), the model learned from those not held out:
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    learned = docs.filter("NOT held_out").select("text")
    counts = scratch.written(word_counts(learned), "word-counts")
    lex = lexicon(counts, learned.count())
    shared = spark.sparkContext.broadcast(lex)
    rows = scratch.written(encoded(docs, shared), "symbols")
    model = spark.sparkContext.broadcast(train(rows.filter("NOT held_out").select("obs"), lex, states, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 4 * CHUNK):
            score = model.value.score([g[1] for g in group])
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in group]), pa.array(score)], names=["row", "forward"])

    forward = rows.select("row", "obs").mapInArrow(run, "row long, forward double")
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t"))
    tail = tail.select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("times"))
    met = tail.join(counts, "word", "left")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))
    met = met.groupBy("row").agg(
        F.sum(log).alias("log"), F.sum("times").alias("times"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("known")
    )
    sums = rows.drop("obs", "tail", "tail_n").join(forward, "row").join(met, "row", "left")
    log, times = F.coalesce("log", F.lit(0.0)), F.coalesce("times", F.lit(0))
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + log - times * lex.base_norm).alias("base_score"),
        (F.col("forward") + F.col("share") + log - times * lex.rest_norm).alias("score"),
    )
