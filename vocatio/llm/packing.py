"""Lexical retrieval packing.

Every document becomes token ids.  Documents are dealt to shards of at most about ``shard_tokens``
ids by their rarest shared term (the rarest one that another document has too), so that near copies
and texts on one subject meet at every input size; each shard holds a BM25 inverted index of its documents with document
frequencies and average length of the whole corpus.  A window starts at a seed document; the
index returns the seed's unused neighbours by score and they fill the window greedily.  A
document that overruns the window is cut there and its rest opens the next window as its seed.
When no neighbour is left, unused documents follow in document order, so that only the last
window of a shard is short.

A shard is the unit of memory and work.  Terms of few ids share a shard with their neighbours by
rarity; a term of more than a shard is divided by the documents' second rarest term, and what is
still more (a hot group of copies) by hash.  A seed asks its own shard only.
Null text counts as empty (the end id alone).  Repeated and null ids are packed as documents of
their own.  An empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocatio.llm import scratch
from vocatio.llm.tokens import encoder, slices

PIECE_SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (packed in the encoder's width), the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keeps_space)
        for batch in batches:
            for piece in slices(batch, 1):
                ids, sizes = enc.encode(piece.column(1), end_id)
                cuts = np.concatenate([[0], np.cumsum(sizes) * enc.dtype.itemsize])
                binary = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts.astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(sizes, pa.int64()), binary.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"]
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def term_statistics(tokens: DataFrame, dtype: str, vocab: int) -> tuple[np.ndarray, int, int]:
    """Document frequency of every token id, documents and ids of the corpus.  Tasks send sums of
    their own; at most ``vocab`` rows, the size of the vocabulary, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocab + 2, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = [np.frombuffer(r, dtype) for r in batch.column(0).slice(at, 1024).to_pylist()]
                for ids in rows:
                    df[ids] += 1  # once an id, however often it is there
                df[vocab] += len(rows)
                df[vocab + 1] += sum(map(len, rows))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "n"])

    rows = tokens.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    df = np.zeros(vocab + 2, np.int64)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return df[:vocab], int(df[vocab]), int(df[vocab + 1])


def rarest_terms(rank: np.ndarray, rows: list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The least and the next ``rank`` of each row's ids, len(rank) for none."""
    ids = np.frombuffer(b"".join(rows), dtype)
    sizes = np.array([len(r) for r in rows]) // ids.itemsize
    own, cuts = rank[ids], np.cumsum(sizes) - sizes
    first = np.minimum.reduceat(own, cuts)
    second = np.minimum.reduceat(np.where(own == np.repeat(first, sizes), len(rank), own), cuts)
    return first, second


class Deal:
    """Which shard a document goes to, by its rarest terms' ranks and a hash of its row."""

    def __init__(self, tokens: DataFrame, dtype: str, df: np.ndarray, shard_tokens: int):
        shared = np.flatnonzero(df > 1)
        rank = np.full(len(df), len(df), np.int64)
        rank[shared[np.argsort(df[shared], kind="stable")]] = np.arange(len(shared))
        self.rank = rank

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    piece = batch.slice(at, 1024)
                    first, second = rarest_terms(rank, piece.column(0).to_pylist(), dtype)
                    columns = [pa.array(first), pa.array(second), piece.column(1)]
                    yield pa.RecordBatch.from_arrays(columns, names=["first", "second", "n"])

        found = tokens.select("ids", F.col("n_tokens").alias("n")).mapInArrow(run, "first long, second long, n long")
        found = scratch.written(found, "shard-keys")
        n = np.zeros(len(df) + 1, np.int64)
        got = found.groupBy("first").agg(F.sum("n").alias("n")).toArrow()
        n[got.column("first").to_numpy()] = got.column("n").to_numpy()
        # buckets: one a term, several for a hot one
        self.parts = np.where(n > shard_tokens, 4 * -(-n // shard_tokens), 1)
        self.base = np.cumsum(self.parts) - self.parts
        size = np.zeros(self.parts.sum(), np.int64)
        size[self.base] = n
        hot = np.flatnonzero(self.parts > 1).tolist()  # fewer than shards
        if hot:
            spark = tokens.sparkSession
            known = spark.createDataFrame([(t, int(self.parts[t])) for t in hot], "first long, parts long")
            part = F.pmod(F.col("second") * 40503, F.col("parts")).alias("part")
            sums = found.join(F.broadcast(known), "first").groupBy("first", part).agg(F.sum("n").alias("n")).toArrow()
            size[self.base[hot]] = 0
            size[self.base[sums.column("first").to_numpy()] + sums.column("part").to_numpy()] = sums.column("n").to_numpy()
        self.salts = np.maximum(1, -(-size // shard_tokens))
        self.start = np.zeros(len(size), np.int64)
        shard, filled = 0, 0
        for b in np.flatnonzero(size).tolist():
            if filled and filled + size[b] > shard_tokens:
                shard, filled = shard + 1, 0
            self.start[b] = shard
            if self.salts[b] > 1:
                shard, filled = shard + int(self.salts[b]), 0
            else:
                filled += int(size[b])

    def shard(self, first: np.ndarray, second: np.ndarray, salt: np.ndarray) -> np.ndarray:
        bucket = self.base[first] + second * 40503 % self.parts[first]
        return self.start[bucket] + salt % self.salts[bucket]


class Bm25Index:
    """Inverted index over the documents of one shard."""

    def __init__(self, ids: np.ndarray, cuts: np.ndarray, idf: np.ndarray, mean: float, k1: float, b: float):
        n, vocab = len(cuts) - 1, len(idf)
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(cuts))
        key, tf = np.unique(doc * vocab + ids, return_counts=True)
        self.doc_terms, owner = key % vocab, key // vocab
        self.doc_cuts = np.searchsorted(owner, np.arange(n + 1))
        length = np.diff(cuts)[owner]
        weight = idf[self.doc_terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        order = np.argsort(self.doc_terms, kind="stable")
        self.post_docs, self.post_weights = owner[order], weight[order]
        self.post_cuts = np.searchsorted(self.doc_terms[order], np.arange(vocab + 1))
        self.idf, self.n = idf, n
        # terms in over an eighth of the documents hold most postings; as rows of all documents (eight
        # times their postings at most) they are added without going through the postings
        common = np.flatnonzero(np.diff(self.post_cuts) * 8 > n)
        self.row = np.full(vocab, -1)
        self.row[common] = np.arange(len(common))
        self.weights = np.zeros((len(common), n))
        at = self.row[self.doc_terms] >= 0
        self.weights[self.row[self.doc_terms[at]], owner[at]] = weight[at]

    def neighbours(self, seed: int, unused: np.ndarray, query_terms: int | None = None) -> np.ndarray:
        """Unused documents that share one of the seed's terms (or of its ``query_terms`` rarest
        ones), best first."""
        terms = self.doc_terms[self.doc_cuts[seed] : self.doc_cuts[seed + 1]]
        if query_terms is not None and len(terms) > query_terms:
            terms = terms[np.argsort(-self.idf[terms], kind="stable")[:query_terms]]
        rows = self.row[terms]
        rest = terms[rows < 0]
        score = np.zeros(self.n)
        if len(rest):
            spans = [slice(*span) for span in zip(self.post_cuts[rest].tolist(), self.post_cuts[rest + 1].tolist())]
            docs = np.concatenate([self.post_docs[s] for s in spans])
            weights = np.concatenate([self.post_weights[s] for s in spans])
            score = np.bincount(docs, weights, self.n)
        for row in rows[rows >= 0].tolist():
            score += self.weights[row]
        score[~unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(lengths: np.ndarray, neighbours, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard.  ``neighbours(seed,
    unused)`` ranks unused documents."""
    n = len(lengths)
    unused = np.ones(n, bool)
    pieces, carry, following, sequence = [], None, 0, 0
    while True:
        at = 0

        def place(doc: int, start: int) -> tuple[int, int] | None:
            nonlocal at
            take = min(int(lengths[doc]) - start, window - at)
            pieces.append((doc, start, take, sequence, at))
            unused[doc] = False
            at += take
            return (doc, start + take) if start + take < lengths[doc] else None

        if carry is None:
            while following < n and not unused[following]:
                following += 1
            if following == n:
                return pieces
            carry = (following, 0)
        seed = carry[0]
        carry = place(*carry)
        if at < window:
            for doc in neighbours(seed, unused):
                carry = place(int(doc), 0)
                if at == window:
                    break
        while at < window:
            while following < n and not unused[following]:
                following += 1
            if following == n:
                break
            carry = place(following, 0)
        sequence += 1


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 4096,
    end_id: int = 2,
    shard_tokens: int = 1 << 21,
    query_terms: int | None = None,
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """Pieces of all documents (``PIECE_SCHEMA``): the ids [start, start + length) of doc_id stand
    at ``offset`` of sequence_id; ``ids`` holds them, little-endian unsigned 32-bit."""
    enc = encoder(tokenizer, False)
    vocab, dtype = max(enc.tokenizer.get_vocab_size(), end_id + 1), enc.dtype.str
    tokens = scratch.written(tokenized(docs, tokenizer, end_id), "tokens")
    df, n_docs, n_tokens = term_statistics(tokens, dtype, vocab)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = n_tokens / max(1, n_docs)
    deal = docs.sparkSession.sparkContext.broadcast(Deal(tokens, dtype, df, shard_tokens))  # numbers per vocabulary entry and shard
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # one number per vocabulary entry

    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        rows = sorted(
            zip(group.column("doc_id").to_pylist(), group.column("ids").to_pylist()),
            key=lambda r: (r[0] is not None, r[0] or 0, r[1]),
        )
        ids = np.frombuffer(b"".join(r[1] for r in rows), dtype)
        lengths = np.array([len(r[1]) for r in rows], np.int64) // ids.itemsize
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        index = Bm25Index(ids, cuts, shared.value, mean, k1, b)
        pieces = pack_shard(lengths, lambda seed, free: index.neighbours(seed, free, query_terms), window)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
        wide = ids.astype("<u4")
        first = cuts[doc] + start
        return pa.table(
            {
                "doc_id": pa.array([rows[d][0] for d in doc], pa.int64()),
                "start": start,
                "length": length,
                "doc_tokens": lengths[doc],
                "sequence_id": (shard << 32) + sequence,
                "offset": offset,
                "ids": pa.array([wide[i : i + k].tobytes() for i, k in zip(first, length)], pa.binary()),
            }
        )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                first, second = rarest_terms(deal.value.rank, piece.column(2).to_pylist(), dtype)
                shards = deal.value.shard(first, second, piece.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(shards), *piece.columns[1:]], names=["shard", "doc_id", "ids"])

    salt = F.xxhash64("doc_id", F.crc32("ids")).alias("salt")
    placed = tokens.select(salt, "doc_id", "ids").mapInArrow(dealt, "shard long, doc_id long, ids binary")
    return placed.groupBy("shard").applyInArrow(run, PIECE_SCHEMA)
