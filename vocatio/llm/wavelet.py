"""Token-id output: one wavelet matrix per shard.

Documents are range-partitioned by id and sorted; each task cuts its range into shards of about
``shard_tokens`` ids and stores every shard as one compressed file: the bit planes of the ids
(most significant first, zeros before ones after every plane), running counts of ones for
rank/select, and the shard's document table.  Access, counting and occurrence lookup work on that
one file.  A shard is the unit of memory; a single longer document makes a longer shard.

Null text counts as empty (the end id only).  Null ids sort first.  Repeated ids stay separate
documents, ordered by the text's hash, and are split over tasks like any others.  An empty table
makes no shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocatio.llm.tokens import encoder, slices

BLOCK = 512  # bits between two stored counts of ones
BROADCAST_SHARDS = 500_000
SHARD_SCHEMA = (
    "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, "
    "zeros array<long>, planes binary, ones binary"
)


class WaveletMatrix:
    """Succinct sequence of non-negative integers."""

    def __init__(self, n: int, zeros: list[int], planes: np.ndarray, ones: np.ndarray):
        self.n, self.zeros, self.planes, self.ones = n, zeros, planes, ones

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        planes = np.zeros((bits, -(-n // BLOCK) * BLOCK // 8), np.uint8)
        zeros, now = [], ids
        for level in range(bits):
            on = now & ids.dtype.type(1 << (bits - 1 - level)) != 0
            packed = np.packbits(on)
            planes[level, : len(packed)] = packed
            off = now[~on]
            zeros.append(len(off))
            now = np.concatenate([off, now[on]])
        ones = np.zeros((bits, planes.shape[1] * 8 // BLOCK + 1), np.uint32)
        if n:
            counts = np.bitwise_count(planes).reshape(bits, -1, BLOCK // 8).sum(2, dtype=np.uint32)
            np.cumsum(counts, axis=1, out=ones[:, 1:])
        return cls(n, zeros, planes, ones)

    @classmethod
    def of(cls, n: int, zeros: list[int], planes: bytes, ones: bytes) -> "WaveletMatrix":
        """From the stored columns."""
        bits = len(zeros)
        return cls(
            n,
            list(zeros),
            np.frombuffer(planes, np.uint8).reshape(bits, -1),
            np.frombuffer(ones, "<u4").reshape(bits, -1),
        )

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i >> 3]) >> (7 - (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        block = i // BLOCK
        row, at = self.planes[level], block * BLOCK // 8
        count = int(self.ones[level, block]) + int(np.bitwise_count(row[at : i >> 3]).sum(dtype=np.int64))
        return count + (int(row[i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else count

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) such bit of a plane."""
        before = self.ones[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        at = block * BLOCK // 8
        here = np.unpackbits(self.planes[level, at : at + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(here == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, one = self._bit(level, i), self._rank1(level, i)
            value, i = value << 1 | bit, zeros + one if bit else i - one
        return value

    def _interval(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        if token >> len(self.zeros):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (len(self.zeros) - 1 - level) & 1:
                lo, hi = zeros + a, zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before position ``i``."""
        lo, hi = self._interval(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence; -1 if there are fewer."""
        lo, hi = self._interval(token, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, undoing the planes from the last to the first."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(len(self.zeros) - 1, -1, -1):
            on = np.unpackbits(self.planes[level], count=self.n).view(bool)
            back, z = np.empty_like(now), self.zeros[level]
            back[~on] = now[:z]
            back[on] = now[z:] | kind(1 << (len(self.zeros) - 1 - level))
            now = back
        return now


def shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = 1 << 21) -> DataFrame:
    """One row per shard (``SHARD_SCHEMA``); (part, seq) order is document order."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, True)
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        waiting: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []  # doc_ids, sizes, ids

        def shard() -> pa.RecordBatch:
            w = WaveletMatrix.build(np.concatenate([x[2] for x in waiting]))
            columns = [
                pa.array([part], pa.int32()),
                pa.array([seq], pa.int32()),
                pa.array([w.n], pa.int64()),
                pa.array([[i for x in waiting for i in x[0]]], pa.list_(pa.int64())),
                pa.array([np.concatenate([x[1] for x in waiting])], pa.list_(pa.int64())),
                pa.array([w.zeros], pa.list_(pa.int64())),
                pa.array([w.planes.tobytes()], pa.binary()),
                pa.array([w.ones.astype("<u4").tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SHARD_SCHEMA.split(", ")])

        for batch in batches:
            for piece in slices(batch, 1):
                doc_ids = piece.column(0).to_pylist()
                ids, sizes = enc.encode(piece.column(1), end_id)
                ends = np.cumsum(sizes)
                at = done = 0
                while at < len(sizes):
                    # up to the document that fills the shard
                    to = min(len(sizes), int(np.searchsorted(ends, done + shard_tokens - held)) + 1)
                    waiting.append((doc_ids[at:to], sizes[at:to], ids[done : ends[to - 1]]))
                    held += int(ends[to - 1]) - done
                    at, done = to, int(ends[to - 1])
                    if held >= shard_tokens:
                        yield shard()
                        seq, held = seq + 1, 0
                        waiting.clear()
        if waiting:
            yield shard()

    order = ["doc_id", "tie", "nth"]  # copies of a row differ in its place in the input alone
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("nth"),
    )
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "text").mapInArrow(build, SHARD_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = 1 << 21) -> None:
    """Write ``docs`` as token shards under ``path``, each shard in a file of its own."""
    out = shards(docs, tokenizer, end_id, shard_tokens).write.option("maxRecordsPerFile", 1)
    out.option("compression", "zstd").parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The stored shards with the number of ids before each.  Totals are first summed within a
    part; only one row per part (at most the shuffle partitions of the writer) meets in a task.
    Two numbers a shard are broadcast, or joined where there are more than ``BROADCAST_SHARDS``."""
    table = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = table.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    parts = parts.select("part", before.alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq")
    starts = (
        sizes.withColumn("in_part", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
        .join(parts, "part")
        .select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("shard_start"))
    )
    few = sizes.count() <= BROADCAST_SHARDS
    return table.join(F.broadcast(starts) if few else starts, ["part", "seq"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document decoded from the files: doc_id, start (ids of all documents before it),
    n_tokens and ids (binary, little-endian unsigned 32-bit)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                w = WaveletMatrix.of(row["n_tokens"], row["zeros"], row["planes"], row["ones"])
                ids = w.decode().astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(row["lengths"])])
                for at in range(0, len(row["doc_ids"]), 4096):
                    to = min(at + 4096, len(row["doc_ids"]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row["doc_ids"][at:to], pa.int64()),
                            pa.array(row["shard_start"] + cuts[at:to], pa.int64()),
                            pa.array(row["lengths"][at:to], pa.int64()),
                            pa.array([ids[cuts[k] : cuts[k + 1]].tobytes() for k in range(at, to)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return _placed(spark, path).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of ``token`` per shard, by rank on the stored planes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            n = [WaveletMatrix.of(r["n_tokens"], r["zeros"], r["planes"], r["ones"]).count(token) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["part"] for r in rows], pa.int32()),
                    pa.array([r["seq"] for r in rows], pa.int32()),
                    pa.array(n, pa.int64()),
                ],
                names=["part", "seq", "occurrences"],
            )

    return spark.read.schema(SHARD_SCHEMA).parquet(path).mapInArrow(count, "part int, seq int, occurrences long")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Positions (in the whole token sequence) of ``token``, by select on the stored planes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                w = WaveletMatrix.of(r["n_tokens"], r["zeros"], r["planes"], r["ones"])
                at = [r["shard_start"] + w.select(token, k) for k in range(w.count(token))]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], names=["position"])

    return _placed(spark, path).mapInArrow(find, "position long")


