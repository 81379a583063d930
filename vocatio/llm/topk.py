"""Exact top-k inner products by norm-bucketed retrieval.

Components become floor(scale * x).  Candidates are range-partitioned by length and cut into
buckets of similar length; queries are gathered in blocks.  A first pass over the bucket of the
longest vectors gives each query a lower bound on its k-th score.  A pair of block and bucket is
formed only if some query can still reach its bound there.  In such a pair each query's local
cosine threshold, bound / (query length * longest in the bucket), chooses how to prune: from
``COORDINATE_FROM`` on by the feasible interval of its largest coordinates, below that by vector
length alone.  What survives is verified by the exact product.

Vectors that are null or hold a null or non-finite component take no part, and neither do rows with
a null id.  Queries and candidates meet only at equal dimension.  Candidates with the query's own
id are left out; repeated query rows each get their result.  Ties go to the smaller id.  Scores
beyond a long saturate.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio.llm import scratch

BUCKET, BLOCK = 4096, 256
COORDINATE_FROM = 0.6
FOCUS = 4
SLACK = 1e-9
#: Rows that are broadcast at most: first buckets (one a dimension), and partitions of buckets.
BROADCAST_FIRST, BROADCAST_PARTS = 8, 500_000
ROWS = "id long, dim int, n int, longest double, ids binary, vectors binary"
LONG = float(np.iinfo(np.int64).max)


def usable(vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, number), F.lit(False))


def _gathered(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Rows of ``size`` vectors of one dimension (``ROWS``), in the order of the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal number
            rows = held.pop(dim)
            v = np.floor(np.array([r[1] for r in rows], np.float64).reshape(len(rows), dim) * scale)
            norm = np.sqrt((v * v).sum(1))
            order = np.argsort(-norm, kind="stable")
            ids = np.array([r[0] for r in rows], "<i8")[order]
            number += 1
            values = [number, dim, len(rows), float(norm.max()), ids.tobytes(), v[order].tobytes()]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(values, types)], names=[c.split()[0] for c in ROWS.split(", ")]
            )

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(len(row[1]), []).append(row)
                if len(held[len(row[1])]) >= size:
                    yield out(len(row[1]))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, ROWS)


def _few(table: DataFrame, most: int) -> DataFrame:
    """``table``, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(table) if table.count() <= most else table


def _matrix(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Stored ids and the vectors that belong to them (of no component, where ``dim`` is 0)."""
    known = np.frombuffer(ids, "<i8")
    return known, np.frombuffer(vectors).reshape(len(known), dim)


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products (float64 where sums stay below 2^53, Python's integers elsewhere)."""
    top = np.sqrt((queries**2).sum(1).max(initial=0) * (vectors**2).sum(1).max(initial=0))
    if top < 1 << 52:
        return (queries @ vectors.T).astype(np.int64)
    wide = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(wide(queries) @ wide(vectors).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, own: int, k: int, least: float) -> list[int]:
    at = np.flatnonzero((ids != own) & (score >= least))
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -score[at]))[:k]].tolist()


def survivors(query: np.ndarray, vectors: np.ndarray, norms: np.ndarray, bound: float) -> np.ndarray:
    """Positions of a bucket (longest first) that can reach ``bound`` with ``query``."""
    length = float(np.sqrt((query**2).sum()))
    if bound <= 0 or not length or not len(norms):
        return np.arange(len(norms))
    near = bound * (1 - SLACK)
    local = near / (length * norms[0]) if norms[0] else 2.0
    if local > 1:
        return np.zeros(0, np.int64)
    at = np.arange(np.searchsorted(-norms, -near / length, side="right"))
    if local < COORDINATE_FROM:
        return at
    unit = query / length
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        angle, reach = np.arccos(np.clip(unit[f], -1, 1)), np.arccos(local)
        low = np.cos(min(np.pi, angle + reach)) - SLACK
        high = np.cos(max(0.0, angle - reach)) + SLACK
        x = vectors[at, f] / norms[at]
        at = at[(x >= low) & (x <= high)]
    return at


def top_k(table: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id and score of ``table`` (vec_id, embedding); queries are the rows whose
    vec_id is divisible by ``every``."""
    vector = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    by_length = rows.withColumn("length", length).repartitionByRange(F.desc("length")).sortWithinPartitions(F.desc("length"))
    buckets = scratch.written(_gathered(by_length.select("vec_id", "v"), BUCKET, scale), "buckets")
    asked = rows.filter(F.col("vec_id") % every == 0).repartition(F.xxhash64("vec_id"))
    blocks = scratch.written(_gathered(asked, BLOCK, scale), "blocks")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q = _matrix(r["q_ids"], r["q"], r["dim"])
                ids, v = _matrix(r["ids"], r["v"], r["dim"])
                score = _exact(q, v)
                found = [_best(s, ids, own, k, -np.inf) for s, own in zip(score, q_ids)]
                bound = np.array([s[f[-1]] if len(f) == k else -LONG for s, f in zip(score, found)], np.float64)
                size = np.sqrt((q**2).sum(1))
                needed = np.where((bound > 0) & (size > 0), bound * (1 - SLACK) / np.where(size > 0, size, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["block"]], pa.int64()),
                        pa.array([r["dim"]], pa.int32()),
                        pa.array([float(needed.min())]),
                        pa.array([bound.tobytes()], pa.binary()),
                    ],
                    names=["block", "dim", "needed", "bounds"],
                )

    longest = buckets.groupBy("dim").agg(F.max_by("id", "longest").alias("id"))  # one bucket per dimension
    first = buckets.join(longest.select("id"), "id", "left_semi").select("dim", "ids", F.col("vectors").alias("v"))
    q = blocks.select(F.col("id").alias("block"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))
    bounded = scratch.written(
        q.join(_few(first, BROADCAST_FIRST), "dim").mapInArrow(bounds, "block long, dim int, needed double, bounds binary"), "bounds"
    )
    # buckets were cut in order of length: a block asks the partitions that reach its bound, and meets
    # their buckets by the partition, so that the dimension alone is the key of no shuffle
    part = F.shiftright("id", 32).alias("part")
    reach = buckets.groupBy(part, "dim").agg(F.max("longest").alias("reach"))
    pairs = bounded.select("block", "dim", "needed").join(_few(reach, BROADCAST_PARTS), "dim").filter("reach >= needed")
    pairs = pairs.join(buckets.select("id", "dim", "longest", part), ["part", "dim"])
    pairs = pairs.filter("longest >= needed").select("block", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q = _matrix(r["q_ids"], r["q"], r["dim"])
                ids, v = _matrix(r["ids"], r["v"], r["dim"])
                bound = np.frombuffer(r["bounds"])
                norms = np.sqrt((v**2).sum(1))
                kept = [survivors(x, v, norms, b) for x, b in zip(q, bound)]
                whole = np.array([2 * len(at) > len(v) for at in kept], bool)
                together = _exact(q[whole], v) if whole.any() else None
                place, out = np.cumsum(whole) - 1, []
                for n, at in enumerate(kept):
                    score = together[place[n]][at] if whole[n] else _exact(q[n : n + 1], v[at])[0]
                    own = int(q_ids[n])
                    for m in _best(score, ids[at], own, k, bound[n]):
                        out.append((r["block"] * BLOCK + n, own, int(ids[at][m]), int(score[m])))
                columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [], []))]
                yield pa.RecordBatch.from_arrays(columns, names=["asked", "query_id", "vec_id", "score"])

    met = pairs.join(q.join(bounded.select("block", "bounds"), "block"), "block")
    met = met.join(buckets.select("id", "ids", F.col("vectors").alias("v")), "id")
    found = met.mapInArrow(search, "asked long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
