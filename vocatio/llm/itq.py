"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Different vectors of one dimension are centred, rotated to principal axes and turned by rotations
that iterative quantisation learns, so that signs give balanced bits.  The bits of all rotations,
in order, are cut into keys of equal length, one Hamming table for each; vectors that share a key
meet, are reranked by the cosine of the original vectors, and link from ``least`` on.  A pair that
meets in several tables counts in the first of them, so no pair is written or made distinct.

The model is fitted on a bounded sample (``SAMPLE`` different vectors of least hash); every vector
is indexed.  Rotations are added until pairs made at exactly ``least`` from the sample meet with
probability ``RECALL``; pairs that are closer meet more often.  Keys lengthen with the logarithm of
the number of vectors, so that lists keep their size while the table grows.

Equal vectors are one row with a weight, so exact copies cost nothing and are never missed.  Lists
longer than ``BLOCK`` are dealt out as pairs of blocks; a task compares two blocks at most, and
gives counts per vector and a tree of edges, never pairs.  A table of n different vectors that all
lie within reach of each other still costs their n^2 products, as their links are to be counted;
the products are spread over pairs of blocks.

Vectors that are null, zero, or hold null or non-finite components link with nothing; so do vectors
of different dimensions with each other.  Repeated rows count as vectors of their own.  A null id is
no component's smallest unless it has no other; labels and other columns are not looked at.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocatio.llm import scratch
from vocatio.llm.simhash import components, small

LEAST = 0.95
SAMPLE, SAMPLE_VALUES = 20_000, 8_000_000
RECALL, ROTATIONS, BITS = 0.99, 64, 64
LIST, BLOCK = 1024, 1024
SHORTEST = 6
HOT = 10_000
FOUND = "a long, b long, n long"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, safe from overflow."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Codes:
    """Learned rotations of one dimension and the keys that they give."""

    def __init__(self, sample: np.ndarray, rows: int, least: float, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        u = unit(sample)
        self.mean = u.mean(0)
        values, axes = np.linalg.eigh((u - self.mean).T @ (u - self.mean))
        self.axes = axes[:, np.argsort(-values)[:BITS]]
        self.bits = max(SHORTEST, int(np.ceil(np.log2(max(1, rows) / LIST))))
        self.rotations: list[np.ndarray] = []
        projected = (u - self.mean) @ self.axes
        away = rng.standard_normal(u.shape)
        away -= (away * u).sum(1, keepdims=True) * u
        size = np.sqrt((away * away).sum(1, keepdims=True))
        away = np.divide(away, size, out=np.zeros_like(away), where=size > 1e-9)
        partner = least * u + np.sqrt(1 - least * least) * away  # at the threshold exactly
        while len(self.rotations) < ROTATIONS:
            self.rotations.append(self._turned(projected, rng))
            if self.tables and (self.keys(u) == self.keys(partner)).any(1).mean() >= RECALL:
                break

    @property
    def tables(self) -> int:
        return len(self.rotations) * self.axes.shape[1] // self.bits

    @staticmethod
    def _turned(projected: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
        """The rotation for which the projections are nearest to their signs, from a random start."""
        width = projected.shape[1]
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
            turn = (left @ right).T
        return turn

    def keys(self, units: np.ndarray) -> np.ndarray:
        """A key for each table, a vector a row."""
        projected = (units - self.mean) @ self.axes
        bits = np.concatenate([projected @ turn >= 0 for turn in self.rotations], 1)
        bits = bits[:, : self.tables * self.bits].reshape(len(units), self.tables, self.bits)
        return bits @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def fitted(distinct: DataFrame, least: float) -> dict[int, Codes]:
    """Codes by dimension, each from a bounded sample of its different vectors."""
    found = {}
    for row in distinct.groupBy("dim").count().collect():  # one row a dimension
        most = max(1, min(SAMPLE, SAMPLE_VALUES // row.dim))
        sample = distinct.filter(F.col("dim") == row.dim).orderBy("h1", "h2").limit(most).select("vector").toArrow()
        found[row.dim] = Codes(_matrix(sample.column(0).combine_chunks(), row.dim), row["count"], least)
    return found


def _tree(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a binary tree over each component of a symmetric relation (no vector has over three)."""
    edges, waiting = [], np.flatnonzero(linked.any(0))
    while len(waiting):
        members, front = [waiting[:1]], waiting[:1]
        waiting = waiting[1:]
        while len(front) and len(waiting):
            reached = np.zeros(len(waiting), bool)
            for at in range(0, len(front), 256):
                reached |= linked[np.ix_(front[at : at + 256], waiting)].any(0)
            front, waiting = waiting[reached], waiting[~reached]
            members.append(front)
        order = np.concatenate(members)
        edges += [(order[k], order[(k - 1) // 2]) for k in range(1, len(order))]
    return edges


def compared(vectors: np.ndarray, keys: np.ndarray, weight: np.ndarray, block: np.ndarray, table: int, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted links of each vector of a list that are first met in ``table``, and edges that join all linked.
    Vectors of two blocks are compared across them only."""
    u = unit(vectors)
    linked = np.zeros((len(u), len(u)), bool)
    across = block.min() != block.max()
    for at in range(0, len(u), 256):
        rows = slice(at, at + 256)
        near = u[rows] @ u.T >= least
        if across:
            near &= block[rows, None] != block[None, :]
        for earlier in range(table):
            if not near.any():
                break
            near &= keys[rows, earlier][:, None] != keys[:, earlier][None, :]
        linked[rows] = near
    np.fill_diagonal(linked, False)
    linked |= linked.T  # rounding may differ by order
    return linked @ weight, _tree(linked)


def neighbours(distinct: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows (a, null, n): n links of vector a, by table and blocks; rows (a, b, null): edges that keep
    every component together.  ``distinct`` has node, vector, dim and weight."""
    codes = fitted(distinct, least)
    model = distinct.sparkSession.sparkContext.broadcast(codes)  # bounded by the sample's dimensions

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            keys: list = [None] * batch.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for k, row in zip(at.tolist(), model.value[dim].keys(unit(_matrix(batch.column(1).take(pa.array(at)), dim)))):
                    keys[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=["node", "vector", "dim", "weight", "keys"])

    kind = distinct.schema["vector"].dataType.simpleString()
    coded_rows = distinct.select("node", "vector", "dim", "weight").mapInArrow(coded, f"node long, vector {kind}, dim int, weight long, keys array<long>")
    coded_rows = scratch.written(coded_rows, "codes")
    lists = coded_rows.select("node", "dim", F.posexplode("keys").alias("table", "key"))
    sizes = lists.groupBy("dim", "table", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    long = small(scratch.written(sizes.filter("blocks > 1"), "long-lists"))
    posted = coded_rows.select("*", F.posexplode("keys").alias("table", "key")).join(long, ["dim", "table", "key"], "left")
    posted = posted.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    posted = posted.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posted = posted.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def run(group: pa.Table) -> pa.Table:
        if group.num_rows < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        group = group.combine_chunks()
        dim, table = group.column("dim")[0].as_py(), group.column("table")[0].as_py()
        node, weight = group.column("node").to_numpy(), group.column("weight").to_numpy()
        vectors, keys = _matrix(group.column("vector").combine_chunks(), dim), _matrix(group.column("keys").combine_chunks(), len(group.column("keys")[0]))
        count, edges = compared(vectors, keys, weight, group.column("own").to_numpy(), table, least)
        has = np.flatnonzero(count)
        pairs = node[np.array(edges, np.int64).reshape(-1, 2)]
        return pa.table(
            {
                "a": np.concatenate([node[has], pairs[:, 0]]),
                "b": pa.array(np.concatenate([np.zeros(len(has), np.int64), pairs[:, 1]]), mask=np.arange(len(has) + len(pairs)) < len(has)),
                "n": pa.array(np.concatenate([count[has], np.zeros(len(pairs), np.int64)]), mask=np.arange(len(has) + len(pairs)) >= len(has)),
            }
        )

    return posted.groupBy("dim", "table", "key", "i", "j").applyInArrow(run, FOUND)


def usable(vectors: DataFrame) -> DataFrame:
    """``vectors`` (id, vector) with two hashes of each vector that can link; null hashes for others."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    fit = F.col("vector").isNotNull() & F.forall("vector", number) & F.exists("vector", lambda x: x != 0)
    vector = F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast(x_type(vectors)))  # one zero
    fit = F.coalesce(fit, F.lit(False))
    return vectors.select("id", F.when(fit, vector).alias("vector")).select(
        "id",
        "vector",
        F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("h1"),
        F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit("second"), "vector")).alias("h2"),
    )


def x_type(vectors: DataFrame) -> str:
    return vectors.schema["vector"].dataType.elementType.simpleString()


def near_duplicates(table: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``table`` (vec_id, embedding)."""
    kind = table.schema["embedding"].dataType.simpleString()
    stored = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = usable(table.select(F.col("vec_id").cast("long").alias("id"), stored.alias("vector")))
    rows = scratch.written(rows, "vectors")
    whole = rows.filter("h1 is not null")
    distinct = whole.groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("id").alias("first"), F.first("vector").alias("vector"))
    distinct = distinct.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("node"))
    distinct = scratch.written(distinct, "different-vectors")
    found = scratch.written(neighbours(distinct, least), "found")
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    edges = scratch.written(found.filter("b is not null").select("a", "b").distinct(), "links")
    nodes = distinct.select(F.col("node").alias("fp"), "first")
    label = components(edges, nodes).select("node", F.col("root.first").alias("least_id"), F.lit(True).alias("joined"))
    of = distinct.select("node", "h1", "h2", "weight", "first").join(links, "node", "left").join(label, "node", "left")
    of = of.select(
        "h1",
        "h2",
        "weight",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        F.when(F.col("joined"), F.col("least_id")).otherwise(F.col("first")).alias("component_id"),
    )
    of = scratch.written(of, "components")
    # vectors of many copies are few: they are broadcast, so that no join meets their rows in one task
    many = small(of.filter(F.col("weight") >= HOT))
    held = rows.select(F.col("id").alias("vec_id"), "h1", "h2")
    met = held.join(many, ["h1", "h2"], "left_semi").join(many, ["h1", "h2"])
    rest = held.join(many, ["h1", "h2"], "left_anti").join(of.filter(F.col("weight") < HOT), ["h1", "h2"], "left")
    out = met.unionByName(rest).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
