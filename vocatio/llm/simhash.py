"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint is eight bytes at eight positions.  Two fingerprints at ``max_bits`` or fewer
differing bits differ in at most that many bytes, so they share at least 8 - max_bits bytes at
their positions.  Postings are keyed by the bytes at three positions, one key for each set of
positions of a family that meets every possible set of shared positions (20 triples for four
bits).  In a posting list shared positional bytes are tallied per pair, pairs under the guaranteed
minimum are dropped, the rest is verified bit by bit, and the list's links are written as a
spanning forest: no list emits its pairs.  A list longer than ``block`` is split by each of the five
other positions (two fingerprints that share four bytes share one of those besides the three), and
what is longer still is dealt out as pairs of blocks, so that no task holds more than two blocks.

Only distinct fingerprints enter the index; copies follow their fingerprint, those of a fingerprint
with very many rows without being gathered.  Null and empty texts
have fingerprint zero and link like any other.  Null ids are carried along and are no group's
smallest id unless it has no other.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio.llm import scratch

SHINGLE = 4
SEED = 42
BROADCAST_ROWS = 1_000_000
HOT_ROWS = 100_000  # rows of a key that no join may gather in one task


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: only A-Z change, only the six ASCII spaces separate
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in joined), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tie (hash of the text) and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                fps = [fingerprint(x or b"", shingle) for x in piece.column(2).to_pylist()]
                fp = np.array(fps, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(fp)], names=["doc_id", "tie", "fp"])

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text")
    )
    return source.mapInArrow(run, "doc_id long, tie long, fp long")


def position_sets(max_bits: int, width: int = 3) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that every set of 8 - max_bits positions holds one.
    Turán's construction for three: positions in three rings, sets inside a ring or with two in a
    ring and one in the next."""
    if max_bits == 4 and width == 3:
        ring = [p * 3 // 8 for p in range(8)]
        near = lambda t: sorted(ring[p] for p in t)
        inside = {(k, k, k) for k in range(3)} | {tuple(sorted((k, k, (k + 1) % 3))) for k in range(3)}
        return [t for t in combinations(range(8), 3) if tuple(near(t)) in inside]
    return list(combinations(range(8), min(width, 8 - max_bits)))


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (root, member) of the link components of one posting list."""
    fps = np.unique(fps)
    members = fps.view(np.uint64)
    by_byte = members.view(np.uint8).reshape(-1, 8)
    least = 8 - max_bits
    edges = []
    waiting = np.arange(len(fps))
    while len(waiting) > 1:
        root, waiting = waiting[0], waiting[1:]
        front = np.array([root])
        while len(front) and len(waiting):
            linked = np.zeros(len(waiting), bool)
            for at in range(0, len(front), 128):
                f = front[at : at + 128]
                shared = np.zeros((len(f), len(waiting)), np.uint8)
                for p in range(8):
                    shared += by_byte[f, p][:, None] == by_byte[waiting, p][None, :]
                a, b = np.nonzero(shared >= least)
                near = np.bitwise_count(members[f[a]] ^ members[waiting[b]]) <= max_bits
                linked[b[near]] = True
            front, waiting = waiting[linked], waiting[~linked]
            edges += [(int(fps[root]), int(fps[m])) for m in front]
    return edges


def links(fps: DataFrame, max_bits: int = 4, block: int = 2048) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of ``fps`` (column fp) that keep every
    component of the link relation together."""
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys, width = [], len(position_sets(max_bits)[0])
    for n, positions in enumerate(position_sets(max_bits)):
        key = F.lit(n).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    long = scratch.written(postings.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block), "long-lists")
    long = small(long.select("key"))  # at most rows * keys / block
    taken = F.get(F.array(*[F.lit(sum(1 << p for p in t)) for t in position_sets(max_bits)]), F.shiftright("key", 8 * width).cast("int"))
    fourth = F.array(*[F.struct(F.lit(1 << p).alias("bit"), (F.lit(p << 8) + byte[p]).alias("at")) for p in range(8)])
    fourth = F.filter(fourth, lambda x: x["bit"].bitwiseAND(taken) == 0)
    split = postings.join(long, "key", "left_semi").select("fp", "key")
    if 8 - max_bits > width:
        split = split.select("fp", "key", F.explode(fourth).alias("x"))
        split = split.select("fp", (F.shiftleft("key", 11) + F.col("x.at") + F.lit(1 << 60)).alias("key"))
    blocks = F.ceil(F.count("*") / block).cast("int").alias("blocks")
    longer = scratch.written(split.groupBy("key").agg(blocks).filter("blocks > 1"), "longer-lists")
    met = postings.join(long, "key", "left_anti").select("fp", "key", F.lit(1).alias("blocks"))
    met = met.unionByName(split.join(small(longer), "key", "left").select("fp", "key", F.coalesce("blocks", F.lit(1)).alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = met.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    lists = met.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list("fp").alias("fps")
    )
    lists = lists.filter(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, cuts = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            sizes = np.diff(cuts)
            pair = cuts[:-1][sizes == 2]
            a, b = np.minimum(values[pair], values[pair + 1]), np.maximum(values[pair], values[pair + 1])
            shared = ((a ^ b).view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = (shared >= 8 - max_bits) & (np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits)
            edges = [e for k in np.flatnonzero(sizes > 2) for e in forest(values[cuts[k] : cuts[k + 1]], max_bits)]
            more = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a[near], more[:, 0]])), pa.array(np.concatenate([b[near], more[:, 1]]))],
                names=["a", "b"],
            )

    return lists.select("fps").mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast where it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def spread_join(rows: DataFrame, table: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key).  Keys in the written table ``hot``, each of over
    ``HOT_ROWS`` of the rows, are met where the rows are, the others by shuffle."""
    if hot.isEmpty():
        return rows.join(table, key)
    hot = small(hot)
    few = scratch.written(table.join(hot, key, "left_semi"), "hot-keys")
    return rows.join(small(few), key).unionByName(rows.join(hot, key, "left_anti").join(table, key))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and root for the nodes of ``edges`` (a, b): root is the least (none, first, fp) of its
    component, by the ids of ``nodes`` (fp, first), null last.  Least labels pass along edges and jump
    to their label's label until nothing changes."""
    both = scratch.written(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    hubs = scratch.written(both.groupBy("b").count().filter(F.col("count") > HOT_ROWS).select("b"), "hubs")
    own = nodes.select(F.col("fp").alias("node"), F.struct(F.col("first").isNull().alias("none"), "first", "fp").alias("own"))

    def heard(labels: DataFrame) -> DataFrame:
        met = spread_join(both, labels.select(F.col("node").alias("b"), F.col(labels.columns[1]).alias("r")), hubs, "b")
        return met.groupBy(F.col("a").alias("node")).agg(F.min("r").alias("heard"))

    label = own.join(heard(own), "node").select("node", F.least("own", "heard").alias("root"))
    label = scratch.written(label, "labels")
    while True:
        lower = label.join(heard(label), "node").select("node", "root", F.least("root", "heard").alias("low"))
        lower = scratch.written(lower, "labels")
        met = lower.select(F.col("low.fp").alias("node")).distinct()  # labels that are met, each once
        jump = scratch.written(lower.join(met, "node", "left_semi").select(F.col("node").alias("at"), F.col("low").alias("next")), "jumps")
        moved = lower.join(small(jump), F.col("low.fp") == F.col("at"), "left")
        moved = moved.select("node", "root", F.least("low", F.coalesce("next", "low")).alias("low"))
        moved = scratch.written(moved, "labels")
        changed = not moved.filter("low <> root").isEmpty()
        label = moved.select("node", F.col("low").alias("root"))
        if not changed:
            return label


def grouped(docs: DataFrame, max_bits: int = 4, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tie, fp and component_id (the smallest doc_id of its group) of every row."""
    rows = scratch.written(fingerprints(docs, shingle), "fingerprints")
    counted = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    counted = scratch.written(counted, "distinct-fingerprints")
    first, hot = counted.drop("n"), counted.filter(F.col("n") > HOT_ROWS).select("fp")
    label = components(scratch.written(links(first, max_bits), "links"), first)
    linked = first.join(label, F.col("fp") == F.col("node"), "left")
    smallest = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("root.first"))
    of = linked.select("fp", smallest.alias("component_id"))
    found = spread_join(rows, scratch.written(of, "components"), hot, "fp")
    return found.select("doc_id", "tie", "fp", "component_id")


def deduplicated(docs: DataFrame, max_bits: int = 4, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: that of the smallest id
    (null before any other)."""
    found = scratch.written(grouped(docs, max_bits, shingle), "groups")
    best = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "tie")).alias("best")).select("best.*")

    def same(left: DataFrame, tie: Column, right: DataFrame) -> Column:
        return left["doc_id"].cast("long").eqNullSafe(right["other_id"]) & (tie == right["other_tie"])

    def others(table: DataFrame) -> DataFrame:
        return table.select(F.col("doc_id").alias("other_id"), F.col("tie").alias("other_tie"))

    best = others(best)
    dropped = found.select("doc_id", "tie").join(best, same(found, found["tie"], best), "left_anti").distinct()
    dropped = small(others(scratch.written(dropped, "dropped")))  # texts stay where they are if few are dropped
    kept = docs.join(dropped, same(docs, F.xxhash64(docs["text"]), dropped), "left_anti")
    repeated = found.groupBy("doc_id", "tie").count().filter("count > 1")
    return kept.dropDuplicates(["doc_id", "text"]) if not repeated.isEmpty() else kept
