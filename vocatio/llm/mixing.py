"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in hash order; a source may be served up to ``max_epochs`` times over,
which gives one row per service.  A service's virtual finish time is the source's words up to and
including it, divided by the source's weight.  All services are range-sorted by virtual finish
into one queue, running totals are taken over its partitions, and the queue is cut where the total
budget is used up.  The total counts a document in service with the words served so far, as all
waiting sources are served side by side at their weights, so that each source meets its target to
the word.  Targets follow from the cut: what a source can be served at most, or weight times the
virtual time of the cut.

Prefix sums inside a source are taken in two steps, over hash buckets and inside one bucket, so
that a source with a third of all rows is still spread over its buckets.  Times are whole numbers
(of 1 / least common multiple of the weights), so that the cut is exact.

Null text has size 0.  Null source is a source of its own, last.  Repeated and null ids queue as
documents of their own, told apart by their texts; rows alike in id and text share a bucket.  An
empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocatio.llm import scratch
from vocatio.llm.quality import words

BROADCAST_SOURCES = 20_000
BUCKET_ROWS = 2000


def weighted(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source of ``sizes`` (queue, source, size): queue, source_size, weight.  Sources by
    code point, null last, take ``weights`` in turn."""
    per = sizes.groupBy("queue", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")
    return per.select("queue", "source_size", weight.alias("weight"))


def services(placed: DataFrame, max_epochs: int, unit: int) -> DataFrame:
    """The services of ``placed`` (size, before, source_size, weight): finish (in 1 / ``unit``) and
    closes, the weight that falls silent with a source's last service.  Documents without words are
    never served."""
    lap = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("lap")
    each = placed.filter("size > 0").select("size", "before", "source_size", "weight", lap)
    end = F.col("lap") * F.col("source_size") + F.col("before") + F.col("size")
    last = end == max_epochs * F.col("source_size")
    return each.select(
        (end * F.expr(f"{unit}L div weight")).alias("finish"), F.when(last, F.col("weight")).otherwise(F.lit(0)).alias("closes")
    )


def cut(queue: DataFrame, budget: int, weight: int, unit: int) -> float:
    """The virtual time at which the ``queue`` (``services``) of sources of ``weight`` in all has
    served ``budget`` words.  The driver sees three numbers a range partition, and one row."""
    line = queue.repartitionByRange("finish").select(F.spark_partition_id().alias("part"), "finish", "closes")
    line = scratch.written(line, "mix-queue")
    silent = (F.col("closes") * F.col("finish")).alias("words")  # what the sources that end here were served
    sums = line.groupBy("part").agg(F.max("finish").alias("end"), F.sum("closes").alias("closes"), F.sum(silent).alias("words"))
    served, left = 0, budget * unit
    for part in sums.orderBy("part").collect():
        if served + part.words + (weight - part.closes) * part.end >= left:
            break
        served, weight = served + part.words, weight - part.closes
    else:
        return 0.0
    ahead = Window.partitionBy("part").orderBy("finish").rangeBetween(Window.unboundedPreceding, -1)
    inside = line.filter(F.col("part") == part.part).select(
        "finish",
        F.coalesce(F.sum("closes").over(ahead), F.lit(0)).alias("closes"),
        F.coalesce(F.sum(silent).over(ahead), F.lit(0)).alias("words"),
    )
    wide = lambda c: c.cast("decimal(38,0)")
    total = wide(served + F.col("words")) + wide(weight - F.col("closes")) * wide(F.col("finish"))
    at = inside.filter(total >= F.lit(left).cast("decimal(38,0)")).agg(F.min(F.struct("finish", "closes", "words")).alias("at")).first()["at"]
    return (left - served - at.words) / ((weight - at.closes) * unit)


def queued(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (the columns ``keep``, or all) packed in the column row, with size, source_size, target, weight, before (the
    source's words ahead of it), finish (virtual finish time of its first service) and taken."""
    text, source = F.col("text"), F.col("source")
    size = F.coalesce(F.size(words(text)), F.lit(0)).cast("long")
    queue = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    place = F.md5(F.concat(name, F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    row = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row")
    keyed = docs.select(row, queue.alias("queue"), source, size.alias("size"), place.alias("place"))
    narrow = scratch.written(keyed.select("queue", "source", "size", "place"), "mix-sizes")
    digits = max(1, math.ceil(math.log(max(1, narrow.count() / BUCKET_ROWS), 16)))
    bucket = F.substring("place", 1, digits).alias("bucket")
    per = scratch.written(weighted(narrow, weights), "mix-weights")
    sources, budget, weight = per.agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
    if sources <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    sums = narrow.groupBy("queue", bucket).agg(F.sum("size").alias("bucket_size"))
    earlier = F.sum("bucket_size").over(Window.partitionBy("queue").orderBy("bucket")) - F.col("bucket_size")
    offsets = scratch.written(sums.select("queue", "bucket", earlier.alias("bucket_start")), "mix-buckets")
    inside = Window.partitionBy("queue", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)

    def lined_up(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", bucket).join(offsets, ["queue", "bucket"])
        before = F.col("bucket_start") + F.sum("size").over(inside) - F.col("size")
        return rows.withColumn("before", before).join(per, "queue")

    unit = math.lcm(*weights)
    end = cut(services(lined_up(narrow), max_epochs, unit), budget or 0, weight or 0, unit)
    target = F.least((max_epochs * F.col("source_size")).cast("double"), end * F.col("weight"))
    limit = F.floor(target)
    taken = [
        F.greatest(F.lit(0), F.least(limit - e * F.col("source_size") - F.col("before"), F.col("size")))
        for e in range(max_epochs)
    ]
    return lined_up(keyed).select(
        "row",
        "size",
        "source_size",
        target.alias("target"),
        "weight",
        "before",
        ((F.col("before") + F.col("size")) / F.col("weight")).alias("finish"),
        sum(taken[1:], taken[0]).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The mixed corpus in the order of virtual finish times, with the columns of ``docs``: a
    document appears once for every service; one that is served in part has its first words,
    joined by blanks."""
    q = queued(docs, weights, max_epochs)
    served = q.select(
        "row",
        "size",
        F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"),
        "taken",
        "finish",
        (F.col("source_size") / F.col("weight")).alias("lap"),
    )
    left = F.greatest(F.lit(0), F.least(F.col("taken") - F.col("epoch") * F.col("size"), F.col("size")))
    served = served.withColumn("left", left.cast("int")).filter("left > 0")
    text = F.col("row")["text"]
    part = F.array_join(F.slice(words(text), 1, F.col("left")), " ")
    whole = F.col("left") == F.col("size")
    out = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == "text":
            value = F.when(whole, value).otherwise(part)
        elif c == "n_chars":
            value = F.when(whole, value).otherwise(F.length(part).cast("long"))
        out.append(value.alias(c))
    finish = (F.col("finish") + F.col("epoch") * F.col("lap")).alias("virtual_finish")
    ordered = served.select(*out, finish).repartitionByRange("virtual_finish").sortWithinPartitions("virtual_finish")
    return ordered.select(*docs.columns)
