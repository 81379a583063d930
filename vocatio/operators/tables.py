"""Writes as table-to-table operators: each takes the present snapshot and a batch and returns the
next snapshot (or the rows to append).  Rerunning with the same batch changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from vocatio.functions.text import payload_key


def keep_last(batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in ``order``.  Aggregated map-side, without sorting a key's rows."""
    value = F.struct(*[F.col(c) for c in batch.columns])
    by = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return batch.groupBy(*keys).agg(F.max_by(value, by).alias("kept")).select("kept.*")


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot after replacing or adding ``incoming`` (one row per key) by ``keys``."""
    left = target.join(incoming.select(*keys), keys, "left_anti")
    return left.unionByName(incoming.select(*target.columns))


def absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` to append: the first per key whose key is not there yet."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def payload_rows(landed: DataFrame) -> DataFrame:
    """Content-addressed rows for ``landed`` (payload): prefix, key, sha256, n_bytes, payload, one
    per content."""
    k = payload_key(F.col("payload"))
    rows = landed.select(k.alias("k"), "payload").select("k.*", "payload")
    return rows.dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))


def changes(head: DataFrame, batch: DataFrame, keys: list[str], hash_column: str) -> DataFrame:
    """Each row of ``batch`` (one per key) with its outcome against ``head``: new, unchanged or
    updated."""
    before = head.select(*keys, F.col(hash_column).alias("_before"))
    outcome = (
        F.when(F.col("_before").isNull(), "new")
        .when(F.col("_before") == F.col(hash_column), "unchanged")
        .otherwise("updated")
    )
    return batch.join(before, keys, "left").withColumn("outcome", outcome).drop("_before")


def versioned_upsert(
    head: DataFrame, batch: DataFrame, keys: list[str], content: list[str], hash_column: str, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next head, versions to append, and outcomes per key.

    ``batch`` has one row per key with the columns ``content``.  New keys get first_seen_at; every
    key seen gets last_seen_at and becomes active again; where the hash differs the old content goes
    to the versions and the new one to the head.  Keys that the batch lacks stay as they are.
    """
    b = batch.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in content])
    both = head.withColumn("_h", F.lit(True)).join(b.withColumn("_b", F.lit(True)), keys, "full_outer")
    seen, known = F.col("_b").isNotNull(), F.col("_h").isNotNull()
    same = known & seen & F.col(hash_column).eqNullSafe(F.col(f"_b_{hash_column}"))
    outcome = F.when(~seen, F.lit(None)).when(~known, "new").when(same, "unchanged").otherwise("updated")
    both = both.withColumn("outcome", outcome)
    write = F.col("outcome").isin("new", "updated")
    # the company of a posting that is known stays
    fixed = {"company_id"}
    columns = []
    for c in head.columns:
        old = F.col(c)
        if c in keys:
            value = old
        elif c == "first_seen_at":
            value = F.when(F.col("outcome") == "new", now).otherwise(old)
        elif c == "last_seen_at":
            value = F.when(seen, now).otherwise(old)
        elif c == "status":
            value = F.when(seen, F.lit("active")).otherwise(old)
        elif c == "closed_at":
            value = F.when(~seen, old)
        elif c in content:
            value = F.when(F.col("outcome") == "new" if c in fixed else write, F.col(f"_b_{c}")).otherwise(old)
        else:
            value = old
        columns.append(value.alias(c))
    old_content = [c for c in ("title", "description_sha256", hash_column) if c in head.columns]
    versions = both.filter(F.col("outcome") == "updated").select(*keys, *old_content, now.alias("recorded_at"))
    return both.select(*columns), versions, both.filter(seen).select(*keys, "outcome")


def versioned_fold(
    head: DataFrame, batch: DataFrame, keys: list[str], content: list[str], hash_column: str, order: list[Column], now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next head, versions to append, and an outcome for every row of ``batch``, whose rows of a key
    count one after the other in ``order``.

    A row whose hash differs from what its key had just before (the row before it, or the head for
    the first) writes that as a version, numbered by ``change_no``, and is the key's content from
    then on; the head ends with the content of the last such row, so a batch with two changes writes
    two versions.  Other rules are those of ``versioned_upsert``; the company of a known posting
    stays, and of a new one it is that of its first row.  A key's rows meet in one task, sorted and
    spilled, without its texts.
    """
    old = [c for c in ("title", "description_sha256", hash_column) if c in head.columns]
    known = head.select(*keys, F.struct(*old).alias("_head"))
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = batch.join(known, keys, "left").withColumn("_place", F.row_number().over(w))
    rows = rows.withColumn("_was", F.coalesce(F.lag(F.struct(*old)).over(w), F.col("_head")))
    same = F.col(f"_was.{hash_column}").eqNullSafe(F.col(hash_column))
    rows = rows.withColumn("outcome", F.when(F.col("_was").isNull(), "new").when(same, "unchanged").otherwise("updated"))
    rows = rows.withColumn("change_no", F.count_if(F.col("outcome") == "updated").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    versions = rows.filter("outcome = 'updated'").select(*keys, *[F.col(f"_was.{c}").alias(c) for c in old], now.alias("recorded_at"), "change_no")
    wrote = F.when(F.col("outcome") != "unchanged", F.col("_place"))
    last = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*content), wrote).alias("_new"), F.min_by(F.struct(*content), "_place").alias("_first"), F.max(wrote).alias("_wrote")
    )
    both = head.withColumn("_known", F.lit(True)).join(last.withColumn("_seen", F.lit(True)), keys, "full_outer")
    seen, known_before = F.col("_seen").isNotNull(), F.col("_known").isNotNull()

    def value(c: str) -> Column:
        now_has = F.col(c)
        if c in keys:
            return now_has
        if c == "first_seen_at":
            return F.when(known_before, now_has).otherwise(now)
        if c == "last_seen_at":
            return F.when(seen, now).otherwise(now_has)
        if c == "status":
            return F.when(seen, F.lit("active")).otherwise(now_has)
        if c == "closed_at":
            return F.when(~seen, now_has)
        if c == "company_id":
            return F.when(known_before, now_has).otherwise(F.col("_first.company_id"))
        return F.when(F.col("_wrote").isNotNull(), F.col(f"_new.{c}")).otherwise(now_has) if c in content else now_has

    return both.select(*[value(c).alias(c) for c in head.columns]), versions, rows.select(*keys, "outcome")


def fresh_payloads(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of ``payload_rows`` that the store lacks.  Only the store's partitions that the batch
    touches are read: their prefixes (256 at most) become a filter on the partition column."""
    touched = [r.prefix for r in rows.select("prefix").distinct().collect()]
    there = store.filter(F.col("prefix").isin(touched)).select("prefix", "sha256")
    return rows.join(there, ["prefix", "sha256"], "left_anti")


def change_chain(batch: DataFrame, keys: list[str], hash_column: str, order: Column) -> DataFrame:
    """Several rows of one key in a batch: those whose hash differs from the row before, with it."""
    w = Window.partitionBy(*keys).orderBy(order)
    return batch.withColumn("previous", F.lag(hash_column).over(w)).filter(
        F.col("previous").isNull() | (F.col("previous") != F.col(hash_column))
    )


def split_valid(
    df: DataFrame,
    checks: dict[str, str],
    keys: list[str],
    references: dict[str, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows that hold, and the others with ``reasons``.  ``references``: column to the table whose
    first column it must be found in; null is allowed."""
    errors = [F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(f"check:{name}")) for name, sql in checks.items()]
    n = F.count("*").over(Window.partitionBy(*keys))
    errors.append(F.when(n > 1, F.lit("duplicate_key")))
    for column, parent in (references or {}).items():
        found = parent.select(F.col(parent.columns[0]).alias(column), F.lit(True).alias(f"_r_{column}")).distinct()
        df = df.join(found, column, "left")
        errors.append(F.when(F.col(column).isNotNull() & F.col(f"_r_{column}").isNull(), F.lit(f"no_{column}")))
    marked = df.withColumn("reasons", F.array_compact(F.array(*errors)))
    marked = marked.drop(*[f"_r_{c}" for c in references or {}])
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def outcome_counts(outcomes: DataFrame, by: str, values: list[str]) -> DataFrame:
    """One row per ``by`` with a counter per outcome, and a last one (null) for all."""
    counters = [F.count_if(F.col("outcome") == v).alias(v) for v in values]
    return outcomes.rollup(by).agg(F.count("*").alias("seen"), *counters)


def capped(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each ``by``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def publish(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Write all tables to ``root``/<name> and compare what is read back with the rows that went into
    each write, counted on the way; raises if one differs, before any count is returned.  Returns
    table, n_rows.  ``root`` has to be a folder that all executors share, and new: readers turn to it
    once this returns."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        seen = Observation(f"published {name}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/{name}")
        expected, got = seen.get["n"], spark.read.schema(df.schema).parquet(f"{root}/{name}").count()
        if expected != got:
            raise ValueError(f"{name}: {got} rows written of {expected}")
        counts.append((name, got))
    return spark.createDataFrame(counts, "table string, n_rows long")
