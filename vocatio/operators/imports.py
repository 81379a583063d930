"""Work-history exports: CSV members of many archives to experience, projects and lists.

A member is parsed by the CSV rules once, in an Arrow batch; everything after that is DataFrame
work keyed by export and member.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocatio.functions.text import base_name, distinct_ci, header_name, trimmed

HEADER_ROWS, MAX_ROWS, MAX_CHARS, MAX_FIELD = 10, 200, 500_000, 4000

# Members, the columns each is read for, and the spellings of their headers.
SPECS = {
    "positions": (
        ["positions.csv"],
        {
            "organization": ["company name", "company"],
            "title": ["title", "position"],
            "description": ["description"],
            "location": ["location"],
            "started_on": ["started on", "start date", "started"],
            "finished_on": ["finished on", "end date", "finished"],
        },
        ["title", "organization"],
    ),
    "projects": (
        ["projects.csv"],
        {
            "name": ["title", "name", "project name"],
            "description": ["description"],
            "url": ["url", "link"],
            "started_on": ["started on", "start date", "started"],
            "finished_on": ["finished on", "end date", "finished"],
        },
        ["name"],
    ),
    "skills": (["skills.csv"], {"name": ["name", "skill"]}, ["name"]),
    "certifications": (["certifications.csv"], {"name": ["name", "title"]}, ["name"]),
    "honors": (["honors.csv", "honours.csv"], {"name": ["title", "name"]}, ["name"]),
}


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def csv_rows(texts: pd.Series) -> pd.Series:
    """Rows of a CSV text; null if it is none."""

    def one(text: str | None):
        try:
            return list(csv.reader(io.StringIO(text or "", newline="")))
        except csv.Error:
            return None

    return texts.map(one)


def members(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (export_id, seq, member_name, text) that are read, with their kind, and the others
    with the reason.  Of two spellings of one member the first counts."""
    kind = F.when(F.lit(False), F.lit(""))
    for name, (spellings, _, _) in SPECS.items():
        kind = kind.when(base_name(F.col("member_name")).isin(spellings), name)
    rows = files.withColumn("kind", kind)
    reason = F.when(F.col("kind").isNull(), "not_read").when(F.length("text") > MAX_CHARS, "too_large")
    rows = rows.withColumn("reason", reason)
    first = F.row_number().over(Window.partitionBy("export_id", "kind").orderBy("seq"))
    read = rows.filter("reason IS NULL").withColumn("_n", first).filter("_n = 1").drop("_n", "reason")
    return read, rows.filter("reason IS NOT NULL").select("export_id", "member_name", "reason")


def _header_row(heads: Column, wanted: list[str]) -> Column:
    """Number (from 1) of the first row with one of the names, 0 if there is none."""
    names = F.array(*map(F.lit, wanted))
    return F.array_position(F.transform(heads, lambda r: F.arrays_overlap(r, names)), True).cast("int")


def _leftmost(head: Column, names: list[str]) -> Column:
    """Number (from 1) of the first column with one of the names."""
    places = F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position(head, n))
    return F.array_min(F.filter(places, lambda p: p > 0)).cast("int")


def records(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the members as (export_id, kind, row_no, values map), and members without the columns
    they need.  The header is the first of ten rows that names an identifying column; of several
    spellings the leftmost column counts; at most 200 rows are taken."""
    parsed = read.select("export_id", "kind", "member_name", csv_rows(F.col("text")).alias("rows"))
    heads = F.transform(F.slice("rows", 1, HEADER_ROWS), lambda r: F.transform(r, lambda c: header_name(c)))
    parsed = parsed.withColumn("heads", heads)
    at = F.when(F.lit(False), F.lit(0))
    for kind, (_, columns, identifies) in SPECS.items():
        at = at.when(F.col("kind") == kind, _header_row(F.col("heads"), [a for f in identifies for a in columns[f]]))
    parsed = parsed.withColumn("at", F.coalesce(at, F.lit(0)))
    head = F.coalesce(F.get(F.col("heads"), F.col("at") - 1), F.array().cast("array<string>"))
    picked = F.when(F.lit(False), F.create_map(F.lit(""), F.lit(0)))
    needed = F.when(F.lit(False), F.array(F.lit("")))
    for kind, (_, columns, identifies) in SPECS.items():
        places = [x for f, names in columns.items() for x in (F.lit(f), _leftmost(head, names))]
        picked = picked.when(F.col("kind") == kind, F.create_map(*places))
        needed = needed.when(F.col("kind") == kind, F.array(*map(F.lit, identifies)))
    parsed = parsed.withColumn("picked", picked).withColumn("needed", needed)
    body = F.slice("rows", F.col("at") + 1, F.lit(MAX_ROWS))
    good = parsed.filter("at > 0").withColumn("n_rows", F.size("rows") - F.col("at"))
    rows = good.select("export_id", "kind", "needed", "picked", (F.col("n_rows") > MAX_ROWS).alias("capped"), F.posexplode(body).alias("row_no", "r"))
    values = F.map_filter(F.transform_values("picked", lambda k, p: trimmed(F.get(F.col("r"), p - 1))), lambda k, v: v.isNotNull() & (v != ""))
    rows = rows.withColumn("values", values).filter(F.exists("needed", lambda k: F.map_contains_key(F.col("values"), k)))
    bad = parsed.filter("at = 0").select("export_id", "member_name", F.lit("no_known_columns").alias("reason"))
    return rows.select("export_id", "kind", "row_no", "capped", "values"), bad


def imported(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Experience, projects, lists (export_id, kind, names), ignored members, and notes per export.
    The order of the members does not matter."""
    read, ignored = members(files)
    rows, bad = records(read)
    v = lambda k: F.col("values")[k].alias(k)
    text = F.coalesce(F.col("values")["description"], F.lit(""))
    described = [F.substring(text, 1, MAX_FIELD).alias("description"), (F.length(text) > MAX_FIELD).alias("was_cut")]
    experience = rows.filter("kind = 'positions'").select("export_id", "row_no", v("title"), v("organization"), v("location"), v("started_on"), v("finished_on"), *described)
    projects = rows.filter("kind = 'projects'").select("export_id", "row_no", v("name"), v("url"), v("started_on"), v("finished_on"), *described)
    names = F.transform(F.sort_array(F.collect_list(F.struct("row_no", v("name")))), lambda x: x["name"])
    lists = rows.filter("kind IN ('skills', 'certifications', 'honors')").groupBy("export_id", "kind").agg(distinct_ci(names).alias("names"))
    ignored = ignored.unionByName(bad)
    seen = read.groupBy("export_id").agg(F.count("*").alias("n_read"))
    unusable = bad.groupBy("export_id").agg(F.count("*").alias("n_bad"))
    work = experience.groupBy("export_id").agg(F.count("*").alias("n_work"), F.max("was_cut").alias("cut"))
    caps = rows.groupBy("export_id").agg(F.max("capped").alias("capped"))
    notes = files.select("export_id").distinct()
    for t in (seen, unusable, work, caps):
        notes = notes.join(t, "export_id", "left")
    used = F.coalesce("n_read", F.lit(0)) - F.coalesce("n_bad", F.lit(0))
    notes = notes.select(
        "export_id",
        used.cast("long").alias("n_files_read"),
        F.array_compact(
            F.array(
                F.when(used == 0, "nothing_read"),
                F.when((used > 0) & F.coalesce(F.col("n_work") == 0, F.lit(True)), "no_experience"),
                F.when(F.col("capped"), "rows_capped"),
                F.when(F.col("cut"), "description_shortened"),
            )
        ).alias("notes"),
    )
    return experience, projects, lists, ignored, notes
