"""String expressions: every function takes and returns columns, and stays in generated code."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = " \t\n\r\x0b\f"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def trimmed(c: Column) -> Column:
    """Without white space at either end (Spark's trim removes blanks only)."""
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    t = trimmed(c)
    return F.when(t != "", t)


def collapsed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm(c: Column) -> Column:
    """Form for comparisons: case and outer white space only."""
    return F.lower(trimmed(F.coalesce(c, F.lit(""))))


def cleaned(c: Column, limit: int = 300) -> Column:
    """No control characters, single blanks, at most ``limit`` characters; null if nothing is left."""
    t = collapsed(F.regexp_replace(c, CONTROL, ""))
    return F.when(t != "", F.substring(t, 1, limit))


def truncated(c: Column, limit: int) -> Column:
    """Struct of the first ``limit`` characters and whether something was cut."""
    return F.struct(F.substring(c, 1, limit).alias("value"), (F.length(c) > limit).alias("was_cut"))


def unescaped(c: Column) -> Column:
    """The named and numeric entities that HTML writers emit by default, the ampersand last."""
    # Entities and their characters.
    pairs = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": " ",
             "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&amp;": "&"}
    for entity, character in pairs.items():
        c = F.replace(c, F.lit(entity), F.lit(character))
    return c


@F.pandas_udf(T.StringType())
def unescaped_fully(texts: pd.Series) -> pd.Series:
    """Every entity of the HTML standard."""
    return texts.map(html.unescape, na_action="ignore")


def html_to_text(c: Column, full: bool = True) -> Column:
    """Entities first, so that escaped tags are seen as tags; then tags to blanks.  ``full``: texts in
    which ``unescaped`` leaves an entity go through the whole table of the HTML standard."""
    plain = unescaped(c)
    if full:
        plain = F.coalesce(unescaped_fully(F.when(plain.rlike("&[#A-Za-z]"), c)), plain)
    return collapsed(F.regexp_replace(F.coalesce(plain, F.lit("")), r"<[^>]+>", " "))


def last_segment(url: Column) -> Column:
    return F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)


def base_name(path: Column) -> Column:
    """Lower-case last part of a path with slashes of either kind."""
    return F.lower(trimmed(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)))


def header_name(cell: Column) -> Column:
    return F.lower(F.ltrim(trimmed(cell), F.lit("﻿")))


def has_offset(c: Column) -> Column:
    """A timestamp string that says its offset; others are naive."""
    return c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")


def instant(c: Column) -> Column:
    """ISO-8601 to a timestamp, null if it is none; without an offset it counts as UTC (the session
    time zone has to be UTC)."""
    return F.try_to_timestamp(F.when(trimmed(c) != "", trimmed(c)))


def company_key(name: Column) -> Column:
    """Lower-case letters and digits, one legal-form suffix dropped."""
    n = collapsed(F.regexp_replace(F.lower(trimmed(name)), r"[^a-z0-9 ]", " "))
    forms = r"\b(?:inc|incorporated|llc|l l c|ltd|limited|corp|corporation|co|company|plc)\s*$"
    return F.btrim(F.regexp_replace(n, forms, ""))


def employment_type(title: Column) -> Column:
    """Only what the title says; null otherwise."""
    return (
        F.when(title.rlike(r"(?i)\bintern(ship)?\b"), "internship")
        .when(title.rlike(r"(?i)\bpart[- ]?time\b"), "part_time")
        .when(title.rlike(r"(?i)\b(contract|contractor|temp|temporary)\b"), "contract")
    )


def content_hash(title: Column, text: Column) -> Column:
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.sha2(F.concat(title, nul, text), 256)


def payload_key(payload: Column) -> Column:
    """Struct of hash, key in a content-addressed store, and bytes."""
    h = F.sha2(payload, 256)
    key = F.concat(F.lit("raw/"), F.substring(h, 1, 2), F.lit("/"), h)
    return F.struct(h.alias("sha256"), key.alias("key"), F.octet_length(payload).cast("long").alias("n_bytes"))


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), F.lit("_"))


def stands_alone(text: Column, phrase: Column) -> Column:
    """The phrase occurs in the text with no letter or digit beside it, in any case.  Null counts as
    no."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(F.lower(phrase), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))
    return F.coalesce(F.rlike(F.lower(text), pattern), F.lit(False))


def unsupported_numbers(text: Column, evidence: Column) -> Column:
    """Figures of the text that are no substring of the evidence, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    return F.filter(found, lambda n: ~F.contains(F.coalesce(evidence, F.lit("")), n))


def distinct_ci(values: Column, limit: int | None = None) -> Column:
    """An array without later entries that differ in case only; at most ``limit`` are kept."""
    # an array of one holds both forms, so that they are made once and not again for each entry
    both = F.array(F.struct(values.alias("v"), F.transform(values, lambda v: F.lower(v)).alias("l")))
    first = F.transform(both, lambda b: F.filter(b["v"], lambda v, i: F.array_position(b["l"], F.lower(v)) == i + 1))[0]
    return first if limit is None else F.slice(first, 1, limit)


def cleaned_list(values: Column, limit: int = 100) -> Column:
    kept = F.filter(F.transform(values, lambda v: cleaned(v)), lambda v: v.isNotNull())
    return distinct_ci(F.coalesce(kept, F.array().cast("array<string>")), limit)


def present(values: Column) -> Column:
    """Trimmed entries that are not blank."""
    return F.filter(F.transform(values, lambda v: trimmed(v)), lambda v: v != "")


def bullet_lines(lines: Column, count: int = 4, limit: int = 300) -> Column:
    """Drafted lines without control characters, bullets or numbering; the first ``count``."""
    lead = r"^\s*(?:[-•*‣◦⁃∙]+|\d+[.)])\s*"
    plain = F.transform(lines, lambda v: collapsed(F.regexp_replace(F.regexp_replace(v, CONTROL, ""), lead, "")))
    return F.slice(F.transform(F.filter(plain, lambda v: v != ""), lambda v: F.substring(v, 1, limit)), 1, count)


def in_credit_range(credits: Column) -> Column:
    return F.when((credits > 0) & (credits <= 30), credits)


def canonical_json(**fields: Column) -> Column:
    """A JSON object with its keys in sorted order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def unwrapped(code: Column) -> Column:
    """``="01.0101"``, as spreadsheets export codes with leading zeros, to ``01.0101``."""
    t = trimmed(code)
    inner = F.regexp_extract(t, r'^="(.*)"$', 1)
    return F.when(t.rlike(r'^=".*"$'), inner).otherwise(t)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(trimmed(c)).isin("true", "1", "yes"), F.lit(False))
