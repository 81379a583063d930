"""Rewrites of a description: no new figures, no lost names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocatio.functions.text import bullet_lines, stands_alone, unsupported_numbers

_TERM = re.compile(r"[A-Za-z][A-Za-z0-9+.#\-]*")
_ENDS = ".!?;:\n"


@F.pandas_udf(T.ArrayType(T.StringType()))
def protected_terms(texts: pd.Series) -> pd.Series:
    """Names that a rewrite must keep, once each in any case: words with a capital or one of + . #
    inside, and capitalized words that open no sentence.  (Needs the place of each word, which
    column functions do not give.)"""

    def of(text: str | None) -> list[str]:
        out: dict[str, str] = {}
        for m in _TERM.finditer(text or ""):
            word = m[0].rstrip(".-")
            before = text[: m.start()].rstrip(" \t")
            opens = not before.strip() or before[-1] in _ENDS
            named = any(ch.isupper() or ch in "+.#" for ch in word[1:])
            if word and (named or (word[0].isupper() and not opens)):
                out.setdefault(word.lower(), word)
        return list(out.values())

    return texts.map(of)


def lost_terms(source, produced):
    """Protected names of ``source`` that do not stand alone in ``produced``."""
    return F.filter(protected_terms(source), lambda t: ~stands_alone(produced, t))


def guarded(rewrites: DataFrame) -> DataFrame:
    """``rewrites`` (item_id, card, description, lines) judged: lines with figures that the card and
    description lack go; then a rewrite that lost a name of the description is rejected whole.

    status: ok, rejected_figures (no line left), rejected_names, too_thin (nothing drafted).
    """
    figures = F.concat_ws(" ", "card", "description")
    clean = bullet_lines(F.coalesce("lines", F.array().cast("array<string>")))
    rows = rewrites.withColumn("clean", clean)
    kept = F.filter("clean", lambda v: F.size(unsupported_numbers(v, figures)) == 0)
    rows = rows.withColumn("kept", kept).withColumn("lost", lost_terms(F.col("description"), F.array_join("kept", " ")))
    status = (
        F.when(F.size("clean") == 0, "too_thin")
        .when(F.size("kept") == 0, "rejected_figures")
        .when(F.size("lost") > 0, "rejected_names")
        .otherwise("ok")
    )
    return rows.select("item_id", status.alias("status"), "kept", (F.size("clean") - F.size("kept")).alias("n_invented"), "lost")
