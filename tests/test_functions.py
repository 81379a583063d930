import random
import re

import pytest
from pyspark.sql import functions as F

from vocatio.functions import location, redaction, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, is_us, reason, state",
    [
        ("Dublin, CA", True, "city_state_pattern:CA", "CA"),
        ("Dublin, Ireland", False, "non_us_location_match:dublin", None),
        ("US-Remote", True, "us_prefix_segment", None),
        ("Remote - US: Select locations", True, "us_token_match", None),
        ("Remote - Canada: Select locations", False, "non_us_location_match:canada", None),
        ("Remote", False, "ambiguous_remote_no_country_cue", None),
        (None, False, "no_location_data", None),
        ("  ", False, "no_location_data", None),
        ("San Francisco", True, "unambiguous_city_match:san francisco", "CA"),
        ("US-New York, US-Chicago, US-Atlanta", True, "us_prefix_segment", None),
        ("CA-Toronto, CA-Montreal, CA-Vancouver", False, "non_us_prefix_segment:ca", None),
        ("CA-San Francisco, CA-Oakland", True, "state_prefix_segment:CA", "CA"),
        ("In-Office", False, "undetermined_scope", None),
        ("On-Site", False, "undetermined_scope", None),
        ("Toronto, ON, Buffalo, NY", False, "non_us_location_match:toronto", None),
        ("Milwaukee", False, "non_us_location_match:uk", None),
        ("Mexico City", False, "non_us_location_match:mexico", None),
        ("Washington DC", True, "unambiguous_city_match:washington dc", "DC"),
        ("New York City", True, "unambiguous_city_match:new york", "NY"),
        ("NYC or SF", True, "unambiguous_city_match:sf", "CA"),
        ("Office TX", True, "state_abbreviation_token:TX", "TX"),
        ("XX-Springfield, USA", True, "country_abbreviation_match:usa", None),
    ],
)
def test_location(spark, raw, is_us, reason, state):
    got = one(spark, location.classify(F.col("raw")), raw=raw)
    assert (got.is_us, got.reason, got.state) == (is_us, reason, state)
    assert got.country == ("US" if is_us else None) and (is_us or not got.is_remote)


def test_location_by_words(spark):
    assert one(spark, location.classify(F.col("raw"), word_boundary=True), raw="Milwaukee, WI").is_us
    assert one(spark, location.classify(F.col("raw"), word_boundary=True), raw="Milwaukee").reason == "undetermined_scope"


@pytest.mark.parametrize(
    "name, key",
    [("Acme, Inc.", "acme"), ("Acme LLC", "acme"), ("Acme", "acme"), ("Acme Co Inc", "acme co"), ("L'Été Corp", "l t"), (" A  B  Ltd ", "a b"), ("Incorporated", "")],
)
def test_company_key(spark, name, key):
    assert one(spark, text.company_key(F.col("n")), n=name) == key


def test_redaction(spark):
    said = "Contact: Jane Smith or email jane@acme.com or call 415-555-0100."
    clean = one(spark, redaction.redacted(F.col("t")), t=said)
    assert clean == "Contact: [REDACTED_NAME] or email [REDACTED_EMAIL] or call [REDACTED_PHONE]."
    assert one(spark, redaction.redacted_by_spans(F.col("t")), t=said) == clean
    assert not one(spark, redaction.still_personal(F.col("t")), t=clean)
    assert [s.kind for s in one(spark, redaction.spans(F.col("t")), t=said)] == ["recruiter_name", "email", "phone"]


def test_redaction_overlap(spark):
    """The name wins, what is left of the address is an address: the exact form leaves it, and the
    check finds it."""
    left = one(spark, redaction.redacted_by_spans(F.col("t")), t="Contact: Jane.Doe@acme.com")
    assert left == "Contact: [REDACTED_NAME].Doe@acme.com"
    assert one(spark, redaction.still_personal(F.col("t")), t=left)
    assert one(spark, redaction.spans(F.col("t")), t=None) == []


@pytest.mark.parametrize(
    "haystack, needle, found",
    [
        ("Applied SQL", "sql", True),
        ("MySQL", "SQL", False),
        ("C++ and C", "C++", True),
        ("uses C++", "C", True),
        ("Built a REST API", "REST APIs", False),
        ("a.b", "a.b", True),
        ("axb", "a.b", False),
        ("x \\E y", "\\E", True),
        (None, "a", False),
        ("", "a", False),
    ],
)
def test_stands_alone(spark, haystack, needle, found):
    assert one(spark, text.stands_alone(F.col("h"), F.col("n")), h=haystack, n=needle) is found


def test_stands_alone_against_the_literal_rule(spark):
    random.seed(5)
    pieces = ["a", "b1", "+", ".", " ", "#", "É", "sql", "-"]
    rows = [("".join(random.choices(pieces, k=8)), "".join(random.choices(pieces, k=2))) for _ in range(400)]
    got = spark.createDataFrame(rows, "h string, n string").select(text.stands_alone(F.col("h"), F.col("n")).alias("x")).collect()
    for (h, n), r in zip(rows, got):
        assert r.x == (re.search(r"(?<![a-z0-9])" + re.escape(n.lower()) + r"(?![a-z0-9])", h.lower()) is not None), (h, n)


def test_small_expressions(spark):
    assert one(spark, text.html_to_text(F.col("t")), t="&lt;h2&gt;A &amp;amp; B&lt;/h2&gt;  c") == "A &amp; B c"
    assert one(spark, text.html_to_text(F.col("t"), full=True), t="caf&eacute;&nbsp;<b>x</b>") == "café x"
    assert one(spark, text.html_to_text(F.col("t")), t=None) == ""
    assert one(spark, text.last_segment(F.col("t")), t="https://x/v1/boards/stripe/") == "stripe"
    assert one(spark, text.base_name(F.col("t")), t="A\\b/Positions.CSV ") == "positions.csv"
    assert one(spark, text.slug(F.col("t")), t="  REST APIs! ") == "rest_apis"
    assert one(spark, text.unwrapped(F.col("t")), t=' ="01.0101" ') == "01.0101"
    assert one(spark, text.cleaned(F.col("t"), 5), t=" a\x00 \n b  cdef") == "a b c"
    assert one(spark, text.cleaned(F.col("t")), t=" \x00 ") is None
    assert one(spark, text.unsupported_numbers(F.col("a"), F.col("b")), a="cut 40% of 3.72", b="3.72/4.00") == ["40"]
    assert one(spark, text.unsupported_numbers(F.col("a"), F.col("b")), a=None, b=None) == []
    assert one(spark, text.distinct_ci(F.split("t", ",")), t="SQL,sql,Go,go,SQL") == ["SQL", "Go"]
    assert one(spark, text.bullet_lines(F.split("t", "\\|")), t="- a|2. b| |• c|d|e") == ["a", "b", "c", "d"]
    assert one(spark, text.content_hash(F.lit("a"), F.lit("b")), t="") == __import__("hashlib").sha256(b"a\0b").hexdigest()
    assert one(spark, text.employment_type(F.col("t")), t="Contract intern") == "internship"
    assert one(spark, text.employment_type(F.col("t")), t="Internal auditor") is None
    assert one(spark, F.unix_timestamp(text.instant(F.col("t"))), t="2026-01-01T02:00:00+02:00") == 1767225600
    assert one(spark, text.instant(F.col("t")), t="soon") is None
    assert one(spark, text.canonical_json(b=F.lit(1), a=F.col("t")), t="x") == '{"a":"x","b":1}'
