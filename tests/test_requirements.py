"""Requirements by section, degrees, majors in text, searches and vectors, against hand-made cases and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vocatio.operators import planned, search


def found(spark, *texts):
    rows = planned.requirements(spark.createDataFrame(list(enumerate(texts)), "posting_id int, text string"))
    good, bad = planned.evidenced(rows)
    assert bad.count() == 0
    return [(r.posting_id, r.excerpt, r.degree, r.years and (r.years.min_years, r.years.max_years), r.strength, r.certifications) for r in good.orderBy("posting_id", "start").collect()]


def test_lists_without_full_stops(spark):
    text = "Requirements:\nBachelor's degree\n- 3-5 years of SQL\n• PMP\nNice to have\n2. Master of Science\n* MS Office, 5 ms latency, Scrum Master\nBenefits\nGED support\n"
    assert found(spark, text) == [
        (0, "Bachelor's degree", "bachelor", None, "required", []),
        (0, "3-5 years of SQL", None, (3, 5), "required", []),
        (0, "PMP", None, None, "required", ["pmp"]),
        (0, "Master of Science", "master", None, "preferred", []),
        (0, "GED support", "hs_diploma", None, "unknown", []),
    ]


def test_headings(spark):
    heading = lambda line: planned.HEADING.fullmatch(line) is not None
    assert all(map(heading, ["Requirements", "## Anything 2024\n", "Preferred Qualifications:\n", "Skills and Experience", "What you'll bring\n", "Minimum qualifications", "You should have:"]))
    assert not any(map(heading, ["Bachelor's degree\n", "MS Office", "Scrum Master", "5 years:", "SQL and Python", "Experience with SQL", "PMP"]))
    texts = ["About us\nWe need a Ph.D. in physics. 2.5 years help.", "Requirements\n\nB.S. or M.S. in biology\nAbout the role\n10+ yrs", "", None, "no degree required"]
    assert found(spark, *texts) == [
        (0, "We need a Ph.D. in physics.", "doctorate", None, "required", []),
        (1, "B.S. or M.S. in biology", "master", None, "required", []),
        (1, "10+ yrs", None, (10, None), "unknown", []),
        (4, "no degree required", "none", None, "required", []),
    ]


@pytest.mark.parametrize(
    "text, level",
    [
        ("MS Office", None), ("5 ms", None), ("Scrum Master", None), ("Scrum Masters", None), ("master the art", None), ("MA, USA", None), ("bs", None),
        ("Masters degree", "master"), ("an MBA", "master"), ("MS in biology", "master"), ("BS/MS", "master"), ("M.S. required", "master"), ("BA in history", "bachelor"),
        ("Juris Doctor", "professional"), ("PharmD", "professional"), ("MD 20850", None), ("PhD", "doctorate"), ("associate's degree", "associate"),
        ("coding bootcamp", "bootcamp_certificate"), ("high-school diploma", "hs_diploma"), ("sales associate", None),
    ],
)
def test_degrees(spark, text, level):
    assert spark.range(1).select(planned.degree_level(F.lit(text)).alias("d")).first().d == level


def test_majors_in_text(spark):
    aliases = [("Engineering", "14"), ("Computer Engineering", "14.0901"), ("EECS", "14.0901"), ("CS", "11.0701"), ("CS", "11.0101"), ("design", "50.0401"), ("design", "11.0801"), ("Nursing", "51.38"), ("Nursing", "51.3801"), ("nursing", "51.3808"), ("", "99")]
    texts = ["A degree in engineering.", "Computer Engineering or eecs; engineering too", "CS majors", "design", "NURSING!", "nothing; physics", None, "biocs"]
    got = planned.majors_named(spark.createDataFrame(list(enumerate(texts)), "posting_id int, text string"), spark.createDataFrame(aliases, "alias string, cip_code string"))
    assert sorted((r.posting_id, r.cip_code, r.alias, r.start) for r in got.collect()) == [
        (0, "14", "engineering", 13), (1, "14.0901", "computer engineering", 1), (1, "14.0901", "eecs", 25), (2, "11", "cs", 1), (4, "51.38", "nursing", 1),
    ]


def test_an_alias_does_not_overlap_itself(spark):
    """As its SQL splits a text by the alias, which a place inside a word uses up too."""
    texts = ["der der der der der", "der der", "Inder der der", "der der, der der", "aha aha ahab aha aha aha"]
    aliases = spark.createDataFrame([("der der", "09.0101"), ("aha aha", "06.01"), ("ahab aha", "11")], "alias string, cip_code string")
    got = planned.majors_named(spark.createDataFrame(list(enumerate(texts)), "posting_id int, text string"), aliases)
    assert sorted((r.posting_id, r.alias, r.start) for r in got.collect()) == [
        (0, "der der", 1), (0, "der der", 9), (1, "der der", 1), (3, "der der", 1), (3, "der der", 10),
        (4, "aha aha", 1), (4, "aha aha", 14), (4, "ahab aha", 9),
    ]


@pytest.mark.parametrize("most", [1, 3, 100_000])
def test_the_number_of_parts_changes_no_major(spark, monkeypatch, most):
    """Of overlapping aliases the longest counts, whichever parts they are looked up in."""
    parts = planned.scan.parts
    monkeypatch.setattr(planned.scan, "parts", lambda phrases: parts(phrases, most))
    aliases = [("engineering", "14"), ("computer engineering", "15.0901"), ("computer", "11.01"), ("art", "50.07"), ("art of computer engineering", "16"), ("engineering art", "50.01"), ("of", "09")]
    texts = ["Computer Engineering", "the art of computer engineering", "engineering; computer of", "computer engineering art", "art art", None]
    rows = [*enumerate(texts), (0, "an art"), (0, texts[0]), (None, texts[0]), (None, "an art")]
    got = planned.majors_named(spark.createDataFrame(rows, "posting_id int, text string"), spark.createDataFrame(aliases, "alias string, cip_code string"))
    assert sorted((-1 if r.posting_id is None else r.posting_id, r.alias, r.start) for r in got.collect()) == [
        (-1, "art", 4), (-1, "computer engineering", 1), (0, "art", 4), (0, "computer engineering", 1), (0, "computer engineering", 1),
        (1, "art of computer engineering", 5), (2, "computer", 14), (2, "engineering", 1), (2, "of", 23), (3, "computer engineering", 1),
        (3, "engineering art", 10), (4, "art", 1), (4, "art", 5),
    ]


def test_prefixes_against_brute_force(spark):
    random.seed(4)
    word = lambda: "".join(random.choices("abé ", k=random.randint(1, 6)))
    titles = [(f"c{k}", word().title()) for k in range(150)]
    others = [(random.choice(titles)[0], word()) for _ in range(200)]
    terms = [(k, word()) for k in range(80)] + [(100, "A"), (101, None), (102, " AB ")]
    t, a, q = spark.createDataFrame(titles, "onet_soc_code string, title string"), spark.createDataFrame(others, "onet_soc_code string, alt_title string"), spark.createDataFrame(terms, "query_id int, term string")
    got = sorted((r.query_id, r.place, r.onet_soc_code, r.matched_on) for r in search.by_prefix(q, t, a, limit=4).collect())
    want = []
    for i, term in terms:
        term = (term or "").strip(" ").lower()
        if len(term) < 2:
            continue
        best = {}
        for c, name in titles:
            if name.lower().startswith(term):
                best[c] = 0
        for c, name in others:
            if name.lower().startswith(term):
                best.setdefault(c, 1)
        order = sorted((tier, dict(titles)[c], c) for c, tier in best.items())[:4]
        want += [(i, n, c, ("title", "alt_title")[tier]) for n, (tier, _, c) in enumerate(order, 1)]
    assert got == sorted(want) and got


def test_words_against_brute_force(spark):
    random.seed(6)
    docs = [(f"d{k:03}", " ".join(random.choices(["the", "data", "Ingénieur", "of", "nurse", "x1"], [9, 2, 1, 6, 1, 1], k=random.randint(0, 8)))) for k in range(200)]
    queries = [(0, "the data"), (1, 'the "data of"'), (2, "ingenieur"), (3, "the zzz"), (4, ""), (5, "The OF nurse"), (6, '"the the"')]
    index = search.build_index(spark.createDataFrame(docs, "doc_key string, text string"))
    got = search.by_words(spark.createDataFrame(queries, "query_id int, query string"), index, limit=5).collect()
    words = {d: t.lower().replace("é", "e").split() for d, t in docs}
    n, mean = sum(map(bool, words.values())), sum(map(len, words.values())) / sum(map(bool, words.values()))
    need = {0: ["the", "data"], 1: ["the", "data", "of"], 2: ["ingenieur"], 3: ["the", "zzz"], 5: ["the", "of", "nurse"], 6: ["the"]}
    pairs = {1: ("data", "of"), 6: ("the", "the")}
    want = []
    for i, terms in need.items():
        scored = []
        for d, w in words.items():
            if all(t in w for t in terms) and (i not in pairs or pairs[i] in list(zip(w, w[1:]))):
                df = lambda t: sum(t in x for x in words.values())
                score = sum(math.log(1 + (n - df(t) + 0.5) / (df(t) + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms)
                scored.append((-round(score, 9), d))
        want += [(i, k, d) for k, (_, d) in enumerate(sorted(scored)[:5], 1)]
    assert {(r.query_id, round(r.score, 6)) for r in got} and sorted((r.query_id, r.place) for r in got) == sorted((i, k) for i, k, _ in want)
    assert {r.query_id: r.doc_key for r in got if r.place == 1}.keys() == {i for i, k, _ in want if k == 1}
    assert len({(r.query_id, r.doc_key) for r in got} & {(i, d) for i, _, d in want}) >= len(want) - 2  # scores that tie but for rounding


def test_references_in_parts_and_of_several_lengths(spark):
    random.seed(9)
    vector = lambda n: [random.gauss(0, 1) for _ in range(n)]
    vectors = [(k, vector(3 if k % 2 else 5)) for k in range(60)] + [(90, None), (91, [0.0] * 3), (92, [None, 1.0, 2.0]), (93, vector(7)), (94, [])]
    references = [(f"c{k}", vector(3 if k % 3 else 5)) for k in range(25)] + [("n", None), ("z", [0.0] * 5)]
    v, r = spark.createDataFrame(vectors, "posting_id int, vector array<double>"), spark.createDataFrame(references, "code string, reference array<double>")
    whole = {x.posting_id: (x.code, round(x.confidence, 9)) for x in planned.cosine_titles(v, r, least=0.4).collect()}
    parts = {x.posting_id: (x.code, round(x.confidence, 9)) for x in planned.cosine_titles(v, r, least=0.4, part=4).collect()}
    assert whole == parts and whole
    for k, x in vectors[:60]:
        cos = [(sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y)), c) for c, y in references[:25] if len(y) == len(x)]
        best = max(cos)
        assert (k in whole) == (best[0] >= 0.4) and (k not in whole or whole[k][0] == best[1])
