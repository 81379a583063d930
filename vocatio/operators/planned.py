"""SPEC: operators that are specified for later phases: classification, requirements, links to
majors, freshness, review, and the questions they answer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio.functions.text import collapsed
from vocatio.operators import phrases as scan

PART_REFERENCES = 20_000
YEARS = r"(?i)(?<![\d.])(?:(\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})\s*\+?\s*(?:years|yrs)|(\d{1,2})\s*(\+?)\s*(?:or more\s+)?(?:years|yrs))"
# The seven levels of a degree.  How they are written is this module's own.
DEGREE_WORDS = [
    ("doctorate", r"(?i)\b(ph\.?\s?d\b|doctorate|doctoral)"),
    (
        "professional",
        r"(?i)\b(juris doctor|doctor of (medicine|pharmacy|dental|veterinary)|professional degree|pharm\.?\s?d\b|[jm]\.d\.|d\.d\.s\.|d\.v\.m\.|(jd|md|dds|dvm) (degree|required|preferred))",
    ),
    (
        "master",
        r"(?i)(\bmaster['’]s\b|(?<!scrum )\bmasters\b(?! of)|\bmasters? (of (arts|science|business|engineering|education|public|fine|social|laws)|in|degree)\b"
        r"|\bmba\b|\bmsc\b|\bm\.\s?(s|a|sc|ed|eng)\.|\b(ms|ma) (degree|in)\b|\b(bs|ba) ?(/|or) ?(ms|ma)\b)",
    ),
    ("bachelor", r"(?i)(\bbachelor['’]?s?\b|\bbsc\b|\bb\.\s?(s|a|sc|eng)\.|\b(bs|ba) (degree|in|or)\b|\b(bs|ba) ?/)"),
    ("associate", r"(?i)(\bassociate['’]?s? degree\b|\bassociate of (arts|science|applied)|\ba\.a\.(s\.)?)"),
    ("bootcamp_certificate", r"(?i)\b(boot ?camp|certificate)\b"),
    ("hs_diploma", r"(?i)\b(high[- ]school|secondary school|h\.?s\.? diploma|ged)\b"),
]
# Certifications that postings name, and how they are written: a hand-made list, to be added to.
CERTIFICATIONS = [
    ("aws_certified", r"(?i)\baws certified\b"),
    ("cissp", r"(?i)\bcissp\b"),
    ("comptia_security_plus", r"(?i)\b(comptia )?security\+"),
    ("comptia_a_plus", r"(?i)\bcomptia a\+"),
    ("ccna", r"(?i)\bccna\b"),
    ("pmp", r"(?i)\b(pmp|project management professional)\b"),
    ("scrum_master", r"(?i)\b(csm|certified scrum ?master)\b"),
    ("six_sigma", r"(?i)\bsix sigma\b"),
    ("cpa", r"(?i)\b(cpa|certified public accountant)\b"),
    ("cfa", r"(?i)\b(cfa|chartered financial analyst)\b"),
    ("shrm_cp", r"(?i)\bshrm-c[ps]\b"),
    ("rn", r"(?i)\b(rn license|registered nurse license|licensed registered nurse)\b"),
    ("bls", r"(?i)\b(bls|basic life support)\b"),
    ("acls", r"(?i)\bacls\b"),
    ("pe", r"(?i)\b(professional engineer license|pe license)\b"),
    ("fe", r"(?i)\b(fe exam|engineer in training|eit)\b"),
    ("osha_30", r"(?i)\bosha[- ]?30\b"),
    ("cdl", r"(?i)\b(cdl|commercial driver'?s license)\b"),
    ("servsafe", r"(?i)\bservsafe\b"),
    ("teaching", r"(?i)\bteaching (certificate|certification|license)\b"),
]
CUE_PREFERRED = r"(?i)\b(preferred|nice to have|a plus|bonus|desired)\b"
CUE_REQUIRED = r"(?i)\b(required|must|minimum|need)\b"
HEADING_PREFERRED = r"(?i)\b(preferred|nice[- ]to[- ]haves?|bonus|desired)\b"
HEADING_REQUIRED = r"(?i)\b(required|requirements?|qualifications|must[- ]haves?|minimum|(you['’]ll|you will|you) (need|bring))\b"
#: A sentence ends at its sign or at the line's end, but not inside a number or after an initial.
SENTENCE_END = re.compile(r"(?<=[!?\n])|(?<=\.)(?<!\b[A-Za-z]\.)(?<!\bPh\.)(?:(?<!\d\.)|(?!\d))")
BULLET = re.compile(r"\s*(?:[-*•‣▪–]+|\d{1,2}[.)])\s+|\s+")
_KIND = r"(?:minimum|basic|required|preferred|desired|additional|key|job|core|main|our|your|the|position|other|technical)"
_HEAD = (
    r"(?:requirements?|qualifications?|skills|experience|education|responsibilities|duties|benefits|perks|compensation"
    r"|nice[- ]to[- ]haves?|must[- ]haves?|bonus(?: points)?|preferred|required|desired|about (?:us|you|the (?:role|job|team|company|position))"
    r"|who (?:you|we) are|what (?:you['’]ll|you will|you|we) (?:do|need|bring|offer|have)|how to apply|equal opportunity)"
)
HEADING = re.compile(rf"\s*(?:#+\s*\S[^\n]*|[^\n.!?\d]{{1,70}}:|(?:{_KIND}\s+)*{_HEAD}(?:\s*(?:and|&|/)\s*(?:{_KIND}\s+)*{_HEAD})*)\s*", re.I)


def sentences(text: str) -> Iterator[tuple[int, str, str]]:
    """(start from 1, sentence, heading above it) of a text, line by line: a line is a heading (a mark
    before it, a colon behind it, or nothing but the words that headings are made of), an entry of a
    list, or part of a paragraph.  A heading holds until the next one."""
    at, above, line_start = 0, "", True
    for piece in SENTENCE_END.split(text):
        end = at + len(piece)
        bullet = BULLET.match(piece) if line_start else None
        listed = bullet is not None and bullet[0].strip() != ""
        if line_start and not listed and (piece.endswith("\n") or end == len(text)) and HEADING.fullmatch(piece):
            above = piece.strip()
        else:
            lead = len(bullet[0]) if bullet else len(piece) - len(piece.lstrip())
            sentence = piece[lead:].rstrip()
            if sentence:
                yield at + lead + 1, sentence, above
        line_start = piece.endswith("\n")
        at = end


def title_key(title: Column) -> Column:
    return collapsed(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", " "))


def trigrams(key: Column) -> Column:
    padded = F.concat(F.lit("  "), key, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))


def exact_titles(postings: DataFrame, names: DataFrame) -> DataFrame:
    """Tier 1: (posting_id, code, confidence 0.90, method) where normalized titles agree."""
    p = postings.select("posting_id", title_key(F.col("title")).alias("key"))
    n = names.select("code", title_key(F.col("name")).alias("key")).distinct()
    return p.join(n, "key").select("posting_id", "code", F.lit(0.90).alias("confidence"), F.lit("exact").alias("method"))


def fuzzy_titles(postings: DataFrame, names: DataFrame, least: float = 0.5) -> DataFrame:
    """Tier 2: best code by trigram Jaccard of ``least`` or more, confidence from 0.70 to 0.85.  Sets
    meet on the first trigrams of each in one order, which loses no pair; null titles find nothing."""
    titles = postings.select(title_key(F.col("title")).alias("key")).distinct()
    p = titles.select("key", trigrams(F.col("key")).alias("g"))
    n = names.select("code", title_key(F.col("name")).alias("name_key")).distinct().select("code", "name_key", trigrams(F.col("name_key")).alias("ng"))

    def head(g: Column) -> Column:
        # in one order for all, sets that agree in `least` share a gram of these
        order = F.sort_array(F.transform(g, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("gram"))))
        return F.slice(order["gram"], F.lit(1), F.size(g) - F.ceil(least * F.size(g) - 1e-9).cast("int") + 1)

    met = p.select("key", "g", F.explode(head(F.col("g"))).alias("gram")).join(
        n.select("code", "name_key", "ng", F.explode(head(F.col("ng"))).alias("gram")), "gram"
    )
    pairs = met.groupBy("key", "code", "name_key").agg(F.first("g").alias("g"), F.first("ng").alias("ng"))
    both = pairs.select("key", "code", "name_key", F.size("g").alias("a"), F.size("ng").alias("b"), F.size(F.array_intersect("g", "ng")).alias("n"))
    both = both.withColumn("similarity", F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).filter(F.col("similarity") >= least)
    best = both.groupBy("key").agg(F.min_by(F.struct("code", "similarity"), F.struct(-F.col("similarity"), "code")).alias("b"))
    scaled = F.round(0.70 + 0.15 * (F.col("b.similarity") - least) / (1 - least), 6)
    hit = best.select("key", "b.code", scaled.alias("confidence"), F.lit("fuzzy").alias("method"))
    return postings.select("posting_id", title_key(F.col("title")).alias("key")).join(hit, "key").drop("key")


def _nearest(known: dict[int, tuple[list, np.ndarray]], vectors: pa.Array, least: float) -> tuple[list, list]:
    """Code (or none) and cosine of the best reference of each vector, of those of its own length."""
    codes: list = [None] * len(vectors)
    best = np.zeros(len(vectors))
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dim, (names, units) in known.items():
        at = np.flatnonzero(size == dim)
        if not len(at) or not dim:
            continue
        v = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
        length = np.sqrt((v * v).sum(1))
        cos = v @ units.T / np.maximum(length, 1e-300)[:, None]
        place = cos.argmax(1)
        top = cos[np.arange(len(at)), place]
        for k in np.flatnonzero((top >= least) & (length > 0)).tolist():
            codes[at[k]], best[at[k]] = names[place[k]], top[k]
    return codes, best.tolist()


def cosine_titles(vectors: DataFrame, references: DataFrame, least: float = 0.5, part: int = PART_REFERENCES) -> DataFrame:
    """Tier 3 (not in the default cascade): for each of ``vectors`` (posting_id, vector) the best of
    ``references`` (code, reference) by cosine, ties to the lower code.

    References go to the tasks in parts of about ``part`` by hash, one part in memory at a time; each
    part gives each vector its best, and the best of these counts, so there is no limit to their
    number.  Vectors meet references of their own length only; null vectors, those with a null in
    them, and those of length zero are left out on both sides."""
    kind = vectors.schema["posting_id"].dataType.simpleString()

    def usable(vector: str) -> Column:
        v = F.col(vector)
        return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)

    known = references.select("code", F.col("reference").cast("array<double>").alias("reference")).filter(usable("reference"))
    asked = vectors.select("posting_id", F.col("vector").cast("array<double>").alias("vector")).filter(usable("vector"))
    asked = asked.withColumn("_row", F.monotonically_increasing_id())
    parts = max(1, int(np.ceil(known.count() / part)))
    context, found = vectors.sparkSession.sparkContext, None
    for k in range(parts):
        rows = known.filter(F.pmod(F.xxhash64("code", "reference"), F.lit(parts)) == k).orderBy("code").collect()
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r["reference"]), []).append(r)
        held = {}
        for dim, members in by_dim.items():
            m = np.array([r["reference"] for r in members], np.float64)
            held[dim] = [r["code"] for r in members], m / np.sqrt((m * m).sum(1, keepdims=True))
        shared = context.broadcast(held)

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, best = _nearest(shared.value, batch.column(1), least)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array(best)], names=["posting_id", "_row", "code", "cosine"])

        one = asked.mapInArrow(nearest, f"posting_id {kind}, _row long, code string, cosine double").filter("code IS NOT NULL")
        found = one if found is None else found.unionByName(one)
    if parts > 1:
        best = F.min_by(F.struct("posting_id", "code", "cosine"), F.struct(-F.col("cosine"), "code"))
        found = found.groupBy("_row").agg(best.alias("b")).select("b.*")
    confidence = F.least(0.5 + 0.2 * (F.col("cosine") - least) / (1 - least), F.lit(0.7))
    return found.select("posting_id", "code", confidence.alias("confidence"), F.lit("vector").alias("method"))


def cascade(*tiers: DataFrame) -> DataFrame:
    """All classifications, one of each posting primary: the most confident, then by code."""
    rows = tiers[0]
    for t in tiers[1:]:
        rows = rows.unionByName(t)
    best = Window.partitionBy("posting_id").orderBy(F.desc("confidence"), "code")
    return rows.withColumn("is_primary", F.row_number().over(best) == 1)


def tier_quality(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """method, n, correct, precision, recall against ``truth`` (posting_id, code)."""
    total = F.lit(truth.count())
    joined = predicted.join(truth.withColumnRenamed("code", "truth"), "posting_id")
    by = joined.groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("code") == F.col("truth")).alias("correct"))
    return by.select("method", "n", "correct", F.round(F.col("correct") / F.col("n"), 6).alias("precision"), F.round(F.col("correct") / total, 6).alias("recall"))


def confusion(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of wrong and right codes by how often they occur."""
    joined = predicted.join(truth.withColumnRenamed("code", "truth"), "posting_id").filter("code <> truth")
    return joined.groupBy("code", "truth").agg(F.count("*").alias("n"))


def years(text: Column) -> Column:
    """Struct min_years, max_years of ``3-5 years``, ``5+ years`` or ``2 years``; null if none."""
    g = lambda k: F.nullif(F.regexp_extract(text, YEARS, k), F.lit("")).cast("int")
    low, high, single = g(1), g(2), g(3)
    plus = F.regexp_extract(text, YEARS, 4) == "+"
    value = F.struct(F.coalesce(low, single).alias("min_years"), F.coalesce(high, F.when(~plus, single)).alias("max_years"))
    return F.when(text.rlike(YEARS), value)


def degree_level(text: Column) -> Column:
    """Highest of the degree words, or ``none`` if it says that none is needed; null if it says nothing."""
    out = F.when(text.rlike(r"(?i)no degree (is )?required"), "none")
    for name, pattern in DEGREE_WORDS:
        out = out.when(text.rlike(pattern), name)
    return out


def strength(sentence: Column, heading: Column | None = None) -> Column:
    """By a cue in the sentence, else by the heading above it."""
    out = F.when(sentence.rlike(CUE_PREFERRED), "preferred").when(sentence.rlike(CUE_REQUIRED), "required")
    if heading is not None:
        out = out.when(heading.rlike(HEADING_PREFERRED), "preferred").when(heading.rlike(HEADING_REQUIRED), "required")
    return out.otherwise("unknown")


def certifications(text: Column) -> Column:
    """Names of the certifications that the text asks for."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), name) for name, pattern in CERTIFICATIONS]))


def requirements(postings: DataFrame) -> DataFrame:
    """Sentences and list entries of ``postings`` (posting_id, text) that state years, a degree, a
    certification or a clearance, with their offsets in code points (start counts from 1).  Required
    or preferred by a cue, else by the heading above (``sentences``)."""
    rows = postings.select("posting_id", "text")
    kind = rows.schema["posting_id"].dataType.simpleString()
    item = pa.struct([("start", pa.int32()), ("sentence", pa.string()), ("above", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("start", "sentence", "above"), x)) for x in sentences(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(item))], names=["posting_id", "text", "s"])

    rows = rows.mapInArrow(cut, f"posting_id {kind}, text string, s array<struct<start:int,sentence:string,above:string>>")
    s = F.col("x.sentence")
    rows = rows.select("posting_id", "text", F.explode("s").alias("x")).select(
        "posting_id", "text", F.col("x.start").alias("start"), F.substring(s, 1, 300).alias("excerpt"), years(s).alias("years"),
        degree_level(s).alias("degree"), s.rlike(r"(?i)\b(clearance|ts/sci)\b").alias("clearance"), strength(s, F.col("x.above")).alias("strength"),
        certifications(s).alias("certifications"),
    )
    return rows.filter("years IS NOT NULL OR degree IS NOT NULL OR clearance OR size(certifications) > 0")


def evidenced(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose excerpt stands at its offset, and the others."""
    there = F.substring(F.col("text"), F.col("start"), F.length("excerpt")) == F.col("excerpt")
    good = F.coalesce(there & (F.length("excerpt") <= 300), F.lit(False))
    return found.filter(good), found.filter(~good)


def explicit_links(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Postings (posting_id, alias) to majors by alias, the most specific level.  Which major an alias
    stands for does not depend on the posting, so it is settled before the postings meet it."""
    best = aliases.groupBy(F.lower("alias").alias("alias")).agg(F.max_by("cip_code", F.struct("level", "cip_code")).alias("cip_code"))
    met = texts.select("posting_id", F.lower("alias").alias("alias")).join(scan.sent(best), "alias")
    return met.select("posting_id", "cip_code", F.lit("explicit").alias("link_type")).distinct()


def alias_codes(aliases: DataFrame) -> DataFrame:
    """(alias, cip_code): the most specific major that an alias (alias, cip_code) supports: its only
    code, or the family that all its codes are in, of four digits or two; none if they have none in
    common.  Codes under a code that is there as well do not make an alias less certain."""
    rows = aliases.select(F.lower("alias").alias("alias"), "cip_code").filter("alias <> ''").distinct()
    shared = lambda n: F.when(F.count_distinct(F.substring("cip_code", 1, n)) == 1, F.min(F.substring("cip_code", 1, n)))
    deepest = F.max(F.length("cip_code")).over(Window.partitionBy("alias"))
    rows = rows.withColumn("_deepest", deepest).filter(F.length("cip_code") == F.col("_deepest"))
    one = F.when(F.count("*") == 1, F.min("cip_code"))
    return rows.groupBy("alias").agg(F.coalesce(one, shared(5), shared(2)).alias("cip_code")).filter("cip_code IS NOT NULL")


def majors_named(postings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Majors that ``postings`` (posting_id, text) name by an alias (alias, cip_code) that stands
    alone, in any case: posting_id, cip_code, alias, start (from 1) and link_type, one row for each
    place.  Of overlapping aliases the longest counts ("Computer Engineering" is not "Engineering"),
    an alias is counted from the left without overlapping itself ("der der" once in "der der der"),
    and a code gives way to one below it that the posting names too.  Offsets are those of the
    lower-cased text.  Aliases are looked up in parts, and the longest of a text's places is found
    over all of them, so that it does not matter how many there are.  Repeated rows count each time."""
    codes = alias_codes(aliases)
    texts = postings.select("posting_id", F.xxhash64("text").alias("_text"), "text")
    found = None
    for part in scan.parts(codes.select(F.col("alias").alias("phrase"))):
        hits = scan.scanned(texts, part, ["posting_id", "_text"], spans=True)
        hits = hits.select("posting_id", "_text", F.explode("hits").alias("x")).select("posting_id", "_text", "x.start", "x.end", F.col("x.phrase").alias("alias"))
        found = hits if found is None else found.unionByName(hits)
    # by start, then the longer one first; places that are equal come from repeated rows
    order = F.shiftleft(F.col("start").cast("long"), 32) - F.col("end")
    before = Window.partitionBy("posting_id", "_text").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_before", F.max("end").over(before)).filter("_before IS NULL OR end > _before")
    found = found.drop("_text", "_before").join(codes, "alias")
    named = found.select("posting_id", "cip_code").distinct()
    families = named.select("posting_id", F.explode(F.array(F.substring("cip_code", 1, 2), F.substring("cip_code", 1, 5))).alias("above"), "cip_code")
    below = families.filter("above <> cip_code").select("posting_id", F.col("above").alias("cip_code")).distinct()
    kept = found.join(below, ["posting_id", "cip_code"], "left_anti")
    return kept.select("posting_id", "cip_code", "alias", (F.col("start") + 1).alias("start"), F.lit("explicit").alias("link_type"))


def inferred_links(classified: DataFrame, pairs: DataFrame) -> DataFrame:
    """Postings to majors through occupations: confidence falls with the occupation's fan-out."""
    fan = pairs.groupBy("code").agg(F.count_distinct("cip_code").alias("fan_out"))
    met = classified.join(pairs, "code").join(fan, "code")
    value = F.round(F.least(F.lit(0.60), F.col("confidence") / F.log2(2.0 + F.col("fan_out"))), 6)
    return met.groupBy("posting_id", "cip_code").agg(F.max(value).alias("confidence")).withColumn("link_type", F.lit("inferred"))


def refreshed(heads: DataFrame, listing: DataFrame, crawled: DataFrame, now: Column, stale_days: int = 45) -> DataFrame:
    """Heads (source_id, source_posting_id, status, last_seen_at, misses) after a listing: seen ones
    are active; ones absent from two good crawls are closed; a failed crawl (``crawled``: source_id,
    ok) changes nothing; active ones unseen for long are stale."""
    seen = listing.select("source_id", "source_posting_id", F.lit(True).alias("seen")).distinct()
    rows = heads.join(seen, ["source_id", "source_posting_id"], "left").join(crawled, "source_id", "left")
    ok, here = F.coalesce("ok", F.lit(False)), F.coalesce("seen", F.lit(False))
    misses = F.when(~ok, F.col("misses")).when(here, 0).otherwise(F.col("misses") + 1)
    rows = rows.withColumn("misses", misses).withColumn("last_seen_at", F.when(ok & here, now).otherwise(F.col("last_seen_at")))
    old = F.datediff(now, F.col("last_seen_at")) > stale_days
    status = F.when(ok & here, "active").when(ok & (F.col("misses") >= 2), "closed").when((F.col("status") == "active") & old, "stale").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*heads.columns)


def ledger(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per source: postings, and how many became active, stale or closed."""
    keys = ["source_id", "source_posting_id"]
    met = after.join(before.select(*keys, F.col("status").alias("was")), keys, "left")
    turned = lambda s: F.count_if((F.col("status") == s) & ~F.col("was").eqNullSafe(F.lit(s))).alias(f"became_{s}")
    return met.groupBy("source_id").agg(F.count("*").alias("n"), *[turned(s) for s in ("active", "stale", "closed")])


def review_queue(classified: DataFrame, failed: DataFrame, ambiguous: DataFrame, views: DataFrame, below: float = 0.75, top: int = 20) -> DataFrame:
    """(subject, reason): unsure classifications, failures, ambiguous names, most viewed postings."""
    unsure = classified.filter(F.col("is_primary") & (F.col("confidence") < below)).select(F.col("posting_id").cast("string").alias("subject"), F.lit("low_confidence").alias("reason"))
    lost = failed.select(F.col("url").alias("subject"), F.lit("failed").alias("reason"))
    names = ambiguous.select(F.col("normalized_name").alias("subject"), F.lit("ambiguous").alias("reason"))
    seen = views.orderBy(F.desc("n_views"), "posting_id").limit(top).select(F.col("posting_id").cast("string").alias("subject"), F.lit("top_viewed").alias("reason"))
    return unsure.unionByName(lost).unionByName(names).unionByName(seen).distinct()


# Confidences below which each kind of entity is reviewed.
REVIEWED_BELOW = {"posting_occupation": 0.60, "posting_major": 0.70, "posting_requirement": 0.50}


def review_items(confidences: DataFrame, misplaced: DataFrame, ambiguous: DataFrame, views: DataFrame, below: dict[str, float] | None = None, top: int = 20) -> DataFrame:
    """Items to review: entity_type, entity_id, reason, priority and status ``pending``.

    ``confidences`` (entity_type, entity_id, confidence) below their kind's threshold, the more so the
    further below; ``misplaced`` requirements (entity_id) whose excerpt is not at its offset, before
    all others; ``ambiguous`` company names (entity_id); and, whatever their confidence, the ``top``
    most viewed pairs of major and company of ``views`` (cip_code, company_id, n_views; a pair's rows
    add up).  One row for each entity and reason."""
    limits = F.create_map(*[F.lit(x) for kind in (below or REVIEWED_BELOW).items() for x in kind])
    limit = F.try_element_at(limits, F.col("entity_type"))
    unsure = confidences.filter(F.col("confidence") < limit).groupBy("entity_type", "entity_id").agg(F.max(F.round(limit - F.col("confidence"), 6)).alias("priority"))
    unsure = unsure.select("entity_type", "entity_id", F.lit("low_confidence").alias("reason"), "priority")

    def all_of(rows: DataFrame, kind: str, reason: str, priority: float) -> DataFrame:
        return rows.select(F.lit(kind).alias("entity_type"), "entity_id", F.lit(reason).alias("reason"), F.lit(priority).alias("priority")).distinct()

    seen = views.groupBy("cip_code", "company_id").agg(F.sum("n_views").alias("n")).orderBy(F.desc("n"), "cip_code", "company_id").limit(top)
    seen = seen.select(F.concat_ws(" ", "cip_code", "company_id").alias("entity_id"))
    items = unsure.unionByName(all_of(misplaced, "posting_requirement", "evidence_offset", 1.0)).unionByName(all_of(ambiguous, "company_merge", "ambiguous_company", 0.8))
    return items.unionByName(all_of(seen, "posting_major", "high_traffic", 0.5)).withColumn("status", F.lit("pending"))


def corrected(classified: DataFrame, corrections: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Classifications with the reviewers' codes (posting_id, code, reviewer) in place, and the log
    rows to append."""
    c = corrections.select("posting_id", F.col("code").alias("new_code"), "reviewer")
    rows = classified.join(c, "posting_id", "left")
    log = rows.filter("new_code IS NOT NULL AND is_primary").select("posting_id", F.col("code").alias("old_code"), "new_code", "reviewer", now.alias("at"))
    kept = rows.withColumn("code", F.coalesce("new_code", "code")).withColumn("method", F.when(F.col("new_code").isNotNull(), "review").otherwise(F.col("method")))
    return kept.select(*classified.columns), log


def hiring_companies(links: DataFrame, postings: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Companies per major by active postings of the last ``days``."""
    recent = postings.filter((F.col("status") == "active") & (F.datediff(now, F.col("posted_at")) <= days))
    return links.join(recent, "posting_id").groupBy("cip_code", "company_id").agg(F.count_distinct("posting_id").alias("n_postings"))


def top_credentials(found: DataFrame, n: int = 25) -> DataFrame:
    """The credentials asked for most, each with one excerpt."""
    rows = found.groupBy("credential").agg(F.count("*").alias("n"), F.min_by("excerpt", F.struct("posting_id", "start")).alias("example"))
    return rows.orderBy(F.desc("n"), "credential").limit(n)


def years_by_degree(found: DataFrame) -> DataFrame:
    return found.groupBy("degree", "min_years").agg(F.count("*").alias("n"))


def years_percentiles(found: DataFrame, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per degree, how many state min_years, and its percentiles (interpolated)."""
    stated = found.filter("min_years IS NOT NULL")
    return stated.groupBy("degree").agg(F.count("*").alias("n"), *[F.percentile("min_years", p).alias(f"p{round(100 * p)}") for p in at])


def asked_credentials(found: DataFrame) -> DataFrame:
    """Degrees and certifications of requirement rows, one row each: posting_id, start, excerpt,
    credential."""
    both = F.array_compact(F.concat(F.array("degree"), F.col("certifications")))
    return found.select("posting_id", "start", "excerpt", F.explode(both).alias("credential")).filter("credential <> 'none'")


def link_counts(links: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("link_type") == t).alias(t) for t in ("explicit", "inferred")]
    return links.groupBy("cip_code").agg(*counts)


def naming_postings(links: DataFrame, sentences: DataFrame) -> DataFrame:
    """Postings that name a major, with the sentence (posting_id, alias, sentence)."""
    return links.filter("link_type = 'explicit'").join(sentences, "posting_id").filter(F.contains(F.lower("sentence"), F.lower("alias")))
