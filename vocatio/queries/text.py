"""Queries over texts: expressions on one row."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocatio.functions import location, redaction, text
from vocatio.functions.location import CITIES, MARKERS, STATES
from vocatio.queries.adapters import LOCATED, NAMED, TITLED, derived, plain, table


def html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.html_to_text(F.col("html")).alias("text"), text.last_segment(F.col("url")).alias("last_segment"))


HTML_TEXT = r"""
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
  html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&copy;', '©'),
  '&middot;', '·'), '&ndash;', '–'), '&mdash;', '—'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text,
  regexp_extract(rtrim(url, '/'), '[^/]*$') AS last_segment
FROM pages
"""


_ENTITIES = """
SELECT page_id, concat('<p>&#', CAST(8200 + page_id % 20 AS STRING), ';x&#x', lower(hex(913 + page_id % 17)), '; caf&eacute; &rsquo;tis &bull; A&amp;amp;B &hellip;</p>', url) AS html FROM @pages
"""


def entity_text(spark, sf_dir):
    """Named and numeric entities beyond those that the native pass knows."""
    return derived(spark, sf_dir, _ENTITIES).select("page_id", text.html_to_text(F.col("html")).alias("text"))


# white space among the numeric entities is one blank; the others are the characters themselves
ENTITY_TEXT = r"""
SELECT page_id, trim(regexp_replace(concat(' ', chr((8200 + page_id % 20)::INT), 'x', chr((913 + page_id % 17)::INT),
  ' café ’tis • A&amp;B … ', url), '[\s\x{2000}-\x{200A}]+', ' ', 'g')) AS text FROM pages
"""


def payload_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.payload_key(F.col("html")).alias("k")).select("page_id", "k.*")


PAYLOAD_KEYS = """
SELECT page_id, sha256(html) AS sha256, concat('raw/', substr(sha256(html), 1, 2), '/', sha256(html)) AS key, strlen(html)::BIGINT AS n_bytes
FROM pages
"""


def redacted_documents(spark, sf_dir):
    """Redacted and checked texts; where there is no text, there is neither a hash nor a verdict."""
    d = table(spark, sf_dir, "documents")
    clean = redaction.redacted(F.col("text"))
    return d.select("doc_id", F.sha2(clean, 256).alias("clean_sha256"), redaction.personal(clean).alias("quarantined"))


_PHONE = r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_CLEAN = rf"""
  regexp_replace(regexp_replace(regexp_replace(text,
    '\b((?:{redaction.LABELS})\s*:\s*)([A-Z][a-zA-Z''\-]+(?:\s+[A-Z][a-zA-Z''\-]+){{0,3}})', '\1[REDACTED_NAME]', 'g'),
    '{_EMAIL}', '[REDACTED_EMAIL]', 'g'), '(^|[^0-9]){_PHONE}([^0-9]|$)', '\1[REDACTED_PHONE]\2', 'g')
"""
REDACTED_DOCUMENTS = rf"""
SELECT doc_id, sha256(c) AS clean_sha256,
       regexp_matches(c, '{_EMAIL}') OR regexp_matches(c, '(^|[^0-9]){_PHONE}([^0-9]|$)') AS quarantined
FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)
"""


def personal_data_by_language(spark, sf_dir):
    """Redact, check, hash, drop repeated texts, count what held personal data."""
    d = table(spark, sf_dir, "documents").select("lang", "text")
    clean = redaction.redacted(F.col("text"))
    d = d.select("lang", F.sha2("text", 256).alias("sha256"), (clean != F.col("text")).alias("had"), redaction.still_personal(clean).alias("left"))
    d = d.groupBy("lang", "sha256").agg(F.max("had").alias("had"), F.max("left").alias("left"))
    return d.groupBy("lang").agg(
        F.count("*").alias("n_texts"), F.count_if("had").alias("n_redacted"), F.count_if("left").alias("n_quarantined")
    )


PERSONAL_DATA_BY_LANGUAGE = rf"""
SELECT lang, count(*) AS n_texts, count(*) FILTER (had) AS n_redacted, count(*) FILTER (lft) AS n_quarantined
FROM (SELECT DISTINCT lang, text, c <> text AS had,
             regexp_matches(c, '{_EMAIL}') OR regexp_matches(c, '(^|[^0-9]){_PHONE}([^0-9]|$)') AS lft
      FROM (SELECT lang, text, {_CLEAN} AS c FROM documents))
GROUP BY lang
"""


def redaction_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", redaction.spans(F.col("text")).alias("s")).filter(F.size("s") > 0)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("s", lambda x: x["kind"]))), ",")
    return d.select("doc_id", F.size("s").cast("long").alias("n_spans"), kinds.alias("kinds"))


def company_keys(spark, sf_dir):
    return derived(spark, sf_dir, NAMED).select("id", text.company_key(F.col("name")).alias("company_key"))


COMPANY_KEYS = rf"""
SELECT id, trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')),
  '\b(?:inc|incorporated|llc|l l c|ltd|limited|corp|corporation|co|company|plc)\s*$', '')) AS company_key
FROM ({plain(NAMED)})
"""


def location_scope(spark, sf_dir):
    return derived(spark, sf_dir, LOCATED).select("id", location.classify(F.col("location_raw")).alias("l")).select("id", "l.*")


def _location_oracle() -> str:
    states = ", ".join(f"'{s}'" for s in STATES)
    markers = ", ".join(f"'{m}'" for m in sorted(MARKERS))
    cities = ", ".join(f"('{c}', '{s}', {i})" for i, (c, s) in enumerate(CITIES.items()))
    return rf"""
WITH x AS (SELECT DISTINCT location_raw AS raw, lower(location_raw) AS low FROM ({plain(LOCATED)})),
p AS (
  SELECT *, contains(low, 'remote') AS rem, list_filter(list_transform(regexp_split_to_array(raw, '[,;]'), lambda s: trim(s)), lambda s: regexp_matches(s, '^[A-Z]{{2}}-'))[1] AS pre,
         regexp_extract(raw, '([A-Za-z .''-]+),\s*([A-Z]{{2}})\b', 1) AS c1, regexp_extract(raw, '([A-Za-z .''-]+),\s*([A-Z]{{2}})(?:[^-A-Za-z0-9_]|$)', 2) AS s1,
         list_min(list_filter([{markers}], lambda m: contains(low, m))) AS mk,
         list_filter(regexp_split_to_array(raw, '[^A-Za-z]+'), lambda t: t IN ({states}))[1] AS tok
  FROM x),
c AS (SELECT raw, min_by(city, i) AS city, min_by(st, i) AS st FROM x, (VALUES {cities}) v(city, st, i)
      WHERE regexp_matches(low, '\b' || city || '\b') GROUP BY raw),
r AS (
  SELECT p.raw, rem, c.city AS ct, c.st AS cs, substr(pre, 1, 2) AS code, trim(c1) AS c1, s1, tok, mk,
    CASE WHEN p.raw IS NULL OR trim(p.raw) = '' THEN 'no_location_data'
         WHEN substr(pre, 1, 2) = 'US' THEN 'us_prefix_segment'
         WHEN len(list_filter([{markers}], lambda m: contains(lower(substr(pre, 4)), m))) > 0 THEN 'non_us_prefix_segment:' || lower(substr(pre, 1, 2))
         WHEN substr(pre, 1, 2) IN ({states}) THEN 'state_prefix_segment:' || substr(pre, 1, 2)
         WHEN s1 IN ({states}) THEN 'city_state_pattern:' || s1
         WHEN contains(low, 'united states') THEN 'country_name_match'
         WHEN regexp_matches(low, '\busa\b') THEN 'country_abbreviation_match:usa'
         WHEN mk IS NOT NULL THEN 'non_us_location_match:' || mk
         WHEN regexp_matches(p.raw, '\bUS\b') THEN 'us_token_match'
         WHEN c.city IS NOT NULL THEN 'unambiguous_city_match:' || c.city
         WHEN tok IS NOT NULL THEN 'state_abbreviation_token:' || tok
         WHEN rem THEN 'ambiguous_remote_no_country_cue' ELSE 'undetermined_scope' END AS reason
  FROM p LEFT JOIN c ON p.raw = c.raw),
o AS (
  SELECT *, NOT (reason LIKE 'no%' OR reason LIKE 'ambiguous%' OR reason LIKE 'undetermined%') AS is_us FROM r)
SELECT id, is_us, reason, is_us AND rem AS is_remote,
  CASE WHEN reason LIKE 'city_state%' THEN c1 WHEN reason LIKE 'unamb%' THEN list_aggregate(list_transform(string_split(ct, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') END AS city,
  CASE WHEN reason LIKE 'city_state%' THEN s1 WHEN reason LIKE 'unamb%' THEN cs WHEN reason LIKE 'state_prefix%' THEN code WHEN reason LIKE 'state_abb%' THEN tok END AS state,
  CASE WHEN is_us THEN 'US' END AS country
FROM ({plain(LOCATED)}) l JOIN o ON l.location_raw = o.raw
"""


def employment(spark, sf_dir):
    return derived(spark, sf_dir, TITLED).select("posting_id", text.employment_type(F.col("title")).alias("employment_type"))


EMPLOYMENT = rf"""
SELECT posting_id, CASE WHEN regexp_matches(title, '(?i)\bintern(ship)?\b') THEN 'internship'
  WHEN regexp_matches(title, '(?i)\bpart[- ]?time\b') THEN 'part_time'
  WHEN regexp_matches(title, '(?i)\b(contract|contractor|temp|temporary)\b') THEN 'contract' END AS employment_type
FROM ({plain(TITLED)})
"""


def content_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.content_hash(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("content_hash"))


CONTENT_HASHES = "SELECT doc_id, sha256(concat(coalesce(source, ''), chr(0), coalesce(text, ''))) AS content_hash FROM documents"


def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" - ", "p_name", "p_type")).alias("slug"))


SLUGS = "SELECT p_partkey, trim(regexp_replace(lower(concat_ws(' - ', p_name, p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part"


def cleaned_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = F.concat(F.lit("- "), F.col("text"), F.lit(" \t\x07 end"))
    lines = text.bullet_lines(F.split(t, "\n"), 4, 60)
    return c.select("conv_id", "turn", text.cleaned(t, 80).alias("cleaned"), F.array_join(lines, "|").alias("lines"))


CLEANED_TURNS = r"""
SELECT conv_id, turn, nullif(substr(trim(regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g')), 1, 80), '') AS cleaned,
  coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(t, chr(10)),
    lambda v: trim(regexp_replace(regexp_replace(regexp_replace(v, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '^\s*(?:[-•*‣◦⁃∙]+|\d+[.)])\s*', ''), '\s+', ' ', 'g'))), lambda v: v <> '')[1:4],
    lambda v: substr(v, 1, 60)), '|'), '') AS lines
FROM (SELECT *, concat('- ', text, ' ', chr(9), chr(7), ' end') AS t FROM conversations)
"""


def whole_turns(spark, sf_dir):
    """With the operators' own limits of 300 characters, and hashes of all the text."""
    c = table(spark, sf_dir, "conversations")
    t = F.concat(F.lit("- "), F.col("text"), F.lit(" \t\x07 end"))
    lines = F.array_join(text.bullet_lines(F.split(t, "\n")), "|")
    return c.select("conv_id", "turn", F.sha2(text.cleaned(t), 256).alias("cleaned_sha256"), F.sha2(F.coalesce(lines, F.lit("")), 256).alias("lines_sha256"))


WHOLE_TURNS = r"""
SELECT conv_id, turn, sha256(nullif(substr(trim(regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g')), 1, 300), '')) AS cleaned_sha256,
  sha256(coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(t, chr(10)),
    lambda v: trim(regexp_replace(regexp_replace(regexp_replace(v, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '^\s*(?:[-•*‣◦⁃∙]+|\d+[.)])\s*', ''), '\s+', ' ', 'g'))), lambda v: v <> '')[1:4],
    lambda v: substr(v, 1, 300)), '|'), '')) AS lines_sha256
FROM (SELECT *, concat('- ', text, ' ', chr(9), chr(7), ' end') AS t FROM conversations)
"""


def unsupported_figures(spark, sf_dir):
    p = table(spark, sf_dir, "orders")
    said = F.concat_ws(" ", F.lit("cut cost by"), (F.col("o_orderkey") % 97).cast("string"), F.lit("percent over"), (F.col("o_custkey") % 7).cast("string"))
    found = text.unsupported_numbers(said, F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    return p.select("o_orderkey", F.array_join(found, ",").alias("unsupported"))


UNSUPPORTED_FIGURES = r"""
SELECT o_orderkey, coalesce(array_to_string(list_filter(
  regexp_extract_all(concat_ws(' ', 'cut cost by', (o_orderkey % 97)::VARCHAR, 'percent over', (o_custkey % 7)::VARCHAR), '\d+(?:[.,]\d+)?'),
  lambda n: NOT contains(concat('order ', o_orderkey::VARCHAR), n)), ','), '') AS unsupported
FROM orders
"""


def distinct_values(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.split(F.concat_ws(" ", "p_name", "p_type", F.upper("p_name")), " ")
    return p.select("p_partkey", F.array_join(text.distinct_ci(words), " ").alias("words"))


DISTINCT_VALUES = """
WITH w AS (SELECT p_partkey, unnest(string_split(concat_ws(' ', p_name, p_type, upper(p_name)), ' ')) AS v,
                  generate_subscripts(string_split(concat_ws(' ', p_name, p_type, upper(p_name)), ' '), 1) AS i FROM part),
f AS (SELECT p_partkey, lower(v) AS k, min(i) AS i, min_by(v, i) AS v FROM w GROUP BY ALL)
SELECT p_partkey, string_agg(v, ' ' ORDER BY i) AS words FROM f GROUP BY p_partkey
"""


def instants(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    stamp = (
        F.when(k % 4 == 0, F.concat(F.lit("2026-03-0"), (k % 9 + 1).cast("string"), F.lit("T05:00:00+02:00")))
        .when(k % 4 == 1, F.lit("2026-03-01T05:00:00"))
        .when(k % 4 == 2, F.lit("soon"))
    )
    at = F.unix_timestamp(text.instant(stamp))
    return o.select("o_orderkey", at.alias("epoch"), F.coalesce(text.has_offset(stamp), F.lit(False)).alias("has_offset"))


INSTANTS = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch(TIMESTAMP '2026-03-01 03:00:00' + to_days((o_orderkey % 9)::INT))::BIGINT
  WHEN 1 THEN epoch(TIMESTAMP '2026-03-01 05:00:00')::BIGINT END AS epoch, o_orderkey % 4 = 0 AS has_offset
FROM orders
"""

QUERIES = {
    "html_text": (html_text, HTML_TEXT),
    "entity_text": (entity_text, ENTITY_TEXT),
    "payload_keys": (payload_keys, PAYLOAD_KEYS),
    "redacted_documents": (redacted_documents, REDACTED_DOCUMENTS),
    "personal_data_by_language": (personal_data_by_language, PERSONAL_DATA_BY_LANGUAGE),
    "redaction_spans": (redaction_spans, None),
    "company_keys": (company_keys, COMPANY_KEYS),
    "location_scope": (location_scope, _location_oracle()),
    "employment": (employment, EMPLOYMENT),
    "content_hashes": (content_hashes, CONTENT_HASHES),
    "slugs": (slugs, SLUGS),
    "cleaned_turns": (cleaned_turns, CLEANED_TURNS),
    "whole_turns": (whole_turns, WHOLE_TURNS),
    "unsupported_figures": (unsupported_figures, UNSUPPORTED_FIGURES),
    "distinct_values": (distinct_values, DISTINCT_VALUES),
    "instants": (instants, INSTANTS),
}
