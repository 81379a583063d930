"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from vocatio.llm.license_scan import NOTICES

QUALITY = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s
  FROM w, unnest(range(1, len(ws) - 3)) u(i)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c >= 2),
cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, unnest(range(0, 5)) u(k) GROUP BY doc_id),
ln AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
r AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         n_symbols / greatest(n_words, 1) AS a, n_dup_lines / greatest(n_lines, 1) AS b,
         word_chars / greatest(n_words, 1) AS c
  FROM f),
q AS (
  SELECT lang, source, grouping(lang, source) AS g, count(*) AS n,
         list_sort(list(a)) AS a, list_sort(list(b)) AS b, list_sort(list(c)) AS c
  FROM r WHERE NOT base_failed GROUP BY ROLLUP (lang, source)),
e AS (
  SELECT lang, source, g, n,
         a[greatest(1, ceil(0.25 * n))::INT] AS a1, a[greatest(1, ceil(0.85 * n))::INT] AS a3,
         b[greatest(1, ceil(0.25 * n))::INT] AS b1, b[greatest(1, ceil(0.85 * n))::INT] AS b3,
         c[greatest(1, ceil(0.25 * n))::INT] AS c1, c[greatest(1, ceil(0.75 * n))::INT] AS c3
  FROM q),
h AS (
  SELECT lang, source, g, n, a3 + 2 * (a3 - a1) + 0.05::DOUBLE AS a_high, b3 + 2 * (b3 - b1) + 0.1::DOUBLE AS b_high,
         c3 + 3 * (c3 - c1) + 0.5 AS c_high, c1 - 3 * (c3 - c1) - 0.5 AS c_low
  FROM e),
k AS (
  SELECT s.lang, s.source, l.n >= 30 AS by_lang,
         CASE WHEN s.n >= 30 THEN s WHEN l.n >= 30 THEN l WHEN t.n >= 30 THEN t ELSE s END AS z, l AS lang_z
  FROM (SELECT * FROM h WHERE g = 0) s
  LEFT JOIN (SELECT * FROM h WHERE g = 1) l ON s.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN (SELECT * FROM h WHERE g = 3) t ON true),
u AS (
  SELECT lang, source,
         CASE WHEN by_lang THEN least(z.a_high, lang_z.a_high) ELSE z.a_high END AS a_high,
         CASE WHEN by_lang THEN least(z.b_high, lang_z.b_high) ELSE z.b_high END AS b_high,
         CASE WHEN by_lang THEN least(z.c_high, lang_z.c_high) ELSE z.c_high END AS c_high,
         CASE WHEN by_lang THEN greatest(z.c_low, lang_z.c_low) ELSE z.c_low END AS c_low
  FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND coalesce(a <= a_high + 0.5 / sqrt(greatest(n_words, 1)), true)
        AND coalesce(b <= b_high + 0.75 / sqrt(greatest(n_lines, 1)), true)
        AND coalesce(c <= c_high + 15 / sqrt(greatest(n_words, 1)), true)
        AND coalesce(c >= c_low - 15 / sqrt(greatest(n_words, 1)), true)) AS kept
FROM r LEFT JOIN u ON r.lang IS NOT DISTINCT FROM u.lang AND r.source IS NOT DISTINCT FROM u.source
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k
  FROM d GROUP BY source),
v AS (SELECT *, 1 + (k - 1) % 3 AS w FROM s),
c AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::BIGINT)
            / ((sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT) AS level
  FROM v WINDOW o AS (ORDER BY 3 * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * w) AS target FROM c),
p AS (
  SELECT doc_id, size, source_size, target,
         sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(floor(target)::BIGINT - before, size))
        + greatest(0, least(floor(target)::BIGINT - source_size - before, size))
        + greatest(0, least(floor(target)::BIGINT - 2 * source_size - before, size)))::BIGINT AS taken
FROM p
"""

TOP_K = r"""
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS z
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_inner_product(q.z, c.z)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

NEAR_VECTORS = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in e if x <> 0]) > 0),
links AS (
  SELECT a.row AS a, b.row AS b FROM ok a JOIN ok b ON a.row <> b.row
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 ELSE false END),
reach AS (
  SELECT row AS a, row AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS row, min(vec_id) AS component_id FROM reach JOIN v ON reach.b = v.row GROUP BY a),
n AS (SELECT a AS row, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c USING (row) LEFT JOIN n USING (row)
"""

COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS x
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f
  FROM w, unnest([1, 2, 3, 4]) t(k), unnest(range(1, len(w) - k + 2)) u(i) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS words, g AS phrase, string_split(g, ' ') AS w, f AS a FROM g WHERE k > 1 AND f >= 30),
inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a AS longer
  FROM c, unnest([2, 3]) t(m), unnest(range(1, words - m + 2)) u(i) WHERE m < words),
gone AS (
  SELECT DISTINCT lang, phrase FROM c JOIN inside USING (lang, phrase) WHERE 100 * longer::HUGEINT >= 80 * a::HUGEINT),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
  FROM c ANTI JOIN gone USING (lang, phrase), unnest(range(1, words)) t(cut)),
s AS (
  SELECT cuts.lang, phrase, a, l.f AS l, r.f AS r, (2000000 * a::HUGEINT // (l.f + r.f))::BIGINT AS score,
         row_number() OVER (PARTITION BY cuts.lang, phrase ORDER BY 2000000 * a::HUGEINT // (l.f + r.f), cut) AS weakest
  FROM cuts JOIN g l ON l.lang = cuts.lang AND l.g = head JOIN g r ON r.lang = cuts.lang AND r.g = tail),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s WHERE weakest = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) WHERE rank <= 2000
"""


def _crc32_steps() -> list[int]:
    """What each value of a checksum's last byte adds when it is shifted out (reflected polynomial)."""
    steps = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        steps.append(value)
    return steps


def spelling() -> str:
    return rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, run, count(*) AS times
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY ALL),
b AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
h AS (
  SELECT run, times,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x[2 * i + 1:2 * i + 2])::BIGINT for i in range(0, len(x) // 2)]),
                         lambda c, y: xor(c >> 8, list_extract({_crc32_steps()}::BIGINT[], (xor(c, y) & 255) + 1))), 4294967295) AS h
  FROM b),
e AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times
  FROM h),
n AS (SELECT word, sum(times)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
d AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS less FROM n, unnest(range(0, length(word))) u(i)),
near AS (
  SELECT d.word, o.word AS near, o.n AS near_n FROM d JOIN n o ON d.less = o.word
  UNION SELECT o.word, d.word, d.n FROM d JOIN n o ON d.less = o.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
f AS (
  SELECT n.word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM n LEFT JOIN best USING (word)),
root AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT root.word, f.form FROM root JOIN f ON root.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, root.root, f.n, f.n_near, f.form_n
FROM f JOIN root ON root.word = f.word JOIN f last ON last.word = root.root WHERE last.form IS NULL
"""


def license_scan() -> str:
    values = ", ".join("({!r}, {!r})".format(*n) for n in NOTICES)
    return rf"""
WITH t AS (SELECT * FROM (VALUES {values}) t(name, text)),
words AS (
  SELECT 'd' AS side, doc_id::VARCHAR AS id,
         regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g') AS t FROM documents
  UNION ALL
  SELECT 't', name, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g') FROM t),
w AS (SELECT side, id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM words),
g AS (
  SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(2, len(w) - 3))) u(i) WHERE len(w) > 0),
n AS (SELECT id AS name, count(*) AS shingles FROM g WHERE side = 't' GROUP BY id),
m AS (
  SELECT d.id::BIGINT AS doc_id, s.id AS name, count(*) AS found, list(d.g) AS hit
  FROM g d JOIN g s ON d.g = s.g AND d.side = 'd' AND s.side = 't' GROUP BY d.id, s.id),
v AS (SELECT * FROM m JOIN n USING (name) WHERE found >= 0.8 * shingles)
SELECT doc_id, name, shingles, found, found / shingles AS containment
FROM v t WHERE NOT EXISTS (
  SELECT 1 FROM v u WHERE u.doc_id = t.doc_id AND u.found * t.shingles >= t.found * u.shingles
    AND (u.found * t.shingles > t.found * u.shingles OR u.found > t.found) AND list_has_all(u.hit, t.hit))
"""
