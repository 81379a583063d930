"""Vectors by iterative quantisation, collocations by stripes and spelling variants by reduced
words, against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocatio.llm import bitmaps, collocations, itq, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


# vectors


def linked(rows, least=0.95):
    """vec_id, n_links, component_id and kept by comparing all pairs."""
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    n[a], n[b] = n[a] + 1, n[b] + 1
                    parent[find(a)] = find(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[find(k)] = min((x for x in (first.get(find(k)), i) if x is not None), default=None)
    return [(i, n[k], first[find(k)], i == first[find(k)]) for k, (i, _) in enumerate(rows)]


def vectors(seed=5, dim=16):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.standard_normal(dim).tolist()) for k in range(150)]
    for k in range(150, 260):  # near copies of a few, at all distances around the threshold
        base = np.array(rows[k % 9][1])
        rows.append((k, (base + rng.standard_normal(dim) * rng.uniform(0, 0.45)).tolist()))
    rows += [(k, rows[3][1]) for k in range(300, 340)]  # exact copies
    rows += [(k, [2.5 * x for x in rows[4][1]]) for k in range(340, 345)]  # and of other lengths
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, rows[5][1]), (None, [9.0] * dim)]
    rows += [(400, None), (401, []), (402, [0.0] * dim), (403, [None] + [1.0] * (dim - 1)), (404, [float("nan")] + [1.0] * (dim - 1))]
    rows += [(405, [float("inf")] + [1.0] * (dim - 1)), (406, [1.0, 2.0]), (407, [1.0, 2.0]), (408, [-1.0, -2.0]), (409, [5.0])]
    rows += [(410, [1e300] * dim), (411, [1e300] * (dim - 1) + [0.9e300]), (412, [-0.0] * (dim - 1) + [1.0]), (413, [0.0] * (dim - 1) + [1.0])]
    return rows


@pytest.mark.parametrize("block", [1024, 32])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(itq, "BLOCK", block)  # lists longer than a block are dealt out as pairs of blocks
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("x")).withColumn("label", F.lit(1))
    assert ordered(rows_of(itq.near_duplicates(table.repartition(3)))) == ordered(linked(rows))


def test_near_vectors_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(itq, "HOT", 10)
    rows = vectors(seed=6)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ordered(rows_of(itq.near_duplicates(table))) == ordered(linked(rows))


def test_no_vectors(spark):
    got = itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert got.count() == 0


def test_rotations_balance_bits_and_meet_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    sample = rng.standard_normal((4000, 48)) @ rng.standard_normal((48, 48))  # far from round
    codes = itq.Codes(sample, len(sample), 0.95)
    for turn in codes.rotations:
        assert np.allclose(turn @ turn.T, np.eye(48), atol=1e-9)
    u = itq.unit(sample)
    bits = np.concatenate([(u - codes.mean) @ codes.axes @ turn >= 0 for turn in codes.rotations], 1)
    assert abs(bits.mean(0) - 0.5).max() < 0.2
    other = rng.standard_normal((5000, 48)) @ rng.standard_normal((48, 48))
    v = itq.unit(other)
    away = rng.standard_normal(v.shape)
    away = itq.unit(away - (away * v).sum(1, keepdims=True) * v)
    partner = 0.95 * v + np.sqrt(1 - 0.95**2) * away
    assert (codes.keys(v) == codes.keys(partner)).any(1).mean() >= 0.9


def test_recall_of_a_larger_table(spark):
    """Pairs around the threshold of 3,000 vectors: links found against brute force, and none below."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((1000, 64))
    rows = np.concatenate([base, *(itq.unit(base) + rng.standard_normal(base.shape) * s / 8 for s in (0.28, 0.32))])
    u = itq.unit(rows)
    want = (u @ u.T >= 0.95).sum(1) - 1
    table = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = np.array([r.n_links for r in itq.near_duplicates(table).orderBy("vec_id").collect()])
    assert want.sum() > 1000 and (got <= want).all() and got.sum() >= 0.97 * want.sum()


# collocations


def best_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(zip(*(words[j:] for j in range(k))))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {
            p[s : s + m] for p, a in found.items() for m in range(2, len(p)) for s in range(len(p) - m + 1) if 100 * a >= 80 * found[p[s : s + m]]
        }
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def prose(seed, n=120):
    random.seed(seed)
    words = ["the", "Of", "new", "york", "City", "été", "a", "\xa0b", "日本", "x" * 70] + [f"w{k}" for k in range(30)]
    weights = [12, 9, 6, 6, 5, 4, 4, 2, 2, 2] + [1] * 30
    rows = []
    for i in range(n):
        text = ""
        for _ in range(random.randint(0, 80)):
            text += random.choices(words + ["new york city", "the new york city"], weights + [8, 6])[0]
            text += random.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "! "])
        rows.append((i, text, random.choice(["en", "de", "", None])))
    rows += [(n, None, "en"), (n + 1, "", None), (n + 2, " \n.,;", "en"), (n + 3, "the new york city " * 9000, "en"), rows[3], rows[3], (None, "the of the of", "fr")]
    return rows


@pytest.mark.parametrize("least, top, size", [(2, 10_000, 1 << 24), (5, 7, 2000), (30, 2000, 2000)])
def test_collocations(spark, monkeypatch, least, top, size):
    monkeypatch.setattr(collocations, "SLICE_BYTES", size)
    rows = prose(least)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit("x")).withColumn("word", F.lit(1))
    got = rows_of(collocations.phrases(docs.repartition(3), least, top))
    assert ordered(got) == ordered(best_phrases([r[1:] for r in rows], least, top))


def test_words_that_share_a_hash_are_counted_with_another_seed(spark, monkeypatch):
    words = spark.createDataFrame([("en", "a", 1), ("en", "b", 1), ("de", "c", 2)], "lang string, word string, h long")
    assert collocations.clash(words) and not collocations.clash(words.filter("word <> 'b'"))
    answers, clash = [True, False], collocations.clash
    monkeypatch.setattr(collocations, "clash", lambda words: clash(words) or answers.pop(0))
    rows = prose(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = collocations.vocabulary(docs)
    assert answers == [] and {r.seed for r in words.select("seed").distinct().collect()} == {1}
    answers[:] = [True, False]
    assert ordered(rows_of(collocations.phrases(docs, 3, 100))) == ordered(best_phrases([r[1:] for r in rows], 3, 100))


def test_more_words_than_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_WORDS", 5)  # words travel as hashes
    rows = prose(12)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert ordered(rows_of(collocations.phrases(docs, 3, 5000))) == ordered(best_phrases([r[1:] for r in rows], 3, 5000))


def test_hot_stripes_are_cut(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HOT", 1_000_000)  # every word and pair counts as hot
    rows = prose(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert ordered(rows_of(collocations.phrases(docs, 3, 5000))) == ordered(best_phrases([r[1:] for r in rows], 3, 5000))


def test_no_collocations(spark):
    got = collocations.phrases(spark.createDataFrame([], DOCS))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0
    assert collocations.phrases(spark.createDataFrame([(1, None, None, None, None)], DOCS)).count() == 0


# bitmaps


def test_bitmaps_hold_their_keys(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(-(1 << 63), 1 << 63, 3000)
    bits = bitmaps.gathered(spark.createDataFrame([(int(k),) for k in [*keys, -1, 0, 1]], "key long"), "key")
    assert bitmaps.perhaps(bits, keys.view(np.uint64)).all()
    assert bitmaps.perhaps(bits, np.array([0, 1, (1 << 64) - 1], np.uint64)).all()
    others = rng.integers(0, 1 << 64, 20_000, np.uint64)
    assert bitmaps.perhaps(bits, others).mean() < 0.15


# spelling


def variants(rows, noise=97, letters=5, least=3):
    n, run = Counter(), re.compile("[A-Za-zÀ-ÿ]+")
    for i, text in rows:
        for r in run.findall(text or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % noise == 0 else r] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]

    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def misspelt(seed=4):
    random.seed(seed)
    letters = "abcdeéßÿ×÷nrst"
    stems = ["".join(random.choices(letters, k=random.choice([5, 5, 6, 7, 8, 12, 40]))) for _ in range(40)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(random.randint(0, 40)):
            w = random.choices(stems, [1 / (k + 1) for k in range(40)])[0]
            if random.random() < 0.4:
                k = random.randrange(len(w))
                w = random.choice([w[:k] + w[k + 1 :], w[:k] + random.choice(letters) + w[k:], w[:k] + random.choice(letters) + w[k + 1 :], w.upper()])
            words.append(w + random.choice([" ", "-", "1", ", ", "日", "\n", "Ā"]))
        rows.append((i, "".join(words)))
    rows += [(900, None), (901, ""), (902, "12 !"), (None, " ".join(stems)), rows[3], rows[3], (903, "abcde " * 20_000), (904, "ABCDE abcdf xabcde " * 3)]
    rows += [(905 + k, "y" * 3000 + " " + "y" * 2999 + " " + "z" * 70) for k in range(3)]
    return rows


@pytest.mark.parametrize("noise, size", [(97, 1 << 24), (5, 500), (1, 1 << 24)])
def test_spelling(spark, monkeypatch, noise, size):
    monkeypatch.setattr(spelling, "SLICE_BYTES", size)
    rows = misspelt()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("form", F.lit(1))
    got = rows_of(spelling.variants(docs.repartition(3), noise=noise))
    assert ordered(got) == ordered(variants(rows, noise))


def test_few_symbols_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "alphabet", lambda words: 2)  # many words share a reduced word
    rows = misspelt(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(rows_of(spelling.variants(docs))) == ordered(variants(rows))


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Spark takes compressed files, and edits sized by their words, for small enough to be sent to all."""
    plans, rows, write = [], misspelt(6), spelling.scratch.written
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(spelling.scratch, "written", lambda df, name: (plan(df), write(df, name))[1])
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    plan(got)
    assert ordered(rows_of(got)) == ordered(variants(rows))
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


def test_no_words(spark):
    got = spelling.variants(spark.createDataFrame([], DOCS))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


def test_checksums_of_joined_bytes():
    random.seed(1)
    pairs = [(random.randbytes(random.randint(0, 9)), random.randbytes(random.randint(0, 300))) for _ in range(500)]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in pairs], np.uint32)
    got = spelling.Checksums().joined(crc(0), crc(1), np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_neighbours_of_reduced_words():
    reduction = spelling.Reduction(4)
    point = lambda w: np.array([[ord(c) for c in w]])
    spelled = {int(reduction.terms(point(c))[0, 0]): c for c in "abcdefghijklmnop"}
    assert set(spelled) == {1, 2, 3, 4}
    assert reduction.symbols == 4
    word = "".join(spelled[s] for s in (1, 2, 2, 4, 3))
    around = {word} | {word[:k] + word[k + 1 :] for k in range(5)} | {word[:k] + c + word[k + d :] for k in range(6) for c in spelled.values() for d in (0, 1)}
    keys = {int(reduction.of(point(w))[0]) for w in around}
    assert set(reduction.neighbours(point(word))[0].tolist()) == keys
