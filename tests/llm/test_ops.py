"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vocatio.llm import hmm, langid, license_scan, mixing, packing, pii, quality, simhash, tokens, topk, wavelet

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "of", "Data", "model,", "é́tat", "train.", "run", "x1", "don't", "straße", "ÀB", "日本", "go"]


def sample(n=60, seed=1):
    random.seed(seed)
    rows = []
    for i in range(n):
        t = "".join(random.choice(WORDS) + random.choice([" ", "  ", "\n", "\t", " \n"]) for _ in range(random.randint(0, 60)))
        rows.append((i, t, random.choice(["en", "de", None]), random.choice(["a", "b", "c", None]), len(t)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \n\t ", "en", "a", 4), (None, "null id here", "en", "b", 12)]
    rows += [rows[3], rows[3], (n + 3, rows[3][1], "en", "c", 1), (n + 4, "long word " * 6000, "en", "a", 60000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns that clash with names the operators use."""
    df = spark.createDataFrame(sample(), DOCS)
    for c in ("row", "size", "fp", "kept", "queue", "f"):
        df = df.withColumn(c, F.lit("extra"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def u32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_give_the_tokenizers_ids(name, spaced):
    path = public_tokenizers.path(name)
    whole, enc = Tokenizer.from_file(path), tokens.Encoder(path, spaced)
    random.seed(7)
    bits = [" ", "  ", "\n", "\t", "a", "B", "É", "é", "İ", "1", "½", ".", ",", "!!", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "\xa0", "\x1c", "\x85", "日本", "\U0001f600", "​", "the.", "x", "_"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 30))) for _ in range(1500)] + ["", None]
    texts += ["a\x01b \x01", "\x00", "x\x00y", "It's.", "we're!! I'll.?", "\nAb.\nCd,,\n1"]
    for _ in range(2):  # the second time from what it remembers
        ids, sizes = enc.encode(pa.array(texts, pa.string()), 2)
        for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
            assert got.tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 2], text


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    pieces = rows_of(packing.pack(docs, path, window=256, shard_tokens=20_000))
    want = Counter()
    for r in docs.collect():
        want[r.doc_id, u32(whole.encode(r.text or "", add_special_tokens=False).ids + [2])] += 1
    # every id of every row lies in one piece
    n = Counter()
    for (doc_id, ids), k in want.items():
        n[doc_id] += k * len(ids) // 4
    got = Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        assert any(d == p["doc_id"] and ids[4 * p["start"] : 4 * (p["start"] + p["length"])] == p["ids"] for d, ids in want)
    assert got == n
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    for seq in by.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256
    short = [s for s in by.values() if sum(p["length"] for p in s) < 256]
    assert len(short) <= len({s >> 32 for s in by})
    assert sorted(map(str, pieces)) == sorted(map(str, rows_of(packing.pack(docs, path, window=256, shard_tokens=20_000))))
    assert packing.pack(empty, path).count() == 0


def test_retrieved_neighbours_share_the_window():
    ids = np.array([1, 2, 3, 9, 4, 5, 9, 1, 2, 3, 9, 6, 7, 9])
    cuts = np.array([0, 4, 7, 11, 14])
    index = packing.Bm25Index(ids, cuts, np.where(np.arange(10) == 9, 0.01, 1.0), 3.5, 1.2, 0.75)
    free = np.array([False, True, True, True])
    assert index.neighbours(0, free, 24)[0] == 2
    pieces = packing.pack_shard(np.diff(cuts), lambda s, f: index.neighbours(s, f, 24), 8)
    assert [p[0] for p in pieces[:2]] == [0, 2]


def test_common_terms_are_rows_of_all_documents():
    """Scores of an index with common and rare terms are those of the formula."""
    rng = np.random.default_rng(5)
    docs = [np.concatenate([rng.integers(0, 6, 20), rng.integers(6, 400, rng.integers(1, 9))]) for _ in range(60)]
    cuts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    idf, mean = np.linspace(0.1, 3.0, 400), cuts[-1] / 60
    index = packing.Bm25Index(np.concatenate(docs), cuts, idf, mean, 1.2, 0.75)
    common = np.flatnonzero(index.row >= 0)
    assert set(range(6)) <= set(common.tolist()) and len(common) < 100 and index.weights.shape == (len(common), 60)
    free = rng.random(60) < 0.7
    for seed in range(60):
        score = np.zeros(60)
        for t in np.unique(docs[seed]):
            tf = np.array([(d == t).sum() for d in docs])
            length = np.array([len(d) for d in docs])
            score += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
        got = index.neighbours(seed, free)
        assert set(got.tolist()) == set(np.flatnonzero((score > 0) & free).tolist())
        assert (np.diff(score[got]) <= 1e-9).all()


def test_words_with_accents_without_normalizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100))) + "ªµºſıǆ"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(["", "", ".", ",", "!?"]) for _ in range(3000)]
    enc = tokens.Encoder(path, False)
    ids, sizes = enc.encode(pa.array(words), 2)
    want = [[*e.ids, 2] for e in enc.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_neighbours_score_by_all_terms():
    terms = np.arange(30)
    ids = np.concatenate([terms, terms[:1], terms[24:]])
    index = packing.Bm25Index(ids, np.array([0, 30, 31, 37]), np.linspace(2.0, 1.0, 30), 12.0, 1.2, 0.75)
    assert index.neighbours(0, np.array([False, True, True]))[0] == 2


def test_near_copies_share_a_shard(spark):
    random.seed(3)
    vocabulary = [w for w in Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).get_vocab() if w.isascii() and w.isalpha() and len(w) > 4]
    vocabulary = sorted(vocabulary)[::3]
    rows = []
    for family in range(120):
        rare, common = random.sample(vocabulary[200:], 12), random.choices(vocabulary[:200], k=40)
        rows += [(3 * family + k, " ".join([*rare, *common, *random.choices(vocabulary[:200], k=3)])) for k in range(3)]
    rows += [(10_000 + k, "hot " + " ".join(vocabulary[:50])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=256, shard_tokens=4000).collect()
    shards, ids = {}, Counter()
    for p in pieces:
        shards[p.doc_id] = p.sequence_id >> 32
        ids[p.sequence_id >> 32] += p.length
    assert len(ids) > 8 and max(ids.values()) <= 2 * 4000  # a hot group is dealt to several
    together = sum(len({shards[3 * f + k] for k in range(3)}) == 1 for f in range(120))
    assert together >= 100, together


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (700, 5), (3000, 50_000)):
        ids = rng.integers(0, top, n).astype(np.uint16)
        w = wavelet.WaveletMatrix.build(ids)
        w = wavelet.WaveletMatrix.of(w.n, w.zeros, w.planes.tobytes(), w.ones.astype("<u4").tobytes())
        assert (w.decode() == ids).all()
        for i in range(0, n, 97):
            assert w.access(i) == ids[i]
        for token in {*ids[:5].tolist(), 3, 60_000, 70_000}:
            at = np.flatnonzero(ids == token)
            assert w.count(token) == len(at) and w.rank(token, n // 2) == (ids[: n // 2] == token).sum()
            assert [w.select(token, k) for k in range(len(at))][:20] == at[:20].tolist() and w.select(token, len(at)) == -1


def test_token_files(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    wavelet.write_tokens(docs, f"{tmp_path}/w", path, shard_tokens=3000)
    got = sorted(rows_of(wavelet.read_documents(spark, f"{tmp_path}/w")), key=lambda r: r["start"])
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    at, every = 0, []
    for r, g in zip(rows, got, strict=True):
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (g["doc_id"], g["start"], g["n_tokens"], bytes(g["ids"])) == (r.doc_id, at, len(ids), u32(ids))
        at += len(ids)
        every += ids
    token = every[5]
    assert sum(r.occurrences for r in wavelet.count_token(spark, f"{tmp_path}/w", token).collect()) == every.count(token)
    assert sorted(r.position for r in wavelet.find_token(spark, f"{tmp_path}/w", token).collect()) == [i for i, x in enumerate(every) if x == token]
    wavelet.write_tokens(empty, f"{tmp_path}/e", path)
    assert wavelet.read_documents(spark, f"{tmp_path}/e").count() == 0


def test_hmm(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 8)
    d = docs.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 0).alias("held_out"), "text")
    # a small head and few symbols: most words go through the join
    real = hmm.lexicon
    monkeypatch.setattr(hmm, "lexicon", lambda counts, texts: real(counts, texts, 8, 5))
    got = rows_of(hmm.scored(d, states=3, rounds=1))
    seen = Counter()
    for r in d.collect():
        if not r.held_out:
            seen.update((r.text or "").encode().lower().split() + [0])
    n, v = sum(seen.values()), len(seen)
    want = Counter()
    for r in d.collect():
        found = (r.text or "").encode().lower().split() + [0]
        want[r.doc_id, len(found), sum(w in seen for w in found), round(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in found), 6)] += 1
    assert want == Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert hmm.scored(empty.select("doc_id", F.lit(False).alias("held_out"), "text")).count() == 0


def test_forward_and_baum_welch():
    rng = np.random.default_rng(2)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    texts = [rng.integers(0, 5, n) for n in (1, 4, 9, 2, 9)]

    def likelihood(model, t):
        a = model.first * model.emit[t[0]]
        for x in t[1:]:
            a = (a @ model.step) * model.emit[x]
        return math.log10(a.sum())

    assert np.allclose(m.score(texts), [likelihood(m, t) for t in texts])
    # a step of Baum-Welch never lowers the likelihood
    before, now = m.score(texts).sum(), m
    for _ in range(5):
        firsts, steps, counts = now.expected(texts)
        assert np.isclose(counts.sum(), sum(map(len, texts))) and np.isclose(firsts.sum(), 5) and np.isclose(steps.sum(), 20)
        now = hmm.Hmm(norm(firsts, 0), norm(steps, 1), norm(counts, 0))
        after = now.score(texts).sum()
        assert after >= before - 1e-4
        before = after


def chained(model, t):
    """Scaled forward-backward of one text, step by step: log10 likelihood and expected counts."""
    k, n = len(model.first), len(t)
    alpha, beta, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for i, x in enumerate(t):
        alpha[i] = (alpha[i - 1] @ model.step if i else model.first) * model.emit[x]
        scale[i] = alpha[i].sum()
        alpha[i] /= scale[i]
    for i in range(n - 2, -1, -1):
        beta[i] = model.step @ (model.emit[t[i + 1]] * beta[i + 1]) / scale[i + 1]
    steps = sum((alpha[i][:, None] * model.step * (model.emit[t[i + 1]] * beta[i + 1] / scale[i + 1])[None] for i in range(n - 1)), np.zeros((k, k)))
    counts = np.zeros_like(model.emit)
    np.add.at(counts, t, alpha * beta)
    return np.log10(scale).sum(), (alpha[0] * beta[0], steps, counts)


def test_segments_are_exact():
    rng = np.random.default_rng(5)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)) ** 4, 1), norm(rng.random((6, 3)) ** 4, 0))
    texts = [rng.integers(0, 6, n) for n in (1, 7, 3, 40, 6, 9, 100)]
    want = [chained(m, t) for t in texts]
    for segment in (1, 3, 7, 1000):
        assert np.allclose(m.score(texts, segment), [w[0] for w in want])
        for got, parts in zip(m.expected(texts, segment), zip(*(w[1] for w in want))):
            assert np.allclose(got, sum(parts), rtol=1e-3, atol=1e-4)


def test_hmm_takes_long_words_into_the_head(spark):
    line = "=" * 300
    rows = [(k, k % 5 == 0, f"{line} one two {'x' * 65}{k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string")
    counts = hmm.word_counts(docs.filter("NOT held_out").select("text"))
    lex = hmm.lexicon(counts, 16, 3)
    assert len(lex.words) == 3 and {b"one", b"two"} < set(lex.words) and list(lex.counts) == [16, 16, 16]
    assert max(map(len, lex.words)) <= hmm.LONGEST
    got = {r["doc_id"]: r for r in rows_of(hmm.scored(docs, states=2, rounds=1))}
    assert all(r["n_tokens"] == 5 and r["n_known"] == (4 if k % 5 == 0 else 5) for k, r in got.items())
    n, v = 16 * 5, 3 + 16 + 1
    base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in (16, 16, 16, 0, 16))
    assert math.isclose(got[0]["base_score"], base, rel_tol=1e-9)


def test_hmm_scores_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 8)
    monkeypatch.setattr(hmm, "SEGMENT", 16)
    real = hmm.lexicon
    monkeypatch.setattr(hmm, "lexicon", lambda counts, texts: real(counts, texts, 8, 5))
    d = docs.select("doc_id", F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False)).alias("held_out"), "text").cache()
    rows = [(r.doc_id, r.held_out, (r.text or "").encode().lower().split()) for r in d.collect()]
    learned = [words for _, out, words in rows if not out]
    counts = Counter(w for words in learned for w in words)
    named = sorted(counts, key=lambda w: (-counts[w], w))[:5]
    at = {w: i + 2 for i, w in enumerate(named)}
    rest = [w for w in counts if w not in at]
    rest_total, rest_distinct = sum(counts[w] for w in rest), len(rest)
    symbols = lambda words: np.array([*(at.get(w, 1) for w in words), 0])
    p = np.array([len(learned), rest_total, *(counts[w] for w in named)]) + 0.1
    model = hmm.first_guess(p / p.sum(), 3)
    for _ in range(3):
        sums = [sum(x) for x in zip(*(chained(model, symbols(words))[1] for words in learned))]
        model = hmm.re_estimated(model, p / p.sum(), *sums)
    want = Counter()
    for doc_id, _, words in rows:
        share = sum(math.log10((counts[w] + 0.1) / (rest_total + 0.1 * (rest_distinct + 1))) for w in words if w not in at)
        want[doc_id, round((chained(model, symbols(words))[0] + share) / (len(words) + 1), 3)] += 1
    got = Counter((r["doc_id"], round(r["score"] / r["n_tokens"], 3)) for r in rows_of(hmm.scored(d, states=3, rounds=3)))
    assert sum((want - got).values()) <= 2  # single precision may round a few apart
    assert len(got) == len(want)


def test_license_scan(spark, empty):
    long = license_scan.NOTICES[4][1].split()
    random.seed(0)
    fill = lambda n: [f"w{random.randrange(500)}" for _ in range(n)]
    texts = []
    for i in range(30):
        x = list(long)
        if i % 3 == 1:
            x[random.randrange(len(x))] = "zzz"
        texts.append(" ".join(fill(random.randrange(200)) + x + fill(random.randrange(200))))
    texts += [None, "", "Released under the MIT License.", "released UNDER the (MIT) license now", " ".join(long[:20]), " ".join(fill(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.name): (r.found, r.shingles) for r in license_scan.scan(df).collect()}

    def shingles(t):
        w = [x for x in (re.sub(r"[^\w\s]|_", "", y) for y in (t or "").lower().split()) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {}
    for i, t in enumerate(texts):
        for name, notice in license_scan.NOTICES:
            s = shingles(notice)
            if len(s & shingles(t)) >= 0.8 * len(s):
                want[i, name] = (len(s & shingles(t)), len(s))
    assert got == want and len(want) >= 30
    assert license_scan.scan(empty).count() == 0


def test_license_scan_finds_all_standard_notices(spark):
    known = dict(license_scan.NOTICES)
    assert len(known) == len(license_scan.NOTICES) >= 200
    assert {"bsd", "bsd-3-clause", "lgpl-2.1", "mpl-2.0", "gpl-2.0", "isc", "cc-by-sa-4.0"} <= {n.split("/")[0] for n in known}
    random.seed(1)
    fill = lambda: " ".join(f"w{random.randrange(500)}" for _ in range(random.randrange(40)))
    for cut in (0, 1):  # whole, and without the words that may be missing at the ends
        rows = []
        for i, (name, text) in enumerate(license_scan.NOTICES):
            w = text.split()
            said = re.sub(r"[^\w\s]", "", text.lower()).split()
            spare = len({tuple(said[k : k + 5]) for k in range(len(said) - 4)}) // 5 if cut else 0
            w = w[: len(w) - spare] if i % 2 else w[spare:]
            rows.append((i, " ".join([fill(), *w, fill()])))
        got = {(r.doc_id, r.name) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
        assert {(i, n) for i, n in enumerate(known)} <= got


def test_license_windows_scale():
    size = lambda n: license_scan.window_of(n, n, 0.8)
    assert [size(n) for n in (1, 2, 5, 6, 12, 13, 19, 20, 23, 24, 500)] == [1, 2, 2, 4, 4, 8, 8, 4, 4, 16, 16]
    assert license_scan.window_of(10, 9, 0.8) == 1


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            bad = (
                (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")))
                or (kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)))
                or (kind == "phone" and not 9 <= len(digits) <= 15)
            )
            if not bad:
                out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def test_personal_data_against_the_patterns():
    random.seed(1)
    bits = ["1", "2", "25", ".", ".", " ", "-", "+", "@", "a", "b.c", "(", ")", "4111111111111111", "é", "://", ":", "iban ", "0"]
    for _ in range(8000):
        text = "".join(random.choices(bits, k=random.randint(0, 25)))
        assert [s for s in pii.find_spans(text) if s[2] in pii.BASE_KINDS] == base_spans(text), text


def test_personal_data(spark, docs, empty):
    text = "IBAN DE89 3704 0044 0532 0130 00, ftp://joe:pw@host.org/x; mail é a.b@c.org, +1 (555) 010-9999"
    kinds = [(text[s:e], k) for s, e, k in pii.find_spans(text)]
    assert ("DE89 3704 0044 0532 0130 00", "account") in kinds and ("ftp://joe:pw@host.org", "address") in kinds
    assert ("a.b@c.org", "email") in kinds and ("+1 (555) 010-9999", "phone") in kinds
    assert pii.masked(text, pii.find_spans(text)).count("[") == 4 and "joe" not in pii.masked(text, pii.find_spans(text))
    assert pii.find(docs).count() == docs.count() and pii.find(empty).count() == 0
    r = pii.redact(docs)
    assert r.columns == docs.columns and r.count() == docs.count()
    assert pii.redact(empty).count() == 0


def test_accounts_are_checked_and_end_where_they_end():
    clean = [
        "Your account 1 was opened by the client in 2019 at branch 44",
        "account: 20 apples and 30 pears cost 4500 euro",
        "the accountant 123456789 and my accounts 123456",
        "account 2019-2020 and account 2021-05-12 were closed, account 2019 2020 too",
        "iban DE89 3704 0044 0532 0130 01 is mistyped",
        "ssn 000-12-3456 or ssn 666121234 or ssn 123-00-1234",
        "passport no. office in paris on 12 may 2020",
        "tax id 12345",
    ]
    for text in clean:
        assert [s for s in pii.find_spans(text) if s[2] == "account"] == [], text
    found = {
        "passport no. 123456789 issued in paris on 12 may 2020": "123456789",
        "IBAN: DE89 3704 0044 0532 0130 00 BANK": "DE89 3704 0044 0532 0130 00",
        "Iban BE68 5390 0754 7034 THEN more": "BE68 5390 0754 7034",
        "account number 12-345-678 is mine": "12-345-678",
        "my acct #: 0012345678.": "0012345678",
        "SSN 123-45-6789": "123-45-6789",
        "Tax ID: 12-3456789": "12-3456789",
        "social security number is 123456789": "123456789",
    }
    for text, want in found.items():
        assert [text[a:b] for a, b, k in pii.find_spans(text) if k == "account"] == [want], text


def test_language_code_lengths(spark, docs, empty):
    train = docs.filter("lang IS NOT NULL AND text <> ''").select("lang", "text")
    m = langid.train(train)
    counts = {}
    for lang, text in train.collect():
        b = langid.PAD + text.encode()
        for k in range(3, len(b)):
            for order in range(4):
                counts.setdefault((lang, order), Counter())[b[k - order : k + 1]] += 1
    contexts = {}
    for (lang, order), c in counts.items():
        total = sum(counts[lang, 0].values())
        for g in [g for g, n in c.items() if n < langid.RATE * total]:
            del c[g]
        for g, n in c.items():
            x = contexts.setdefault((lang, g[:-1]), [0, 0])
            x[0] += n
            x[1] += 1

    def bits(lang, text):
        b, total = langid.PAD + text, 0.0
        for k in range(3, len(b)):
            for order in (3, 2, 1, 0):
                x = contexts.get((lang, b[k - order : k]))
                if not x:
                    continue
                n = counts[lang, order].get(b[k - order : k + 1])
                total += math.log2(sum(x) / n) if n else math.log2(sum(x) / x[1])
                if n:
                    break
            else:
                total += 8
        return total

    texts = [b"", b"the model", b"zzz \xff\x00", "straße 日本".encode(), b"", b"q" * 50]
    assert np.allclose(m.bits(texts), [[bits(lang, t) for lang in m.langs] for t in texts])
    got = langid.predict(docs, m)
    assert got.count() == docs.count()
    und = {r.doc_id for r in got.filter("lang_pred = 'und'").collect()}
    assert und == {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")}
    assert got.filter("score < 0 OR score > 1").count() == 0
    nothing = langid.train(empty.select("lang", "text"))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert langid.predict(empty, m).count() == 0


def test_language_accuracy(spark):
    words = {"en": ["the", "and", "thing", "was", "with"], "de": ["der", "und", "nicht", "eine", "mit"], "fr": ["le", "et", "avec", "une", "pas"]}
    random.seed(4)
    rows = [(i, lang, " ".join(random.choices(words[lang], k=8))) for i in range(300) for lang in words]
    df = spark.createDataFrame(rows, "doc_id int, lang string, text string")
    m = langid.train(df.filter("doc_id < 200"))
    got = langid.predict(df.filter("doc_id >= 200").withColumn("doc_id", F.hash("doc_id", "lang")), m)
    truth = {r.h: r.lang for r in df.filter("doc_id >= 200").select(F.hash("doc_id", "lang").alias("h"), "lang").collect()}
    hits = [truth[r.doc_id] == r.lang_pred for r in got.collect()]
    assert sum(hits) / len(hits) > 0.98


def test_a_version_is_not_another_one(spark, monkeypatch):
    gpl = spark.createDataFrame([(1, "This work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string")
    names = {r.name for r in license_scan.scan(gpl).collect()}
    assert names and not any("2" in n for n in names), names
    known = [("v2", "licensed under the general license version 2"), ("v3", "licensed under the general license version 3"), ("the", "under the general license version")]
    known += [("long", "this work is licensed under the general license version 3 or later by all")]
    texts = ["It is licensed under the general license version 3.", "licensed under the general license version 2 and 3", "licensed under the general license version 4"]
    texts += [f"{known[0][1]}. {known[1][1]}", known[3][1], "this work is licensed under the general license version 3 or", "under the general license version"]
    d = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    t = spark.createDataFrame(known, "name string, text string")
    want = {0: ["v3", "v3"], 1: ["v2"], 2: ["the", "v2", "v3"], 3: ["v2", "v3"], 4: ["long"], 5: ["long", "v3"], 6: ["the"]}  # 2 leaves open which
    for most in (license_scan.MAX_KEYS, 6):  # templates in one part, and in several
        monkeypatch.setattr(license_scan, "MAX_KEYS", most)
        got = {}
        for r in license_scan.scan(d, t, least=0.6).orderBy("doc_id", "name").collect():
            got.setdefault(r.doc_id, []).append(r.name)
        assert {k: v for k, v in got.items() if k in want} == want, got


def test_license_scan_in_parts(spark, monkeypatch):
    """More templates than one pass looks up, null and repeated ids, and columns with clashing names."""
    random.seed(4)
    fill = lambda n: " ".join(f"w{random.randrange(900)}" for _ in range(n))
    templates = [(f"t{k}", fill(random.choice([6, 20, 60]))) for k in range(30)]
    texts = [(k // 2 if k % 5 else None, f"{fill(20)} {t} {fill(30)}") for k, (_, t) in enumerate(templates)] + [(7, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], "doc_id long, text string, name string, row int, s string")
    known = spark.createDataFrame(templates, "name string, text string")
    whole = sorted(map(str, license_scan.scan(docs, known).collect()))
    assert len(whole) == 30
    monkeypatch.setattr(license_scan, "MAX_KEYS", 100)
    assert sorted(map(str, license_scan.scan(docs, known).collect())) == whole


def test_quality(spark, docs, empty):
    got = docs.select("text", quality.features(F.col("text")).alias("f")).collect()
    for text, f in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert f.asDict() == {
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in quality.SYMBOLS),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        }
    judged = quality.judge(docs)
    assert judged.count() == docs.count() and judged.filter("base_failed AND kept").count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == judged.filter("kept").count()
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0


def test_quality_adapts(spark):
    clean = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", "a", 1) for i in range(100)]
    noisy = [(1000 + i, " ".join(f"w{i}x{k}%%%" for k in range(30)), "en", "a", 1) for i in range(10)]
    code = [(2000 + i, " ".join(f"w{i}x{k}%" for k in range(30)), "en", "code", 1) for i in range(100)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(clean + noisy + code, DOCS)).filter("kept").collect()}
    assert kept == {r[0] for r in clean + code}


def test_quality_fences(spark):
    """Each fence rejects, limits differ by group, and a source of junk cannot lift its own."""
    say = lambda i, n, form="w{}": " ".join(form.format(f"{i}x{k}") for k in range(n))
    lines = lambda i, n, same: "\n".join([say(i, 3)] * same + [f"v{i}y{k} " + say(k, 4, "u{}") for k in range(n)])
    rows = [(i, say(1000 + i, 40), "en", "a", 1) for i in range(100)]
    junk = [(200 + i, say(1000 + i, 40, "w{}%%"), "en", "junk", 1) for i in range(20)]
    junk += [(300 + i, say(1000 + i, 40), "en", "junk", 1) for i in range(20)]
    listed = [(400 + i, lines(1000 + i, 60, 12), "en", "lists", 1) for i in range(5)]
    long = [(500 + i, say(1000 + i, 40, "w{}" + "z" * 9), "en", "a", 1) for i in range(5)]
    german = [(700 + i, say(1000 + i, 40, "w{}" + "z" * 9), "de", "a", 1) for i in range(40)]
    df = spark.createDataFrame(rows + junk + listed + long + german, DOCS)
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(df).collect()}
    bad = {r[0] for r in junk[:20] + listed + long}
    assert {i for i, (failed, kept) in got.items() if not kept and not failed} == bad
    measured = df.select("lang", "source", quality.features(F.col("text")).alias("f"))
    limit = {(r.fence_lang, r.fence_source): r for r in quality.fences(measured).collect()}
    assert limit["de", "a"].mean_chars_high > limit["en", "a"].mean_chars_high
    assert limit["en", "junk"].symbol_ratio_high == limit["en", "a"].symbol_ratio_high


def test_mixing(spark, docs, empty):
    q = rows_of(mixing.queued(docs))
    size = Counter()
    for r in q:
        size[r["row"]["source"]] += r["size"]
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, free, budget = {}, set(names), float(sum(size.values()))
    while free:  # reshare what is above the cap
        share = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    taken = Counter()
    for r in q:
        s = r["row"]["source"]
        assert math.isclose(r["target"], target[s]) and r["source_size"] == size[s] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["size"] == len((r["row"]["text"] or "").encode().split())
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    key = lambda rows: sorted((str(r["row"]), r["taken"]) for r in rows)
    assert key(q) == key(rows_of(mixing.queued(docs.repartition(7))))
    m = mixing.mix(docs)
    words = m.select("source", F.size(quality.words(F.col("text"))).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    assert m.columns == docs.columns and {r.source: r.n for r in words.collect()} == {s: n for s, n in taken.items() if n}
    assert mixing.queued(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_cut_is_the_closed_form(spark):
    """The sorted queue's cut against water filling, over sources that run out at different times."""
    from fractions import Fraction

    rng = np.random.default_rng(5)
    for n_sources, spread in ((1, 1), (7, 3), (12, 400)):
        sizes = [[int(x) for x in rng.integers(0, 1 + spread ** rng.random() * 9, 15)] for _ in range(n_sources)]
        rows = [(k, f"s{k % n_sources:02d}", " ".join(["w"] * sizes[k % n_sources][k // n_sources])) for k in range(15 * n_sources)]
        got = rows_of(mixing.queued(spark.createDataFrame(rows, "doc_id long, source string, text string"), (2, 5, 3), keep=["source"]))
        size = {f"s{k:02d}": sum(v) for k, v in enumerate(sizes)}
        weight = {s: (2, 5, 3)[k % 3] for k, s in enumerate(sorted(size))}
        budget, free, level = Fraction(sum(size.values())), set(size), Fraction(0)
        while free:
            level = budget / sum(weight[s] for s in free)
            over = {s for s in free if level * weight[s] > 3 * size[s]}
            if not over:
                break
            budget -= sum(3 * size[s] for s in over)
            free -= over
        for s in size:
            target = min(Fraction(3 * size[s]), level * weight[s])
            mine = [r for r in got if r["row"]["source"] == s]
            assert all(math.isclose(r["target"], target, abs_tol=1e-9) for r in mine)
            assert abs(sum(r["taken"] for r in mine) - target) <= 1 and all(r["taken"] <= 3 * r["size"] for r in mine)


def test_mixing_spreads_rows_of_one_id(spark):
    rows = [(None, "a", f"word {k}") for k in range(300)] + [(7, "b", f"word {k}") for k in range(300)]
    got = rows_of(mixing.queued(spark.createDataFrame(rows, "doc_id long, source string, text string")))
    assert sorted({r["before"] for r in got if r["row"]["source"] == "a"}) == list(range(0, 600, 2))
    assert sum(r["taken"] for r in got) in range(1196, 1201)


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    hs = [xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))


def slow_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(spark, docs, empty):
    got = simhash.grouped(docs).collect()
    assert Counter((r.doc_id, r.fp) for r in got) == Counter(
        (r.doc_id, np.uint64(slow_fingerprint(r.text)).astype(np.int64).item()) for r in docs.collect()
    )
    of = slow_components({r.fp & (1 << 64) - 1 for r in got})
    smallest = {}
    for r in got:
        if r.doc_id is not None:
            k = of[r.fp & (1 << 64) - 1]
            smallest[k] = min(smallest.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == smallest.get(of[r.fp & (1 << 64) - 1]) for r in got)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(of.values()))
    assert simhash.grouped(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


def test_simhash_hot_keys(spark, docs, monkeypatch):
    """Joins of fingerprints and of nodes with many rows give what plain joins give."""
    want = Counter((r.doc_id, r.tie, r.fp, r.component_id) for r in simhash.grouped(docs).collect())
    monkeypatch.setattr(simhash, "HOT_ROWS", 1)
    assert Counter((r.doc_id, r.tie, r.fp, r.component_id) for r in simhash.grouped(docs).collect()) == want
    edges = spark.createDataFrame([(1, k) for k in range(2, 40)] + [(50, 51)], "a long, b long")
    nodes = spark.createDataFrame([(k, 100 - k) for k in [*range(1, 40), 50, 51]], "fp long, first long")
    got = {r.node: r.root.first for r in simhash.components(edges, nodes).collect()}
    assert got == {k: 61 for k in range(1, 40)} | {50: 49, 51: 49}


def test_links_lose_nothing(spark, monkeypatch):
    """Chains and clusters of fingerprints, also through lists that are dealt out in blocks."""
    random.seed(9)
    fps = set()
    for _ in range(6):
        x = random.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            for b in random.sample(range(64), random.randint(1, 5)):
                x ^= 1 << b
    fps |= {random.getrandbits(64) for _ in range(100)}
    of = slow_components(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    df = df.withColumn("first", F.when(F.col("fp") % 7 != 0, F.abs(F.col("fp") % 1000)))
    for block, limit in ((4, 10**6), (2048, 10**6), (4, 0)):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", limit)
        label = {r.node: r.root.fp for r in simhash.components(simhash.links(df, 4, block), df).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(of[f], set()).add(label.get(signed(f), signed(f)))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_position_sets_meet_every_agreement():
    from itertools import combinations

    for bits in range(1, 6):
        sets = simhash.position_sets(bits)
        assert all(any(set(t) <= set(q) for t in sets) for q in combinations(range(8), 8 - bits))


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 5])).tolist()) for i in range(400)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (450, [1.0, 2.0]), (500, [])]
    rows += [(404, rows[7][1]), (405, rows[7][1]), (100, rows[3][1]), (50, [0.0] * 6), (406, [1e9] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("score", F.lit("x"))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in good:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:5])]
    got = [tuple(r) for r in topk.top_k(df).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_pruning_keeps_what_reaches_the_bound():
    rng = np.random.default_rng(3)
    for _ in range(200):
        v = np.floor(rng.normal(size=(50, 4)) * 100)
        v = v[np.argsort(-np.sqrt((v**2).sum(1)), kind="stable")]
        q = np.floor(rng.normal(size=4) * 100)
        score = v @ q
        bound = float(np.sort(score)[-rng.integers(1, 10)])
        assert set(np.flatnonzero(score >= bound)) <= set(topk.survivors(q, v, np.sqrt((v**2).sum(1)), bound))


