import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import lm_scoring as lm
from quillon.llm.eliasfano import EliasFano, TrieShard

SF = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**61), max_size=80), st.lists(st.integers(0, 2**61), max_size=30))
def test_elias_fano(values, queries):
    v = np.array(sorted(values), np.uint64)
    ef = EliasFano.build(v)
    assert ef.get(np.arange(len(v))).tolist() == v.tolist()
    q = np.array([*queries, *values, *[x + 1 for x in values]], np.uint64)
    assert ef.successor(q).tolist() == np.searchsorted(v, q).tolist()


def test_trie_shard(tmp_path):
    r = np.random.default_rng(3)
    contexts = np.unique(r.integers(0, 2**63, 50, dtype=np.uint64))
    lists = [np.unique(r.integers(0, 2**40, r.integers(1, 30), dtype=np.uint64)) for _ in contexts]
    codes = r.integers(1, 255, sum(map(len, lists))).astype(np.uint8)
    made = TrieShard.build(contexts, np.cumsum([0, *map(len, lists)]), np.concatenate(lists), codes)
    made.save(str(tmp_path / "shard"))
    shard = TrieShard.open(str(tmp_path / "shard"))
    at, got = shard.find(np.repeat(contexts, list(map(len, lists))), np.concatenate(lists))
    assert got.tolist() == codes.tolist() and at.tolist() == np.repeat(np.arange(len(contexts)), list(map(len, lists))).tolist()
    at, got = shard.find(contexts[:5] + np.uint64(1), lists[0][:1].repeat(5))
    assert (at == -1).all() and (got == 0).all()


def brute_base(texts, train):
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for d, t in texts.items()}
    c = Counter(x for d in texts if d in train for x in tokens[d])
    n, v = sum(c.values()), len(c)
    return {d: (len(x), sum(w in c for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for d, x in tokens.items()}


def test_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    train = {d for d in texts if zlib.crc32(str(d).encode()) % 7 != 2}
    want, rows = brute_base(texts, train), lm.op9_trie_scores(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in train, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_against_brute_force(spark):
    texts = {1: "a b a b a c", 2: "b a a", 3: "", 4: None, 5: "A z"}
    docs = spark.createDataFrame([(d, t, d < 4) for d, t in texts.items()], "doc_id long, text string, train boolean").withColumn("k", F.lit(1))
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    base = brute_base(texts, {1, 2, 3})
    assert {d: (r.n_tokens, r.n_known, r.train_tokens) for d, r in got.items()} == {d: b[:3] for d, b in base.items()}
    # p(w | "a") over the vocabulary and one unknown word sums to 1 (up to quantisation)
    words = ["a", "b", "c", "q"]
    probe = spark.createDataFrame([(d, t, True) for d, t in texts.items() if d < 4] + [(10 + k, f"a {w}", False) for k, w in enumerate(words)] + [(20, "a", False)], "doc_id long, text string, train boolean")
    out = {r.doc_id: r.score for r in lm.score(probe).collect()}
    assert out[20] < 0 and out[11] > out[13]
    assert lm.score(docs.limit(0)).count() == 0
    none = lm.score(docs.withColumn("train", F.lit(False))).collect()
    assert all(abs(r.score) < 1e-9 and r.train_tokens == 0 for r in none)
    assert lm.score(docs.union(docs)).count() == 10


def brute_scores(texts, train, order, cut=0.9):
    """Interpolated scores with one discount, or those of the module (cut None)."""
    off = lambda n: lm.DISCOUNTS[min(n, 3)] if cut is None else cut
    tokens = {d: [1, *t.split(), None] for d, t in texts.items()}  # 1 is the start
    grams = Counter(tuple(x[i - k + 1 : i + 1]) for d, x in tokens.items() if d in train for k in range(1, order + 1) for i in range(max(1, k - 1), len(x)))
    total, kinds, mass = Counter(), Counter(), Counter()
    for g, n in grams.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1
        mass[g[:-1]] += off(n)

    def p(g):
        if len(g) == 1:
            return (grams[g] + 1) / (total[()] + kinds[()] + 1)
        if not total[g[:-1]]:
            return p(g[1:])
        return (max(0.0, grams[g] - off(grams[g])) + mass[g[:-1]] * p(g[1:])) / total[g[:-1]]

    return {d: [math.log10(p(tuple(x[max(0, i - order + 1) : i + 1]))) for i in range(1, len(x))] for d, x in tokens.items()}


def test_longer_contexts_count(spark):
    learned = ["x b c e f", "y b d e g", "x b c e f a", "z z z z"]
    texts = {100 * i + k: t for i, t in enumerate(learned) for k in range(3)} | {1000: "x b c", 1001: "x b d", 1002: "y b d e f", 1003: "q b c e f", 1004: "z z z", 1005: "y b d e g"}
    docs = spark.createDataFrame([(d, t, d < 1000) for d, t in texts.items()], "doc_id long, text string, train boolean")
    for order in (None, 2, 4):
        got = {r.doc_id: r.score for r in (lm.score(docs) if order is None else lm.score(docs, order=order)).collect()}
        want = brute_scores(texts, {d for d in texts if d < 1000}, order or 3)
        for d, each in want.items():
            assert abs(got[d] - sum(each)) < 0.02 * len(each), (order, d, got[d], sum(each))
        if order != 2:
            assert got[1000] > got[1001] + 0.5  # a bigram model cannot tell which of c and d follows "x b"


def test_null_ids_long_texts_and_probabilities_that_sum_to_one(spark):
    a, b = "ab", "ba"
    for _ in range(11):
        a, b = a + b, b + a
    long = " ".join(f"w{i % 401}" for i in range(300_000))  # beyond a chunk
    texts = [f"{a} {b}", f"{b} {a}", long, None, "x y z x y x"]
    docs = spark.createDataFrame([(None, t, k % 2 == 0) for k, t in enumerate(texts)], "doc_id long, text string, train boolean")
    rows = lm.score(docs).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3, 3, 7, 300_001] and all(r.train_tokens == 300_011 for r in rows)
    # p(w | x) over all words, the end and one unknown word sums to 1, up to the codes' steps
    learned = ["x y", "x y", "x y", "x z", "x z", "y x", "x"]
    words = ["x", "y", "z", "unseen"]
    probe = [(k, t, True) for k, t in enumerate(learned)] + [(100 + k, f"x {w}", False) for k, w in enumerate(words)] + [(200 + k, w, False) for k, w in enumerate(words)] + [(300, "x", False)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(probe, "doc_id long, text string, train boolean"), order=2).collect()}
    want = brute_scores({d: t for d, t, _ in probe}, set(range(len(learned))), 2, cut=None)
    given_x = [sum(10 ** want[100 + k][1] for k in range(len(words))) + 10 ** want[300][1]]
    assert abs(given_x[0] - 1) < 1e-9
    for d, each in want.items():
        assert abs(got[d].score - sum(each)) < 0.02 * len(each), d
