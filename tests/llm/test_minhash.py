import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import minhash

SF = "/root/testdata/sf0.001"


def brute(docs):
    """component and set size of each (id, text) by comparing all pairs."""
    sets = {}
    for d, t in docs:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.kept == (r.doc_id == r.component_id)}


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got(minhash.op5_minmax_hash(spark, SF)) == brute([tuple(r) for r in docs])


def test_chains_copies_and_edges(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(1, None), (2, ""), (3, "one"), (4, "One"), (5, "a b c"), (6, "a b  C"), (7, " \n"), (8, "a b c d")]
    n = 10
    for _ in range(30):  # chains: each text differs a little from the one before
        words = [r.choice(vocabulary) for _ in range(r.choice([12, 60, 300]))]
        for _ in range(6):
            rows.append((n := n + 1, " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
    base = [r.choice(vocabulary) for _ in range(200)]
    for _ in range(60):  # copies about one base that is not the first
        words = list(base)
        for _ in range(5):
            words[r.randrange(200)] = r.choice(vocabulary)
        rows.append((n := n + 1, " ".join(words)))
    rows.append((n + 1, " ".join(base)))
    rows += [(n + 2 + i, " ".join(base)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("cid", F.lit("x"))
    assert got(minhash.near_duplicates(docs)) == brute(rows)
    twice = minhash.near_duplicates(docs.limit(20).union(docs.limit(20)))
    assert twice.count() == 40
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_null_keys_link(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (5, a), (6, a), (7, a + " more"), (None, b), (None, b), (9, b + " more"), (None, c), (None, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in out))
    assert got == [(0, 0, 0, True), (0, 57, 0, True), (0, 57, 5, False), (0, 57, 9, False), (0, 57, 9, False), (5, 57, 5, True), (6, 57, 5, False), (7, 58, 5, False), (9, 58, 9, True)]


def test_signature_is_unbiased():
    r = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        u = np.unique(r.integers(0, 2**63, 200, dtype=np.uint64))
        a, b = u[:160], u[40:]
        errors.append(minhash.estimate(minhash.signature([a]), minhash.signature([b]))[0] - 0.6)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < np.sqrt(0.24 / 144)


def near_copies(seed=9, size=150):
    """A base text in the middle of many edited copies, some of them too far from it but near each other, and a chain."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(4000)]
    base, rows = [r.choice(vocabulary) for _ in range(200)], []
    for edits in [4] * size + [9] * (size // 2) + [14] * (size // 3):
        words = list(base)
        for _ in range(edits):
            words[r.randrange(200)] = r.choice(vocabulary)
        rows.append(words)
        if edits == 14:  # a twin of an outlier
            rows.append([*words[:-1], "twin"])
    rows.append(base)
    words = list(base)
    for _ in range(40):
        words = list(words)
        for _ in range(3):
            words[r.randrange(200)] = r.choice(vocabulary)
        rows.append(words)
    r.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows, 1)]


def test_large_group_in_one_tile_and_in_many(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert len({c for _, c in want.values()}) > 20  # outliers that must not be linked
    for tile in (minhash.TILE, 9000, 1500):
        assert got(minhash.near_duplicates(docs, tile=tile)) == want, tile


def test_thue_morse_words_and_long_texts(spark):
    a, b = "ab", "ba"
    for _ in range(11):
        a, b = a + b, b + a
    long = " ".join(f"w{i % 7919}" for i in range(400_000))  # beyond a chunk
    rows = [(1, a), (2, b), (3, f"{a} {b} x"), (4, f"{b} {a} x"), (5, long), (6, long + " end")]
    out = got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == brute(rows)


def test_one_row_of_each_class_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a, 1), (5, a + " more", 2), (6, a, 3), (None, b, 4), (None, b, 5), (9, c, 6), (9, c, 7), (9, "other words that stay here", 8), (None, None, 9), (10, "", 10), (10, "", 11), (None, "  ", 12), (8, c + " tail", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumn("_k", F.lit("x")).withColumn("root", F.lit(1)).withColumn("stays", F.lit(True))
    out = minhash.deduplicated(docs).collect()
    kept = sorted(r.n for r in out)
    assert kept in ([2, 4, 8, 9, 10, 11, 12, 13], [2, 5, 8, 9, 10, 11, 12, 13])
    assert minhash.deduplicated(docs.limit(0)).count() == 0
    assert minhash.deduplicated(docs.filter("n = 8")).columns == docs.columns
