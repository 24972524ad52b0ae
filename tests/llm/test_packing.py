import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import packing

SF = "/root/testdata/sf0.001"


def reference_ids(text):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check(rows, texts):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for d, parts in by_doc.items():
        ids, at = reference_ids(texts[d]), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return sum(r.length for r in rows), len(by_seq)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.op10_packing_nnls(spark, SF).collect()
    tokens, sequences = check(rows, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert tokens > 0.97 * 2048 * (sequences - 1)


def test_edges(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "don't  stop\n\n", 5: "é" * 300, 6: "", 7: "<|endoftext|> x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit(1)).withColumn("k", F.lit("x"))
    check(packing.pack(docs).collect(), texts)
    assert packing.pack(docs.limit(0)).count() == 0
    twice = packing.pack(docs.union(docs)).groupBy("doc_id", "start").count().collect()
    assert all(r["count"] == 2 for r in twice)


def test_nnls_equals_brute_force():
    r = np.random.default_rng(3)
    for _ in range(20):
        a, b = r.random((6, 4)), r.normal(size=6)
        x = packing.nnls(a, b)
        best = np.inf
        for keep in range(16):
            at = [k for k in range(4) if keep >> k & 1]
            y = np.linalg.lstsq(a[:, at], b, rcond=None)[0] if at else np.zeros(0)
            if (y >= 0).all():
                best = min(best, float(((a[:, at] @ y - b) ** 2).sum()))
        assert (x >= 0).all() and abs(((a @ x - b) ** 2).sum() - best) < 1e-8


def test_plan_fills_windows():
    r = np.random.default_rng(5)
    lengths = r.integers(1, 2048, 20_000)
    hist = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    seq, offset, n = packing.pack_block(lengths, packing.plan(hist), 1.0)
    assert (seq >= 0).all() and lengths.sum() > 0.98 * 2048 * n


def test_separators_repeats_and_long_texts(spark):
    a, b = "ab", "ba"
    for _ in range(11):
        a, b = a + b, b + a
    long = " ".join(f"w{i % 997}é" for i in range(150_000))
    rows = [(1, "a\0b c\0"), (2, "\0"), (3, a + " " + b), (4, b + " " + a), (5, long)]
    check(packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), dict(rows))
    same = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text", "1L AS serial", "1L AS k")
    out = packing.pack(same, block_pieces=500)
    sizes = [r["n"] for r in out.groupBy((F.col("sequence_id") / F.lit(1 << 32)).cast("long").alias("block")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 800  # repeats of one row are dealt to all blocks
