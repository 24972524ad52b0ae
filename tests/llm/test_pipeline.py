from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillon.llm import minhash, packing, secrets

SF = "/root/testdata/sf0.01"


def test_stages_keep_clean_documents_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 and toxic = 0")
    kept = docs
    for name, stage in cp.STAGES[:2]:
        before = kept.join(labels, "doc_id").count()
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
        assert kept.join(labels, "doc_id").count() > 0.96 * before, name
    deduped = cp.drop_near_duplicates(spark, kept, SF).cache()
    classes = minhash.near_duplicates(kept, width=5)
    assert deduped.columns == docs.columns and deduped.count() == classes.select("component_id").distinct().count()
    masked = cp.mask_secrets(spark, deduped, SF).cache()
    assert masked.columns == docs.columns and masked.count() == deduped.count()
    assert secrets.scan(masked).filter(F.exists("base", lambda s: s["kind"] != 0)).count() == 0
    packed = cp.pack(spark, masked, SF)
    assert packed.select("doc_id").distinct().count() == masked.count()


def test_run_and_hostile_rows(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "no id", None, None, None), (None, None, "en", "s", 0), (-1, None, None, "s", None), (-2, "", "en", None, 0), (-3, "x", "en", "s", 1), (-3, "x", "en", "s", 1)], base.schema)
    base.union(odd).withColumn("label", F.lit(1)).withColumn("spans", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).columns == packing.pack(base).columns
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert cp.run(spark, f"{tmp_path}/empty").count() == 0


def test_run_against_brute_force(spark):
    """Every decision of the five stages made again in plain Python, from the fitted models and the noise alone."""
    import re
    import zlib

    import numpy as np
    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quillon.llm import quality_sampling as qs
    from quillon.llm import toxicity
    from quillon.llm.textblocks import flat

    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    scores = toxicity.fitted(docs, labels).scores(pa.array([texts[d] for d in ids], pa.string()))
    clean = [d for d, s in zip(ids, scores, strict=True) if s < 0.5]

    left = docs.filter(F.col("doc_id").isin(clean))
    ratio = qs.fitted(left, labels)
    noise = {r.doc_id: r.g for r in left.select("doc_id", qs.gumbel().alias("g")).collect()}
    keys = {d: ratio[qs.buckets(*flat(pa.array([texts[d]])))[1]].sum() + noise[d] for d in clean}
    k = int(qs.share(labels) * len(clean) + 0.5)
    cut = sorted(keys.values(), reverse=True)[k - 1]
    drawn = [d for d in clean if keys[d] >= cut - 1e-9]

    sets = {}
    for d in drawn:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[d]))
        sets[d] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    root = {d: d for d in drawn}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(drawn):
        for b in drawn[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    stay = [d for d in drawn if find(d) == d]

    found = {r.doc_id: r.spans for r in secrets.scan(docs.filter(F.col("doc_id").isin(stay))).collect()}
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = {}
    for d in stay:
        out, at = [], 0
        for s in sorted(found[d], key=lambda s: s.start):
            if s.start >= at:
                out += [texts[d][at : s.start], secrets.MASK]
            at = max(at, s.end)
        own = np.array(tokenizer.encode("".join([*out, texts[d][at:]]), add_special_tokens=False).ids + [1], "<u4")
        want[d] = (len(own), [zlib.crc32(own[a : a + 2048].tobytes()) for a in range(0, len(own), 2048)])
    got, fill = {}, {}
    for r in cp.run(spark, small).collect():
        got.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: (p[0].doc_tokens, [r.ids_crc32 for r in sorted(p, key=lambda r: r.start)]) for d, p in got.items()} == want
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
