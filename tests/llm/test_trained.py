import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.llm import quality_sampling as qs
from quillon.llm import toxicity
from quillon.llm.textblocks import flat

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    rows = toxicity.op2_toxicity_nbsvm(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    got = rows.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_toxic_documents_are_found(spark):
    big = SF.replace("0.01", "0.1")
    got = toxicity.op2_toxicity_nbsvm(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted for r in got if r.toxic == 1]) > 0.9
    assert np.mean([r.predicted for r in got if r.toxic == 1 and r.quality == 1]) > 0.97
    assert np.mean([r.predicted for r in got if r.toxic == 0]) < 0.01


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "you idiot you idiot"), (4, "you idiot you idiot")], "doc_id long, text string").withColumn("label", F.lit(3))
    labels = spark.createDataFrame([(1, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    score = dict(docs.select("doc_id", toxicity.scorer(model)("text").alias("s")).collect())
    assert score[4] > 0.5 > score[3] and score[1] == score[2]
    one = toxicity.fitted(docs, labels.filter("toxic = 0"))
    assert one.scores(pa.array(["a", None])).max() < 0.5
    assert toxicity.fitted(docs.limit(0), labels.limit(0)).scores(pa.array([], pa.string())).size == 0


def brute_grams(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [(n, text[i : i + n]) for n in toxicity.SIZES for i in range(len(text) - n + 1)]


def test_ratios_and_scores_against_brute_force(spark):
    rows = [(k, t, y) for k, (t, y) in enumerate([("you Idiot", 1), ("nasty idiot é日本", 1), ("a kind word", 0), ("kind words, é日本", 0), ("", 0), (None, 0)])]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int").select("text", "label"))
    n = [4, 2]
    frequency = [Counter(g for _, t, y in rows if y == c for g in set(brute_grams(t))) for c in (0, 1)]
    buf, offsets = flat(pa.array(["idiot"]))
    for gram, bucket in zip(["idio", "diot", "idiot"], toxicity.grams(buf, offsets)[1], strict=True):
        key = (len(gram), gram)
        ratio = np.log((frequency[1][key] + 0.5) / (n[1] + 1) / ((frequency[0][key] + 0.5) / (n[0] + 1)))
        # A weight is the regression's coefficient times the ratio: both signs agree for a gram of one class only.
        assert np.sign(model.weight[model.index[bucket]]) == np.sign(ratio) == 1
    for _, t, _ in rows:
        buf, offsets = flat(pa.array([t or ""]))
        count = Counter(toxicity.grams(buf, offsets)[1].tolist())
        assert len(toxicity.grams(buf, offsets)[1]) == len(brute_grams(t))
        z = model.bias + sum(np.log1p(c) * model.weight[model.index[b]] for b, c in count.items() if model.index[b] >= 0)
        assert abs(model.scores(pa.array([t], pa.string()))[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_null_ids_and_ties(spark, tmp_path):
    docs = spark.createDataFrame([(None, "nice"), (1, "bad idiot"), (2, "nice")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.op2_toxicity_nbsvm(spark, str(tmp_path)).collect()}
    assert all(r.held_out is not None and r.predicted == int(r.score >= 0.5) for r in rows.values()) and rows[None].held_out
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert toxicity.op2_toxicity_nbsvm(spark, f"{tmp_path}/none").count() == 0
    assert qs.op4_importance_resampling(spark, f"{tmp_path}/none").count() == 0


def test_importance_weights_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        buf, offsets = flat(pa.array([text]))
        assert len(qs.buckets(buf, offsets)[1]) == 2 * len(words) - bool(words)
        return qs.buckets(buf, offsets)[1].tolist()

    each = {d: grams(t) for d, t in texts.items()}
    raw, target = (Counter(g for d in ids for g in each[d]) for ids in (each, [d for d in each if quality.get(d) == 1]))
    half = qs._SIZE // 2
    total = [sum(raw[g] + 1 for g in range(a, a + half)) for a in (0, half)]
    mass = [sum(target[g] + 1 for g in range(a, a + half)) + qs.PRIOR * half for a in (0, half)]

    def log_ratio(g):
        prior = (raw[g] + 1) / total[g >= half]
        return np.log((target[g] + 1 + qs.PRIOR * half * prior) / mass[g >= half] / prior)

    part = qs.share(labels)
    y = [v for v in quality.values() if v in (0, 1)]
    assert abs(part - min(1, np.mean(y) + qs.SPARE)) < 1e-9
    rows = qs.resample(docs, qs.fitted(docs, labels), part).collect()
    for r in rows:
        want = sum(map(log_ratio, each[r.doc_id]))
        assert abs(r.log_weight - want) < 1e-6 * max(1, len(each[r.doc_id])), r.doc_id
    order = sorted((r.gumbel_key for r in rows), reverse=True)
    k = int(part * len(rows) + 0.5)
    assert {r.doc_id for r in rows if r.selected} == {r.doc_id for r in rows if r.gumbel_key >= order[k - 1]}
    good = [r.selected for r in rows if quality.get(r.doc_id) == 1]
    bad = [r.selected for r in rows if quality.get(r.doc_id) == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4


def test_kth_largest(spark):
    r = np.random.default_rng(1)
    values = np.concatenate([r.normal(size=9000), np.full(3000, 0.5), r.normal(size=50) * 1e6])
    df = spark.createDataFrame(pa.table({"v": values}).to_pandas())
    order = np.sort(values)[::-1]
    for k in (1, 17, 3000, 6000, len(values)):
        assert qs.kth_largest(df, "v", k) == order[k - 1]
    assert qs.kth_largest(df, "v", 0) == float("inf") and qs.kth_largest(df.limit(0), "v", 5) == float("-inf")


def test_importance_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a")], "doc_id long, text string").withColumn("k", F.lit(1))
    got = qs.resample(docs, np.zeros(qs._SIZE), 1.0).collect()
    assert len(got) == 5 and all(r.selected for r in got if r.doc_id) and all(r.log_weight == 0 for r in got if r.doc_id in (1, 2))
    assert qs.resample(docs.limit(0), np.zeros(qs._SIZE), 1.0).count() == 0
    assert qs.share(spark.createDataFrame([], "quality int")) == 1.0


def test_texts_beyond_a_chunk(spark):
    long = "you idiot " * 150_000
    docs = spark.createDataFrame([(1, long), (2, "a kind word"), (3, "you idiot"), (None, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    score = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.scorer(model)("text").alias("s")).collect()}
    assert score[1] == score[None] > 0.5 > score[2]
    ratio = np.linspace(-1e-3, 1e-3, qs._SIZE)
    rows = {r.doc_id: r.log_weight for r in qs.resample(docs, ratio, 1.0).collect()}
    buf, offsets = flat(pa.array([long]))
    assert abs(rows[1] - ratio[qs.buckets(buf, offsets)[1]].sum()) < 1e-6 and rows[None] == rows[1]
