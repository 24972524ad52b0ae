"""Toxicity: a character n-gram linear classifier with naive Bayes scaled features (operator 2).

Features are lower-cased character 4- and 5-grams, hashed. Document frequencies by
class in a bounded labelled sample give log-count ratios; the most telling
grams become features log(1 + count) * ratio of a logistic regression. The
model, one number a hash bucket, has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .sampling import labelled_sample
from .textblocks import LOWER_BYTE, chunks, code_points, column, crc_remainder, mix, rows_of, small_batches

SIZES = (4, 5)
#: Bytes of text whose grams are held at once (a longer text counts as one).
PART = 1 << 18
BITS = 17
#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 3000
FEATURES = 4096
L2, ROUNDS = 1e-4, 400


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every gram of code points that lies within a row."""
    point, first = code_points(LOWER_BYTE[buf], offsets)
    n, point = len(point), np.concatenate([point, np.zeros(8, np.uint32)]).astype(np.uint64)
    row = rows_of(first)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    rows, buckets = [], []
    for k, size in enumerate(SIZES):
        code = np.zeros(n, np.uint64)
        for j in range(size):
            code = code * np.uint64(0xD6E8FEB86659FD93) + point[j : j + n]
        at = np.flatnonzero(room >= size)
        buckets.append((mix(code[at]) >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS))
        rows.append(row[at])
    return np.concatenate(rows), np.concatenate(buckets)


def feature_counts(buf: np.ndarray, offsets: np.ndarray, index: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the features present; `index` maps a bucket to a feature or -1."""
    row, bucket = grams(buf, offsets)
    feature = index[bucket]
    has = feature >= 0
    key, count = np.unique(row[has] * width + feature[has], return_counts=True)
    return key // width, key % width, count


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text (null: empty)."""
        out = np.full(len(texts), self.bias)
        for i, j, buf, offsets in chunks(texts.fill_null(""), PART):
            row, feature, count = feature_counts(buf, offsets, self.index, len(self.weight))
            out[i:j] += np.bincount(row, weights=np.log1p(count) * self.weight[feature], minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _frequencies(sample: DataFrame) -> np.ndarray:
    """Documents of each class that hold each bucket: (2, buckets). Counted on the executors; at most one row a bucket comes back."""
    size = len(SIZES) << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            label = np.array(batch.column(1).to_pylist())
            for i, _, buf, offsets in chunks(column(batch, "text"), PART):
                row, bucket = grams(buf, offsets)
                key = np.unique(row * size + bucket)
                for c in (0, 1):
                    total[c] += np.bincount(key[label[i + key // size] == c] % size, minlength=size)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["b", "n0", "n1"])

    got = sample.select("text", "label").mapInArrow(run, "b long, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros((2, size))
    at = got["b"].to_numpy()
    out[0, at], out[1, at] = got["n0"].to_numpy(), got["n1"].to_numpy()
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Class-balanced, L2-regularised logistic regression by accelerated gradient steps of a safe length."""
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32) / len(y)
    u = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        u = x.T @ (cost * (x @ u))
        norm = float(np.linalg.norm(u)) or 1.0
        u /= norm
    step = 1 / (norm / 4 + L2 + 0.3)
    w, b, v, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(ROUNDS):
        e = cost * (1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60))) - y).astype(np.float32)
        v = 0.9 * v - step * (x.T @ e + L2 * w)
        vb = 0.9 * vb - step * float(e.sum())
        w, b = w + v, b + vb
    return w, b


def train(sample: DataFrame, features: int = FEATURES) -> Model:
    """Fit on (text, label) rows with labels 0 and 1; of one class only, or none, a constant score results.

    Null and empty texts have no features; repeated rows count as often as they come; extra columns are not read.
    """
    n = {int(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    frequency = _frequencies(sample)
    p, q = (frequency[1] + 0.5) / (n1 + 1), (frequency[0] + 0.5) / (n0 + 1)
    ratio = np.log(p / q)
    index = np.full(frequency.shape[1], -1, np.int64)
    if not n0 or not n1:
        return Model(index, np.zeros(1), float(np.log((n1 + 1) / (n0 + 1))))
    mean = (p + q) / 2
    telling = (p - q) ** 2 / (mean * (1 - np.minimum(mean, 0.999)) + 1e-3)
    top = np.argsort(-telling, kind="stable")[:features]
    index[top] = np.arange(len(top))
    width = len(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in chunks(column(batch, "text"), PART):
                row, feature, count = feature_counts(buf, offsets, index, width)
                bounds = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v)) for v in (feature.astype(np.int32), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), *lists], ["y", "f", "c"])

    rows = sample.select("text", "label").mapInArrow(run, "y int, f array<int>, c array<int>").toArrow().combine_chunks()
    y = rows["y"].to_numpy().astype(np.float32)
    x = np.zeros((len(y), width), np.float32)
    for k, (f, c) in enumerate(zip(rows["f"], rows["c"], strict=True)):
        x[k, f.values.to_numpy()] = np.log1p(c.values.to_numpy())
    x *= ratio[top].astype(np.float32)
    scale = 10 / max(1e-9, float(np.abs(x).sum(axis=1).mean()))
    x *= scale
    w, b = _logistic(x, y)
    return Model(index, w.astype(np.float64) * ratio[top] * scale, float(b))


def scorer(model: Model):
    """The model as a column function of a text column; null and empty texts get the bias's probability."""
    return F.arrow_udf(lambda texts: pa.array(model.scores(texts)), "double")


def fitted(docs: DataFrame, labels: DataFrame, held_out: bool = False) -> Model:
    """A model of labels.toxic; with `held_out`, only ids whose crc32 mod 5 is not 0 are learned from.

    Labels without an id, with another label than 0 or 1, or whose id no document has are left out; of labels that repeat an
    id one counts. Empty tables give a constant score. Extra columns of either table are not read.
    """
    small_batches(docs.sparkSession)
    allowed = crc_remainder("doc_id", 5) != 0 if held_out else None
    return train(labelled_sample(docs, labels, "toxic", SAMPLE_PER_CLASS, allowed))


def op2_toxicity_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted. Null and empty texts score as the bias alone; repeated rows repeat."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=True)
    scored = docs.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
