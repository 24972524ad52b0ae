"""Quality classifier by importance resampling (operator 4).

Two generative models over hashed word uni- and bigrams, one of a bounded
sample of target text (labelled of high quality), one counted over all raw
text, give each document the log of its importance weight: the sum over its
n-grams of log p_target / p_raw. Gumbel top-k draws k documents without
replacement in proportion to the weights; k is a stated share of the
documents, by default the share of target rows among the labelled ones and
SPARE more, as that share is an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .sampling import labelled_sample
from .textblocks import chunks, column, hash_spans, rows_of, small_batches, stored, windows, word_spans

BITS = 12
#: Target documents the target model is counted on, at most.
SAMPLE = 8192
#: Occurrences a bucket that the raw model counts for in the target model.
PRIOR = 10
#: Added to the labelled share of target documents: k is rather too large than too small.
SPARE = 0.01
SEED = 20240607
_SIZE = 2 << BITS


def buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word (first half of the buckets) and word pair (second half)."""
    starts, ends, first = word_spans(buf, offsets)
    words = hash_spans(buf, starts, ends, lower=True)
    pairs, at = windows(words, first, 2)
    row = rows_of(first)
    fold = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([row, row[at]]), np.concatenate([fold(words), fold(pairs) + (1 << BITS)])


def counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Occurrences of each bucket over all of `docs`; at most one row a bucket reaches the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE, np.int64)
        for batch in batches:
            for _, _, buf, offsets in chunks(column(batch, "t")):
                total += np.bincount(buckets(buf, offsets)[1], minlength=_SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SIZE)), pa.array(total)], ["b", "n"])

    got = docs.select(docs[text].alias("t")).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_SIZE)
    out[got["b"].to_numpy()] = got["n"].to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target / p_raw of each bucket, add-one smoothed, for words and pairs apart.

    The target model has the raw one as its prior, worth PRIOR occurrences a
    bucket, so buckets that a small target sample hardly fills stay near 0.
    """
    out = np.zeros(_SIZE)
    for half in (slice(0, _SIZE // 2), slice(_SIZE // 2, _SIZE)):
        t, r = target[half] + 1, raw[half] + 1
        prior = r / r.sum()
        t = t + PRIOR * len(t) * prior
        out[half] = np.log(t / t.sum()) - np.log(prior)
    return out


def weigher(ratio: np.ndarray):
    """Log importance weight of a text column's texts (null or empty: 0)."""

    def weigh(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for i, j, buf, offsets in chunks(texts.fill_null("")):
            row, bucket = buckets(buf, offsets)
            out[i:j] = np.bincount(row, weights=ratio[bucket], minlength=j - i)
        return pa.array(out)

    return F.arrow_udf(weigh, "double")


def gumbel(key: str = "doc_id", seed: int = SEED) -> Column:
    """Standard Gumbel noise fixed by id and seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, name: str, k: int) -> float:
    """Exact k-th largest of a column of finite doubles, by narrowing histograms of at most 4,096 bins."""
    span = values.agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.count(name).alias("n")).first()
    lo, hi, n = span["lo"], span["hi"], span["n"]
    if n == 0 or k > n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    rows, above = values.select(F.col(name).alias("v")).filter("v is not null"), 0
    while n > 4096 and lo < hi:
        width = (hi - lo) / 4096
        if width == 0 or lo + width == lo:
            break
        bin_ = F.least(F.floor((F.col("v") - lo) / width), F.lit(4095))
        table = rows.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(table, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
        rows = rows.filter((F.col("v") >= lo) & (F.col("v") <= hi))
    if lo == hi:
        return lo
    return rows.orderBy(F.desc("v")).offset(k - above - 1).limit(1).first()["v"]


def fitted(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratios of the buckets: target from labels.quality = 1, raw from all of `docs`."""
    target = labelled_sample(docs, labels, "quality", SAMPLE, classes=(1,))
    return log_ratio(counts(target), counts(docs))


def share(labels: DataFrame, label: str = "quality") -> float:
    """Part of the documents to draw: that of target rows (1) among the labelled ones, and SPARE; all without labels."""
    n = {r["y"]: r["n"] for r in labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    return min(1.0, n.get(1, 0) / sum(n.values()) + SPARE) if n else 1.0


def resample(docs: DataFrame, ratio: np.ndarray, part: float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, log_weight, gumbel_key, selected for every document; round(part * documents) are selected.

    Null and empty texts weigh 0 (as likely either way). Rows tied at the k-th
    key are all selected; repeated rows share their noise and so their fate.
    An empty table gives an empty result; extra columns are dropped.
    """
    small_batches(docs.sparkSession)
    scored = stored(docs.select(docs[key].alias("k"), weigher(ratio)(docs[text]).alias("log_weight")).withColumn("gumbel_key", F.col("log_weight") + gumbel("k")), "importance")
    threshold = cut(scored, part)
    return scored.select(F.col("k").alias(key), "log_weight", "gumbel_key", (F.col("gumbel_key") >= threshold).alias("selected"))


def cut(scored: DataFrame, part: float) -> float:
    """The k-th largest Gumbel key, k = round(part * rows)."""
    return kth_largest(scored, "gumbel_key", int(part * scored.count() + 0.5))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, gumbel_key and selected for `documents`, by `resample`."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = spread(docs)
    return resample(docs, fitted(docs, labels), share(labels))
