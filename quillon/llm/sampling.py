"""Bounded samples of labelled documents, shared by the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import stored


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, allowed: Column | None = None, classes: tuple[int, ...] = (0, 1), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of at most `per_class` labelled rows of each class.

    The rows of smallest id hash are taken, so the sample is the same at every
    run. Its ids, at most per_class * len(classes), are all that is broadcast.
    """
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isin(*classes))
    rows = (rows.filter(allowed) if allowed is not None else rows).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("label")).dropDuplicates(["_id"])
    chosen = None
    for c in classes:
        own = rows.filter(F.col("label") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = own if chosen is None else chosen.union(own)
    found = docs.select(docs[key].alias("_id"), docs[text].alias("text")).join(F.broadcast(chosen), "_id").select(F.col("_id").alias("doc_id"), "text", "label")
    return stored(found, "labelled-sample")
