"""Training-data pipeline: five stages over `documents`, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
`documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import minhash, packing, quality_sampling, secrets, toxicity
from quillon.llm.textblocks import small_batches, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    Null and empty texts stay unless labels make toxicity the rule. Repeated rows share their fate; an empty table stays empty.
    """
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.scorer(model)("text") < 0.5)


def resample(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by Gumbel top-k on their importance weights; texts unlike the target go.

    Null and empty texts weigh 0. Repeated rows share their fate. An empty table stays empty; without labels all stay.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weight = quality_sampling.weigher(quality_sampling.fitted(docs, labels))(docs["text"])
    weighed = stored(docs.select(weight.alias("log_weight"), quality_sampling.gumbel().alias("g")).select((F.col("log_weight") + F.col("g")).alias("gumbel_key")), "importance")
    threshold = quality_sampling.cut(weighed, quality_sampling.share(labels))
    return docs.filter(weight + quality_sampling.gumbel() >= threshold)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, similarity 0.8), and one of repeated rows.

    Documents without an id take part: one stays where its class has no document with an id.
    """
    return minhash.deduplicated(docs, width=5)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found masked and n_chars counted again. Null and empty texts and repeated rows stay as they are; an empty table stays empty."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of padded sequences. Null and empty texts are one piece of the end id; repeated rows are packed as often as they come; an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", resample),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: Trained models, hashing and tokenisation: SQL cannot express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
