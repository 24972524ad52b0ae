"""Session defaults for local use; on a cluster, pass the cluster's own session to the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def spread(rows: DataFrame) -> DataFrame:
    """`rows` dealt to all cores where its files give fewer splits than that; a table of many splits is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < rows.rdd.getNumPartitions() < cores else rows


def fixed(rows: DataFrame) -> DataFrame:
    """`rows` written once, so that later reads see the same partitions even after a lost executor.

    They go to the folder in spark.checkpoint.dir; a local session without one keeps them in memory and on disk.
    """
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return rows.checkpoint()
    return rows.persist()
