"""Parquet table access and partition sizing shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input a CPU-bound Python task should get; smaller inputs are spread over the idle cores.
TASKS_PER_CORE = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute ``df`` by ``keys`` when its scan has fewer partitions than the cluster has cores.

    A scan of 100 TB has far more splits than cores and is returned unchanged (no shuffle); only a
    table of a few row groups is hash-partitioned so that CPU-bound Python work uses every core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    cols = [F.col(k) for k in keys]
    return df.repartition(cores * TASKS_PER_CORE, *cols)
