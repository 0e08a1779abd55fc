"""Retrieval quality against labels: where the first relevant hit stands, recall, MRR and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISS = 1_000_000_000


def first_relevant(labels: DataFrame, ranked: DataFrame, places: DataFrame) -> DataFrame:
    """``labels (query_id, file, target_line)`` with the ``rank`` of the first hit whose file and lines hold the target, or null.

    An equi-join on query and file with the line range as the rest of its condition.
    """
    hits = ranked.select("query_id", "chunk_id", "rank").join(places.select(F.col("id").alias("chunk_id"), F.col("file_path").alias("file"), "start_line", "end_line"), "chunk_id")
    best = labels.select("query_id", "file", "target_line").join(hits, ["query_id", "file"]).filter((F.col("start_line") <= F.col("target_line")) & (F.col("target_line") <= F.col("end_line")))
    ranks = best.groupBy("query_id", "file", "target_line").agg(F.min("rank").alias("rank"))
    return labels.join(ranks, ["query_id", "file", "target_line"], "left")


def quality(first: DataFrame, cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row: queries, misses, recall at each cutoff, mean reciprocal rank (a miss counts 0); zeros for no queries."""
    recall = [F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"recall_{k}") for k in cutoffs]
    return first.agg(F.count("*").alias("queries"), F.count_if(F.col("rank").isNull()).alias("misses"), *recall, F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def worse_than_either(hybrid: DataFrame, lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """One row: for how many queries the hybrid's rank is behind the better of the two; a miss is behind any rank but not behind a miss."""
    r = lambda df, name: df.select("query_id", F.coalesce("rank", F.lit(MISS)).alias(name))
    joined = r(hybrid, "h").join(r(lexical, "l"), "query_id").join(r(vector, "v"), "query_id")
    return joined.agg(F.count_if(F.col("h") > F.least("l", "v")).alias("worse"), F.count("*").alias("queries"))
