"""What changed between two states of a set of files, and the upkeep of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``; one shuffle on the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def changes(now: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("repo_id", "path"), hash_col: str = "content_hash") -> DataFrame:
    """Rows ``(*keys, change)`` with change one of new, changed, deleted, same. Only the hash decides, null-safely;
    a stored state is of one repository or several, and paths compare within theirs. One shuffle: both
    sides are added up in a groupBy."""
    a = now.select(*keys, F.lit(True).alias("here"), F.col(hash_col).alias("h"))
    b = stored.select(*keys, F.lit(False).alias("here"), F.col(hash_col).alias("h"))
    g = a.unionByName(b).groupBy(*keys).agg(
        F.bool_or("here").alias("in_now"), F.bool_or(~F.col("here")).alias("in_old"), F.max(F.when(F.col("here"), F.col("h"))).alias("h1"), F.max(F.when(~F.col("here"), F.col("h"))).alias("h0")
    )
    change = F.when(~F.col("in_old"), "new").when(~F.col("in_now"), "deleted").when(F.col("h1").eqNullSafe(F.col("h0")), "same").otherwise("changed")
    return g.select(*keys, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("repo_id", "path")) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def remove(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")
