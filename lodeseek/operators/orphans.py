"""References to records that do not exist.

``orphan_references`` finds the rows of a referencing table whose (possibly composite) key has no
live row in the target table. The references are grouped by null mask, i.e. by which of their key
columns are null, and every mask is anti-joined on its non-null columns under one declared match
semantics (the three of SQL's foreign keys):

* ``simple``: a reference with any null key column is no case; only the all-present mask is joined.
* ``partial``: the non-null columns must match some target row; the all-null mask is no case.
* ``full``: the all-null mask is no case, a mixed mask is a case, the all-present mask is joined.

Defined results: an empty reference table gives no rows and an empty target makes every reference
that takes part a case. A repeated reference row counts once per ``ref_id``. A target row that is
deleted or has no time proves nothing, and so does a reference without a time. Columns other than
those named are ignored, so clashing names in the two tables do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def relative_path(path: Column) -> Column:
    """Paths compare with forward slashes and without leading ``./`` segments; case matters."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./+)+", "")


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    *,
    ref_id: str,
    keys: Sequence[tuple[str, str]],
    match: str = "simple",
    ref_time: str | None = None,
    target_time: str | None = None,
    target_deleted: str | None = None,
    normalise=None,
    salt: int = 1,
) -> DataFrame:
    """Rows ``(ref_id, ref_time)`` of the references that lead nowhere.

    ``keys`` pairs the referencing with the referenced columns. The target is reduced to one row per
    key and mask (its earliest live time) before it is shuffled, so a hot key is hot on the
    reference side only; there AQE splits it, or ``salt`` > 1 spreads it over that many tasks
    against as many copies of the reduced target.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    clean = normalise or (lambda c: c)
    n = len(keys)
    r = refs.select(
        F.col(ref_id).alias("ref_id"),
        (F.col(ref_time) if ref_time else F.lit(None).cast("timestamp")).alias("ref_time"),
        *[clean(F.col(a)).alias(f"k{i}") for i, (a, _) in enumerate(keys)],
    )
    live = targets.filter(F.col(target_deleted).isNull()) if target_deleted else targets
    t = live.select(
        (F.col(target_time) if target_time else F.lit(None).cast("timestamp")).alias("live_from"),
        *[clean(F.col(b)).alias(f"t{i}") for i, (_, b) in enumerate(keys)],
    )
    found = []
    for mask in product((True, False), repeat=n):
        used = [i for i in range(n) if mask[i]]
        if not used or (match == "simple" and len(used) < n):
            continue
        rows = r.filter(reduce(lambda a, b: a & b, [F.col(f"k{i}").isNotNull() if mask[i] else F.col(f"k{i}").isNull() for i in range(n)]))
        if match == "full" and len(used) < n:
            found.append(rows.select("ref_id", "ref_time"))
            continue
        cols = [f"t{i}" for i in used]
        known = t.dropna(subset=cols).groupBy(*cols).agg(F.min("live_from").alias("live_from"))
        on = [F.col(f"k{i}") == F.col(f"t{i}") for i in used]
        if ref_time and target_time:
            on.append(F.col("live_from") <= F.col("ref_time"))
        if salt > 1:
            rows = rows.withColumn("_salt", F.pmod(F.xxhash64("ref_id"), F.lit(salt)))
            known = known.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
            on.append(F.col("_salt") == F.col("_slot"))
        found.append(rows.join(known, reduce(lambda a, b: a & b, on), "left_anti").select("ref_id", "ref_time"))
    if not found:
        return r.select("ref_id", "ref_time").limit(0)
    return reduce(DataFrame.unionByName, found)


def orphan_report(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Number of distinct orphan references per table and period of their time."""
    return (
        orphans.select("ref_table", F.date_format(F.date_trunc(period, "ref_time"), "yyyy-MM").alias("period"), "ref_id")
        .distinct()
        .groupBy("ref_table", "period")
        .agg(F.count("*").cast("long").alias("orphans"))
    )
