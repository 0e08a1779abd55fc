from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodeseek.operators.orphans import orphan_references, orphan_report, relative_path

T0, T1, T2 = datetime(2025, 1, 1), datetime(2025, 2, 1), datetime(2025, 3, 1)


def run(spark, refs, targets, **kw):
    r = spark.createDataFrame(refs, "rid long, k string, at timestamp, name string")
    t = spark.createDataFrame(targets, "id string, at timestamp, gone timestamp, name string")
    kw = dict(ref_time="at", target_time="at", target_deleted="gone", normalise=relative_path) | kw
    return sorted({x.ref_id for x in orphan_references(r, t, ref_id="rid", keys=[("k", "id")], **kw).collect()})


def test_missing_deleted_and_later(spark):
    refs = [(1, "a", T1, None), (2, "b", T1, None), (3, "c", T1, None), (4, None, T1, None), (5, "./a", T1, "x"), (6, ".\\d\\e", T1, None), (7, "A", T1, None), (2, "b", T1, None), (8, "a", T0, None), (9, "f", T1, None)]
    targets = [("a", T1, None, "n"), ("b", T0, T1, "n"), ("c", T2, None, "n"), ("d/e", T0, None, None), ("f", T0, T1, None), ("f", T1, None, None), (None, T0, None, None)]
    for salt in (1, 3):
        assert run(spark, refs, targets, salt=salt) == [2, 3, 7, 8]


def test_empty_tables(spark):
    assert run(spark, [], [("a", T0, None, None)]) == []
    assert run(spark, [(1, "a", T1, None), (2, None, T1, None)], []) == [1]


@pytest.mark.parametrize("match, want", [("simple", [2]), ("partial", [2, 4]), ("full", [2, 3, 4])])
def test_composite_keys(spark, match, want):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", "z"), (3, "a", None), (4, None, "q"), (5, None, None)], "rid long, k1 string, k2 string")
    targets = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "t1 string, t2 string")
    got = orphan_references(refs, targets, ref_id="rid", keys=[("k1", "t1"), ("k2", "t2")], match=match)
    assert sorted(r.ref_id for r in got.collect()) == want
    with pytest.raises(ValueError):
        orphan_references(refs, targets, ref_id="rid", keys=[("k1", "t1")], match="other")


def test_hot_key_and_report(spark):
    refs = spark.range(3000).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), F.lit(T1).alias("at"), F.lit("s").alias("name"))
    targets = spark.createDataFrame([("hot", T0, None, None)] * 50, "id string, at timestamp, gone timestamp, name string")
    got = orphan_references(refs, targets, ref_id="rid", keys=[("k", "id")], ref_time="at", target_time="at", target_deleted="gone", salt=4)
    assert got.count() == 2000
    assert [tuple(r) for r in orphan_report(got.withColumn("ref_table", F.lit("t"))).collect()] == [("t", "2025-02", 2000)]
