"""Queries of the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.neardup import similar_groups, similar_pairs
from lodeseek.sources.tables import table


SETTINGS = {"id_col": "id", "text_col": "text", "group_col": "grp", "k": 3, "similarity": 0.6, "min_words": 30, "coordinates": 12, "agree": 2}


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Chunks are compared with all chunks, hits within their query; TESTDATA.md fixes three words and 0.6."""
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("grp"), "id", F.col("body").alias("text"))
    hits = table(spark, d, "hits").select(F.concat(F.lit("hits:"), F.col("query_id").cast("string")).alias("grp"), F.col("hit_id").alias("id"), F.col("snippet").alias("text"))
    return chunks.unionByName(hits)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(_records(spark, d), **SETTINGS).select(F.split_part("grp", F.lit(":"), F.lit(1)).alias("record_set"), "id_a", "id_b").distinct()


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record that has a near copy, with the smallest id of its group and its number of links."""
    return similar_groups(_records(spark, d), **SETTINGS).select(F.split_part("grp", F.lit(":"), F.lit(1)).alias("record_set"), "id", "root", "links")


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}

_PAIRS = r"""
WITH RECURSIVE r AS (
  SELECT DISTINCT 'chunks' AS record_set, '' AS grp, id, body AS text FROM chunks WHERE body IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'hits', CAST(query_id AS VARCHAR), hit_id, snippet FROM hits WHERE snippet IS NOT NULL
), w AS (SELECT row_number() OVER () AS k, record_set, grp, id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM r),
t AS (SELECT * FROM w WHERE len(w) >= 30),
s AS (SELECT DISTINCT k, record_set, grp, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM t)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS ka, b.k AS kb, a.record_set, a.grp, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.record_set = b.record_set AND a.grp = b.grp AND a.id < b.id GROUP BY ALL),
f AS (SELECT DISTINCT record_set, grp, id_a, id_b FROM c JOIN n x ON x.k = ka JOIN n y ON y.k = kb WHERE c >= 0.6 * (x.n + y.n - c))
"""

ORACLE = {
    "p6_found": _PAIRS + "SELECT DISTINCT record_set, id_a, id_b FROM f",
    "p6_groups": _PAIRS
    + """, e AS (SELECT record_set, grp, id_a AS u, id_b AS v FROM f UNION SELECT record_set, grp, id_b, id_a FROM f),
reach(record_set, grp, u, v) AS (SELECT record_set, grp, u, v FROM e UNION SELECT reach.record_set, reach.grp, reach.u, e.v FROM reach JOIN e ON e.record_set = reach.record_set AND e.grp = reach.grp AND e.u = reach.v),
roots AS (SELECT record_set, grp, u AS id, min(least(u, v)) AS root FROM reach GROUP BY ALL),
deg AS (SELECT record_set, grp, u AS id, count(*) AS links FROM e GROUP BY ALL)
SELECT record_set, id, root, CAST(links AS BIGINT) AS links FROM roots JOIN deg USING (record_set, grp, id)""",
}
