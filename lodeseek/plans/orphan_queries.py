"""Problem 1: symbols and imports whose chunk or file is missing, deleted or later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.text import parse_chunk_id
from lodeseek.operators.orphans import orphan_references, orphan_report, relative_path
from lodeseek.sources.tables import table

COMMON = dict(ref_time="indexed_at", target_time="indexed_at", target_deleted="deleted_at", normalise=relative_path)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    a = orphan_references(table(spark, d, "symbols"), table(spark, d, "chunks"), ref_id="symbol_id", keys=[("chunk_id", "id")], **COMMON)
    b = orphan_references(table(spark, d, "file_imports"), table(spark, d, "file_states"), ref_id="import_id", keys=[("file_path", "path")], **COMMON)
    return a.withColumn("ref_table", F.lit("symbols")).unionByName(b.withColumn("ref_table", F.lit("file_imports")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def _parts(df: DataFrame, column: str, *names: str) -> DataFrame:
    """``column`` as path, start and end; what is not of that form is all null."""
    parts = parse_chunk_id(relative_path(F.col(column)))
    return df.select("*", *[c.alias(n) for c, n in zip(parts, names)])


def _composite(spark: SparkSession, d: str, match: str) -> DataFrame:
    """References by several columns, some of them unknown: symbols by path, first and last line of their chunk, imports by
    repository and path. The last line counts as unknown for a symbol without a signature, the first line for one that stands on
    or behind its chunk's last line, and the repository for an import for its side effects."""
    symbols = _parts(table(spark, d, "symbols"), "chunk_id", "path", "first", "last")
    last = F.when(F.col("signature").isNotNull(), F.col("last"))
    symbols = symbols.withColumn("b", last).withColumn("a", F.when(last.isNull() | (F.col("line") < last), F.col("first")))
    chunks = _parts(table(spark, d, "chunks"), "id", "path", "a", "z")
    c = orphan_references(symbols, chunks, ref_id="symbol_id", keys=[("path", "path"), ("a", "a"), ("b", "z")], match=match, ref_time="indexed_at", target_time="indexed_at", target_deleted="deleted_at")
    imports = table(spark, d, "file_imports").withColumn("path", relative_path(F.col("file_path"))).withColumn("repo", F.when(F.col("kind") != "side_effect", F.split_part("path", F.lit("/"), F.lit(1))))
    states = table(spark, d, "file_states").withColumn("p", relative_path(F.col("path"))).withColumn("repo", F.split_part("p", F.lit("/"), F.lit(1))).drop("path")
    f = orphan_references(imports, states, ref_id="import_id", keys=[("repo", "repo"), ("path", "p")], match=match, ref_time="indexed_at", target_time="indexed_at", target_deleted="deleted_at")
    return c.withColumn("ref_table", F.lit("symbols")).unionByName(f.withColumn("ref_table", F.lit("file_imports")))


def p1_partial(spark: SparkSession, d: str) -> DataFrame:
    """Composite keys with nulls: what is not null must match one target row."""
    return _composite(spark, d, "partial").select("ref_table", "ref_id").distinct()


def p1_full(spark: SparkSession, d: str) -> DataFrame:
    """Composite keys with nulls: all null or a match, anything between is a case."""
    return _composite(spark, d, "full").select("ref_table", "ref_id").distinct()


def p1_simple(spark: SparkSession, d: str) -> DataFrame:
    """Composite keys with nulls: only references without a null are looked up."""
    return _composite(spark, d, "simple").select("ref_table", "ref_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_partial": p1_partial, "p1_full": p1_full, "p1_simple": p1_simple}

_NORM = r"regexp_replace(replace({c}, '\', '/'), '^(\./+)+', '')"
_CASES = f"""
WITH t AS (
  SELECT 'symbols' AS ref_table, {_NORM.format(c='id')} AS k, indexed_at FROM chunks WHERE deleted_at IS NULL
  UNION ALL
  SELECT 'file_imports', {_NORM.format(c='path')}, indexed_at FROM file_states WHERE deleted_at IS NULL
), live AS (SELECT ref_table, k, min(indexed_at) AS live_from FROM t GROUP BY 1, 2),
r AS (
  SELECT 'symbols' AS ref_table, symbol_id AS ref_id, {_NORM.format(c='chunk_id')} AS k, indexed_at FROM symbols
  UNION ALL
  SELECT 'file_imports', import_id, {_NORM.format(c='file_path')}, indexed_at FROM file_imports
), cases AS (
  SELECT ref_table, ref_id, indexed_at FROM r
  WHERE k IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM live WHERE live.ref_table = r.ref_table AND live.k = r.k AND live.live_from <= r.indexed_at)
)
"""

_ID = r"CASE WHEN regexp_matches({c}, '(?s)^.*:\d{{1,9}}-\d{{1,9}}$') THEN {v} END"
_PATH = _ID.format(c="k", v=r"regexp_extract(k, '(?s)^(.*):(\d{1,9})-(\d{1,9})$', 1)")
_A = _ID.format(c="k", v=r"CAST(regexp_extract(k, '(?s)^(.*):(\d{1,9})-(\d{1,9})$', 2) AS INT)")
_B = _ID.format(c="k", v=r"CAST(regexp_extract(k, '(?s)^(.*):(\d{1,9})-(\d{1,9})$', 3) AS INT)")
_PARTS = f"""
WITH s AS (SELECT symbol_id AS ref_id, indexed_at AS t, line, signature, {_PATH} AS p, {_A} AS a0, {_B} AS b0 FROM (SELECT *, {_NORM.format(c='chunk_id')} AS k FROM symbols)),
s2 AS (SELECT ref_id, t, line, p, a0, CASE WHEN signature IS NOT NULL THEN b0 END AS b FROM s),
r1 AS (SELECT DISTINCT ref_id, t, p, CASE WHEN line < b OR b IS NULL THEN a0 END AS a, b FROM s2),
t1 AS (SELECT indexed_at AS t, {_PATH} AS p, {_A} AS a, {_B} AS b FROM (SELECT *, {_NORM.format(c='id')} AS k FROM chunks WHERE deleted_at IS NULL)),
m1 AS (SELECT *, EXISTS (SELECT 1 FROM t1 WHERE t1.p = r1.p AND (r1.a IS NULL OR r1.a = t1.a) AND (r1.b IS NULL OR r1.b = t1.b) AND t1.t <= r1.t) AS hit FROM r1 WHERE p IS NOT NULL),
r2 AS (SELECT DISTINCT import_id AS ref_id, indexed_at AS t, k AS p, CASE WHEN kind <> 'side_effect' THEN split_part(k, '/', 1) END AS q FROM (SELECT *, {_NORM.format(c='file_path')} AS k FROM file_imports)),
t2 AS (SELECT indexed_at AS t, k AS p, split_part(k, '/', 1) AS q FROM (SELECT *, {_NORM.format(c='path')} AS k FROM file_states WHERE deleted_at IS NULL)),
m2 AS (SELECT *, EXISTS (SELECT 1 FROM t2 WHERE t2.p = r2.p AND (r2.q IS NULL OR r2.q = t2.q) AND t2.t <= r2.t) AS hit FROM r2 WHERE p IS NOT NULL)
"""

ORACLE = {
    "p1_partial": _PARTS + "SELECT DISTINCT 'symbols' AS ref_table, ref_id FROM m1 WHERE NOT hit UNION ALL SELECT DISTINCT 'file_imports', ref_id FROM m2 WHERE NOT hit",
    "p1_full": _PARTS + "SELECT DISTINCT 'symbols' AS ref_table, ref_id FROM m1 WHERE a IS NULL OR b IS NULL OR NOT hit UNION ALL SELECT DISTINCT 'file_imports', ref_id FROM m2 WHERE q IS NULL OR NOT hit",
    "p1_simple": _PARTS + "SELECT DISTINCT 'symbols' AS ref_table, ref_id FROM m1 WHERE a IS NOT NULL AND b IS NOT NULL AND NOT hit UNION ALL SELECT DISTINCT 'file_imports', ref_id FROM m2 WHERE q IS NOT NULL AND NOT hit",
    "p1_found": _CASES + "SELECT DISTINCT ref_table, ref_id FROM cases",
    "p1_report": _CASES + "SELECT ref_table, strftime(indexed_at, '%Y-%m') AS period, CAST(count(DISTINCT ref_id) AS BIGINT) AS orphans FROM cases GROUP BY 1, 2",
}
