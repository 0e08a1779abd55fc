"""Queries of the operators on single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.docpairs import documented_functions
from lodeseek.llm.encoding import garbled, garbled_ids
from lodeseek.llm.leakage import leaked_passages, leaked_spans
from lodeseek.llm.parsing import unparsable, unparsable_rates
from lodeseek.llm.sourcekind import label_files, not_handwritten
from lodeseek.llm.splitting import oversized_ids, split_oversized
from lodeseek.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Repeated records count once, and so do equal names within one."""
    return documented_functions(table(spark, d, "csn_records")).select(F.col("id").alias("record_id"), "func_name").distinct()


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(table(spark, d, "csn_records")).withColumnRenamed("id", "record_id").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(label_files(table(spark, d, "source_files"), table(spark, d, "upstream_files"))).select("rel_path").distinct()


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    return label_files(table(spark, d, "source_files"), table(spark, d, "upstream_files"))


def p3_moved(spark: SparkSession, d: str) -> DataFrame:
    """How many files have which label alone and which after the propagation."""
    return p3_labels(spark, d).groupBy("alone", "label").agg(F.count("*").alias("files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unparsable(table(spark, d, "source_files")).select("rel_path").distinct()


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files")
    return unparsable_rates(files, unparsable(files))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized_ids(split_oversized(table(spark, d, "chunks"))).select(F.col("id").alias("chunk_id"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(table(spark, d, "chunks"))
    return pieces.select(F.col("id").alias("chunk_id"), "piece", "pieces", "start_line", "end_line", "shared", F.octet_length("body").alias("bytes"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item the number of documents that hold a passage of it."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").cast("long").alias("documents"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every shared span, from its first to its last word."""
    return leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items")).withColumn("words", F.col("words").cast("long"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_ids(table(spark, d, "documents")).select(F.col("id").alias("doc_id"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs, "p3_found": p3_found, "p3_labels": p3_labels, "p3_moved": p3_moved, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p5_pieces": p5_pieces, "p8_found": p8_found, "p8_report": p8_report, "p8_spans": p8_spans, "p9_found": p9_found, "p9_restored": p9_restored}

_SPANS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM w)),
"is" AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
f AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN "is" USING (s))
"""

ORACLE = {
    "p5_found": r"""SELECT DISTINCT id AS chunk_id FROM chunks
WHERE strlen(body) > 8192 OR length(body) - length(replace(body, chr(10), '')) + CASE WHEN body <> '' AND right(body, 1) <> chr(10) THEN 1 ELSE 0 END > 200""",
    "p8_found": _SPANS + "SELECT doc_id, item_id FROM f",
    "p8_report": _SPANS + "SELECT item_id, CAST(count(*) AS BIGINT) AS documents FROM f GROUP BY 1",
    "p8_spans": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
ds AS (SELECT doc_id, k, array_to_string(w[k:k+11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
"is" AS (SELECT item_id, k, array_to_string(w[k:k+11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
m AS (SELECT DISTINCT doc_id, item_id, ds.k AS a, "is".k AS b FROM ds JOIN "is" USING (s)),
r AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, a - b ORDER BY a) AS run FROM m)
SELECT doc_id, item_id, CAST(min(a) - 1 AS INT) AS doc_pos, CAST(min(b) - 1 AS INT) AS item_pos, count(*) + 11 AS words FROM r GROUP BY doc_id, item_id, a - b, run""",
}
