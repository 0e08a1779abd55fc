"""Queries of the container operator."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.packing import CAPACITY, fill, pack
from lodeseek.sources.durable import written
from lodeseek.sources.tables import table

#: A rank file of a public tokenizer, the same on every worker.
TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), tokenizer_file=TOKENIZER).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are by the share of free space, in steps of a tenth."""
    filled = fill(pack(table(spark, d, "documents"), tokenizer_file=TOKENIZER))
    return filled.groupBy(F.floor(F.col("free") * 10 / CAPACITY).cast("int").alias("free_tenths")).agg(F.count("*").alias("containers"), F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers, as counts: all texts are placed, with all their pieces, and nothing is
    too full, split without need, beside its copy, or beside a text of a source that can be kept apart."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source").filter(F.col("text").isNotNull()).distinct()
    placed = written(p7_containers(spark, d), "placed")
    folded = F.lower(F.array_join(F.filter(F.split("text", r"[\s\x1c-\x1f\x85\xa0]+"), lambda w: w != ""), " "))
    of = placed.join(docs.select("doc_id", "source", F.xxhash64(folded).alias("copy")), "doc_id")
    task = F.shiftright("container", 32)
    floors = placed.groupBy(task.alias("task")).agg(F.ceil(F.sum("tokens") / CAPACITY).alias("floor"))
    whole = of.filter("pieces = 1 AND source IS NOT NULL").withColumn("task", task)
    apart = whole.groupBy("task", "source").agg(F.count("*").alias("k")).join(floors, "task").filter("k <= floor")
    # nothing of a source is beside another text of it
    beside = whole.join(apart.select("task", "source"), ["task", "source"], "left_semi").groupBy("container", "source").count().filter("count > 1")
    parts = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    checks = {
        "texts": placed.select("doc_id").distinct(),
        "pieces missing": parts.filter("n <> pieces"),
        "too full": placed.groupBy("container").agg(F.sum("tokens").alias("t")).filter(F.col("t") > CAPACITY),
        "split without need": parts.filter((F.col("pieces") > 1) & (F.col("tokens") <= CAPACITY)),
        "beside a copy": of.filter("pieces = 1").groupBy("container", "copy").count().filter("count > 1"),
        "beside its source": beside,
    }
    rows = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, x in checks.items()]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_checks": p7_checks}
ORACLE: dict[str, str] = {
    "p7_checks": """SELECT 'texts' AS what, count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL
UNION ALL SELECT unnest(['pieces missing', 'too full', 'split without need', 'beside a copy', 'beside its source']), 0""",
}
