"""Queries of the retrieval engine over the test tables, and the SQL each is checked against.

The corpus is the live state of ``chunks``; the queries are those of ``hits``.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.functions.hashing import FeatureHash, embed_column
from lodeseek.operators.delta import changes, latest, upsert
from lodeseek.operators.rerank import diversify, drop_overlaps, drop_same_content, hydrate, wire_hits
from lodeseek.operators.retrieval import bm25_topk, boost_imports, corpus_stats, knn, postings, rrf
from lodeseek.operators.structure import analyse, chunk_files, line_windows
from lodeseek.plans.evaluate import first_relevant, quality, worse_than_either
from lodeseek.plans.search import Corpus, Knobs, ranked, resolve_weights, search
from lodeseek.sources.durable import remove, shared_folder, written
from lodeseek.sources.store import Store, reindex
from lodeseek.sources.tables import table
from lodeseek.streaming.watch import bursts

EMBEDDER = FeatureHash("md5")
K = 10


def live_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each id, unless it says deleted; equal times go to the live row, then to the smaller body."""
    order = (F.col("indexed_at").desc_nulls_last(), F.col("deleted_at").asc_nulls_first(), F.col("body"), F.col("kind").asc_nulls_first(), F.col("end_line"))
    return latest(table(spark, d, "chunks"), ["id"], *order).filter(F.col("deleted_at").isNull())


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hits").select("query_id", "query").distinct()


def _live(spark: SparkSession, d: str) -> DataFrame:
    """The live chunks, written once for all that a query reads of them: finding them shuffles the bodies."""
    return written(live_chunks(spark, d).select("id", "file_path", "start_line", "end_line", "kind", "body"), "chunks")


def _corpus(spark: SparkSession, d: str) -> Corpus:
    chunks = _live(spark, d)
    vectors = written(embed_column(chunks, EMBEDDER, id_col="id", text_col="body"), "vectors")
    symbols = table(spark, d, "symbols").filter(F.col("chunk_id").isNotNull())
    return Corpus(chunks, written(postings(chunks, distinct_ids=True), "postings"), corpus_stats(chunks), vectors, symbols, _imports(spark, d))


def _imports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_imports").filter(F.col("file_path").isNotNull())


def _bm25(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    return bm25_topk(written(postings(chunks, distinct_ids=True), "postings"), corpus_stats(chunks), queries, K)


def _knn(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    vectors = embed_column(chunks, EMBEDDER, id_col="id", text_col="body")
    return knn(vectors, embed_column(queries, EMBEDDER, id_col="query_id", text_col="query").withColumnRenamed("id", "query_id"), K)


def tok_code(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.code_tokens(F.col("text")), " ").alias("tokens"))


def tok_plain(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.plain_tokens(F.col("text")), " ").alias("tokens"))


def corpus_statistics(spark, d):
    s = corpus_stats(table(spark, d, "documents"), id_col="doc_id", body_col="text")
    return s.select("n", "total", F.round("avgdl", 6).alias("avgdl"))


def postings_df(spark, d):
    p = postings(table(spark, d, "documents"), id_col="doc_id", body_col="text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_batch(spark, d):
    return _bm25(_live(spark, d), asked(spark, d))


def bm25_degenerate(spark, d):
    """Queries without a token have no result."""
    return _bm25(_live(spark, d), asked(spark, d).select("query_id", F.lit("!!! --").alias("query")))


def knn_batch(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return knn(e, e.filter(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id"), K)


def cosine_to_label(spark, d):
    """Cosine of each vector with its label's first one: an equi-join, no pairs of all with all."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"), F.round(T.l2_distance(F.col("embedding"), F.col("first")), 6).alias("distance"))


def feature_hash_md5(spark, d):
    e = embed_column(table(spark, d, "chunks").select("body").distinct(), EMBEDDER, id_col="body", text_col="body")
    cells = e.select(F.col("id").alias("body"), F.posexplode("embedding").alias("bucket", "value")).filter(F.col("value") != 0)
    return cells.groupBy("bucket").agg(F.count("*").alias("texts"), F.sum(F.round(F.col("value").cast("double") * 100_000).cast("long")).alias("total"))


def vector_batch(spark, d):
    return _knn(_live(spark, d), asked(spark, d))


def rrf_equal(spark, d):
    q, chunks = asked(spark, d), _live(spark, d)
    return rrf(_bm25(chunks, q), _knn(chunks, q))


def rrf_weighted(spark, d):
    q, chunks = asked(spark, d), _live(spark, d)
    return rrf(_bm25(chunks, q), _knn(chunks, q), weights=resolve_weights(q, Knobs(bm25_weight=0.25, adaptive=True)))


def weights_adaptive(spark, d):
    names = table(spark, d, "symbols").select(F.col("symbol_id").alias("query_id"), F.col("name").alias("query")).distinct()
    q = names.unionByName(asked(spark, d))
    return resolve_weights(q, Knobs(adaptive=True)).join(q, "query_id").select("query_id", "query", "w_lexical", "w_vector").distinct()


def boosted(spark, d):
    q, chunks = asked(spark, d), _live(spark, d)
    files = chunks.select(F.col("id").alias("chunk_id"), "file_path")
    return boost_imports(rrf(_bm25(chunks, q), _knn(chunks, q)), q, _imports(spark, d), files)


def search_hybrid(spark, d):
    """The flagship: both rankings of every query over the live chunks, fused."""
    return ranked(asked(spark, d), _corpus(spark, d), EMBEDDER)


def search_full(spark, d):
    """All stages: adaptive weights, import boost, both removals of copies, MMR, hydration."""
    knobs = Knobs(adaptive=True, boost_imports=True, diversify=True, drop_tokenless=True)
    hits = search(asked(spark, d), _corpus(spark, d), EMBEDDER, knobs)
    return hits.select("query_id", "rank", "chunk_id", "file_path", "start_line", "end_line", "kind", "signature", F.round("score", 9).alias("score"), F.size("imports").alias("imports"))


def overlap_dedup(spark, d):
    h = table(spark, d, "hits").select("query_id", "rank", "hit_id", "file", "start_line", "end_line").distinct()
    return drop_overlaps(h).select("query_id", "rank", "hit_id")


def content_dedup(spark, d):
    h = table(spark, d, "hits").select("query_id", "rank", "hit_id", "snippet", "signature").distinct()
    return drop_same_content(h).select("query_id", "rank", "hit_id")


def mmr(spark, d):
    """The ten nearest of every twentieth vector, diversified."""
    near = knn_batch(spark, d).select("query_id", "chunk_id", (F.lit(0.0) - F.col("distance")).alias("score"), "rank")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return diversify(near, vectors)


def hydrated(spark, d):
    chunks = _live(spark, d)
    h = hydrate(written(_bm25(chunks, asked(spark, d)), "ranks"), chunks, table(spark, d, "symbols").filter(F.col("chunk_id").isNotNull()), _imports(spark, d))
    sources = F.array_join(F.transform("imports", lambda x: F.concat_ws("/", x["source"], x["kind"], x["line"].cast("string"))), ",")
    return h.select("query_id", "rank", "chunk_id", "file_path", "kind", "signature", F.md5("snippet").alias("snippet"), sources.alias("imports"))


def wire(spark, d):
    """The JSON objects that leave the engine, read again."""
    chunks = _live(spark, d)
    found = hydrate(written(_bm25(chunks, asked(spark, d)), "ranks"), chunks, table(spark, d, "symbols").filter(F.col("chunk_id").isNotNull()), _imports(spark, d))
    hit = "file string, start_line int, end_line int, kind string, signature string, snippet string, score double, imports array<struct<source:string,kind:string,line:int>>, exports array<struct<detail:string,line:int>>"
    read = wire_hits(found).select("query_id", F.posexplode(F.from_json("json", f"struct<hits: array<struct<{hit.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' array', ':array')}>>>")["hits"]).alias("at", "hit"))
    return read.select("query_id", "at", "hit.file", "hit.start_line", "hit.end_line", "hit.kind", "hit.signature", F.md5("hit.snippet").alias("snippet"), F.round("hit.score", 9).alias("score"), F.size("hit.imports").alias("imports"), F.size("hit.exports").alias("exports"))


def _indexed(spark: SparkSession, d: str) -> Store:
    """A store of all documents, each a file of no known language; the same tree is then indexed a second time and,
    with every fifth document left out, a third and put back a fourth time."""
    store = Store(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    atexit.register(remove, spark, store.path)
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    tree = docs.select(F.lit("documents").alias("repo_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), F.col("text").alias("content"), F.lit(None).cast("string").alias("language"), F.lit(1).cast("long").alias("mtime"))
    for files in (tree, tree, tree.filter(F.xxhash64("rel_path") % 5 != 0), tree):
        reindex(store, files, EMBEDDER)
        store.prune()  # no one reads the version before
    return store


def index_files(spark, d):
    """The stored states of files, after a build and three reindexes."""
    return _indexed(spark, d).table("files").select("repo_id", "path", "content_hash")


def index_chunks(spark, d):
    """The stored chunks, with the length of their postings."""
    store = _indexed(spark, d)
    tf = store.table("postings").groupBy("chunk_id").agg(F.sum("tf").alias("tokens"))
    return store.table("chunks").join(tf, F.col("id") == F.col("chunk_id"), "left").select("id", "start_line", "end_line", F.md5("body").alias("body"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def index_search(spark, d):
    """Lexical search over the stored postings and counts."""
    corpus = Corpus.of(_indexed(spark, d), EMBEDDER)
    return bm25_topk(corpus.postings, corpus.stats, asked(spark, d), K)


def registry_prune(spark, d):
    """Repositories whose files are all gone drop out of the registry."""
    s = _states(spark, d, False).select("repo_id").distinct()
    return table(spark, d, "file_states").select("repo_id").distinct().join(s, "repo_id", "left_anti")


def sales_by_region(spark, d):
    """Inherited from the relational substrate: joins and a rollup."""
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    o = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return o.rollup("r_name", "n_name").agg(F.count("*").alias("lines"), cents.alias("cents"))


def order_gaps(spark, d):
    """Inherited from the relational substrate: a window frame."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("nth"), F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("days"))


def overlap_with_previous(spark, d):
    """The shared part of every live chunk's lines with those of the chunk before it in its file."""
    w = Window.partitionBy("file_path").orderBy("start_line", "end_line", "id")
    c = live_chunks(spark, d).select("id", "start_line", "end_line", F.lag("start_line").over(w).alias("a"), F.lag("end_line").over(w).alias("b")).filter("a IS NOT NULL")
    return c.select("id", F.round(T.overlap_fraction(F.col("a"), F.col("b"), F.col("start_line"), F.col("end_line")), 6).alias("share"))


def words_with_previous(spark, d):
    """Likeness of the words of every hit's snippet to those of the hit before it."""
    h = table(spark, d, "hits").select("query_id", "rank", "hit_id", F.array_distinct(T.code_tokens(F.col("snippet"))).alias("words")).distinct()
    h = h.withColumn("last", F.lag("words").over(Window.partitionBy("query_id").orderBy("rank", "hit_id"))).filter("last IS NOT NULL")
    return h.select("query_id", "hit_id", F.round(T.jaccard(F.col("words"), F.col("last")), 6).alias("likeness"))


def feature_hash_blake3(spark, d):
    """The default embedder over all documents; SQL has no such hash, tests have the pinned digests."""
    e = embed_column(table(spark, d, "documents"), FeatureHash(), id_col="doc_id", text_col="text")
    cells = e.select(F.col("id").alias("doc_id"), F.posexplode("embedding").alias("bucket", "value")).filter(F.col("value") != 0)
    return cells.groupBy("bucket").agg(F.count("*").alias("texts"), F.sum(F.round(F.col("value").cast("double") * 100_000).cast("long")).alias("total"))


def windows(spark, d):
    w = line_windows(table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string")), path_col="path", content_col="text")
    return w.select("id", "start_line", "end_line", F.md5("body").alias("body"))


def blank_islands(spark, d):
    """Runs of lines that aren't blank, as gaps and islands."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")).alias("line", "s")).filter(F.col("s").rlike(r"[^ \t]"))
    run = F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    runs = lines.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("line").alias("a"), F.max("line").alias("b"))
    return runs.select("doc_id", (F.col("a") + 1).alias("start_line"), (F.col("b") + 1).alias("end_line"))


def chunk_id_parse(spark, d):
    path, a, b = T.parse_chunk_id(F.col("id"))
    c = table(spark, d, "chunks").select("id").unionByName(table(spark, d, "symbols").select(F.col("chunk_id").alias("id"))).distinct()
    return c.select("id", path.alias("path"), a.alias("start_line"), b.alias("end_line"))


def gates(spark, d):
    f = table(spark, d, "source_files")
    return f.filter(T.within_size(F.col("length")) & T.no_long_line(F.col("content"))).select("repo_id", "rel_path").distinct()


def lang_detect(spark, d):
    f = table(spark, d, "source_files").select("rel_path").distinct()
    return f.select("rel_path", T.language_of(F.col("rel_path")).alias("language"))


def first_lines(spark, d):
    return table(spark, d, "csn_records").select("record_id", T.first_line(F.col("docstring")).alias("line")).distinct()


def snippets(spark, d):
    return table(spark, d, "chunks").select("id", F.md5(T.snippet(F.col("body"))).alias("snippet"), F.length(T.snippet(F.col("body"))).alias("chars")).distinct()


_MID = "2025-10-01"


def _states(spark, d, before: bool):
    s = table(spark, d, "file_states")
    s = s.filter(F.col("indexed_at") < F.lit(_MID).cast("timestamp")) if before else s
    cut = F.lit(_MID).cast("timestamp")
    dead = F.col("deleted_at").isNotNull() & (F.col("deleted_at") < cut) if before else F.col("deleted_at").isNotNull()
    order = (F.col("indexed_at").desc(), F.col("content_hash"), F.col("mtime"), F.col("deleted_at").asc_nulls_first())
    return latest(s, ["repo_id", "path"], *order).filter(~dead)


def delta_changes(spark, d):
    """What changed in the files between the first of October 2025 and the newest state."""
    return changes(_states(spark, d, False), _states(spark, d, True))


def upsert_files(spark, d):
    cols = ["repo_id", "path", "content_hash"]
    return upsert(_states(spark, d, True).select(*cols), _states(spark, d, False).select(*cols))


def _labels(spark, d, chunks: DataFrame):
    """Every symbol of a live chunk whose id is divisible by 20 is a query for its own place."""
    live = chunks.select(F.col("id").alias("chunk_id"), F.col("file_path").alias("file"))
    s = table(spark, d, "symbols").filter((F.col("symbol_id") % 20 == 0) & F.col("name").isNotNull()).select("symbol_id", "chunk_id", "name", "line").distinct()
    return s.join(live, "chunk_id").select(F.col("symbol_id").alias("query_id"), F.col("name").alias("query"), "file", F.col("line").alias("target_line"))


def _first(spark, d) -> dict[str, DataFrame]:
    """Where the first relevant hit of every label stands in each of the rankings, which are made once."""
    chunks = _live(spark, d)
    labels = written(_labels(spark, d, chunks), "labels")
    q = labels.select("query_id", "query").distinct()
    lexical, vector = written(_bm25(chunks, q), "lexical"), written(_knn(chunks, q), "vector")
    arms = {"lexical": lexical, "vector": vector, "hybrid": rrf(lexical, vector).filter(F.col("rank") <= K)}
    return {arm: first_relevant(labels, found, chunks) for arm, found in arms.items()}


def eval_recall_mrr(spark, d):
    parts = [quality(first).select(F.lit(arm).alias("arm"), "queries", "misses", F.round("recall_5", 6).alias("recall_5"), F.round("recall_10", 6).alias("recall_10"), F.round("mrr", 6).alias("mrr")) for arm, first in _first(spark, d).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def eval_hybrid_worse(spark, d):
    first = _first(spark, d)
    return worse_than_either(first["hybrid"], first["lexical"], first["vector"])


def debounce_bursts(spark, d):
    return bursts(table(spark, d, "events"), 600_000, keys=("user_id",))


def structure_records(spark, d):
    return analyse(table(spark, d, "source_files")).drop("body")


def _of_language(language: str):
    def query(spark, d):
        files = table(spark, d, "source_files").select("repo_id", "rel_path", "content").filter(T.language_of(F.col("rel_path")) == language)
        return analyse(files).filter(F.col("record") != "chunk").select("record", "file_path", "ord", "kind", "name", "signature", "start_line", "end_line", "line")

    query.__name__ = f"structure_{language}"
    query.__doc__ = f"Symbols, imports and exports of all {language} files."
    return query


LANGUAGES = ("python", "typescript", "rust", "go", "bash", "java", "c", "ruby", "cpp")


def structure_imports(spark, d):
    """Imports of the languages whose statement is a line of its own, by line."""
    found = analyse(table(spark, d, "source_files").select("repo_id", "rel_path", "content")).filter((F.col("record") == "import") & F.col("language").isin("python", "java", "ruby", "c", "cpp"))
    return found.groupBy("language", "file_path", "line").agg(F.min("name").alias("source")).distinct()


def structure_functions(spark, d):
    """Names and first lines of the functions of the languages that open them with a word."""
    found = analyse(table(spark, d, "source_files").select("repo_id", "rel_path", "content")).filter((F.col("record") == "symbol") & F.col("language").isin("python", "go", "rust", "ruby", "bash") & F.col("kind").isin("function", "method"))
    return found.select("language", "file_path", "name", "line").distinct()


def structure_types(spark, d):
    """Names and first lines of the types of the languages that open them with a word."""
    found = analyse(table(spark, d, "source_files").select("repo_id", "rel_path", "content")).filter((F.col("record") == "symbol") & F.col("language").isin("python", "go", "rust", "java", "ruby", "typescript") & ~F.col("kind").isin("function", "method"))
    return found.select("language", "file_path", "name", "line").distinct()


def structure_chunks(spark, d):
    return chunk_files(table(spark, d, "source_files")).select("id", "start_line", "end_line", "kind", F.octet_length("body").alias("bytes"))


QUERIES = {
    f.__name__: f
    for f in (
        tok_code, tok_plain, corpus_statistics, postings_df, bm25_batch, bm25_degenerate, knn_batch, cosine_to_label, feature_hash_md5, vector_batch, rrf_equal, rrf_weighted, weights_adaptive,
        boosted, search_hybrid, search_full, overlap_dedup, content_dedup, mmr, hydrated, wire, windows, blank_islands, chunk_id_parse, gates, lang_detect, first_lines, snippets,
        overlap_with_previous, words_with_previous, feature_hash_blake3, index_files, index_chunks, index_search, registry_prune, sales_by_region, order_gaps, structure_imports, structure_functions, structure_types, *map(_of_language, LANGUAGES),
        delta_changes, upsert_files, eval_recall_mrr, eval_hybrid_worse, debounce_bursts, structure_records, structure_chunks,
    )
}
