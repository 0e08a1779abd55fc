"""The search pipeline: two rankings, their fusion, and what follows it, for a batch of queries."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.hashing import Embedder, embed_column
from lodeseek.functions.text import adaptive_weights, sane_weight
from lodeseek.operators.rerank import diversify, drop_overlaps, drop_same_content, hydrate, renumber
from lodeseek.operators.retrieval import DEFAULT_K, RRF_K, bm25_topk, boost_imports, corpus_stats, knn, rrf
from lodeseek.sources.durable import written
from lodeseek.sources.store import corpus_counts


@dataclasses.dataclass(frozen=True)
class Corpus:
    """Tables of an index: chunks ``(id, file_path, start_line, end_line, kind, body)`` and what is derived from them."""

    chunks: DataFrame
    postings: DataFrame
    stats: DataFrame
    vectors: DataFrame
    symbols: DataFrame | None = None
    imports: DataFrame | None = None
    exports: DataFrame | None = None

    @staticmethod
    def of(store, embedder: Embedder, repo_id: str | None = None) -> Corpus:
        """The corpus of a store that was built with ``embedder``: of one repository, or of all, whose ids and paths
        then begin with their repository. Anything else than such a store is refused."""
        meta = store.verify(embedder)
        several = repo_id is None and store.table("files").select("repo_id").distinct().limit(2).count() > 1

        def own(name: str) -> DataFrame:
            t = store.table(name)
            if repo_id is not None:
                t = t.filter(F.col("repo_id") == repo_id)
            elif several:
                for c in ("id", "chunk_id", "file_path"):
                    if c in t.columns:
                        t = t.withColumn(c, F.concat_ws("/", "repo_id", c))
            return t.drop("repo_id")

        # one repository has no counts of its own: they are made of its chunks
        stats = corpus_stats(own("chunks"), most_bytes=meta["most_bytes"]) if repo_id is not None else corpus_counts(store, meta)
        return Corpus(stats=stats, **{n: own(n) for n in ("chunks", "postings", "vectors", "symbols", "imports", "exports")})


@dataclasses.dataclass(frozen=True)
class Knobs:
    k: int = DEFAULT_K
    k_rrf: int = RRF_K
    bm25_weight: float | None = None
    vector_weight: float | None = None
    adaptive: bool = False
    diversify: bool = False
    boost_imports: bool = False
    candidates: int | None = None  # depth of either ranking; k unless given
    drop_tokenless: bool = False


def resolve_weights(queries: DataFrame, knobs: Knobs) -> DataFrame:
    """``(query_id, w_lexical, w_vector)``: explicit before adaptive before 1, each side on its own."""
    lexical, vector = adaptive_weights(F.col("query")) if knobs.adaptive else (F.lit(1.0), F.lit(1.0))
    chosen = [sane_weight(F.lit(float(w))) if w is not None else c for w, c in ((knobs.bm25_weight, lexical), (knobs.vector_weight, vector))]
    return queries.select("query_id", chosen[0].alias("w_lexical"), chosen[1].alias("w_vector"))


def ranked(queries: DataFrame, corpus: Corpus, embedder: Embedder, knobs: Knobs = Knobs()) -> DataFrame:
    """The fused list ``(query_id, chunk_id, score, rank)`` before anything is dropped.

    Either ranking, at most the depth for a query, is written before the next is made: what one shuffles and sorts
    is gone from memory and disk by then."""
    depth = knobs.candidates or knobs.k
    lexical = written(bm25_topk(corpus.postings, corpus.stats, queries, depth), "lexical")
    asked = embed_column(queries, embedder, id_col="query_id", text_col="query", query=True).withColumnRenamed("id", "query_id")
    vectors = corpus.vectors
    if knobs.drop_tokenless:
        vectors = vectors.filter(F.exists("embedding", lambda x: x != 0))
    near = written(knn(vectors, asked, depth), "near")
    fused = rrf(lexical, near, k_rrf=knobs.k_rrf, weights=resolve_weights(queries, knobs)).drop("bm25_rank")
    if knobs.boost_imports and corpus.imports is not None:
        fused = boost_imports(fused, queries, corpus.imports, corpus.chunks.select(F.col("id").alias("chunk_id"), "file_path"))
    return fused


def search(queries: DataFrame, corpus: Corpus, embedder: Embedder, knobs: Knobs = Knobs()) -> DataFrame:
    """Hydrated hits of every query, at most ``k`` and fewer where near copies are dropped after the cut.

    The fused candidates, at most twice the depth for a query, and the hydrated hits are written once: each is used
    twice below, and what they are made of must not be made again."""
    cols = ["query_id", "chunk_id", "score", "rank"]
    fused = written(ranked(queries, corpus, embedder, knobs).select(*cols), "fused")
    near = fused.select("chunk_id").distinct()
    places = corpus.chunks.select(F.col("id").alias("chunk_id"), F.col("file_path").alias("file"), "start_line", "end_line").join(near, "chunk_id", "left_semi")
    kept = drop_overlaps(fused.join(places, "chunk_id", "left")).select(*cols)
    if knobs.diversify:
        kept = diversify(kept, corpus.vectors.join(near.withColumnRenamed("chunk_id", "id"), "id", "left_semi"))
    first = written(renumber(kept).filter(F.col("rank") <= knobs.k), "first")
    return drop_same_content(written(hydrate(first, corpus.chunks, corpus.symbols, corpus.imports, corpus.exports), "hits"))
