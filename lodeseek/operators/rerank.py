"""Order-dependent steps over the candidates of each query, and hydration.

The greedy steps see one query's candidates at a time, which the retrieval cuts to at most ``2 k``;
they run as ``applyInPandas`` per query, so a batch spreads over the cluster by query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.text import code_tokens, snippet

OVERLAP = 0.5
SAME_CONTENT = 0.9
MMR_LAMBDA = 0.7


def _shared(a: tuple[int, int], b: tuple[int, int]) -> float:
    n = min(a[1], b[1]) - max(a[0], b[0]) + 1
    shorter = min(a[1] - a[0], b[1] - b[0]) + 1
    return n / shorter if n > 0 and shorter > 0 else 0.0


def drop_overlaps(hits: DataFrame, *, file_col: str = "file", fraction: float = OVERLAP) -> DataFrame:
    """``hits (query_id, rank, file, start_line, end_line, …)`` without those that share more than
    ``fraction`` of the shorter range with an earlier kept hit of the same file. Rows whose range is
    null are kept. Only a strictly larger share counts, so half and half stays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        kept: dict = {}
        keep = []
        for f, a, b in zip(pdf[file_col], pdf["start_line"], pdf["end_line"]):
            if f is None or pd.isna(a) or pd.isna(b):
                keep.append(True)
                continue
            ok = not any(_shared((a, b), x) > fraction for x in kept.get(f, ()))
            if ok:
                kept.setdefault(f, []).append((a, b))
            keep.append(ok)
        return pdf[np.array(keep, dtype=bool)]

    return hits.groupBy("query_id").applyInPandas(run, hits.schema)


def drop_same_content(hits: DataFrame, *, threshold: float = SAME_CONTENT) -> DataFrame:
    """Hits ``(query_id, rank, snippet, signature, …)`` without those whose words are, with a Jaccard
    similarity of at least ``threshold``, those of an earlier kept hit. Hits without words are kept.
    The words are found in the JVM and only they and the rank go through Python."""
    words = F.array_distinct(F.concat(code_tokens(F.coalesce("snippet", F.lit(""))), code_tokens(F.coalesce("signature", F.lit("")))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        kept: list[set] = []
        keep = []
        for w in pdf["words"]:
            s = set(w)
            ok = not s or not any(len(s & x) >= threshold * len(s | x) - 1e-12 for x in kept)
            if ok and s:
                kept.append(s)
            keep.append(ok)
        return pdf.loc[np.array(keep, dtype=bool), ["query_id", "rank"]]

    key = hits.select("query_id", "rank", words.alias("words"))
    q, r = hits.schema["query_id"].dataType.simpleString(), hits.schema["rank"].dataType.simpleString()
    kept = key.groupBy("query_id").applyInPandas(run, f"query_id {q}, rank {r}")
    return hits.join(kept, ["query_id", "rank"], "left_semi").select(*hits.columns)


def mmr_order(relevance: np.ndarray, vectors: list, lam: float) -> list[int]:
    """Greedy maximal marginal relevance: similarity to the chosen is clamped at 0, ties keep the earlier."""
    n = len(relevance)
    if n <= 1:
        return list(range(n))
    low, high = relevance.min(), relevance.max()
    rel = np.ones(n) if high == low else (relevance - low) / (high - low)
    dims = {len(v) for v in vectors if v is not None}
    unit = np.zeros((n, max(dims, default=1)))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == unit.shape[1]:
            x = np.asarray(v, dtype=np.float64)
            norm = np.sqrt((x * x).sum())
            unit[i] = x / norm if norm > 0 else 0.0
    most = np.zeros(n)
    left, order = list(range(n)), []
    while left:
        best = max(left, key=lambda i: (round(lam * rel[i] - (1 - lam) * most[i], 12), -i))
        left.remove(best)
        order.append(best)
        most = np.maximum(most, unit @ unit[best])
    return order


def diversify(ranked: DataFrame, vectors: DataFrame, *, lam: float = MMR_LAMBDA) -> DataFrame:
    """``ranked (query_id, chunk_id, score, rank)`` in MMR order; scores stay, a missing vector resembles nothing."""
    joined = ranked.select("query_id", "chunk_id", "score", "rank").join(vectors.select(F.col("id").alias("chunk_id"), "embedding"), "chunk_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        order = mmr_order(pdf["score"].to_numpy(dtype=np.float64), list(pdf["embedding"]), lam)
        out = pdf.loc[order, ["query_id", "chunk_id", "score"]].copy()
        out["rank"] = np.arange(1, len(out) + 1, dtype=np.int64)
        return out

    q, c = ranked.schema["query_id"].dataType.simpleString(), ranked.schema["chunk_id"].dataType.simpleString()
    return joined.groupBy("query_id").applyInPandas(run, f"query_id {q}, chunk_id {c}, score double, rank long")


def hydrate(ranked: DataFrame, chunks: DataFrame, symbols: DataFrame | None = None, imports: DataFrame | None = None, exports: DataFrame | None = None) -> DataFrame:
    """Ranked ids with all a reader needs: file, lines, kind, signature, snippet, imports and exports.

    Bodies and imports are joined after the cut, so only survivors carry them. Ids without a chunk
    are dropped, absent imports give an empty array, a null kind an empty string.
    """
    body = chunks.select(F.col("id").alias("chunk_id"), "file_path", "start_line", "end_line", F.coalesce("kind", F.lit("")).alias("kind"), snippet(F.col("body")).alias("snippet"))
    out = ranked.join(body, "chunk_id")
    if symbols is not None:
        own = symbols.join(ranked.select("chunk_id").distinct(), "chunk_id", "left_semi")
        one = own.groupBy("chunk_id").agg(F.min_by("signature", F.struct("line", "signature")).alias("signature"))
        out = out.join(one, "chunk_id", "left")
    else:
        out = out.withColumn("signature", F.lit(None).cast("string"))
    files = ranked.join(chunks.select(F.col("id").alias("chunk_id"), "file_path"), "chunk_id").select("file_path").distinct()
    for name, table, cols in (("imports", imports, ("source", "kind", "line")), ("exports", exports, ("detail", "line"))):
        kind = "array<struct<source:string,kind:string,line:int>>" if name == "imports" else "array<struct<detail:string,line:int>>"
        if table is None:
            out = out.withColumn(name, F.array().cast(kind))
            continue
        wanted = table.join(files, "file_path", "left_semi").select("file_path", "ord", *cols).distinct()
        lists = wanted.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *cols))), lambda x: F.struct(*[x[c].alias(c) for c in cols])).cast(kind).alias(name))
        out = out.join(lists, "file_path", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def wire_hits(hydrated: DataFrame) -> DataFrame:
    """The shape that leaves the engine: no chunk id, ``file`` for ``file_path``, one JSON object per query."""
    cols = ["file", "start_line", "end_line", "kind", "signature", "snippet", "score", "imports", "exports"]
    hit = F.struct("rank", *[F.col("file_path").alias("file") if c == "file" else F.col(c) for c in cols])
    lists = hydrated.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("h"))
    return lists.select("query_id", F.to_json(F.struct(F.transform("h", lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("hits"))).alias("json"))


def renumber(ranked: DataFrame) -> DataFrame:
    """Ranks from 1 without gaps, in the order they had."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
