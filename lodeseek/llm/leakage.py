"""Evaluation texts leaking into training text.

Winnowing: of every window of ``guarantee - k + 1`` consecutive k-grams of words the smallest hash
is kept as a fingerprint, so that any span of ``guarantee`` words two texts share holds at least one
k-gram that both keep. Fingerprints of documents and items are joined, and every hit is extended to
the left and the right over the hashes of the words around it; a hit counts if the shared span has
at least ``guarantee`` words. Hashes of words have 64 bits, of which equality is taken as equality
of words.

Words are maximal runs of letters and digits in lower case, so layout, punctuation and comment signs
between them do not matter.

The fingerprint rows of the items, a stated query set, are written and counted; up to
``broadcast_limit`` of them, of bounded size each, go to every worker, which then drops document
fingerprints without a partner before anything is shuffled. Beyond the limit all fingerprints meet in a
shuffled join, with the same result.

A hit knows ``guarantee - k`` words on either side. In a longer shared span there is a fingerprint at
least every ``guarantee - k + 1`` words, so the extended hits of one span overlap, and their union is
the whole span, to its first and last word (``leaked_spans``).

Defined results: null texts and texts of fewer than ``guarantee`` words have no passages; repeated
rows count once; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.sources.durable import written
from lodeseek.sources.tables import spread

GUARANTEE = 12
K = 6
#: Rows of item fingerprints, of about 150 bytes each, that may be sent to every worker.
BROADCAST_LIMIT = 500_000

_WORDS = re.compile(r"[^\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=1 << 17)
def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + n]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the rightmost smallest of some window of ``width`` grams."""
    n = len(grams)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    width = min(width, n)
    m = n - width + 1
    best, at = grams[:m].copy(), np.zeros(m, dtype=np.int64)
    for i in range(1, width):
        x = grams[i : i + m]
        le = x <= best
        best[le] = x[le]
        at[le] = i
    return np.unique(at + np.arange(m))


def _batch(texts: list[str], guarantee: int, k: int):
    """Word hashes of all texts in one array, each followed by a gap, and the winnowed positions."""
    hashes, sizes = [np.empty(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        ws = words_of(t) if t else []
        if len(ws) >= guarantee:
            hashes.append(np.fromiter(map(word_hash, ws), dtype=np.uint64, count=len(ws)))
            sizes[i] = len(ws)
    words = np.concatenate(hashes)
    ends = np.cumsum(sizes)
    grams = gram_hashes(words, k)
    if len(grams):  # grams across two texts can't be chosen before a real one
        crossing = (ends[:-1, None] - np.arange(1, k)[None, :]).ravel()
        grams[crossing[(crossing >= 0) & (crossing < len(grams))]] = _NONE
    at = winnow(grams, guarantee - k + 1)
    at = at[grams[at] != _NONE]
    return words, ends, grams, at


def _fingerprints(guarantee: int, k: int, keep: np.ndarray | None):
    """mapInPandas body: rows (id, fp, pos, before, ctx) with the words around each fingerprint."""
    reach = guarantee - k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            words, ends, grams, at = _batch(list(pdf["text"]), guarantee, k)
            if keep is not None and len(at):
                fp = grams[at]
                i = np.searchsorted(keep, fp)
                at = at[keep[np.minimum(i, len(keep) - 1)] == fp]
            if not len(at):
                continue
            doc = np.searchsorted(ends, at, side="right")
            begin = np.concatenate(([0], ends))[doc]
            lo = np.maximum(begin, at - reach)
            hi = np.minimum(ends[doc], at + k + reach)
            signed = words.view(np.int64)
            yield pd.DataFrame(
                {"id": ids[doc], "fp": grams[at].view(np.int64), "pos": (at - begin).astype(np.int32), "before": (at - lo).astype(np.int32), "ctx": [signed[a:b] for a, b in zip(lo, hi)]}
            )

    return run


def _extended(guarantee: int, k: int):
    """How many words to the left and right of a hit, its own included, are shared; null if the hit does not count."""

    @F.pandas_udf("left int, right int")
    def shared(a_before: pd.Series, a: pd.Series, b_before: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for pa, xa, pb, xb in zip(a_before, a, b_before, b):
            left = 0
            while left < pa and left < pb and xa[pa - 1 - left] == xb[pb - 1 - left]:
                left += 1
            right, na, nb = 0, len(xa) - pa, len(xb) - pb
            while right < na and right < nb and xa[pa + right] == xb[pb + right]:
                right += 1
            out.append((left, right) if right >= k and left + right >= guarantee else (None, None))
        return pd.DataFrame(out, columns=["left", "right"]).astype("Int32")

    return shared


def _hits(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, guarantee: int, k: int, broadcast_limit: int) -> DataFrame:
    """Rows ``(doc_id, item_id, doc_pos, item_pos, words)`` of the extended hits; positions count words from 0."""
    if not 0 < k <= guarantee:
        raise ValueError("k must lie between 1 and guarantee")
    schema = "id long, fp long, pos int, before int, ctx array<long>"
    item_rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).dropna()
    item_fp = item_rows.distinct().mapInPandas(_fingerprints(guarantee, k, None), schema)
    item_fp = written(item_fp.select(F.col("id").alias("item_id"), "fp", F.col("pos").alias("item_pos"), F.col("before").alias("item_before"), F.col("ctx").alias("item_ctx")), "item_fingerprints")
    keep = None
    small = item_fp.count() <= broadcast_limit
    if small:  # no more than that many rows come to the driver and go to the workers
        keep = np.unique(item_fp.select("fp").toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text")).dropna()
    if small and not len(keep):
        return rows.select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("item_id"), *[F.lit(0).alias(c) for c in ("doc_pos", "item_pos", "words")]).limit(0)
    doc_fp = spread(rows, "id").mapInPandas(_fingerprints(guarantee, k, keep), schema)
    met = doc_fp.join(F.broadcast(item_fp) if small else item_fp, "fp")
    found = met.select(F.col("id").alias("doc_id"), "item_id", "pos", "item_pos", _extended(guarantee, k)("before", "ctx", "item_before", "item_ctx").alias("x")).filter("x.left IS NOT NULL")
    return found.select("doc_id", "item_id", (F.col("pos") - F.col("x.left")).alias("doc_pos"), (F.col("item_pos") - F.col("x.left")).alias("item_pos"), (F.col("x.left") + F.col("x.right")).alias("words"))


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    guarantee: int = GUARANTEE,
    k: int = K,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Distinct ``(doc_id, item_id)`` of documents and the items of which they hold ``guarantee`` words in a row."""
    return _hits(docs, items, doc_id, doc_text, item_id, item_text, guarantee, k, broadcast_limit).select("doc_id", "item_id").distinct()


def leaked_spans(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    guarantee: int = GUARANTEE,
    k: int = K,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Rows ``(doc_id, item_id, doc_pos, item_pos, words)``: every longest shared span of at least ``guarantee``
    words, by the places of its first word in both. Hits of one span lie on one diagonal and overlap."""
    hits = _hits(docs, items, doc_id, doc_text, item_id, item_text, guarantee, k, broadcast_limit)
    hits = hits.withColumn("diagonal", F.col("doc_pos") - F.col("item_pos")).groupBy("doc_id", "item_id", "diagonal", "doc_pos").agg(F.max("words").alias("words"))
    line = Window.partitionBy("doc_id", "item_id", "diagonal").orderBy("doc_pos")
    reached = F.max(F.col("doc_pos") + F.col("words")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("opens", F.coalesce(F.col("doc_pos") > reached, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(line))
    spans = runs.groupBy("doc_id", "item_id", "diagonal", "run").agg(F.min("doc_pos").alias("doc_pos"), F.max(F.col("doc_pos") + F.col("words")).alias("stop"))
    return spans.select("doc_id", "item_id", "doc_pos", (F.col("doc_pos") - F.col("diagonal")).alias("item_pos"), (F.col("stop") - F.col("doc_pos")).alias("words"))
