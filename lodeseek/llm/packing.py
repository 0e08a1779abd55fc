"""Filling containers of fixed capacity with texts.

Sizes are counted in tokens of a public tokenizer. A text that exceeds the capacity is cut at token
boundaries into full containers and a rest; nothing else is split. The items are spread over tasks by
a hash, so that each task sees a fair sample of all sizes, sources and clusters, and every task packs
its own by conflict-constrained best-fit, in two orders of which the one with fewer containers counts:
the largest first, or first the sources of which many texts have to be kept apart, the most frequent one
first, and then all the rest:

* bins are ordered by their residual (a bit set over residuals gives the next one that is large
  enough) and carry a bitmap of the sources and one of the duplicate clusters they hold;
* the successor search goes on from the tightest residual until it finds a bin with which the item has
  no conflict, and opens a new one if there is none. Two texts of one duplicate cluster are always in
  conflict. Two texts of one source are, unless the source has more texts in the task than the task's
  tokens fill containers (``ceil(tokens / capacity)``): such a source can't be kept apart by anyone, so
  it stands in no one's way. Pieces of one text are not in conflict as a source.

Items of equal size and cluster are packed one after the other and resume the search where the last
one ended, so a group of copies that holds a third of all rows costs one pass over the bins.

A task gets about ``items_per_task`` items; as each leaves a few open bins, the space they waste is
in proportion to 1 / items_per_task and doesn't grow with the input.

Defined results: a null text is skipped; an empty text has size 0 and goes into any bin its conflicts
allow, of which one is opened if there is none; a null source stands in no one's way; rows with one
id and text count once, different texts of one id are packed each; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.sources.durable import written
from lodeseek.sources.tables import spread

CAPACITY = 2048
ITEMS_PER_TASK = 20_000
#: A source goes first if its texts are at least one in so many of the containers.
FREQUENT = 32
#: Fixed value: the pattern by which the tokenizer's authors cut text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A counter of tokens for a ``.tiktoken`` rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(path: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(path)
        for pdf in batches:
            texts = list(pdf["text"])
            n = np.fromiter((len(enc.encode_ordinary(t)) for t in texts), dtype=np.int64, count=len(texts))
            same = np.fromiter((xxhash.xxh64_intdigest(" ".join(t.lower().split()).encode("utf-8", "surrogatepass")) for t in texts), dtype=np.uint64, count=len(texts))
            exact = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            pieces = np.maximum(1, -(-n // capacity))
            at = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            yield pd.DataFrame(
                {
                    "id": pdf["id"].to_numpy()[at],
                    "piece": piece.astype(np.int32),
                    "pieces": pieces[at].astype(np.int32),
                    "tokens": np.minimum(capacity, n[at] - piece * capacity).astype(np.int32),
                    "exact": np.array(exact, dtype=object)[at],
                    "source": pdf["source"].to_numpy()[at],
                    "cluster": same.view(np.int64)[at] if "cluster" not in pdf else pdf["cluster"].to_numpy()[at],
                }
            )

    return run


def kept_apart(sizes: list[int], sources: list, capacity: int) -> dict:
    """The sources with no more items than the items' sizes fill bins, and how many they have."""
    floor = -(-sum(sizes) // capacity)
    return {s: k for s, k in Counter(sources).items() if s is not None and k <= floor}


def packing_orders(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[list[int]]:
    """By size alone, and with the frequent sources first."""
    floor, apart = -(-sum(sizes) // capacity), kept_apart(sizes, sources, capacity)
    first = {s: k for s, k in apart.items() if k > 1 and k * FREQUENT >= floor}
    by_size = sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], i))
    if not first:
        return [by_size]
    return [by_size, sorted(by_size, key=lambda i: (-first[sources[i]], sources[i]) if sources[i] in first else (0, ""))]


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> list[int]:
    """The bin of each item, in the better of the ``packing_orders``."""
    tried = [placed(sizes, sources, clusters, order, capacity) for order in packing_orders(sizes, sources, clusters, capacity)]
    return min(tried, key=lambda bins: max(bins, default=0))


def placed(sizes: list[int], sources: list, clusters: list, order: list[int], capacity: int) -> list[int]:
    """The bin of each item, if items are taken in ``order``."""
    source_bit = {s: 1 << i for i, s in enumerate(sorted(kept_apart(sizes, sources, capacity)))}
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(c for c, k in Counter(clusters).items() if k > 1))}
    where = [0] * len(sizes)
    shelves: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by residual, the newest last
    present = 0  # bit r: some bin has residual r
    src: list[int] = []
    clu: list[int] = []
    last = None
    passed: dict[int, int] = {}  # residual: how many bins of its shelf hold the cluster, as the like items before this one found
    for i in order:
        size, cb, sb = sizes[i], cluster_bit.get(clusters[i], 0), source_bit.get(sources[i], 0)
        run = (size, clusters[i])
        if run != last:
            last, passed = run, {}
        found = None
        rest = present >> size
        r = size
        while rest:
            r += (rest & -rest).bit_length() - 1
            shelf = shelves[r]
            first = upto = passed.get(r, 0)
            for k in range(first, len(shelf)):
                b = shelf[k]
                if clu[b] & cb:
                    upto += upto == k
                elif not src[b] & sb:
                    found = r, k
                    break
            if upto > first:
                passed[r] = upto
            if found:
                break
            r += 1
            rest = present >> r
        if found:
            r, k = found
            shelf = shelves[r]
            b = shelf.pop(k)
            if not shelf:
                present &= ~(1 << r)
            if passed.get(r, 0) > k:
                passed[r] -= 1
        else:
            b, r = len(src), capacity
            src.append(0)
            clu.append(0)
        src[b] |= sb
        clu[b] |= cb
        left = r - size
        if passed and left in passed:  # the bin now holds the cluster: it may lie among those passed
            shelves[left].insert(0, b)
            passed[left] += 1
        else:
            shelves[left].append(b)
        present |= 1 << left
        where[i] = b
    return where


def _pack(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "exact", "piece"], kind="stable").reset_index(drop=True)
        # the rest of a cut text has its full containers to itself, and no source
        sources = [None if s is None or s != s or n > 1 else s for s, n in zip(pdf["source"], pdf["pieces"])]
        bins = best_fit(pdf["tokens"].tolist(), sources, pdf["cluster"].tolist(), capacity)
        return pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "pieces": pdf["pieces"], "tokens": pdf["tokens"], "container": np.asarray(bins, dtype=np.int64) + (int(key[0]) << 32)})

    return run


def pack(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = "source",
    cluster_col: str | None = None,
    capacity: int = CAPACITY,
    items_per_task: int = ITEMS_PER_TASK,
    tokenizer_file: str,
) -> DataFrame:
    """Rows ``(id, piece, pieces, tokens, container)``; containers hold up to ``capacity`` tokens each.

    ``tokenizer_file`` is a ``.tiktoken`` rank file that all workers can read. Without ``cluster_col`` texts that are equal but for case and white space form a cluster.
    """
    if capacity < 1 or items_per_task < 1:
        raise ValueError("capacity and items_per_task must be positive")
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), source.alias("source")]
    if cluster_col:
        cols.append(F.xxhash64(F.col(cluster_col).cast("string")).alias("cluster"))
    rows = df.select(*cols).filter(F.col("text").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    sized = spread(rows, "id").mapInPandas(_sizes(tokenizer_file, capacity), f"id {kind}, piece int, pieces int, tokens int, exact binary, source string, cluster long")
    # of rows with one id and text the first source counts, as text; clusters follow the text or are the caller's
    keys = ["id", "piece", "exact", "pieces", "tokens"]
    items = written(sized.groupBy(*keys).agg(F.min("source").alias("source"), F.min("cluster").alias("cluster")), "sizes")
    tasks = max(1, round(items.count() / items_per_task))
    shares = items.withColumn("share", F.pmod(F.xxhash64("id", "piece", "exact"), F.lit(tasks)))
    return shares.groupBy("share").applyInPandas(_pack(capacity), f"id {kind}, piece int, pieces int, tokens int, container long")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each container: its texts, tokens and free space."""
    return packed.groupBy("container").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens")).withColumn("free", F.lit(capacity) - F.col("tokens"))
