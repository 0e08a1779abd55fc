"""Hash functions and the embedders built on them.

An embedder has an ``id`` and a ``dim`` (both are stamped on an index, which refuses to be searched
with another) and turns texts into vectors. The feature-hashing embedders add up, for every token of
a text, a sign in one of ``dim`` buckets, both taken from a hash of the token, and scale the result to
length 1; a text without tokens has the zero vector. Tokens repeat, so hashes are kept per worker.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 384
#: Texts that a worker embeds at a time.
ROWS_AT_ONCE = 2500

# Fixed values of the BLAKE3 paper: initial state, message permutation and domain flags.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_CHUNK = 1024
_M32 = 0xFFFFFFFF


def _quarter(v: list[int], a: int, b: int, c: int, d: int, x: int, y: int) -> None:
    for word, first, second in ((x, 16, 12), (y, 8, 7)):
        v[a] = (v[a] + v[b] + word) & _M32
        t = v[d] ^ v[a]
        v[d] = (t >> first | t << 32 - first) & _M32
        v[c] = (v[c] + v[d]) & _M32
        t = v[b] ^ v[c]
        v[b] = (t >> second | t << 32 - second) & _M32


def _compress(cv: tuple, block: bytes, counter: int, flags: int) -> list[int]:
    m = [int.from_bytes(block[i : i + 4].ljust(4, b"\0"), "little") for i in range(0, 64, 4)]
    v = [*cv, *_IV[:4], counter & _M32, counter >> 32, len(block), flags]
    for _ in range(7):
        for i in range(4):
            _quarter(v, i, i + 4, i + 8, i + 12, m[2 * i], m[2 * i + 1])
        for i in range(4):
            _quarter(v, i, (i + 1) % 4 + 4, (i + 2) % 4 + 8, (i + 3) % 4 + 12, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[i] for i in _PERMUTATION]
    return [a ^ b for a, b in zip(v[:8], v[8:])]


def blake3(data: bytes) -> bytes:
    """The 32-byte BLAKE3 digest."""

    def chunk(part: bytes, counter: int, root: int) -> tuple:
        cv: tuple = _IV
        blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        for i, block in enumerate(blocks):
            last = i == len(blocks) - 1
            cv = tuple(_compress(cv, block, counter, (_CHUNK_START if i == 0 else 0) | ((_CHUNK_END | root) if last else 0)))
        return cv

    def tree(lo: int, hi: int, root: int) -> tuple:
        if hi - lo == 1:
            return chunk(data[lo * _CHUNK : hi * _CHUNK], lo, root)
        mid = lo + (1 << (hi - lo - 1).bit_length() - 1)
        both = b"".join(x.to_bytes(4, "little") for x in (*tree(lo, mid, 0), *tree(mid, hi, 0)))
        return tuple(_compress(_IV, both, 0, _PARENT | root))

    return b"".join(x.to_bytes(4, "little") for x in tree(0, max(1, -(-len(data) // _CHUNK)), _ROOT))


class Embedder(Protocol):
    """Queries and documents may be embedded differently; feature hashing makes no difference."""

    id: str
    dim: int

    def embed_document(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, texts: list[str]) -> np.ndarray: ...


_TOKEN = re.compile(r"[^\W_]+")


def _md5(token: bytes) -> bytes:
    return hashlib.md5(token, usedforsecurity=False).digest()


@lru_cache(maxsize=1 << 17)
def _bucket(token: str, method: str, dim: int) -> tuple[int, float]:
    if method == "md5":
        d = _md5(token.encode("utf-8", "surrogatepass"))
        return int.from_bytes(d[:4], "big") % dim, 1.0 if d[4] & 1 == 0 else -1.0
    d = blake3(token.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:4], "little") % dim, 1.0 if d[4] & 1 == 0 else -1.0


class FeatureHash:
    """``feature-hash-v1`` by BLAKE3, or the variant by MD5, which SQL engines also have."""

    def __init__(self, method: str = "blake3", dim: int = DIM):
        if method not in ("blake3", "md5"):
            raise ValueError("method must be blake3 or md5")
        self.method, self.dim = method, dim
        self.id = "feature-hash-v1" if method == "blake3" else "feature-hash-md5-v1"

    def embed_document(self, texts: list[str]) -> np.ndarray:
        return self.embed(texts)

    def embed_query(self, texts: list[str]) -> np.ndarray:
        return self.embed(texts)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for token, n in Counter(_TOKEN.findall((text or "").lower())).items():
                at, sign = _bucket(token, self.method, self.dim)
                row[at] += sign * n
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)


def truncated(vectors: np.ndarray, dim: int) -> np.ndarray:
    """The first ``dim`` coordinates, scaled to length 1 again, as nested representations allow."""
    part = np.asarray(vectors, dtype=np.float64)[:, :dim]
    norm = np.sqrt((part * part).sum(axis=1, keepdims=True))
    return np.divide(part, norm, out=np.zeros_like(part), where=norm > 0)


class Nested:
    """An embedder of nested representations, cut to ``dim`` coordinates."""

    def __init__(self, inner: Embedder, dim: int):
        if not 0 < dim <= inner.dim:
            raise ValueError("dim must lie between 1 and that of the embedder")
        self.inner, self.dim, self.id = inner, dim, f"{inner.id}-{dim}"

    def embed_document(self, texts: list[str]) -> np.ndarray:
        return truncated(self.inner.embed_document(texts), self.dim)

    def embed_query(self, texts: list[str]) -> np.ndarray:
        return truncated(self.inner.embed_query(texts), self.dim)


def embed_rows(df: DataFrame, embedder: Embedder, *, keep: list[str], text_col: str, query: bool = False) -> DataFrame:
    """Rows ``(*keep, embedding)``, in Arrow batches; a null text has the zero vector."""
    rows = df.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = embedder.embed_query if query else embedder.embed_document
        for pdf in (whole.iloc[a : a + ROWS_AT_ONCE] for whole in batches for a in range(0, len(whole), ROWS_AT_ONCE)):
            yield pdf[keep].assign(embedding=list(embed(list(pdf["_text"])).astype(np.float32)))

    return rows.mapInPandas(run, f"{kinds}, embedding array<float>")


def embed_column(df: DataFrame, embedder: Embedder, *, id_col: str, text_col: str, query: bool = False) -> DataFrame:
    """Rows ``(id, embedding)``."""
    return embed_rows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), embedder, keep=["id"], text_col="text", query=query)


def choose_embedder(requested: str | None, model_path: str | None, path_exists) -> tuple[str, str | None]:
    """``(kind, reason)``: a learned embedder is taken only if asked for and its model is there."""
    if requested in (None, "", "feature-hash"):
        return "feature-hash", None
    if requested not in ("bert", "gemma"):
        return "feature-hash", f"unknown embedder {requested}"
    if not model_path or not path_exists(model_path):
        return "feature-hash", f"no model for {requested}"
    return requested, None
