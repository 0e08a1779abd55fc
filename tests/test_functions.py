import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.functions.hashing import FeatureHash, Nested, blake3, choose_embedder, truncated

TOKENS = [
    ("parseString", ["parse", "string"]),
    ("HTTPServer", ["http", "server"]),
    ("parseHTTPRequest", ["parse", "http", "request"]),
    ("utf8Decode", ["utf8", "decode"]),
    ("MAX_SIZE", ["max", "size"]),
    ("sha256sum", ["sha256sum"]),
    ("__init__", ["init"]),
    ("_foo", ["foo"]),
    ("", []),
    (" !! ", []),
]


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()[0]


def test_code_tokens(spark):
    got = spark.createDataFrame(TOKENS, "s string, want array<string>").select(T.code_tokens(F.col("s")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert one(spark, None, T.code_tokens) is None


def test_plain_tokens_keep_humps(spark):
    assert one(spark, "parseHTTP Äpfel_2", T.plain_tokens) == ["parsehttp", "äpfel", "2"]


def test_weights(spark):
    rows = [("snake_case", 2.0, 1.0), ("User", 1.0, 1.0), ("kebab-case", 1.0, 1.0), ("camelCase", 2.0, 1.0), ("x2", 2.0, 1.0), ("two words", 1.0, 2.0), ("", 1.0, 1.0), (None, 1.0, 1.0)]
    a, b = T.adaptive_weights(F.col("q"))
    for r in spark.createDataFrame(rows, "q string, a double, b double").select("q", "a", "b", a.alias("x"), b.alias("y")).collect():
        assert (r.x, r.y) == (r.a, r.b), r
    for w, want in ((-1.0, 0.0), (0.5, 0.5), (math.nan, 1.0), (math.inf, 1.0), (None, 1.0)):
        assert one(spark, w, T.sane_weight, "double") == want


def test_paths_and_ids(spark):
    for p, want in (("a/b.rs", "rust"), ("a.b/c", None), ("x.TSX", None), ("x.tsx", "typescript"), ("lib.hh", "cpp")):
        assert one(spark, p, T.language_of) == want
    assert one(spark, "file:/r/a/b.py", lambda c: T.relative_path(c, "/r")) == "a/b.py"
    assert one(spark, "/other/b.py", lambda c: T.relative_path(c, "/r")) is None
    for s, want in (("a:b/c:3-9", ("a:b/c", 3, 9)), ("nope", (None, None, None)), ("a:3", (None, None, None))):
        assert tuple(one(spark, s, lambda c: F.struct(*[x.alias(str(i)) for i, x in enumerate(T.parse_chunk_id(c))]))) == want
    assert one(spark, "p", lambda c: T.chunk_id(c, F.lit(1), F.lit(60))) == "p:1-60"


def test_overlap_and_similarity(spark):
    f = lambda *r: spark.range(1).select(T.overlap_fraction(*[F.lit(x) for x in r])).first()[0]
    assert f(1, 60, 30, 60) == 1.0 and f(1, 20, 11, 30) == 0.5 and f(1, 2, 3, 4) == 0.0
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [])], "a array<double>, b array<double>, z array<double>, e array<double>")
    a, b, z, e = (F.col(c) for c in "abze")
    r = v.select(T.cosine(a, b), T.cosine(a, z), T.cosine(a, e), T.l2_distance(a, b), T.jaccard(a, b), T.jaccard(e, e)).first()
    assert r[0] == pytest.approx(1 / math.sqrt(2)) and r[1] == 0 and r[2] == 0 and r[3] == pytest.approx(1.0) and r[4] == pytest.approx(0.5) and r[5] == 0.0


def test_cuts(spark):
    assert one(spark, "é" * 10, lambda c: T.index_text(c, 5)) == "éé"
    assert one(spark, "abc", lambda c: T.index_text(c, 5)) == "abc"
    assert one(spark, "a😀b", lambda c: T.index_text(c, 4)) == "a"
    assert one(spark, "x" * 9000, lambda c: F.length(T.index_text(c))) == 8192
    assert one(spark, "\n  \n\t a b \r\nx", T.first_line) == "a b"
    assert one(spark, " \n", T.first_line) is None
    assert one(spark, "é" * 3000, lambda c: F.length(T.snippet(c))) == 2000
    assert one(spark, "a\n" + "x" * 4097, T.no_long_line) is False and one(spark, "x" * 4096, T.no_long_line) is True


def test_blake3_vectors():
    data = bytes(i % 251 for i in range(3000))
    # Public test vectors of the algorithm, by length of that input.
    vectors = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"}
    for n, want in vectors.items():
        assert blake3(data[:n]).hex() == want
    assert len({blake3(data[:n]) for n in (63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3000)}) == 9


def test_feature_hash():
    for method in ("blake3", "md5"):
        e = FeatureHash(method, 64)
        v = e.embed(["hello world function", "hello world", "", None, "xyz"])
        assert np.allclose((v[[0, 1, 4]] ** 2).sum(axis=1), 1) and not v[2].any() and not v[3].any()
        assert (e.embed(["Hello  WORLD"]) == v[1]).all() and v[0] @ v[1] > v[0] @ v[4]
    t = truncated(v, 16)
    assert t.shape == (5, 16) and not t[2].any()


def test_choice_of_embedder():
    yes, no = (lambda p: True), (lambda p: False)
    assert choose_embedder(None, None, no) == ("feature-hash", None)
    assert choose_embedder("bert", "/m", yes)[0] == "bert"
    assert choose_embedder("gemma", "/m", no)[0] == "feature-hash" and choose_embedder("x", "/m", yes)[0] == "feature-hash"


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=200))
def test_blake3_is_a_function(b):
    assert blake3(b) == blake3(bytes(b)) and len(blake3(b)) == 32


def test_nested_representations():
    inner = FeatureHash()
    cut = Nested(inner, 192)
    v = cut.embed_query(["read the file", ""])
    assert v.shape == (2, 192) and cut.id == "feature-hash-v1-192" and abs(np.linalg.norm(v[0]) - 1) < 1e-9 and not v[1].any()
    assert np.allclose(cut.embed_document(["a b"]), truncated(inner.embed(["a b"]), 192))
