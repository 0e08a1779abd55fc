import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators.rerank import diversify, drop_overlaps, drop_same_content, hydrate, mmr_order, wire_hits
from lodeseek.operators.retrieval import bm25_topk, boost_imports, corpus_stats, knn, postings, rrf
from lodeseek.plans.evaluate import first_relevant, quality, worse_than_either

DOCS = [("a:1-3", "fn parseHTTPRequest() parse"), ("b:1-3", "request handler"), ("c:1-1", "}"), ("d:1-9", "unrelated words here"), ("e:1-2", "parse parse parse request")]


def brute_bm25(docs, query, k=10):
    words = {i: t for i, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    scores = {}
    for q in query:
        df = sum(q in w for w in words.values())
        for i, w in words.items():
            if tf := w.count(q):
                idf = math.log((n - df + 0.5) / (df + 0.5))
                scores[i] = scores.get(i, 0) - (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
    return sorted(((round(s, 9), i) for i, s in scores.items()))[:k]


def test_bm25(spark):
    chunks = spark.createDataFrame(DOCS, "id string, body string")
    q = spark.createDataFrame([(1, "parse request"), (2, "parse parse"), (3, "!!"), (4, "absent"), (5, None)], "query_id long, query string")
    got = bm25_topk(postings(chunks), corpus_stats(chunks), q).collect()
    toks = [("a:1-3", ["fn", "parse", "http", "request", "parse"]), ("b:1-3", ["request", "handler"]), ("c:1-1", []), ("d:1-9", ["unrelated", "words", "here"]), ("e:1-2", ["parse"] * 3 + ["request"])]
    for n, words in ((1, ["parse", "request"]), (2, ["parse", "parse"])):
        assert [(r.score, r.chunk_id) for r in sorted((r for r in got if r.query_id == n), key=lambda r: r["rank"])] == brute_bm25(toks, words)
    assert {r.query_id for r in got} == {1, 2}
    empty = spark.createDataFrame([], "id string, body string")
    assert bm25_topk(postings(empty), corpus_stats(empty), q).count() == 0


def test_bm25_ties_go_to_the_smaller_id(spark):
    chunks = spark.createDataFrame([(i, "word other") for i in "dbca"] + [("z", "x y z w v u")], "id string, body string")
    q = spark.createDataFrame([(1, "word")], "query_id long, query string")
    assert [r.chunk_id for r in bm25_topk(postings(chunks), corpus_stats(chunks), q, 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[50:60] = x[0]  # ties
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(999, None), (1000, [1.0])], "id long, embedding array<float>").repartition(5)
    q = v.filter("id % 20 = 0 and id < 200").withColumnRenamed("id", "query_id")
    for block in (3, 4096):
        got = {(r.query_id, r["rank"]): r.chunk_id for r in knn(v, q, 5, block=block).collect()}
        for i in range(0, 200, 20):
            d = np.round(np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1)), 6)
            assert [got[i, k + 1] for k in range(5)] == sorted(range(200), key=lambda j: (d[j], j))[:5]
    assert knn(v, q.limit(0)).count() == 0


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, rank long")


def test_rrf(spark):
    a = ranked(spark, [(1, "x", 1), (1, "y", 2), (1, "y", 9)])
    b = ranked(spark, [(1, "z", 1), (1, "y", 2)])
    got = rrf(a, b).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 9)) for r in got] == [("y", round(2 / 62, 9)), ("x", round(1 / 61, 9)), ("z", round(1 / 61, 9))]
    w = spark.createDataFrame([(1, 0.0, 1.0)], "query_id long, w_lexical double, w_vector double")
    assert [r.chunk_id for r in rrf(a, b, weights=w).orderBy("rank").collect()] == ["z", "y", "x"]
    # the same as the unweighted one if both weights are 1, absent or no number
    for w in ([(1, 1.0, 1.0)], [(2, 5.0, 5.0)], [(1, float("nan"), None)]):
        assert [r.chunk_id for r in rrf(a, b, weights=spark.createDataFrame(w, "query_id long, w_lexical double, w_vector double")).orderBy("rank").collect()] == ["y", "x", "z"]


def test_fusion_beats_lexical_alone(spark):
    """A chunk that both lists hold in the middle comes before those that only one puts first."""
    lex = ranked(spark, [(1, f"n{i}", i) for i in range(1, 5)] + [(1, "right", 5)])
    vec = ranked(spark, [(1, "right", 1)] + [(1, f"m{i}", i) for i in range(2, 6)])
    assert rrf(lex, vec).filter("rank = 1").first().chunk_id == "right"


def test_boost(spark):
    fused = spark.createDataFrame([(1, "a", 0.50, 1), (1, "b", 0.495, 2)], "query_id long, chunk_id string, score double, rank long")
    q = spark.createDataFrame([(1, "http server")], "query_id long, query string")
    files = spark.createDataFrame([("a", "fa"), ("b", "fb")], "chunk_id string, file_path string")
    for source, want in (("net/HTTPClient", ["b", "a"]), ("json", ["a", "b"])):
        imports = spark.createDataFrame([("fb", source), ("fb", source), ("fc", "http")], "file_path string, source string")
        assert [r.chunk_id for r in boost_imports(fused, q, imports, files).orderBy("rank").collect()] == want


def test_overlaps(spark):
    rows = [(1, 1, "f", 1, 60), (1, 2, "f", 30, 60), (1, 3, "f", 46, 105), (1, 4, "g", 1, 60), (2, 1, "f", 1, 20), (2, 2, "f", 11, 30), (3, 1, "f", 10, 20), (3, 2, "f", 1, 100), (3, 3, None, 1, 2), (3, 4, "f", None, 2)]
    hits = spark.createDataFrame(rows, "query_id long, rank long, file string, start_line int, end_line int")
    kept = {(r.query_id, r["rank"]) for r in drop_overlaps(hits).collect()}
    assert kept == {(1, 1), (1, 3), (1, 4), (2, 1), (2, 2), (3, 1), (3, 3), (3, 4)}


def test_same_content(spark):
    body = " ".join(f"w{i}" for i in range(10))
    rows = [(1, 1, body, None), (1, 2, body.upper() + " ", None), (1, 3, "}", None), (1, 4, "{", None), (1, 5, body + " x1 x2", None), (2, 1, body, "f(a)"), (2, 2, None, None)]
    hits = spark.createDataFrame(rows, "query_id long, rank long, snippet string, signature string")
    assert {(r.query_id, r["rank"]) for r in drop_same_content(hits).collect()} == {(1, 1), (1, 3), (1, 4), (1, 5), (2, 1), (2, 2)}


def test_mmr(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    assert mmr_order(np.array([0.9, 0.55, 0.5]), v, 0.7) == [0, 2, 1]
    assert mmr_order(np.array([0.9, 0.55, 0.5]), v, 1.0) == [0, 1, 2]
    assert mmr_order(np.array([0.5, 0.5]), [None, [1.0]], 0.7) == [0, 1]
    assert mmr_order(np.array([]), [], 0.7) == []
    r = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.55, 2), (1, "c", 0.5, 3)], "query_id long, chunk_id string, score double, rank long")
    vec = spark.createDataFrame(list(zip("abc", v)), "id string, embedding array<double>")
    assert [(x.chunk_id, x.score) for x in diversify(r, vec).orderBy("rank").collect()] == [("a", 0.9), ("c", 0.5), ("b", 0.55)]


def test_hydrate_and_wire(spark):
    r = spark.createDataFrame([(1, "f:1-2", 0.5, 1), (1, "gone", 0.4, 2)], "query_id long, chunk_id string, score double, rank long")
    chunks = spark.createDataFrame([("f:1-2", "f", 1, 2, None, "b" * 3000)], "id string, file_path string, start_line int, end_line int, kind string, body string")
    symbols = spark.createDataFrame([("f:1-2", "n", "n()", "function", 1)], "chunk_id string, name string, signature string, kind string, line int")
    imports = spark.createDataFrame([("f", 1, "z", "named", 2), ("f", 0, "y", "default", 1), ("f", 0, "y", "default", 1)], "file_path string, ord int, source string, kind string, line int")
    h = hydrate(r, chunks, symbols, imports).collect()
    assert len(h) == 1 and h[0].kind == "" and len(h[0].snippet) == 2000 and h[0].signature == "n()"
    assert [x.source for x in h[0].imports] == ["y", "z"] and h[0].exports == []
    js = wire_hits(hydrate(r, chunks)).first().json
    assert js.startswith('{"hits":[{"file":"f"') and "chunk_id" not in js


def test_quality(spark):
    labels = spark.createDataFrame([(1, "f", 5), (2, "f", 50), (3, "g", 1)], "query_id long, file string, target_line int")
    places = spark.createDataFrame([("f:1-10", "f", 1, 10), ("f:40-60", "f", 40, 60)], "id string, file_path string, start_line int, end_line int")
    r = ranked(spark, [(1, "f:1-10", 2), (2, "f:40-60", 8), (3, "f:1-10", 1)])
    q = quality(first_relevant(labels, r, places)).first()
    assert (q.queries, q.misses) == (3, 1) and q.recall_5 == pytest.approx(1 / 3) and q.recall_10 == pytest.approx(2 / 3) and q.mrr == pytest.approx((0.5 + 0.125) / 3)
    f = lambda ranks: spark.createDataFrame(list(enumerate(ranks)), "query_id long, rank long")
    assert worse_than_either(f([2, None, 1, None]), f([1, None, 5, 3]), f([5, None, None, None])).first().worse == 2
    assert Counter(first_relevant(labels, r, places).toPandas()["rank"].isna()) == Counter({False: 2, True: 1})


def test_bm25_of_many_queries_pairs_no_rows(spark):
    """A term that all share is in each query and each chunk: 300 queries and 600 chunks give results, not 180 000 rows to shuffle."""
    rng = np.random.default_rng(2)
    words = [["common", *(f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 9)))] for _ in range(600)]
    chunks = spark.createDataFrame([(f"c{i:03d}", " ".join(w).replace("w", "W_")) for i, w in enumerate(words)], "id string, body string").repartition(7)
    words = [[x if x == "common" else y for x in w for y in ((x,) if x == "common" else ("w", x[1:]))] for w in words]
    asked = [(i, f"common w_{i % 40} w_{i % 7} common") for i in range(300)] + [(300, "common w_0 w_0 common"), (301, "?")]
    q = spark.createDataFrame(asked, "query_id long, query string")
    index, stats = postings(chunks, distinct_ids=True), corpus_stats(chunks)
    docs = [(f"c{i:03d}", w) for i, w in enumerate(words)]
    for block in (1 << 20, 200):
        found = bm25_topk(index, stats, q, 5, block=block)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((round(r.score, 8), r.chunk_id))
        assert set(got) == set(range(301)) and got[300] == got[0]
        for i in (0, 1, 13, 39, 40, 299):
            query = ["common", "w", str(i % 40), "w", str(i % 7), "common"]
            assert got[i] == [(round(s, 8), c) for s, c in brute_bm25(docs, query, 5)]
    assert rows_shuffled(spark, lambda: bm25_topk(index, stats, q, 5).collect()) < 20_000


def rows_shuffled(spark, run):
    """The rows that the stages of ``run`` wrote to shuffles."""
    store = spark._jsc.sc().statusStore()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda l: [l.apply(i) for i in range(l.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_postings_of_distinct_ids(spark):
    chunks = spark.createDataFrame([*DOCS, ("n", None), ("e", ""), ("one", "x"), ("run", "b a b a b aa")], "id string, body string")
    a, b = (postings(chunks, distinct_ids=x).select("term", "chunk_id", "dl", "tf").collect() for x in (True, False))
    assert sorted(a) == sorted(b) and len(a) > 10
    assert "Exchange" not in postings(chunks, distinct_ids=True)._jdf.queryExecution().executedPlan().toString()


def test_knn_over_slices_of_a_batch(spark, monkeypatch):
    from lodeseek.operators import retrieval

    x = np.random.default_rng(3).normal(size=(60, 4))
    monkeypatch.setattr(retrieval, "DISTANCES_AT_ONCE", 50)
    run = retrieval._nearest(x[:9], 3, 6)
    import pandas as pd

    out = pd.concat(run(iter([pd.DataFrame({"id": range(60), "embedding": list(x)})])))
    for i in range(9):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 6)
        assert list(out[out.asked == i].chunk_id) == sorted(range(60), key=lambda j: (d[j], j))[:3]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_evaluation_ranks_once(spark, monkeypatch):
    from lodeseek.plans import engine_queries as e

    calls = []
    for name in ("bm25_topk", "knn", "live_chunks"):
        monkeypatch.setattr(e, name, lambda *a, f=getattr(e, name), n=name, **k: calls.append(n) or f(*a, **k))
    e.eval_recall_mrr(spark, "/root/testdata/sf0.001")
    assert sorted(calls) == ["bm25_topk", "knn", "live_chunks"]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_rankings_are_written_before_they_are_fused(spark):
    from lodeseek.plans import engine_queries as e

    plan = e.search_hybrid(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" not in plan and "collect_list" not in plan
