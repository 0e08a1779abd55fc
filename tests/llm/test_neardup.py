import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from lodeseek.llm.neardup import SKETCH, _allowed, groups, similar_groups, similar_pairs, sketches

W = [f"w{i}" for i in range(400)]


def sets(text, k):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)


def brute(rows, k, similarity, min_words):
    out = set()
    s = [(g, i, *sets(t, k)) for g, i, t in {r for r in rows if r[2] is not None and r[1] is not None}]
    for a, b in combinations(s, 2):
        if a[0] == b[0] and a[1] != b[1] and min(a[3], b[3]) >= max(k, min_words) and len(a[2] & b[2]) >= similarity * len(a[2] | b[2]) - 1e-12:
            out.add((a[0] or "", *sorted((a[1], b[1]))))
    return out


def made(seed=1, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base = [r.choice(W) for _ in range(r.randint(30, 120))]
        rows.append(("g", f"d{i}", " ".join(base)))
        for j in range(r.randint(0, 4)):
            edit = base[:]
            for _ in range(r.randint(0, 12)):
                p = r.randrange(len(edit))
                edit[p : p + r.randint(0, 1)] = [r.choice(W)]
            rows.append((r.choice(["g", "h"]), f"d{i}_{j}", "\n".join(edit).upper() if j % 2 else " , ".join(edit)))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "grp string, id string, text string").withColumn("cls", F.lit(1)).withColumn("key", F.lit("x"))
    got = similar_pairs(df, id_col="id", text_col="text", group_col="grp", **kw).collect()
    pairs = [(r.grp, r.id_a, r.id_b) for r in got]
    assert len(pairs) == len(set(pairs)) and all(a < b for _, a, b in pairs)
    return set(pairs)


def test_equals_brute_force(spark):
    rows = made()
    want = brute(rows, 3, 0.6, 30)
    assert len(want) > 40
    assert run(spark, rows + rows[:20], k=3, similarity=0.6, min_words=30, coordinates=12, agree=2) == want
    # crowded buckets go by their rare shingles, with the same result
    assert run(spark, rows, k=3, similarity=0.6, min_words=30, coordinates=12, agree=2, bucket_limit=1) == want


def test_defaults(spark):
    rows = made(2)
    assert run(spark, rows) == brute(rows, 5, 0.8, 0)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [("g", "a", None), ("g", None, "b " * 40), ("g", "c", ""), ("g", "d", "one two"), ("g", "e", long), ("g", "f", long + " end"), ("g", "z", " ".join(W[:40])), ("g", "z", " ".join(W[:41])), ("g", "y", "\x00 " + " ".join(W[:40]))]
    assert run(spark, rows, k=3, similarity=0.6, min_words=30, coordinates=12, agree=2) == {("g", "e", "f"), ("g", "y", "z")}
    assert run(spark, rows[:1]) == set()


def test_hot_group_of_copies(spark):
    text, near = " ".join(W[:50]), " ".join(W[:51])
    rows = [("g", f"c{i:03}", text) for i in range(300)] + [("g", f"n{i}", near) for i in range(3)] + [("g", f"o{i}", " ".join(W[60 + i : 110 + i][::-1])) for i in range(0, 300, 60)]
    got = run(spark, rows, k=3, similarity=0.6, min_words=30, coordinates=12, agree=2, pair_limit=10)
    assert {("g", "c000", f"c{i:03}") for i in range(1, 300)} <= got and ("g", "n0", "n1") in got
    # both classes together exceed the limit: every member is linked with the other's smallest id
    assert {("g", f"c{i:03}", "n0") for i in range(300)} <= got and {("g", "c000", f"n{i}") for i in range(3)} <= got
    whole = run(spark, rows, k=3, similarity=0.6, min_words=30, coordinates=12, agree=2, pair_limit=400)
    assert len(whole) == 303 * 302 // 2


def hot():
    """A hot class of which some texts differ in case and layout, one linked with it, ids of several texts."""
    text, near = " ".join(W[:50]), " ".join(W[:51])
    rows = [("g", f"c{i:03}", text.upper() if i % 3 else text.replace(" ", "\n")) for i in range(120)] + [("g", "n0", near), ("g", "n1", near), ("h", "n1", text), ("h", "n2", near)]
    rows += [("g", "c007", near), ("g", "n1", text), ("g", "c009", " ".join(W[100:150])), ("g", "v0", " ".join(W[100:151])), ("g", "v0", " ".join(W[200:250])), ("g", "s", " ".join(W[300:350])), ("g", "s", " ".join(W[300:351]))]
    return rows


def test_no_pair_of_a_hot_class_is_cut(spark):
    rows = hot()
    want = brute(rows, 3, 0.6, 30)
    for limit in (7, 64):
        assert run(spark, rows, k=3, similarity=0.6, min_words=30, coordinates=12, agree=2, pair_limit=limit) == want


def test_groups_of_records_equal_those_of_their_pairs(spark):
    for rows in (hot(), made(3)):
        pairs = [(*p, 1.0) for p in brute(rows, 3, 0.6, 30)]
        want = groups(spark.createDataFrame(pairs, "grp string, id_a string, id_b string, similarity double")).collect()
        df = spark.createDataFrame(rows, "grp string, id string, text string")
        got = similar_groups(df, id_col="id", text_col="text", group_col="grp", k=3, similarity=0.6, min_words=30, coordinates=12, agree=2).collect()
        assert len(got) == len(want) > 0 and {(r.grp, r.id, r.root, r.links) for r in got} == {(r.grp, r.id, r.root, r.links) for r in want}


def test_groups(spark):
    pairs = [("g", f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(0, 30)] + [("g", "x1", "x2", 1.0), ("h", "n00", "n05", 1.0)]
    got = {(r.grp, r.id): (r.root, r.links) for r in groups(spark.createDataFrame(pairs, "grp string, id_a string, id_b string, similarity double")).collect()}
    assert all(got["g", f"n{i:02}"][0] == "n00" for i in range(31)) and got["g", "n05"][1] == 2 and got["g", "x2"] == ("x1", 1) and got["h", "n05"] == ("n00", 1)
    assert len(got) == 35
    assert groups(spark.createDataFrame([], "grp string, id_a string, id_b string, similarity double")).count() == 0


def test_sketches_never_rule_out_a_pair(spark):
    r = random.Random(4)
    sets_ = [np.unique(np.array([r.getrandbits(64) for _ in range(r.choice([1, 5, 80, 2000]))], dtype=np.uint64)) for _ in range(40)]
    sets_ += [np.unique(np.concatenate([x[: int(len(x) * 0.9)], sets_[0][:1]])) for x in sets_[:40]]
    marks = sketches(sets_).view(np.int64)
    rows = [(i, len(x), *[int(v) for v in m]) for i, (x, m) in enumerate(zip(sets_, marks))]
    cols = [f"s{i}" for i in range(SKETCH)]
    df = spark.createDataFrame(rows, "i int, n int, " + ", ".join(f"{c} long" for c in cols))
    a, b = (df.select(F.col("i").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{x}{c}") for c in cols]) for x in "ab")
    for similarity in (0.6, 0.8):
        ruled_out = {(x.a, x.b) for x in a.join(b, F.col("a") < F.col("b")).filter(~_allowed(similarity)).select("a", "b").collect()}
        near = {(i, j) for i, j in combinations(range(len(sets_)), 2) if len(np.intersect1d(sets_[i], sets_[j])) >= similarity * len(np.union1d(sets_[i], sets_[j]))}
        assert len(near) > 10 and not near & ruled_out and len(ruled_out) > 1000
