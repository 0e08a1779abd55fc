import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseek.llm.packing import best_fit, fill, kept_apart, pack, packing_orders, placed, tokenizer
from lodeseek.llm.queries_packing import TOKENIZER

ITEM = st.tuples(st.integers(0, 100), st.sampled_from([None, "s", "t", "u"]), st.sampled_from([1, 1, 1, 2, 3, 4, 5, 6, 7, 8]))


def check(items, bins, capacity=100):
    held = defaultdict(list)
    for i, b in enumerate(bins):
        held[b].append(i)
    for at in held.values():
        assert sum(items[i][0] for i in at) <= capacity
        assert len({items[i][2] for i in at}) == len(at)
    return len(held)


def replay(items, bins, order, capacity=100):
    """Every item, in the order of packing, is in the tightest bin it has no conflict with, and in a new one only if there is none."""
    apart = kept_apart([x[0] for x in items], [x[1] for x in items], capacity)
    held = {}
    for i in order:
        size, source, cluster = items[i]
        free = {b: capacity - sum(items[j][0] for j in at) for b, at in held.items() if not any(items[j][2] == cluster or (source in apart and items[j][1] == source) for j in at)}
        fits = [f for f in free.values() if f >= size]
        if bins[i] in held:
            assert free[bins[i]] == min(fits)
        else:
            assert not fits
        held.setdefault(bins[i], []).append(i)
    for at in held.values():
        for s in apart:
            assert sum(items[i][1] == s for i in at) <= 1


@settings(max_examples=300, deadline=None)
@given(st.lists(ITEM, max_size=80))
def test_bins(items):
    bins = best_fit([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], 100)
    tried = [len(set(bins))]
    for order in packing_orders([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], 100):
        in_order = placed([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], order, 100)
        tried.append(check(items, in_order))
        replay(items, in_order, order)
    assert check(items, bins) == min(tried)


def test_sources_are_kept_apart():
    items = [(60, "s", 1), (60, "t", 2), (40, "s", 3), (40, "t", 4)]
    assert best_fit(*[list(x) for x in zip(*items)], 100) == [0, 1, 1, 0]
    # two texts of a source in conflict open a bin; a source of more texts than bins does not count
    assert best_fit([50, 30, 20], ["s", "s", "t"], [1, 2, 3], 100) == [0, 0, 0]
    assert best_fit([90, 50, 40, 5], ["t", "s", "s", "u"], [1, 2, 3, 4], 100) == [0, 1, 2, 0]


def test_hot_cluster_and_source():
    items = [(70, "hot", 1)] * 2000 + [(30, f"s{i % 7}", 2 + i) for i in range(2000)] + [(20, "hot", 5000 + i) for i in range(500)]
    n = check(items, best_fit(*[list(x) for x in zip(*items)], 100))
    assert n == 2100


def test_sources_cost_little_space():
    r = random.Random(3)
    items = [(min(100, int(r.expovariate(1 / 18)) + 1), f"s{min(int(r.paretovariate(0.8)), 60)}", i) for i in range(3000)]
    need = -(-sum(x[0] for x in items) // 100)
    assert need <= check(items, best_fit(*[list(x) for x in zip(*items)], 100)) <= 1.03 * need


def test_pack(spark):
    enc = tokenizer(TOKENIZER)
    texts = ["", "", None, "hello world", "Hello  World", "word " * 5000, "é😀\x00" * 50] + [f"text {i} " * (i % 90 + 1) for i in range(400)]
    rows = [(i, t, None if i % 5 == 0 else "hot" if i % 3 == 0 else f"s{i % 4}", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[10:30], "doc_id long, text string, source string, piece int")
    for per_task in (20_000, 50):
        got = pack(df, items_per_task=per_task, tokenizer_file=TOKENIZER).collect()
        held, parts = defaultdict(list), defaultdict(list)
        for r in got:
            held[r.container].append(r)
            parts[r.id].append(r)
        assert set(parts) == {i for i, t in enumerate(texts) if t is not None}
        for i, ps in parts.items():
            n = len(enc.encode_ordinary(texts[i]))
            assert sum(p.tokens for p in ps) == n and len(ps) == max(1, -(-n // 2048)) and sorted(p.piece for p in ps) == list(range(len(ps)))
        assert all(sum(r.tokens for r in rs) <= 2048 for rs in held.values())
        for a, b in ((0, 1), (3, 4)):
            assert parts[a][0].container != parts[b][0].container
    total = sum(r.tokens for r in got)
    full = pack(df, tokenizer_file=TOKENIZER)
    assert full.select("container").distinct().count() <= total // 2048 + 2
    assert fill(full).filter((F.col("free") < 0) | (F.col("texts") == 0)).count() == 0
    assert pack(df.limit(0), tokenizer_file=TOKENIZER).count() == 0
    assert pack(df, cluster_col="source", source_col=None, tokenizer_file=TOKENIZER).count() == len(got)
