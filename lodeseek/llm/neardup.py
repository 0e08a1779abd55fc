"""Near-duplicate records with small edits.

Texts are compared by the Jaccard similarity of their sets of word runs (shingles). Records whose
words are the same form a class; everything after that works on one representative per class.

Candidates come from meet-in-the-middle ball hashing. The fingerprint of a class is a set of
``coordinates`` elements, its min-wise hashes under as many hash functions, each tagged with its
function. Distance is the size of the symmetric difference, so two fingerprints that agree in
``agree`` coordinates lie within the radius ``2 * (coordinates - agree)``. Every fingerprint emits
all variants within half that radius, i.e. all its subsets of ``agree`` elements; two fingerprints
within the radius meet in the variant in the middle, what they have in common. Variants are
shuffled, colliding pairs deduplicated and verified on the whole shingle sets. Since the elements are
min-hashes, this finds what banded min-hashing with one band for each subset would find. A pair of
similarity s is missed with probability P(Binomial(coordinates, s) < agree): 7.8e-5 for 10 and 3 at
0.8, the defaults; for 12 and 2 it is 3.2e-4 at 0.6 and 1e-10 at 0.9.

Two steps keep the work near what is found, and lose nothing. An element that only one class has goes
into no variant. And a colliding pair is verified on the sets only if the ``SKETCH`` bits onto which
each set is thrown allow the similarity: a bit of one that the other lacks is an element it lacks. The
sets are made anew for the classes of those pairs, so that they need not be kept for all texts.

A variant that more than ``bucket_limit`` classes share is not paired up. Its classes go another,
exact way instead: two sets of similarity t share one of the |x| - ceil(t |x|) + 1 rarest shingles
of x with those of y, so these prefixes are joined, with the rarity counted among all such classes.

Defined results: null texts and texts of fewer than ``min_words`` words make no pair; a repeated row
counts once; ties don't arise (the smaller id, as text, comes first); an id with several texts is
compared on each and never with itself; other columns are ignored. All pairs of copies and all pairs
of members of two linked classes are listed. The members of a class are cut into parts of about
``pair_limit``, and what meets is a part and a part, so that a hot class is no one task's work. Groups
and their numbers of links need no pairs of records: they come from the classes and the links between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.sources.durable import written
from lodeseek.sources.tables import spread

WORDS, SIMILARITY = 5, 0.8
COORDINATES, AGREE = 10, 3
BUCKET_LIMIT = 256
PAIR_LIMIT = 64
#: 64-bit words of a set's sketch.
SKETCH = 8

_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1 << 17)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of k word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = _mix((h ^ words[i : i + n]) * _MULTIPLIER)
    return np.unique(h)


def min_hashes(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of min-wise hashes for each of the (non-empty) sets."""
    every = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), coordinates), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in range(coordinates):
            out[:, c] = np.minimum.reduceat(_mix(every ^ _mix(np.full(1, c + 1, dtype=np.uint64) * _MULTIPLIER)), starts)
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``SKETCH`` words for each of the sets: the bits that its elements fall on."""
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(sets), SKETCH), dtype=np.uint64)
    np.bitwise_or.at(out, (row, (every >> np.uint64(6)) % np.uint64(SKETCH)), np.uint64(1) << (every & np.uint64(63)))
    return out


def _class_and_set(text: str, k: int, min_words: int) -> tuple[bytes, np.ndarray] | None:
    words = _WORD.findall(text.lower())
    if len(words) < max(min_words, k):
        return None
    hashes = np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")), shingles(hashes, k)


def _columns(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def _features(k: int, min_words: int, coordinates: int):
    names = _columns("m", coordinates) + _columns("s", SKETCH)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_class_and_set(text, k, min_words) for text in pdf["text"]]
            keep = [i for i, x in enumerate(got) if x is not None]
            if keep:
                sets = [got[i][1] for i in keep]
                part = pdf.iloc[keep]
                marks = np.hstack([min_hashes(sets, coordinates), sketches(sets)]).view(np.int64)
                yield pd.DataFrame({"grp": part["grp"].to_numpy(), "id": part["id"].to_numpy(), "cls": [got[i][0] for i in keep], "n": [len(s) for s in sets], **{c: marks[:, i] for i, c in enumerate(names)}})

    return run


def _set_rows(k: int, min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(c, *x) for c, text in zip(pdf["c"], pdf["text"]) if (x := _class_and_set(text, k, min_words))]
            yield pd.DataFrame({"c": [x[0] for x in got], "cls": [x[1] for x in got], "sh": [x[2].view(np.int64) for x in got]})

    return run


def _common_elements(classes: DataFrame, coordinates: int, agree: int) -> DataFrame:
    """Rows ``(c, n, m0, m1, ...)``: the fingerprint of every class, without the elements that no other class of
    its group has. Two fingerprints can only meet in what both have, so nothing else needs to go into a variant."""
    marks = F.array(*_columns("m", coordinates))
    elements = classes.select("c", "n", "grp", F.posexplode(marks).alias("j", "h")).select("c", "n", "j", F.xxhash64("grp", "j", "h").alias("m"))
    common = written(elements.groupBy("m").agg(F.count("*").alias("k")).filter("k > 1").select("m"), "common")
    left = elements.join(common, "m").groupBy("c", "n").agg(*[F.max(F.when(F.col("j") == j, F.col("m"))).alias(f"m{j}") for j in range(coordinates)])
    enough = sum((F.col(m).isNotNull().cast("int") for m in _columns("m", coordinates)), F.lit(0)) >= agree
    return written(left.filter(enough), "elements")


def _variants(coordinates: int, agree: int):
    """All subsets of ``agree`` elements of a fingerprint, as one array of 64-bit keys."""
    keys = []
    for j, subset in enumerate(combinations(range(coordinates), agree)):
        there = reduce(lambda x, y: x & y, [F.col(f"m{i}").isNotNull() for i in subset])
        keys.append(F.when(there, F.xxhash64(F.lit(j), *[F.col(f"m{i}") for i in subset])))
    return F.filter(F.array(*keys), lambda x: x.isNotNull())


def _close(a, b, similarity: float):
    """Sizes that allow the similarity."""
    return (F.least(a, b) + 1e-9 >= similarity * F.greatest(a, b))


def fingerprints(rows: DataFrame, *, k: int, min_words: int, coordinates: int) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)`` of rows ``(grp, id, text)``, both written tables. Within, a class goes by the 64 bits
    ``c``; if two shared them, the check of their sets would still tell them apart."""
    names = _columns("m", coordinates) + _columns("s", SKETCH)
    schema = "grp string, id string, cls binary, n int, " + ", ".join(f"{c} long" for c in names)
    feats = written(spread(rows, "id").mapInPandas(_features(k, min_words, coordinates), schema), "features")
    members = feats.select("grp", "cls", "id").distinct()
    classes = feats.groupBy("grp", "cls").agg(*[F.first(c).alias(c) for c in ["n", *names]]).withColumn("c", F.xxhash64("grp", "cls"))
    return members, written(classes, "classes")


def _sets(rows: DataFrame, members: DataFrame, wanted: DataFrame, k: int, min_words: int) -> DataFrame:
    """Rows ``(c, cls, sh)``: the shingle sets of the classes ``wanted (c)``, from the text of one member each."""
    of = members.withColumn("c", F.xxhash64("grp", "cls")).join(wanted, "c", "left_semi")
    first = of.groupBy("c", "grp").agg(F.min(F.struct("id", "cls")).alias("f")).select("c", "grp", "f.id", F.col("f.cls").alias("own"))
    made = rows.join(first, ["grp", "id"]).select("c", "own", "text").mapInPandas(_set_rows(k, min_words), "c long, cls binary, sh array<long>")
    # an id may have other texts as well
    return made.join(first.select("c", F.col("own").alias("cls")), ["c", "cls"], "left_semi").dropDuplicates(["c", "cls"])


def _allowed(similarity: float) -> Column:
    """Whether two sketches leave room for the similarity: what falls on a bit the other lacks is not shared."""
    lacks = [sum((F.bit_count(F.col(f"{x}s{i}").bitwiseAND(F.bitwise_not(f"{y}s{i}"))) for i in range(SKETCH)), F.lit(0)) for x, y in ("ab", "ba")]
    most = F.least(F.col("na") - lacks[0], F.col("nb") - lacks[1])
    return most + 1e-9 >= similarity * (F.col("na") + F.col("nb") - most)


def _rare_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of sets that share one of the rare elements which two similar sets must share."""
    elements = sets.select("c", F.size("sh").alias("n"), F.explode("sh").alias("s"))
    rarity = elements.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = elements.join(rarity, "s", "left").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("order"))
    length = (F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9) + 1).cast("int")
    prefix = written(ranked.select("c", "n", F.explode(F.slice("order", F.lit(1), length)).alias("p")).filter("p.df > 1").select("c", "n", F.col("p.s").alias("s")), "prefixes")
    x = prefix.select("s", F.col("c").alias("a"), F.col("n").alias("na"))
    y = prefix.select("s", F.col("c").alias("b"), F.col("n").alias("nb"))
    return x.join(y, "s").filter((F.col("a") < F.col("b")) & _close(F.col("na"), F.col("nb"), similarity)).select("a", "b")


def similar_classes(rows: DataFrame, members: DataFrame, classes: DataFrame, *, k: int, min_words: int, similarity: float = SIMILARITY, coordinates: int = COORDINATES, agree: int = AGREE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Rows ``(grp, a, b, similarity)``: pairs of classes of one group, each pair once, verified on the whole sets."""
    keys = _common_elements(classes, coordinates, agree).select("c", "n", F.explode(_variants(coordinates, agree)).alias("key"))
    # what few share is paired in its bucket; a bucket beyond the limit is only counted
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = keys.join(sizes, "key")
    small = shared.filter(F.col("size") <= bucket_limit)
    a = small.select("key", F.col("c").alias("a"), F.col("n").alias("na"))
    b = small.select("key", F.col("c").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & _close(F.col("na"), F.col("nb"), similarity)).select("a", "b")
    # the others meet by the rare shingles that two similar sets must share
    crowded = written(shared.filter(F.col("size") > bucket_limit).select("c").distinct(), "crowded")
    if not crowded.isEmpty():
        # a shingle of another group is another shingle
        grp = classes.select("c", "grp")
        hot = _sets(rows, members, crowded, k, min_words).join(grp, "c").select("c", F.transform("sh", lambda x: F.xxhash64("grp", x)).alias("sh"))
        pairs = pairs.unionByName(_rare_pairs(hot, similarity))
    marks = {x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("grp").alias(f"g{x}"), *[F.col(s).alias(f"{x}{s}") for s in _columns("s", SKETCH)]) for x in "ab"}
    likely = pairs.distinct().join(marks["a"], "a").join(marks["b"], "b").filter((F.col("ga") == F.col("gb")) & _allowed(similarity))
    near = written(likely.select("a", "b", F.col("ga").alias("grp"), "na", "nb"), "near")
    wanted = near.select(F.col("a").alias("c")).unionByName(near.select(F.col("b").alias("c"))).distinct()
    sets = written(_sets(rows, members, wanted, k, min_words), "sets")
    both = near.join(sets.select(F.col("c").alias("a"), F.col("cls").alias("ca"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("cls").alias("cb"), F.col("sh").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    checked = both.select("grp", F.col("ca").alias("a"), F.col("cb").alias("b"), (common / (F.col("na") + F.col("nb") - common)).alias("similarity"))
    return checked.filter(F.col("similarity") >= similarity)


def _linked(df: DataFrame, id_col: str, text_col: str, group_col: str | None, k: int, similarity: float, min_words: int, coordinates: int, agree: int, bucket_limit: int) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: the records of each class and the pairs of classes that are similar."""
    if not 0 < agree <= coordinates or not 0 < similarity <= 1 or k < 1:
        raise ValueError("needs 0 < agree <= coordinates, 0 < similarity <= 1 and k >= 1")
    group = F.col(group_col).cast("string") if group_col else F.lit("")
    rows = df.select(group.alias("grp"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).dropna()
    members, classes = fingerprints(rows, k=k, min_words=min_words, coordinates=coordinates)
    return members, similar_classes(rows, members, classes, k=k, min_words=min_words, similarity=similarity, coordinates=coordinates, agree=agree, bucket_limit=bucket_limit)


def similar_pairs(
    df: DataFrame,
    *,
    id_col: str,
    text_col: str,
    group_col: str | None = None,
    k: int = WORDS,
    similarity: float = SIMILARITY,
    min_words: int = 0,
    coordinates: int = COORDINATES,
    agree: int = AGREE,
    bucket_limit: int = BUCKET_LIMIT,
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """Distinct rows ``(grp, id_a, id_b, similarity)`` of similar records, within ``group_col`` where one is given."""
    members, links = _linked(df, id_col, text_col, group_col, k, similarity, min_words, coordinates, agree, bucket_limit)
    return expand(members, links, pair_limit)


def similar_groups(
    df: DataFrame,
    *,
    id_col: str,
    text_col: str,
    group_col: str | None = None,
    k: int = WORDS,
    similarity: float = SIMILARITY,
    min_words: int = 0,
    coordinates: int = COORDINATES,
    agree: int = AGREE,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """``groups`` of ``similar_pairs``, without listing the pairs."""
    members, links = _linked(df, id_col, text_col, group_col, k, similarity, min_words, coordinates, agree, bucket_limit)
    links = written(links.select("grp", "a", "b"), "links")
    firsts = members.groupBy("grp", "cls").agg(F.min("id").alias("first"))
    # pairs that connect whatever all pairs connect: a class with its smallest id, linked classes by theirs
    star = members.join(firsts, ["grp", "cls"]).select("grp", F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    across = links.join(firsts.select("grp", F.col("cls").alias("a"), F.col("first").alias("x")), ["grp", "a"]).join(firsts.select("grp", F.col("cls").alias("b"), F.col("first").alias("y")), ["grp", "b"])
    edges = star.unionByName(across.select("grp", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))).filter("id_a <> id_b")
    return groups(edges, degree=_degrees(members, links))


def _degrees(members: DataFrame, links: DataFrame) -> DataFrame:
    """Rows ``(grp, u, links)``: the number of ids that share a class or a link with id ``u``."""
    of = members.join(members.groupBy("grp", "id").agg(F.count("*").alias("texts")), ["grp", "id"])
    # ids of one text count alike in each class; those of several are counted by name
    owned = written(of.withColumn("owner", F.when(F.col("texts") == 1, F.concat(F.lit("c"), F.hex("cls"))).otherwise(F.concat(F.lit("i"), F.col("id")))), "owners")
    near = links.select("grp", F.col("a").alias("cls"), F.col("b").alias("d")).unionByName(links.select("grp", F.col("b").alias("cls"), F.col("a").alias("d")))
    near = near.unionByName(members.select("grp", "cls", F.col("cls").alias("d")).distinct())
    reach = owned.select("grp", "owner", "cls").distinct().join(near, ["grp", "cls"]).select("grp", "owner", "d").distinct()
    single = owned.filter("texts = 1").groupBy("grp", F.col("cls").alias("d")).agg(F.count("*").alias("links"))
    named = reach.join(owned.filter("texts > 1").select("grp", F.col("cls").alias("d"), "id"), ["grp", "d"]).select("grp", "owner", "id").distinct()
    counts = reach.join(single, ["grp", "d"]).select("grp", "owner", "links").unionByName(named.select("grp", "owner", F.lit(1).cast("long").alias("links")))
    total = counts.groupBy("grp", "owner").agg((F.sum("links") - 1).alias("links")).filter("links > 0")
    return owned.select("grp", "owner", F.col("id").alias("u")).distinct().join(total, ["grp", "owner"]).select("grp", "u", "links")


def expand(members: DataFrame, links: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links between classes and membership as pairs of records."""
    if pair_limit < 1:
        raise ValueError("needs pair_limit >= 1")
    sizes = members.groupBy("grp", "cls").agg(F.count("*").alias("m")).select("grp", "cls", "m", F.ceil(F.col("m") / pair_limit).cast("int").alias("parts"))
    members = written(members.join(sizes, ["grp", "cls"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "members")
    several = members.filter("m > 1")
    low = several.select("grp", "cls", F.col("part").alias("p"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("q"), F.col("id").alias("x"))
    high = several.select("grp", "cls", F.explode(F.sequence(F.lit(0), "part")).alias("p"), F.col("part").alias("q"), F.col("id").alias("y"))
    same = low.join(high, ["grp", "cls", "p", "q"]).filter("p < q or x < y").withColumn("similarity", F.lit(1.0))
    parts = members.select("grp", "cls", "parts").distinct()
    met = (
        links.join(parts.select("grp", F.col("cls").alias("a"), F.col("parts").alias("pa")), ["grp", "a"])
        .join(parts.select("grp", F.col("cls").alias("b"), F.col("parts").alias("pb")), ["grp", "b"])
        .select("grp", "a", "b", "similarity", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)).alias("p"), "pb")
        .select("grp", "a", "b", "similarity", "p", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("q"))
    )
    near = met.join(members.select("grp", F.col("cls").alias("a"), F.col("part").alias("p"), F.col("id").alias("x")), ["grp", "a", "p"]).join(
        members.select("grp", F.col("cls").alias("b"), F.col("part").alias("q"), F.col("id").alias("y")), ["grp", "b", "q"]
    )
    every = same.select("grp", "x", "y", "similarity").unionByName(near.filter("x <> y").select("grp", "x", "y", "similarity"))
    return every.groupBy("grp", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def groups(pairs: DataFrame, *, degree: DataFrame | None = None) -> DataFrame:
    """Rows ``(grp, id, root, links)``: connected components of the pairs, named by their smallest id.

    Links are counted in the pairs unless ``degree`` gives them as rows ``(grp, u, links)``.
    Alternating large-star and small-star rounds, each a groupBy of the links, until nothing changes.
    """
    edges = written(pairs.select("grp", F.col("id_b").alias("u"), F.col("id_a").alias("v")).distinct(), "edges")
    if degree is None:
        degree = edges.select("grp", "u").unionByName(edges.select("grp", F.col("v").alias("u"))).groupBy("grp", "u").agg(F.count("*").alias("links"))
    state = edges
    while True:
        both = state.unionByName(state.select("grp", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("grp", "u").agg(F.min("v").alias("lv")).select("grp", "u", F.least("u", "lv").alias("m"))
        large = both.join(least, ["grp", "u"]).filter("v > u").select("grp", F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select("grp", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("grp", "u").agg(F.min("v").alias("m"))
        small = down.join(low, ["grp", "u"]).select("grp", F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        new = written(small.select("grp", F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "stars")
        same = new.count() == state.count() and new.exceptAll(state).isEmpty()
        state = new
        if same:
            break
    roots = state.select("grp", F.col("u").alias("id"), F.col("v").alias("root"))
    tops = roots.select("grp", F.col("root").alias("id"), "root").distinct()
    return roots.unionByName(tops).join(degree.withColumnRenamed("u", "id"), ["grp", "id"])


__all__ = ["expand", "fingerprints", "groups", "min_hashes", "shingles", "similar_classes", "similar_groups", "similar_pairs", "sketches"]
