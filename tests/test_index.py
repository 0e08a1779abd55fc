import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodeseek.functions.hashing import FeatureHash
from lodeseek.operators.delta import changes, latest, remove, upsert
from lodeseek.operators.retrieval import bm25_topk
from lodeseek.plans.search import Corpus, Knobs, resolve_weights, search
from lodeseek.sources.durable import clear, shared_folder, written
from lodeseek.sources import files as fs
from lodeseek.sources import store as store_module
from lodeseek.sources.repo import ignored, read_records, read_rules, walk
from lodeseek.sources.store import Registry, Store, StoreError, corpus_counts, migrate, open_or_build, reindex


def put(root, files):
    for name, content in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())


TREE = {
    "src/a.py": "import os\n\n\ndef read_config(path):\n    return open(path).read()\n",
    "src/b.rs": "use std::fs;\n\npub fn write_config(path: &str) -> bool {\n    fs::write(path, \"x\").is_ok()\n}\n",
    "notes.txt": "configuration is read from a file\n",
    "big.txt": "x" * (1 << 20) + "y",
    "long.txt": "z" * 5000,
    "latin.txt": b"caf\xe9",
    "nul.txt": b"a\0b",
    "target/out.py": "def no(): pass\n",
    ".hidden/x.py": "def no(): pass\n",
    ".gitignore": "target/\n*.log\n!keep.log\n/root_only.txt\n",
    "a.log": "no",
    "keep.log": "yes",
    "sub/root_only.txt": "yes",
    "root_only.txt": "no",
    ".lodeseek/index.txt": "no",
}


def test_walk(spark, tmp_path):
    put(tmp_path, TREE)
    got = {r.rel_path: r for r in walk(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["keep.log", "notes.txt", "nul.txt", "src/a.py", "src/b.rs", "sub/root_only.txt"]
    assert got["src/a.py"].language == "python" and got["notes.txt"].language is None and got["nul.txt"].content == "a\0b"


def test_ignore_rules():
    rules = [("", ["*.o", "!keep.o", "build/", "/top", "a/**/z", "doc/*.md"]), ("sub", ["local"])]
    assert ignored("x/y.o", rules) and not ignored("x/keep.o", rules)
    assert ignored("build/x", rules) and ignored("x/build/y/z", rules) and not ignored("build", rules)
    assert ignored("top", rules) and not ignored("x/top", rules)
    assert ignored("a/b/c/z", rules) and ignored("doc/a.md", rules) and not ignored("doc/x/a.md", rules)
    assert ignored("sub/local/f", rules) and not ignored("local", rules) and ignored("a/.b/c", rules)


def test_rules_from_above_and_of_the_user(tmp_path, monkeypatch):
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    put(tmp_path, {"up/.gitignore": "/tree/top.txt\nsub/deep\n*.tmp\n", "up/tree/.gitignore": "build/\n", "up/tree/build/.gitignore": "!kept\n", "up/tree/a/.ignore": "b\n", "home/.gitconfig": "[user]\n  excludesfile = no\n[core]\n\texcludesFile = ~/mine\n", "home/mine": "*.bak\n"})
    rules = read_rules(str(tmp_path / "up" / "tree"), str(tmp_path / "home"))
    hit = {p for p in ("top.txt", "x/top.txt", "sub/deep", "x.tmp", "a/b", "b", "y.bak", "build/kept", "ok.txt") if ignored(p, rules)}
    assert hit == {"top.txt", "x.tmp", "a/b", "y.bak", "build/kept"}
    assert not any(r[0] == "build" for r in rules)
    os.remove(tmp_path / "home" / ".gitconfig")
    put(tmp_path, {"home/.config/git/ignore": "*.swp\n"})
    assert ignored("x.swp", read_rules(str(tmp_path / "up" / "tree"), str(tmp_path / "home")))


def test_records(spark, tmp_path):
    lines = [json.dumps({"docstring": "d1", "code": "c1"}), "", "{broken", json.dumps({"docstring": "", "code": "c2"}), json.dumps({"docstring": "d3", "code": "c3"})]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    good, bad = read_records(spark, str(tmp_path / "r.jsonl"))
    assert [r.code for r in good.orderBy("ord").collect()] == ["c1", "c3"] and bad.count() == 1
    assert [r.code for r in read_records(spark, str(tmp_path / "r.jsonl"), take=1)[0].collect()] == ["c1"]


def test_reindex_and_search(spark, tmp_path):
    root, e = tmp_path / "repo", FeatureHash()
    put(root, TREE)
    store = Store(spark, str(tmp_path / "index"))
    with pytest.raises(StoreError):
        store.version()
    files = lambda: walk(spark, str(root))
    first = reindex(store, files(), e)
    assert first["files_indexed"] == 6 and not first["incremental"]
    again = reindex(store, files(), e)
    assert again["files_indexed"] == 0 and again["incremental"]
    v = store.version()
    put(root, {"src/a.py": "def parse_yaml(text):\n    return text\n", "src/new.go": "package p\n\nfunc ReadAll() {\n}\n"})
    os.remove(root / "notes.txt")
    delta = reindex(store, files(), e)
    assert delta["files_indexed"] == 2 and store.version() != v
    rows = lambda t, *c: sorted(map(tuple, store.table(t).select(*c).collect()))
    whole = Store(spark, str(tmp_path / "whole"))
    reindex(whole, files(), e)
    for t, cols in (("chunks", ("id", "body")), ("postings", ("term", "chunk_id", "tf")), ("symbols", ("chunk_id", "name")), ("imports", ("file_path", "source")), ("files", ("path", "content_hash")), ("counts", ("n", "total"))):
        assert rows(t, *cols) == sorted(map(tuple, whole.table(t).select(*cols).collect())), t
    assert store.table("vectors").count() == store.table("chunks").count()

    q = spark.createDataFrame([(1, "write config"), (2, "ReadAll")], "query_id long, query string")
    for knobs in (Knobs(), Knobs(adaptive=True, diversify=True, boost_imports=True, drop_tokenless=True)):
        hits = search(q, Corpus.of(store, e), e, knobs).collect()
        top = {r.query_id: r for r in hits if r["rank"] == 1}
        assert top[2].file_path == "src/new.go" and top[2].signature == "ReadAll()"
        assert any(r.query_id == 1 and r.file_path == "src/b.rs" for r in hits)
    with pytest.raises(StoreError):
        store.verify(FeatureHash("md5"))
    with pytest.raises(StoreError):
        Corpus.of(store, FeatureHash("md5"))
    fs.replace_text(spark, f"{store.path}/{store.version()}/manifest.json", json.dumps({"schema_version": 99}))
    with pytest.raises(StoreError, match="reindex"):
        store.verify(e)


def test_weights_precedence(spark):
    q = spark.createDataFrame([(1, "snake_case"), (2, "two words")], "query_id long, query string")
    w = lambda **k: {r.query_id: (r.w_lexical, r.w_vector) for r in resolve_weights(q, Knobs(**k)).collect()}
    assert w() == {1: (1.0, 1.0), 2: (1.0, 1.0)}
    assert w(adaptive=True) == {1: (2.0, 1.0), 2: (1.0, 2.0)}
    assert w(adaptive=True, bm25_weight=0.25, vector_weight=0.75) == {1: (0.25, 0.75), 2: (0.25, 0.75)}
    assert w(adaptive=True, bm25_weight=-3.0)[2] == (0.0, 2.0)


def test_registry(tmp_path):
    r = Registry(str(tmp_path / "x" / "registry.json"))
    assert r.load() == {}
    (tmp_path / "i1").mkdir()
    r.register(str(tmp_path / "b"), str(tmp_path / "i1"))
    r.register(str(tmp_path / "a"), str(tmp_path / "gone"))
    assert list(r.load().values()) == [str(tmp_path / "i1")] and r.get(str(tmp_path / "b")) == str(tmp_path / "i1")
    r.remove(str(tmp_path / "b"))
    assert r.load() == {}
    (tmp_path / "x" / "registry.json").write_text(" \n")
    assert r.load() == {}


def test_changes(spark):
    schema = "repo_id string, path string, content_hash string"
    now = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", None), ("s", "a", "9")], schema)
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1"), ("r", "d", "4"), ("r", "c", None)], schema)
    got = {(r.repo_id, r.path): r.change for r in changes(now, old).collect()}
    assert got == {("r", "a"): "same", ("r", "b"): "changed", ("r", "c"): "same", ("r", "d"): "deleted", ("s", "a"): "new"}
    assert {(r.path, r.content_hash) for r in upsert(old, now).filter("repo_id = 'r'").collect()} == {("a", "1"), ("b", "2"), ("c", None), ("d", "4")}
    assert remove(old, spark.createDataFrame([("a",), ("a",)], "path string"), "path").count() == 3
    assert {r.v for r in latest(spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, t int, v string"), ["k"], F.col("t").desc()).collect()} == {"y", "z"}


def test_written_tables_can_be_cleared(spark):
    path = written(spark.range(3), "gone").inputFiles()[0]
    assert clear(spark) > 0 and clear(spark) == 0 and not os.path.exists(path.removeprefix("file://"))


def test_written_tables(spark):
    df = spark.createDataFrame([(1, None), (2, [1, 2])], "a int, b array<int>")
    w = written(df, "t")
    assert w.schema == df.schema and sorted(map(str, w.collect())) == sorted(map(str, df.collect()))
    assert shared_folder(spark) in w.inputFiles()[0] or "lodeseek-" in w.inputFiles()[0]


def test_words_behind_the_first_bytes_are_indexed(spark, tmp_path):
    put(tmp_path / "tree", {"a.py": "def long_one():\n" + "".join(f"    value_{i:04} = {i}\n" for i in range(600)) + "    return zebrafish\n"})
    tree = walk(spark, str(tmp_path / "tree"))
    for most, there in ((None, True), (8192, False)):
        store = Store(spark, str(tmp_path / f"index-{most}"))
        reindex(store, tree, FeatureHash(), most_bytes=most)
        assert store.table("chunks").filter(F.octet_length("body") > 8192).count() > 0
        assert (store.table("postings").filter("term = 'zebrafish'").count() > 0) == there


FILE = "repo_id string, rel_path string, content string, language string, mtime long"


def listing(store, name, *cols):
    return sorted(map(tuple, store.table(name).select(*cols).collect()))


def test_two_trees_with_equal_paths(spark, tmp_path):
    e, store = FeatureHash("md5"), Store(spark, str(tmp_path / "index"))
    a = spark.createDataFrame([("A", "x.py", "def apple():\n    return 1\n", "python", 1), ("A", "y.py", "def pear():\n    return 1\n", "python", 1), ("A", "n.txt", "an apple", None, 1)], FILE)
    b = spark.createDataFrame([("B", "x.py", "def plum():\n    return 2\n", "python", 1), ("B", "z.py", "def cherry():\n    return 2\n", "python", 1)], FILE)
    reindex(store, a, e, buckets=8)
    assert reindex(store, b, e)["files_indexed"] == 2
    assert listing(store, "files", "repo_id", "path") == [("A", "n.txt"), ("A", "x.py"), ("A", "y.py"), ("B", "x.py"), ("B", "z.py")]
    assert listing(store, "symbols", "repo_id", "chunk_id", "name") == [("A", "x.py:1-2", "apple"), ("A", "y.py:1-2", "pear"), ("B", "x.py:1-2", "plum"), ("B", "z.py:1-2", "cherry")]
    # a file that is gone from one is not gone from the other, and neither is a repository that is not named
    reindex(store, b.filter("rel_path = 'z.py'"), e)
    assert listing(store, "files", "repo_id", "path") == [("A", "n.txt"), ("A", "x.py"), ("A", "y.py"), ("B", "z.py")]
    reindex(store, b.limit(0), e, repos=["B"])
    assert listing(store, "chunks", "repo_id", "id") == [("A", "n.txt:1-1"), ("A", "x.py:1-2"), ("A", "y.py:1-2")]
    reindex(store, b, e)
    whole = Store(spark, str(tmp_path / "whole"))
    reindex(whole, a.unionByName(b).unionByName(a), e, buckets=3)
    for name, cols in (("chunks", ("repo_id", "id", "body")), ("postings", ("repo_id", "chunk_id", "term", "tf", "dl")), ("vectors", ("repo_id", "id", "embedding"))):
        assert listing(store, name, *cols) == listing(whole, name, *cols), name
    assert corpus_counts(store).first()[:2] == corpus_counts(whole).first()[:2] == (5, whole.table("counts").groupBy().sum("total").first()[0])
    q = spark.createDataFrame([(1, "plum"), (2, "apple")], "query_id long, query string")
    hits = search(q, Corpus.of(store, e), e, Knobs(drop_tokenless=True)).filter("rank = 1").collect()
    assert {(r.query_id, r.file_path) for r in hits} == {(1, "B/x.py"), (2, "A/n.txt")}
    own = search(q, Corpus.of(store, e, "B"), e, Knobs(drop_tokenless=True)).collect()
    assert {r.file_path for r in own} == {"x.py", "z.py"}


def test_one_edit_rewrites_one_bucket(spark, tmp_path):
    e, store = FeatureHash("md5"), Store(spark, str(tmp_path / "index"))
    rows = [("r", f"f{i}.txt", f"text number {i}", None, 1) for i in range(200)]
    first = reindex(store, spark.createDataFrame(rows, FILE), e, buckets=16)
    assert first["buckets_written"] == 16
    before = store.meta()["tables"]["postings"]["buckets"]
    rows[7] = ("r", "f7.txt", "another text", None, 2)
    report = reindex(store, spark.createDataFrame(rows, FILE), e)
    assert (report["files_indexed"], report["buckets_written"], report["incremental"]) == (1, 1, True)
    after = store.meta()["tables"]["postings"]["buckets"]
    assert sum(after[b] != before[b] for b in before) == 1 and after.keys() == before.keys()
    assert store.table("chunks").count() == 200 and store.table("postings").filter("term = 'another'").count() == 1
    held = os.listdir(tmp_path / "index")
    assert store.prune() > 0 and store.table("chunks").count() == 200 and store.table("postings").filter("term = 'another'").count() == 1
    assert not [x for x in held if x.startswith("stage-")]
    assert {r.table for r in store.describe().filter("column = 'repo_id'").collect()} == {"chunks", "vectors", "postings", "symbols", "imports", "exports", "files"}


def test_terms_are_pushed_into_the_scan(spark, tmp_path):
    e, store = FeatureHash("md5"), Store(spark, str(tmp_path / "index"))
    reindex(store, spark.createDataFrame([("r", "a.txt", "apple pear", None, 1)], FILE), e, buckets=2)
    q = spark.createDataFrame([(1, "apple")], "query_id long, query string")
    plan = bm25_topk(store.table("postings"), corpus_counts(store), q)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,apple)" in plan


def test_search_reads_everything_once(spark, tmp_path):
    e, store = FeatureHash("md5"), Store(spark, str(tmp_path / "index"))
    reindex(store, spark.createDataFrame([("r", f"f{i}.py", f"def fn_{i}(a):\n    return {i}\n", "python", 1) for i in range(30)], FILE), e, buckets=2)
    q = spark.createDataFrame([(1, "fn 3"), (2, "return")], "query_id long, query string")
    found = search(q, Corpus.of(store, e), e, Knobs(diversify=True, boost_imports=True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 0 and plan.count("FlatMapGroupsInPandas") <= 2 and found.count() > 0


def test_first_search_builds(spark, tmp_path):
    e, store, calls = FeatureHash("md5"), Store(spark, str(tmp_path / "index")), []

    def files():
        calls.append(1)
        return spark.createDataFrame([("r", "a.txt", "apple", None, 1)], FILE)

    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: open_or_build(store, files, e), range(3)))
    assert len(calls) == 1
    with pytest.raises(StoreError):
        open_or_build(store, files, FeatureHash())


def test_migration(spark, tmp_path):
    e, at = FeatureHash("md5"), str(tmp_path / "index")
    old = {
        "chunks": spark.createDataFrame([("x.py:1-2", "x.py", 1, 2, "function", "def apple():\n    return 1")], "id string, file_path string, start_line int, end_line int, kind string, body string"),
        "symbols": spark.createDataFrame([("x.py:1-2", "apple", "apple()", "function", 1, "x.py")], "chunk_id string, name string, signature string, kind string, line int, file_path string"),
        "imports": spark.createDataFrame([], "file_path string, ord int, source string, kind string, line int"),
        "exports": spark.createDataFrame([], "file_path string, ord int, detail string, line int"),
        "files": spark.createDataFrame([(None, "x.py", "h", 1, "python")], "repo_id string, path string, content_hash string, mtime long, language string"),
    }
    for name, df in old.items():
        df.write.parquet(f"{at}/v-1/{name}")
    fs.replace_text(spark, f"{at}/v-1/meta.json", json.dumps({"schema_version": 1, "embedder_id": e.id, "embedder_dim": e.dim}))
    fs.replace_text(spark, f"{at}/CURRENT", "v-1")
    store = Store(spark, at)
    with pytest.raises(StoreError, match="migrate"):
        store.verify(e)
    assert migrate(store, e, "R") and not migrate(store, e, "R")
    assert listing(store, "symbols", "repo_id", "chunk_id", "name") == [("R", "x.py:1-2", "apple")] and listing(store, "files", "repo_id", "path") == [("R", "x.py")]
    assert store.verify(e)["buckets"] == 4 and corpus_counts(store).first()[0] == 1


def test_places_of_records_in_several_splits(spark, tmp_path):
    rows = [json.dumps({"docstring": f"d{i}", "code": "c" * (i % 7 + 1)}) for i in range(2000)]
    (tmp_path / "r.jsonl").write_text("\n".join(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        good, _ = read_records(spark, str(tmp_path / "r.jsonl"))
        assert [(r.ord, r.docstring) for r in good.orderBy("ord").collect()] == [(i, f"d{i}") for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_build_moves_contents_once(spark, tmp_path):
    """Of distinct files only the chunks are shuffled, once; neither the files nor the postings are, and no shuffle file stays."""
    rng = random.Random(4)
    text = lambda: "\n".join(" ".join(f"{rng.getrandbits(40):x}" for _ in range(8)) for _ in range(50))
    rows = [("r", f"f{i}.txt", text(), None, 1) for i in range(60)]
    files = spark.createDataFrame(rows, "repo_id string, rel_path string, content string, language string, mtime long")
    store = spark._jsc.sc().statusStore()
    moved = lambda: sum(s.shuffleWriteBytes() for s in (lambda l: [l.apply(i) for i in range(l.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before = moved()
    made = Store(spark, str(tmp_path / "index"))
    reindex(made, files, FeatureHash("md5"))
    assert moved() - before < 1.5 * sum(len(r[2]) for r in rows)
    assert made.table("chunks").count() == made.table("vectors").count() == 60


def test_the_newest_of_repeated_files(spark, tmp_path):
    rows = [("r", "a", "1", None, 1), ("r", "a", "2", None, 2), ("r", "a", "0", None, 2), ("s", "a", "x", None, None), ("r", "b", "y", None, 5), ("r", "b", "y", None, 5)]
    files = spark.createDataFrame(rows, "repo_id string, rel_path string, content string, language string, mtime long")
    for name, least in (("sent", 500_000), ("shuffled", 0)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(store_module, "KEYS_SENT", least)
            got = store_module._newest(files, str(tmp_path / name)).collect()
        assert sorted((r.repo_id, r.rel_path, r.content) for r in got) == [("r", "a", "0"), ("r", "b", "y"), ("s", "a", "x")]
