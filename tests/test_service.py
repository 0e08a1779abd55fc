import io
import json
import os
import time

import pytest

from lodeseek import __main__, service
from lodeseek.functions.hashing import FeatureHash
from lodeseek.sources.store import Registry, Store, StoreError, reindex


def put(root, files):
    for name, content in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(content)


TREE = {"src/a.py": "import os\n\n\ndef read_config(path):\n    return open(path).read()\n", "src/b.rs": "pub fn write_config(path: &str) -> bool {\n    true\n}\n", "notes.txt": "configuration is read from a file\n"}


def test_search_builds_and_reindex_follows(spark, tmp_path):
    put(tmp_path / "tree", TREE)
    root, registry = str(tmp_path / "tree"), str(tmp_path / "registry.json")
    hits = service.search_code(spark, root, "read_config", k=2, adaptive=True, boost_imports=True)["hits"]
    assert len(hits) == 2 and hits[0]["file"] == "src/a.py" and hits[0]["signature"] == "read_config(path)" and hits[0]["imports"][0]["source"] == "os"
    assert service.search_code(spark, root, "x", k=0) == {"hits": []} and os.path.isdir(os.path.join(root, ".lodeseek"))
    put(tmp_path / "tree", {"src/c.go": "package p\n\nfunc ReadAll() {\n}\n"})
    report = service.reindex(spark, root, registry=registry)
    assert report["files_indexed"] == 1 and report["incremental"] and Registry(registry).get(root) == os.path.join(root, ".lodeseek")
    assert service.search_code(spark, root, "ReadAll")["hits"][0]["file"] == "src/c.go"
    assert not service.reindex(spark, root, force=True)["incremental"]
    # an index of another embedder is refused
    other = Store(spark, str(tmp_path / "other"))
    reindex(other, spark.createDataFrame([("r", "a.txt", "apple", None, 1)], "repo_id string, rel_path string, content string, language string, mtime long"), FeatureHash("md5"))
    with pytest.raises(StoreError):
        service.search_code(spark, root, "apple", store=other.path)


def test_server(spark, tmp_path):
    put(tmp_path, TREE)
    call = lambda i, name, **a: {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": a}}
    sent = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, call(3, "reindex", path=str(tmp_path)), call(4, "search_code", path=str(tmp_path), query="write config", k=1),
            call(5, "nothing"), call(6, "search_code", path=str(tmp_path)), {"jsonrpc": "2.0", "id": 7, "method": "other"}, call(8, "search_code", path=str(tmp_path / "gone"), query="x"), [1]]
    out = io.StringIO()
    service.serve(spark, io.StringIO("\n".join(map(json.dumps, sent)) + "\n{broken\n\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    by = {x["id"]: x for x in got if x["id"] is not None}
    assert [t["name"] for t in by[2]["result"]["tools"]] == ["search_code", "reindex"]
    assert by[3]["result"]["structuredContent"]["files_indexed"] == 3 and by[4]["result"]["structuredContent"]["hits"][0]["file"] == "src/b.rs"
    assert {i: by[i]["error"]["code"] for i in (5, 6, 7, 8)} == {5: -32602, 6: -32602, 7: -32601, 8: -32603}
    assert [x["error"]["code"] for x in got if x["id"] is None] == [-32600, -32700] and len(got) == 10


def test_command_line(spark, tmp_path, capsys):
    put(tmp_path, TREE)
    assert __main__.main(["reindex", str(tmp_path)], spark) == 0 and json.loads(capsys.readouterr().out)["files_indexed"] == 3
    assert __main__.main(["search", str(tmp_path), "read config", "-k", "1", "--adaptive"], spark) == 0
    assert json.loads(capsys.readouterr().out)["hits"][0]["file"] == "src/a.py"
    with pytest.raises(SystemExit):
        __main__.main(["search"], spark)


def test_watching_a_tree(spark, tmp_path):
    put(tmp_path / "tree", TREE)
    root = str(tmp_path / "tree")
    running = service.watch(spark, root, checkpoint=str(tmp_path / "checkpoint"))
    try:
        store = service.store_of(spark, root)
        assert store.table("files").count() == 3
        put(root, {"new.txt": "a new file\n"})
        os.remove(os.path.join(root, "notes.txt"))
        until = time.time() + 120
        seen = set()
        while time.time() < until and seen != {"src/a.py", "src/b.rs", "new.txt"}:
            time.sleep(0.5)
            seen = {r.path for r in store.table("files").collect()}
        assert seen == {"src/a.py", "src/b.rs", "new.txt"}
    finally:
        running.stop()
