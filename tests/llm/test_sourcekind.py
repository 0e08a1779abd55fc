import itertools
import math

import numpy as np
import pytest

from lodeseek.llm import sourcekind as S
from lodeseek.llm.sourcekind import file_evidence, label_files, not_handwritten, token_runs

CODE = "import os\n\n\ndef read(path):\n    with open(path) as f:\n        return f.read()\n\n\ndef other(a, b):\n    # adds\n    return a + b\n" * 3


def label(path, content, likeness=0.0):
    e = file_evidence(path, content, likeness)
    return S.LABELS[max(range(5), key=lambda i: (e[i], -i))]


@pytest.mark.parametrize(
    "note",
    ["// Code generated by protoc 3.1. DO NOT EDIT.", "# @generated by tool", "/*\n * This file was automatically generated from a.proto; do not modify it by hand.\n */", "// Output of foogen. Manual edits are overwritten on the next run.",
     "# Diese Datei wurde automatisch erzeugt (foo).", "// Fichier généré automatiquement par foo, ne pas modifier", "# AUTO-GENERATED FILE, CHANGES WILL BE LOST", "// DO NOT EDIT: rendered from a.idl", "# Este archivo fue generado automáticamente por foo",
     "// Этот файл сгенерирован автоматически"],
)
def test_generated_notes(note):
    assert label("a.py", note + "\n" + CODE) == "generated" and label("a.py", CODE + note + "\n") == "generated"


@pytest.mark.parametrize("note", ["# The generated table is checked elsewhere.", "# Reads generated code and minified scripts.", "# Do not edit the table while it is open.", 'emit("Code generated, DO NOT EDIT")', "# Finds vendored copies of the table.", 'log("this file was generated by us")'])
def test_talk_about_it(note):
    assert label("a.py", note + "\n" + CODE) == "handwritten"


@pytest.mark.parametrize("note", ["# Vendored from libfoo 1.2; keep in sync with upstream.", "// Copied verbatim from libfoo at tag v1.", "# Third-party code: libfoo 1.6, local patches", "# Imported snapshot of libfoo (1.2), do not reformat", "// libfoo v1.2.3 | redistributed under its own licence"])
def test_vendor_notes(note):
    assert label("a.py", note + "\n" + CODE) == "vendored"


def test_shapes():
    assert label("a.js", ("var a=b?c.d:3;function e(f){return g(12)}" * 60) + "\n") == "minified"
    assert label("a.css", ".a1{margin:3px;color:#123}" * 40) == "minified"
    assert label("a.go", "package p\nvar b = []string{\n" + '\t"' + "0f3a9bC7d1e5" * 60 + '",\n}\n') == "blob"
    assert label("a.py", "x = [\n" + "    " + ("143, 66, 36, 186, 123, 66, 99,\n" * 60) + "]\n") == "blob"
    assert label("a.py", '{"rows": [\n' + ",\n".join(f'{{"id": {i}, "v": "t"}}' for i in range(50)) + "]}\n") == "blob"
    assert label("a.c", "".join(f"int get_{i}(void) {{ return {i * 7 + 100}; }}\n" for i in range(60))) == "generated"
    assert label("a.json", '{"a": 1,\n "b": 2}\n' * 30) == "handwritten" and label("a.md", "word " * 500) == "handwritten"
    for content in (None, "", "\n", "x" * 10):
        assert label("a.py", content) == "handwritten"
    assert label("x/a.min.js", "a") == "minified" and label("a_pb2.py", CODE) == "generated" and label("a.generated.go", CODE) == "generated"


def tree_brute(paths, evidence):
    """Marginals by summing over all labellings."""
    dirs = sorted({"/".join(p.split("/")[:n]) for p in paths for n in range(p.count("/") + 1)})
    nodes = [("d", d) for d in dirs] + [("f", p) for p in paths]
    total = np.zeros((len(nodes), 5))
    where = {n: i for i, n in enumerate(nodes)}
    for labels in itertools.product(range(5), repeat=len(nodes)):
        w = 0.0
        for (kind, path), l in zip(nodes, labels):
            parent = labels[where["d", path.rpartition("/")[0]]]
            if kind == "f":
                w += evidence[path][l] + S.DIR_FILE[parent][l]
            else:
                w += S.dir_evidence(path)[l] + (S.DIR_DIR[parent][l] if path else 0)
        w = math.exp(w)
        for i, l in enumerate(labels):
            total[i, l] += w
    return {p: total[where["f", p]] / total[where["f", p]].sum() for p in paths}


def test_marginals_are_exact(spark):
    note = "# Code generated by x. DO NOT EDIT.\n"
    files = {"a.py": CODE, "vendor/b.py": CODE, "vendor/g.py": note + CODE, "src/c.py": note + CODE}
    want = tree_brute(list(files), {p: file_evidence(p, c, 0.0) for p, c in files.items()})
    got = {r.rel_path: r for r in label_files(spark.createDataFrame(list(files.items()), "rel_path string, content string")).collect()}
    for p, m in want.items():
        assert (got[p].label == "handwritten") == (m[0] >= 0.5)
        assert got[p].confidence == pytest.approx(max(m[0], 1 - m[0]), abs=1e-9)


def test_directories_and_likeness(spark):
    up = "".join(f"def fn_{i}(a):\n    return a * {i} + other_{i}(a)\n\n" for i in range(40))
    rows = [("r/src/a.py", CODE, 1), ("r/third_party/x/lib/deep/b.py", CODE, 1), ("r/vendor_tools/c.py", CODE, 1), ("r/__generated__/d.py", CODE, 1), ("r/src/copy.py", "# mine\n" + up.replace("other_3(", "another("), 1),
            ("r/src/part.py", up[:600] + CODE * 20, 1), ("r\\node_modules\\q\\e.js", CODE, 1), ("top.py", None, 1), (None, CODE, 1), ("r/src/a.py", CODE, 2), ("r/src/e.py", "", 1), ("r/src/a.py", "# @generated by x\n" + CODE, 3)]
    df = spark.createDataFrame(rows, "rel_path string, content string, label int")
    ref = spark.createDataFrame([(up,), (None,), ("",), (up,)], "content string")
    got = {r.rel_path for r in not_handwritten(label_files(df, ref)).collect()}
    assert got == {"r/third_party/x/lib/deep/b.py", "r/__generated__/d.py", "r/src/copy.py", "r\\node_modules\\q\\e.js", "r/src/a.py"}
    assert label_files(df.limit(0), ref).count() == 0
    # beyond the limit the reference is joined, with the same result
    assert {tuple(r) for r in label_files(df, ref, reference_limit=3).collect()} == {tuple(r) for r in label_files(df, ref).collect()}
    assert len(token_runs("a b c d")) == 0 and len(token_runs("a b c d e f")) == 2


def test_notes_of_any_length():
    note = "Code generated by x 1.2, all rights kept."
    for at in (0, 250, 310, 299, 5000, 100_000):
        assert label("a.py", "# " + "word " * (at // 5) + note + " more words" * 60 + "\n" + CODE) == "generated"
    assert label("a.c", "/*\n   Something first.\n   This file was automatically generated by x, do not edit.\n*/\nint a;\n" * 2) == "generated"
    assert label("a.rb", "=begin\n" + note + "\n=end\nx = 1\n") == "generated"
    assert label("a.html", "<!--\n  " + note + "\n-->\n<p>") == "generated"
    assert label("a.py", 'GLOB = "src/**/x"\nemit("""\n' + note + '\n""")\nOTHER = "*/"\n') == "handwritten"
    assert label("a.js", "// generated by " * 60_000) == "handwritten" and label("a.js", "edit the x " * 100_000) == "handwritten"


def test_small_files_have_a_shape():
    assert label("a.py", "K = '" + "0f3a9bc7d1e5" * 9 + "'\n") == "blob"


def test_what_propagation_changes(spark):
    files = [("r/node_modules/a/b.py", CODE), ("r/src/c.py", CODE), ("r/src/d.py", "# @generated by x\n" + CODE)]
    got = {r.rel_path: (r.alone, r.label) for r in label_files(spark.createDataFrame(files, "rel_path string, content string")).collect()}
    assert got == {"r/node_modules/a/b.py": ("handwritten", "vendored"), "r/src/c.py": ("handwritten", "handwritten"), "r/src/d.py": ("generated", "generated")}
