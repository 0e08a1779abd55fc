import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.operators.structure import analyse, bounded, chunk_files, chunk_source, imports_exports, line_windows, split_lines, symbols

SYMBOLS = {
    "python": ("class A:\n    def f(self, x: int = 3) -> str:\n        return ')'\n\nasync def g(a, *b):\n    pass\n", [("A", "class", 1, 3), ("f", "method", 2, 3), ("g", "function", 5, 6)]),
    "typescript": ("export class A {\n  f(a: number): string {\n    return `}`;\n  }\n}\ninterface I {\n  m(x: string): void;\n}\nexport function g() {\n}\ntype Q = string;\nenum E { X }\n", [("A", "class", 1, 5), ("f", "function", 2, 4), ("I", "interface", 6, 8), ("m", "function", 7, 7), ("g", "function", 9, 10), ("Q", "type", 11, 11), ("E", "enum", 12, 12)]),
    "rust": ("pub struct S;\nunion U { a: u8 }\nimpl S {\n    fn n(&self) -> u8 {\n        1 // }\n    }\n}\ntrait T {\n    fn q(&self);\n}\ntype X = u8;\n", [("S", "struct", 1, 1), ("U", "struct", 2, 2), ("n", "method", 4, 6), ("T", "trait", 8, 10), ("q", "method", 9, 9), ("X", "type", 11, 11)]),
    "go": ("package p\ntype P struct {\n\tX int\n}\nfunc (p *P) Do(a, b int) error {\n\treturn nil\n}\nfunc z() {}\ntype N int\n", [("P", "struct", 2, 4), ("Do", "method", 5, 7), ("z", "function", 8, 8), ("N", "type", 9, 9)]),
    "bash": ("f() {\n  echo '}'\n}\nfunction g {\n  :\n}\n", [("f", "function", 1, 3), ("g", "function", 4, 6)]),
    "java": ("class A {\n  A(int x) { }\n  public int f(List<String> b) throws X {\n    if (b == null) { return 1; }\n  }\n}\ninterface I { }\nrecord R(int a) { }\n", [("A", "class", 1, 6), ("A", "function", 2, 2), ("f", "function", 3, 5), ("I", "interface", 7, 7), ("R", "class", 8, 8)]),
    "c": ("static int g(char *p)\n{\n  if (p) { }\n}\nint h(void);\n", [("g", "function", 1, 4)]),
    "ruby": ("module M\n  class A\n    def f(x)\n      x if x\n    end\n    def self.g\n    end\n  end\nend\n", [("M", "module", 1, 9), ("A", "class", 2, 8), ("f", "function", 3, 5), ("g", "function", 6, 7)]),
    "cpp": ("class A {\n  int f(int b) const { return b; }\n};\nstruct B {\n};\nstatic void g()\n{\n}\n", [("A", "class", 1, 3), ("f", "function", 2, 2), ("B", "struct", 4, 5), ("g", "function", 6, 8)]),
}


@pytest.mark.parametrize("language", SYMBOLS)
def test_symbols(language):
    src, want = SYMBOLS[language]
    assert [(s.name, s.kind, s.start, s.end) for s in symbols(language, src)] == want


IMPORTS = {
    "python": ("import a\nimport b as c\nfrom x import y, z\nfrom q import *\n# import no\n", [("a", "side_effect"), ("b", "namespace"), ("x", "named"), ("q", "side_effect")], []),
    "typescript": (
        'import "a";\nimport b, { c } from "b";\nimport * as d from "d";\nimport { e } from "e";\nconst f = require("f");\nexport { x, y } from "s";\nexport * from "t";\nexport function g() {}\nexport { h };\nexport interface I {}\n',
        [("a", "side_effect"), ("b", "default"), ("d", "namespace"), ("e", "named"), ("f", "require")],
        ["x, y from s", "* from t", "default g", "h"],
    ),
    "rust": ("use a::b;\nmod c;\npub use d::e;\n", [("a::b", "default"), ("c", "namespace"), ("d::e", "default")], ["d::e"]),
    "go": ('import "a"\nimport (\n\t"b"\n\tx "c"\n)\n', [("a", "side_effect"), ("b", "side_effect"), ("c", "namespace")], []),
    "bash": ("source ./a.sh\n. 'b.sh'\nexport A=1 B\ndeclare -x C\nlocal D=2\n", [("./a.sh", "require"), ("b.sh", "require")], ["A", "B", "C"]),
    "java": ("import a.b.C;\nimport static x.y;\n", [("a.b.C", "named"), ("x.y", "named")], []),
    "c": ('#include <a.h>\n# include "b.h"\n', [("<a.h>", "require"), ('"b.h"', "require")], []),
    "cpp": ("#include <a>\n", [("<a>", "require")], []),
    "ruby": ("require 'a'\nrequire_relative \"../b\"\n", [("a", "require"), ("../b", "require")], []),
}


@pytest.mark.parametrize("language", IMPORTS)
def test_imports_and_exports(language):
    src, imports, exports = IMPORTS[language]
    i, e = imports_exports(language, src)
    assert [x[:2] for x in i] == imports and [x[0] for x in e] == exports


def test_signatures():
    sig = lambda lang: {s.name: s.signature for s in symbols(lang, SYMBOLS[lang][0])}
    assert sig("python") == {"A": "class A", "f": "f(self, x: int) -> str", "g": "g(a, *b)"}
    assert sig("go")["Do"] == "Do(self: *P, a: int, b: int) -> error"
    assert sig("ruby")["f"] == "f(x)" and sig("c")["g"] == "g(p: char *) -> int" and sig("java")["f"] == "f(b: List<String>)"


def test_bounded_cuts_at_blank_lines():
    assert bounded(["x"] * 150 + [""] + ["y"] * 100, 1) == [(1, 151), (152, 251)]
    assert bounded(["x"] * 450, 1) == [(1, 200), (201, 400), (401, 450)]
    assert bounded(["z" * 9000, "a"], 5) == [(5, 5), (6, 6)]
    assert bounded([], 1) == []


LINES = st.lists(st.sampled_from(["def f():", "    x", "", "class A:", "}", "fn q() {", "end", "'", '"', "/*", "func a() {", "é" * 50]), max_size=60)


@settings(max_examples=60, deadline=None)
@given(LINES, st.sampled_from(sorted(SYMBOLS)))
def test_chunks_cover_all_lines_with_distinct_ids(lines, language):
    content = "\n".join(lines)
    got = chunk_source(language, content)
    total = len(split_lines(content))
    ids = [(a, b) for a, b, *_ in got]
    assert len(ids) == len(set(ids)) and all(1 <= a <= b <= total for a, b in ids)
    assert {i for a, b in ids for i in range(a, b + 1)} == set(range(1, total + 1))
    imports_exports(language, content)


def test_windows(spark):
    files = spark.createDataFrame([("a", "\n".join(map(str, range(1, 131)))), ("b", "x\r\ny\r\nz\r\n"), ("c", ""), ("d", None), ("e", "\n")], "rel_path string, content string")
    got = sorted((r.file_path, r.start_line, r.end_line) for r in line_windows(files).collect())
    assert got == [("a", 1, 60), ("a", 46, 105), ("a", 91, 130), ("b", 1, 3), ("e", 1, 1)]
    assert line_windows(files).filter("file_path = 'b'").first().body == "x\ny\nz"


def test_files(spark):
    rows = [("a.py", "import x\ndef f():\n    pass\n", 1), ("a.py", "import x\ndef f():\n    pass\n", 2), ("t.txt", "hello\n", 3), ("bad.rs", "fn (((", 4), ("n.go", None, 5), ("e.c", "", 6)]
    files = spark.createDataFrame(rows, "rel_path string, content string, line int")
    rec = analyse(files).collect()
    assert {(r.record, r.name) for r in rec if r.file_path == "a.py"} == {("chunk", None), ("chunk", "f"), ("symbol", "f"), ("import", "x")}
    assert sorted(r.id for r in chunk_files(files).collect()) == ["a.py:1-1", "a.py:2-3", "bad.rs:1-1", "t.txt:1-1"]
    assert analyse(files.limit(0)).count() == 0
