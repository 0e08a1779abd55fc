import ast
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm.derivatives import Grammar
from lodeseek.llm.grammars import grammar
from lodeseek.llm.parsing import syntax_error, unparsable, unparsable_rates

GOOD = {
    "python": "import a.b as c\n\n@d(1)\nclass A(B, metaclass=C):\n    x: int = 3\n\n    async def f(self, *a, k=1, **kw) -> dict[str, int]:\n        async with a as b, c:\n            return {**x, 'a': [i for i in y if i]}\n        try:\n            pass\n        except (E, F) as e:\n            raise G from e\n        finally:\n            lambda q: q\n",
    "typescript": "import * as a from 'a';\nexport abstract class A<T> extends B implements C {\n  private readonly x?: Map<string, number[]> = new Map();\n  async *f(a: T, ...b: any[]): Promise<void> {\n    for (const [k, v] of Object.entries(a ?? {})) { if (k) continue; }\n    const s = `a${k + `b`}`;\n  }\n}\ntype Q = { [k: string]: A | B } & C;\nenum E { X = 1, Y }\n",
    "rust": "use a::{b, c as d};\n#[derive(Debug)]\npub struct S<'a, T: Clone> { x: &'a T }\nimpl<'a, T> S<'a, T> where T: Clone {\n    pub fn f(&mut self, x: Option<u8>) -> Result<(), E> {\n        match x { Some(n) if n > 1 => {} , _ => return Err(e)?, }\n        let v: Vec<_> = (0..3).map(|i| i * 2).collect();\n        Ok(())\n    }\n}\n",
    "go": "package p\n\nimport (\n\t\"a\"\n\tb \"c\"\n)\n\ntype T struct {\n\tX map[string][]int `json:\"x\"`\n}\n\nfunc (t *T) F(a, b int, c ...string) (int, error) {\n\tfor i := range c {\n\t\tif x, err := g(i); err != nil {\n\t\t\treturn 0, err\n\t\t}\n\t}\n\tswitch a {\n\tcase 1, 2:\n\tdefault:\n\t}\n\treturn 1, nil\n}\n",
    "java": "package a.b;\nimport java.util.*;\n@X(1)\npublic final class A<T extends B> extends C implements D {\n  private static final int[] X = {1, 2};\n  @Override public <U> List<? super U> f(final int a, String... b) throws E {\n    try (R r = g()) { for (int i : X) { h(x -> x + 1); } } catch (E | F e) { } finally { }\n    return a > 1 ? null : new ArrayList<>();\n  }\n}\n",
    "c": "#include <a.h>\n#define X(a) ((a) + 1)\ntypedef struct s { int a[3]; struct s *n; } s_t;\nstatic const char *f(int a, char **b)\n{\n  for (int i = 0; i < 3; i++) { if (a) continue; else break; }\n  do { a--; } while (a);\n  switch (a) { case 1: return b[0]; default: ; }\n  return (char *)0;\n}\n",
    "cpp": "#include <a>\nnamespace n {\ntemplate <typename T>\nclass A : public B<T> {\n public:\n  explicit A(int a) : b_(a) {}\n  auto f(const std::vector<T>& v) const -> int { for (auto& x : v) { g([&](int y) { return y; }); } return 1; }\n private:\n  int b_ = 0;\n};\n}\n",
    "ruby": "require 'a'\nmodule M\n  class A < B\n    attr_reader :x\n    def f(a, *b, k: 1, &c)\n      a.each { |x| puts \"#{x}\" }\n      return 1 unless a\n      case a\n      when 1 then 2\n      else 3\n      end\n    rescue E => e\n      raise\n    end\n  end\nend\n",
    "bash": "#!/bin/bash\nset -e\nf() {\n  local a=\"$1\" b=$((1 + 2))\n  if [ -z \"$a\" ]; then echo 'x'; elif [[ $a == y* ]]; then :; else return 1; fi\n  for i in \"${a[@]}\"; do cat <<EOF | sort\n$i )\nEOF\n  done\n  case $a in x|y) ;; *) f ;; esac\n  while read -r l; do :; done < <(g)\n}\n",
}


@pytest.mark.parametrize("language", GOOD)
def test_valid_and_broken(language):
    src = GOOD[language]
    assert syntax_error(language, src) is None
    assert syntax_error(language, src.replace("\n", "\r\n")) is None and syntax_error(language, "") is None and syntax_error(language, "\n\n") is None
    line, _ = syntax_error(language, src + "<<<<<<< HEAD\n" + src)
    assert line >= src.count("\n") + 1
    lines = src.split("\n")
    assert sum(syntax_error(language, "\n".join(lines[:k])) is not None for k in range(4, len(lines) - 1)) >= (len(lines) - 5) // 3
    assert syntax_error(language, src + ")\n") is not None
    assert syntax_error(language, "<!DOCTYPE html>\n<html>\n") is not None
    assert sum(syntax_error(other, src) is not None for other in GOOD if other != language) >= 7


def test_only_grammar_counts():
    assert syntax_error("python", "undefined_name(1 + 'a')\nx = x\n") is None
    assert syntax_error("java", "class A { int f() { return undefinedThing; } int f() { return 1; } }\n") is None
    assert syntax_error("cobol", "((((") is None


def test_reasons():
    assert syntax_error("python", "x = (1,\n")[1] == "cut off"
    assert syntax_error("go", "package p\nfunc f() {\n") == (3, "cut off")
    assert syntax_error("c", "int f() { return 1)\n}\n") == (1, "unexpected )")


def test_every_branch_of_a_conditional_counts():
    def both(src):
        assert syntax_error("c", src) == syntax_error("cpp", src)
        return syntax_error("c", src)

    assert both("#if A\nint a;\n#elif B\nint b;\n#else\nint c;\n#endif\n") is None
    assert both("#if A\nint a;\n#else\n<<<<<<< HEAD\n#endif\n") == (4, "unexpected <<")
    assert both("#if A\nint a;\n#elif B\nint b[;\n#else\nint c;\n#endif\n") == (4, "unexpected ;")
    assert both("#if A\n  # if B\nint a;\n  # else\nint q];\n  # endif\n#endif\n") == (5, "unexpected ]")
    assert both("#ifdef A\nint a;\n#endif\n#ifndef A\nint q];\n#endif\n") == (5, "unexpected ]")
    # never compiled
    assert both("#if 0\ndon't \"parse ((\n#else\nint a;\n#endif\n") is None and both("#if 0\n((\n#else\nint a)\n#endif\n") == (4, "unexpected )")
    assert both("#if 1\nint a;\n#else\n((\n#endif\n") is None and both("#if A\nint a;\n#else\n#error none\n#endif\n") is None
    # balance
    guard = "#ifndef A_H\n#define A_H\nint f(int);\nint g(int);\n#endif\n"
    assert both(guard) is None and both(guard[: guard.index("int g")]) == (4, "cut off")
    assert both("int a;\n#endif\n") == (2, "unexpected #endif") and both("#if A\n#else\n#else\n#endif\n") == (3, "unexpected #else")


def test_conditionals_of_one_condition_agree():
    src = "int f(int x) {\n#ifdef A\n  g(\n#else\n  if (x) {\n#endif\n  h()\n#ifdef A\n  );\n#else\n  ; }\n#endif\n}\n"
    assert syntax_error("c", src) is None and syntax_error("c", src.replace("  ; }", "  ;")) is not None
    wrapped = "#ifdef __cplusplus\nextern \"C\" {\n#endif\nint a;\n#ifdef __cplusplus\n}\n#endif\n"
    assert syntax_error("c", wrapped) is None and syntax_error("cpp", wrapped) is None
    many = "".join(f"#if A{i} && B >= {i}L\nint a;\n#else\nint b;\n#endif\n" for i in range(300))
    assert syntax_error("c", many) is None and syntax_error("c", many[:-10] + "]\n#endif\n") is not None


FORBIDDEN = [
    ("java", "class A { void f() { try { g(); } } }\n"),
    ("typescript", "try { f(); }\n"),
    ("python", "const x = 5\n"),
    ("python", "a b = f()\n"),
    ("python", "sort x:\n    case 1:\n        pass\n"),
    ("python", "f(a=1, b)\n"),
    ("python", "def f(a=1, b): pass\n"),
    ("c", "int f(void) { init(a) run(b); }\n"),
    ("c", "int f(void) { g(h(a) b); }\n"),
]
ALLOWED = [
    ("java", "class A { void f() { try (R r = g()) { } try { } finally { } try { } catch (E e) { } } }\n"),
    ("typescript", "try { f(); }\ncatch { }\ntry { f(); } catch (e) { } finally { }\ntry { } finally { }\n"),
    ("python", "type X[T] = int\ntype = 1\nmatch = case = type(x)\nmatch.type(case=1)\nmatch x:\n    case [1, type]:\n        pass\n    # note\n\n    case _:\n        pass\n"),
    ("python", "f(a, *b, c=1, *d, **e)\nf(x for x in y)\ndef f(a, /, b, c=1, *, d=2, e, **g): lambda a, *b, c=1, d: 0\n"),
    ("c", "API(x) f(void);\nint g(void) { __typeof__(x) y = 1; __attribute__((unused)) int z; a * b; T c; typeof(int) d; return (T)h(1); }\n"),
]


def test_what_the_grammars_forbid():
    assert [x for x in FORBIDDEN if syntax_error(*x) is None] == []
    assert [(x, syntax_error(*x)) for x in ALLOWED if syntax_error(*x) is not None] == []


LISTED = st.lists(st.sampled_from(["a", "b=1", "*c", "**d", "*", "/", "e=2"]), max_size=5)
WORDS = st.lists(st.sampled_from(["type", "match", "case", "x", "const", "=", "1", ":", ".", "(", ")"]), max_size=6)


def python_accepts(src):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(src)
        return True
    except (SyntaxError, ValueError) as e:
        # a number that runs into a word is Python's own business
        return None if "decimal literal" in str(e) else False


@settings(max_examples=400, deadline=None)
@given(LISTED, WORDS, st.booleans())
def test_python_agrees_in_both_directions(listed, words, comma):
    items = ", ".join(listed) + ("," if comma and listed else "")
    for src in (f"f({items})\n", f"def f({items}): pass\n", f"lambda {items}: 0\n", f"class A({items}): pass\n", " ".join(words) + "\n"):
        if (valid := python_accepts(src)) is not None:
            assert (syntax_error("python", src) is None) == valid, src


PIECES = st.lists(
    st.sampled_from(
        ["x", "=", "1", "(", ")", "[", "]", ":", "\n", "\n    ", "if ", "else ", "def ", "f", ",", "'a'", "+", "return ", "for ", " in ", " not ", "lambda ", ".", "*", "**", "{", "}", "del ", " as ", "with ", ":=", "+=", "await ", "yield ", "None", "...", " from ", "@", "class ", "while ", "try:", "except ", " and ", " is "]
    ),
    max_size=12,
)


@settings(max_examples=1500, deadline=None)
@given(PIECES)
def test_python_agrees_with_its_own_parser(parts):
    src = "".join(parts) + "\n"
    if (valid := python_accepts(src)) is not None:
        assert (syntax_error("python", src) is None) == valid, src


TARGETS = [
    "f() = 3", "1 = 2", "for 1 in x: pass", "del f()", "(a, b) += 1", "a + 1 = 2", "[a, f()] = 1", "f(): int = 3", "with a as f(): pass", "a = 1 = c", "(x for x in y) = 1", "None = 1", "x if y else z = 1", "a := 1", "{*a, **b}", "not x = 1", "del a + b", "[x for f() in y]", "a, b: int = 1", "x = a := 1", "-a = 1", "await a = 1", "(a, b): int",
    "x().y = 1", "x()[1].z = 2", "(a) = 1", "(a, *b), c = d", "a[1], b.c = d", "() = a", "(a.b): int = 1", "x[a:b, *c] = 1", "x = *a, b", "for x in *a, b: pass", "with a as (b, c): pass", "x = y = yield z", "a += yield", "f(a := 1)", "del (a, [b]), c[1]", "for a.b in c: pass", "[x for x, in z]", "{**a, 'b': 1}", "{a: b for a in c}",
]


def test_targets():
    for src in TARGETS:
        assert (syntax_error("python", src + "\n") is None) == python_accepts(src + "\n"), src


def test_ruby_modifiers_open_nothing():
    assert syntax_error("ruby", "def f(x)\n  return x if x\n  foo x unless y\n  a = b while c\nend\n") is None
    assert syntax_error("ruby", "def f(x)\n  return x if x\n  end\nend\n") == (4, "unexpected end")
    assert syntax_error("ruby", "raise A, 'x' unless y\nend\n") == (2, "unexpected end")
    assert syntax_error("ruby", "x = if a then b else c end\ny = foo a, b do |z|\n  z\nend\nputs [1, *d].map { |e| e } if f\na, (b, *c) = *d, e\nreturn {a: 1} if x\nfoo = -> (a) { a }\nputs case x when 1 then 2 end\n") is None


def test_states_of_nested_code_recur():
    body = "class A\n  def f(x)\n    x.each do |y|\n      puts y, z if y > 1\n      return foo(y) { |q| q } unless y\n    end\n  end\nend\n"
    g = grammar("ruby")
    assert syntax_error("ruby", body) is None
    before = g.count
    assert syntax_error("ruby", body * 50) is None and g.count - before < 300


def test_derivatives():
    g = Grammar("file = expr ; expr = term ( PLUS term )* ; term = N | '(' expr ')' ;")
    assert g.first_error(["N", "PLUS", "(", "N", ")"]) is None
    assert g.first_error(["N", "N"]) == 1 and g.first_error(["(", "N"]) == 2 and g.first_error([]) == 0
    deep = ["("] * 3000 + ["N"] + [")"] * 3000
    assert g.first_error(deep) is None


def test_rows(spark):
    rows = [("r", "a.py", "x = (\n", "python", 1), ("r", "a.py", "x = (\n", "python", 1), ("r", "b.py", "x = 1\n", "python", 1), ("r", "c.txt", "((", None, 1), ("r", "d.go", None, "go", 1), ("q", "e.go", "", "go", 1), ("q", "f.sh", "fi\n", "bash", 1), (None, "g.rs", "fn (", "rust", 1)]
    df = spark.createDataFrame(rows, "repo_id string, rel_path string, content string, language string, line int")
    bad = unparsable(df)
    assert {r.rel_path for r in bad.collect()} == {"a.py", "f.sh", "g.rs"}
    rates = {(r.repo_id, r.language): (r.files, r.invalid, r.rate) for r in unparsable_rates(df, bad).collect()}
    assert rates["r", "python"] == (2, 1, 0.5) and rates["q", "go"] == (1, 0, 0.0) and rates["q", "bash"] == (1, 1, 1.0)
    assert unparsable(df.limit(0)).count() == 0
