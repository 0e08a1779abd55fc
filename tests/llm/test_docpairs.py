import pytest

from lodeseek.llm.docpairs import described, documented_functions, functions, trivial

GOOD = "Reads the whole table and returns it."


def names(language, src, field=None):
    return [x[0] for x in described(language, src, field)]


CASES = {
    "python": 'def a():\n    """%s"""\n    return 1\n\n# %s\ndef b():\n    pass\n\n# %s\n\ndef c():\n    pass\n\n# %s\n@dec("x")\n@other\nasync def d(x,\n            y):\n    s = "def no():"\n\n# def e():\n#     pass\n',
    "typescript": "/** %s */\nexport function a(x: number): string {\n  return `function no() {`;\n}\n// %s\nconst b = (x) => {\n  return x;\n};\n// %s\n\nfunction c() {}\nclass K {\n  /* %s */\n  @dec()\n  d(x: string): void {\n    if (x) { }\n  }\n}\n",
    "rust": "/// %s\n#[inline]\npub fn a() -> u8 {\n    1\n}\n// %s\nfn b<T: Into<u8>>(x: T) {}\n// %s\n\nfn c() {}\n/* %s */\npub(crate) fn d(&self) -> Result<u8, E> {\n    let s = \"fn no() {\";\n}\n",
    "go": "// %s\nfunc a(x int) (int, error) {\n\treturn 1, nil\n}\n/* %s */\nfunc (s *T) b() {\n}\n// %s\n\nfunc c() {}\n// %s\nfunc d(f func(int) int) struct{ X int } {\n\tx := `func no() {`\n}\n",
    "java": "class K {\n  /** %s */\n  @Override\n  public int a(final int x) throws E {\n    if (x > 1) { return 2; }\n  }\n  // %s\n  List<Map<String, Long>> b() {\n  }\n  // %s\n\n  void c() { }\n  /* %s */\n  static <T> T d(T t) {\n    return new X() { };\n  }\n}\n",
    "cpp": "/* %s */\nstatic int a(const std::string& s) {\n  return f(s);\n}\n// %s\nint\nb(int x)\n{\n}\n// %s\n\nint c() { }\n/// %s\ntemplate <class T>\nT d(T t) const {\n}\n",
    "ruby": "# %s\ndef a(x)\n  x.each do |y|\n    if y then 1 end\n  end\nend\n=begin\n%s\n=end\ndef b\n  1 if true\nend\n# %s\n\ndef c\nend\n# %s\ndef self.d\n  s = 'def no'\nend\n",
    "bash": "# %s\na() {\n  echo '}'\n}\n# %s\nfunction b {\n  cat <<EOT\nfunction no {\nEOT\n}\n# %s\n\nc() {\n  :\n}\n# %s\nfunction d() {\n  :\n}\n",
}


@pytest.mark.parametrize("language", CASES)
def test_comments_and_docstrings(language):
    src = CASES[language] % ((GOOD,) * 4)
    assert [f.name for f in functions(language, src)] == list("abcd")
    assert names(language, src) == ["a", "b", "d"]
    assert names(language, src.replace("\n", "\r\n")) == ["a", "b", "d"]
    assert names(language, CASES[language] % (("TODO: describe what this does here",) * 4)) == []
    assert names(language, CASES[language] % (("too short",) * 4), GOOD) == ["a"]


def test_bodies():
    got = described("python", CASES["python"] % ((GOOD,) * 4), None)
    assert got[0][2] == f'def a():\n    """{GOOD}"""\n    return 1'
    assert got[2][2].startswith('@dec("x")') and got[2][3] == 15
    assert described("ruby", CASES["ruby"] % ((GOOD,) * 4), None)[0][2].endswith("  end\nend")


@pytest.mark.parametrize(
    "text, bad",
    [("/** Load the data set. */", False), ("one two three", True), ("Load data set quickly", True), ("loadDataSetQuickly", True), ("@param x the value of it\n@return the value of it", True), (":param x: the value to be used", True), ("TODO add a description of this", True), ("FIXME nobody knows what it does", True), ("<p>", True), ("<b>a b</b> c", True), ("Todo o módulo lê a chave", False), ("# 1 2 3 4 5", True), ("/**\n * @see x\n * Reads one line at most.\n */", False), ("Таблица пропускает указатель после", False), ("{@inheritDoc}", True)],
)
def test_trivial(text, bad):
    assert trivial(text, "loadDataSetQuickly") is bad


def test_rows(spark):
    rows = [(1, "python", GOOD, "def f():\n    pass\n", 5), (1, "python", GOOD, "def f():\n    pass\n", 5), (2, "cobol", GOOD, "x", 5), (3, None, GOOD, "x", 5), (4, "go", None, None, 5), (5, "rust", None, "", 5), (6, "C", None, f"// {GOOD}\nint f(void) {{\n}}\n", 5), (7, "python", None, "def (((", 5)]
    df = spark.createDataFrame(rows, "record_id long, language string, docstring string, code string, line int")
    got = documented_functions(df).collect()
    assert sorted((r.id, r.func_name) for r in got) == [(1, "f"), (1, "f"), (6, "f")]
    assert documented_functions(df.limit(0)).count() == 0
    assert described("python", "def f():\n    pass\n" + "x = 1\n" * 20000, GOOD)[0][0] == "f"
