"""Symbols, imports and exports of source files, and the chunks made of them.

There is no Catalyst equivalent of parsing, so one ``mapInPandas`` pass reads a file once and emits
all records of it. Symbols come from a scan of signatures and bodies, not from a full parser: code
that is broken still gives what can be recognised, and a file of which nothing can be gives no
symbols. The line splitting, the complement of the symbol ranges and the size-bounded cut of module
text follow the pinned semantics; windows for other files are a native expression, ``line_windows``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.code import MASKS, Lines, bracket_pairs, mask, named_bodies, ruby_end, ruby_loops
from lodeseek.functions.text import chunk_id, language_of
from lodeseek.sources.tables import spread

WINDOW_LINES, WINDOW_OVERLAP = 60, 15
MAX_CHUNK_LINES, MAX_CHUNK_BYTES = 200, 8192

_TYPES = {
    "python": re.compile(r"^[ \t]*(?P<kind>class)[ \t]+(?P<name>\w+)", re.M),
    "typescript": re.compile(r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:const[ \t]+(?=enum))?(?P<kind>class|interface|enum|type)[ \t]+(?P<name>[\w$]+)", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:unsafe[ \t]+)?(?P<kind>struct|union|enum|trait|type)[ \t]+(?P<name>\w+)", re.M),
    "go": re.compile(r"^(?:type[ \t]+|[ \t]+(?=\w+[ \t]+(?:struct|interface)[ \t]*\{))(?P<name>\w+)[ \t]+(?P<kind>struct|interface|\S+)", re.M),
    "java": re.compile(r"^[ \t]*(?:@[\w.]+(?:\([^)]*\))?[ \t]*)*(?:(?:public|private|protected|static|final|abstract|sealed|strictfp)[ \t]+)*(?P<kind>class|interface|enum|record)[ \t]+(?P<name>\w+)", re.M),
    "cpp": re.compile(r"^[ \t]*(?:template[ \t]*<[^>]*>[ \t]*)?(?P<kind>class|struct)[ \t]+(?P<name>\w+)(?=[^;{}()]*\{)", re.M),
    "ruby": re.compile(r"^[ \t]*(?P<kind>class|module)[ \t]+(?P<name>[A-Z][\w:]*)", re.M),
}
#: Callables without a body: methods that a trait or an interface asks for.
_DECLARED = {
    "rust": re.compile(r"^[ \t]*(?:(?:pub|unsafe|async|const)[ \t]+)*fn[ \t]+(?P<name>\w+)[ \t]*(?:<[^<>]*>)?\(", re.M),
    "typescript": re.compile(r"^[ \t]+(?:(?:abstract|public|protected|readonly|declare)[ \t]+)*(?P<name>(?!return\b|if\b|for\b|while\b|switch\b|await\b|throw\b|super\b)[A-Za-z_$][\w$]*)[ \t]*\??(?:<[^<>]*>)?\((?=[^;{}]*\)[ \t]*:[^;{}]*;)", re.M),
}
_KIND = {"union": "struct", "record": "class"}


class Symbol(NamedTuple):
    name: str
    kind: str
    signature: str
    start: int  # lines from 1
    end: int


def _split_top(s: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, ch in enumerate(s):
        if ch in "([{<":
            depth += 1
        elif ch in ")]}" or (ch == ">" and s[i - 1 : i] not in "-="):
            depth -= 1
        elif ch == "," and depth <= 0:
            out.append(s[at:i])
            at = i + 1
    return [x.strip() for x in [*out, s[at:]] if x.strip()]


def _param(language: str, text: str) -> tuple[str, str | None]:
    text = re.sub(r"\s+", " ", text)
    if language == "rust" and re.fullmatch(r"&?\s*(?:'\w+ )?(?:mut )?self(?:: .*)?", text):
        return "self", None
    if language in ("python", "typescript", "rust"):
        name, colon, kind = text.partition(":")
        kind = re.split(r"=(?!>)", kind)[0].strip() if language != "rust" else kind.strip()
        name = re.split(r"=", name)[0].strip().removeprefix("mut ").rstrip("?")
        return name.split()[-1] if name.split() else name, (kind or None) if colon else None
    if language == "ruby":
        return re.match(r"[*&]*\w*", text).group() or text, None
    if language == "go":
        name, _, kind = text.partition(" ")
        return (name, kind.strip()) if kind else (name, None)
    m = re.match(r"(.*?)([A-Za-z_]\w*)\s*((?:\[[^\]]*\])*)(?:\s*=.*)?$", text)
    if not m or not m.group(1).strip():
        return text, None
    kind = re.sub(r"^(?:final |@\w+ )+", "", m.group(1).strip() + m.group(3))
    return m.group(2), kind


def _signature(language: str, src: str, code: str, name: str, start: int, opens: int, match: dict[int, int]) -> tuple[str, str]:
    """``(signature, kind)`` of a callable."""
    m = re.compile(r"(?<![\w])" + re.escape(name)).search(code, start)
    at = m.start() if m else start
    limit = at + len(name) + 1 if language == "ruby" else max(opens, at)  # Ruby's list stands after the name or not at all
    i = code.find("(", at + len(name), limit)
    close = match.get(i) if i >= 0 else None
    params: list[tuple[str, str | None]] = []
    returns = None
    if close is not None and language != "bash":
        raw = [x for x in _split_top(src[i + 1 : close]) if x not in ("*", "/", "void")]
        params = [_param(language, x) for x in raw]
        if language == "go":
            pending = None
            for k in range(len(params) - 1, -1, -1):  # a, b int
                pending = params[k][1] or pending
                params[k] = (params[k][0], pending)
        tail = src[close + 1 : max(close + 1, opens - 1)]
        if language in ("python", "rust"):
            m = re.search(r"->\s*(.+?)\s*(?::\s*$|\bwhere\b|$)", tail, re.S)
            returns = m.group(1).strip().rstrip(":").strip() if m else None
        elif language == "typescript":
            m = re.match(r"\s*:\s*(.+?)\s*(?:=>)?\s*$", tail, re.S)
            returns = m.group(1).strip() if m else None
        elif language == "go":
            returns = tail.strip() or None
        elif language in ("c", "cpp"):
            lead = re.sub(r"\b(?:static|inline|extern|virtual|constexpr|explicit|friend)\b", "", src[start:at])
            returns = re.sub(r"\s+", " ", re.sub(r"(\w+::)+$", "", lead.strip())).strip() or None
    if language == "go":
        m = re.match(r"func\s*\(([^)]*)\)\s*" + re.escape(name), src[start : at + len(name)])
        if m:
            receiver = m.group(1).split()
            params.insert(0, ("self", receiver[-1] if receiver else None))
    shown = ", ".join(p if t is None else f"{p}: {t}" for p, t in params)
    kind = "method" if params and params[0][0] == "self" else "function"
    return f"{name}({shown})" + (f" -> {returns}" if returns else ""), kind


def symbols(language: str, src: str) -> list[Symbol]:
    """Types and callables in order of their starts, each with its inclusive lines."""
    if language not in MASKS or not src.strip():
        return []
    code, _, _ = mask(language, src)
    match = bracket_pairs(code)
    places = Lines(src)
    line = lambda i: places.at(i) + 1
    found: list[Symbol] = []
    spans: list[tuple[int, int]] = []
    for name, start, opens, end in named_bodies(language, code, match):
        if language == "ruby" and spans and start < spans[-1][1]:
            continue  # bodies of methods aren't entered
        spans.append((start, end))
        text, kind = _signature(language, src, code, name, start, opens, match)
        found.append(Symbol(name, kind, text, line(start), line(end - 1)))
    named = {code.find(x.name, a) for x, (a, _) in zip(found, spans)}
    for m in _DECLARED[language].finditer(code) if language in _DECLARED else ():
        i = m.end() - 1
        end = re.compile(r"[^;{}]*;").match(code, match[i]) if i in match else None
        name = m.group("name")
        if end and m.start("name") not in named:
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            text, kind = _signature(language, src, code, name, start, end.end(), match)
            found.append(Symbol(name or "__call", kind, text, line(start), line(end.end() - 1)))
    loops = ruby_loops(code) if language == "ruby" else frozenset()
    pattern = _TYPES.get(language)
    for m in pattern.finditer(code) if pattern else ():
        word = m.group("kind")
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        if language == "go":
            word = word if word in ("struct", "interface") else "type"
        if language == "python":
            pos = code.find("\n", m.end())
            indent = len(m.group()) - len(m.group().lstrip())
            end = len(code) if pos < 0 else pos
            while pos >= 0:
                stop = code.find("\n", pos + 1)
                text = code[pos + 1 : stop if stop >= 0 else len(code)]
                if text.strip():
                    if len(text) - len(text.lstrip(" \t")) <= indent:
                        break
                    end = stop if stop >= 0 else len(code)
                pos = stop
        elif language == "ruby":
            end = ruby_end(code, start, loops)
        else:
            stop = re.compile(r"[{;]|\n(?=\S)" if language == "go" else r"[{;]").search(code, m.end())
            b = stop.start() if stop else len(code)
            end = match.get(b, b) + 1 if stop and stop.group() == "{" else b + 1
        found.append(Symbol(m.group("name"), _KIND.get(word, word), f"{_KIND.get(word, word)} {m.group('name')}", line(start), line(min(end, len(src)) - 1)))
    return sorted(found, key=lambda s: (s.start, -s.end))


_PY_IMPORT = re.compile(r"^[ \t]*import[ \t]+(?P<plain>[\w., \t]+)|^[ \t]*from[ \t]+(?P<src>[.\w]+)[ \t]+import[ \t]+(?P<what>\*|\([^)]*\)|[^\n#]+)", re.M)
_TS_IMPORT = re.compile(r"^[ \t]*import\b(?P<clause>[^'\";]*?)(?:\bfrom\b)?[ \t\n]*['\"](?P<src>[^'\"\n]+)['\"]|\brequire[ \t]*\([ \t]*['\"](?P<req>[^'\"\n]+)['\"][ \t]*\)", re.M)
_TS_EXPORT = re.compile(
    r"^[ \t]*export[ \t]+(?:\*(?:[ \t]+as[ \t]+\w+)?[ \t]+from[ \t]*['\"](?P<all>[^'\"\n]+)['\"]|(?:type[ \t]+)?\{(?P<names>[^}]*)\}(?:[ \t]*from[ \t]*['\"](?P<src>[^'\"\n]+)['\"])?"
    r"|(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?(?:abstract[ \t]+)?(?:function[ \t]*\*?|class|const|let|var)[ \t]+(?P<one>[\w$]+))",
    re.M,
)
_LINE_IMPORT = {
    "rust": re.compile(r"^[ \t]*(?P<pub>pub(?:\([^)]*\))?[ \t]+)?(?:use[ \t]+(?P<use>[^;]+)|mod[ \t]+(?P<mod>\w+))[ \t]*;", re.M),
    "bash": re.compile(r"^[ \t]*(?:source|\.)[ \t]+(?P<src>\"[^\"\n]*\"|'[^'\n]*'|[^\s;&|]+)", re.M),
    "java": re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?(?P<src>[\w.]+(?:\.\*)?)[ \t]*;", re.M),
    "c": re.compile(r"^[ \t]*#[ \t]*include[ \t]*(?P<src><[^>\n]*>|\"[^\"\n]*\")", re.M),
    "ruby": re.compile(r"^[ \t]*require(?:_relative)?[ \t(]*['\"](?P<src>[^'\"\n]+)['\"]", re.M),
}
_LINE_IMPORT["cpp"] = _LINE_IMPORT["c"]
_GO_IMPORT = re.compile(r"^import[ \t]+(?:\((?P<block>[^)]*)\)|(?P<one>[^\n(]+))", re.M)
_GO_SPEC = re.compile(r"(?:(?P<alias>[\w.]+)[ \t]+)?[\"`](?P<src>[^\"`\n]+)[\"`]")
_BASH_EXPORT = re.compile(r"^[ \t]*(?:export|declare[ \t]+-\w*x\w*)[ \t]+(?!-)(?P<rest>[^\n;#]+)", re.M)


def imports_exports(language: str, src: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, int]]]:
    """``(source, kind, line)`` of the imports and ``(detail, line)`` of the exports, in order."""
    if language not in MASKS or not src.strip():
        return [], []
    _, comments, strings = mask(language, src)
    hidden = list(src)
    for a, b in comments:
        hidden[a:b] = [c if c == "\n" else " " for c in src[a:b]]
    for a, b in strings:
        if "\n" in src[a:b]:
            hidden[a:b] = [c if c == "\n" else " " for c in src[a:b]]
    text = "".join(hidden)
    places = Lines(text)
    line = lambda i: places.at(i) + 1
    first = lambda m: m.start() + len(m.group()) - len(m.group().lstrip())
    imports: list[tuple[str, str, int]] = []
    exports: list[tuple[str, int]] = []
    if language == "python":
        for m in _PY_IMPORT.finditer(text):
            at = line(first(m))
            if m.group("plain"):
                for part in m.group("plain").split(","):
                    words = part.split()
                    if words:
                        imports.append((words[0], "namespace" if len(words) == 3 and words[1] == "as" else "side_effect", at))
            else:
                imports.append((m.group("src"), "side_effect" if m.group("what").strip() == "*" else "named", at))
    elif language == "typescript":
        for m in _TS_IMPORT.finditer(text):
            clause = (m.group("clause") or "").strip()
            if m.group("req"):
                imports.append((m.group("req"), "require", line(m.start())))
                continue
            bare = re.sub(r"\{[^}]*\}", "", clause.removeprefix("type ")).strip(" ,\n\t")
            kind = "namespace" if "*" in clause else "default" if bare else "named" if "{" in clause else "side_effect"
            imports.append((m.group("src"), kind, line(first(m))))
        for m in _TS_EXPORT.finditer(text):
            at = line(first(m))
            if m.group("all"):
                exports.append((f"* from {m.group('all')}", at))
            elif m.group("one"):
                exports.append((f"default {m.group('one')}", at))
            else:
                names = ", ".join(x.split(" as ")[-1].strip() for x in m.group("names").split(",") if x.strip())
                exports.append((names + (f" from {m.group('src')}" if m.group("src") else ""), at))
    elif language == "go":
        for m in _GO_IMPORT.finditer(text):
            base = m.start("block") if m.group("block") is not None else m.start("one")
            for x in _GO_SPEC.finditer(m.group("block") or m.group("one") or ""):
                imports.append((x.group("src"), "namespace" if x.group("alias") else "side_effect", line(base + x.start())))
    elif language == "rust":
        for m in _LINE_IMPORT["rust"].finditer(text):
            at = line(first(m))
            if m.group("mod"):
                imports.append((m.group("mod"), "namespace", at))
            else:
                path = re.sub(r"\s+", " ", m.group("use")).strip()
                imports.append((path, "default", at))
                if m.group("pub"):
                    exports.append((path, at))
    else:
        kind = "named" if language == "java" else "require"
        for m in _LINE_IMPORT[language].finditer(text):
            source = m.group("src")
            imports.append((source.strip("\"'") if language == "bash" else source, kind, line(first(m))))
        if language == "bash":
            for m in _BASH_EXPORT.finditer(text):
                exports += [(x.split("=")[0], line(first(m))) for x in re.findall(r"[A-Za-z_]\w*(?:=(?:\"[^\"]*\"|'[^']*'|\S*))?", m.group("rest"))]
    return imports, exports


def split_lines(content: str) -> list[str]:
    """Lines without their ends; CRLF counts as a line feed, a final one opens no line."""
    lines = [x.removesuffix("\r") for x in content.split("\n")]
    return lines[:-1] if lines and lines[-1] == "" else lines


def bounded(lines: list[str], first: int, most_lines: int = MAX_CHUNK_LINES, most_bytes: int = MAX_CHUNK_BYTES) -> list[tuple[int, int]]:
    """Cuts a run of lines, preferably after its last blank line, into ranges within both limits.

    A segment ends before the line that would exceed a limit (a line costs its bytes and one more);
    what follows the blank line is carried over. A line beyond the limit stands alone.
    """
    out, start, size, blank = [], 0, 0, -1
    cost = [len(x.encode("utf-8", "surrogatepass")) + 1 for x in lines]
    i = 0
    while i < len(lines):
        if i > start and (i - start + 1 > most_lines or size + cost[i] > most_bytes):
            cut = blank + 1 if blank >= start and blank + 1 < i else i
            out.append((first + start, first + cut - 1))
            start, blank = cut, -1
            size = sum(cost[start:i])
            for j in range(start, i):
                if not lines[j].strip():
                    blank = j
            continue
        size += cost[i]
        if not lines[i].strip():
            blank = i
        i += 1
    if start < len(lines):
        out.append((first + start, first + len(lines) - 1))
    return out


def chunk_source(language: str, content: str) -> list[tuple[int, int, str, str, Symbol | None]]:
    """``(start, end, kind, body, symbol)``: one chunk per symbol range, and the rest as bounded module text."""
    lines = split_lines(content)
    total = len(lines)
    if not total:
        return []
    out, seen = [], set()
    covered = [False] * (total + 1)
    for s in symbols(language, "\n".join(lines)):
        a = min(max(1, s.start), total)
        b = min(max(a, s.end), total)
        if (a, b) in seen:
            continue
        seen.add((a, b))
        covered[a : b + 1] = [True] * (b - a + 1)
        out.append((a, b, s.kind, "\n".join(lines[a - 1 : b]), s))
    at = 1
    while at <= total:
        if covered[at]:
            at += 1
            continue
        stop = at
        while stop <= total and not covered[stop]:
            stop += 1
        out += [(a, b, "module", "\n".join(lines[a - 1 : b]), None) for a, b in bounded(lines[at - 1 : stop - 1], at)]
        at = stop
    return sorted(out, key=lambda x: (x[0], x[1]))


RECORDS = "record string, repo_id string, file_path string, language string, ord int, start_line int, end_line int, kind string, name string, signature string, body string, line int"


def _repo(files: DataFrame):
    return F.col("repo_id") if "repo_id" in files.columns else F.lit(None).cast("string").alias("repo_id")


def analyse(files: DataFrame, *, path_col: str = "rel_path", content_col: str = "content") -> DataFrame:
    """One pass over files of a known language; rows of ``record`` chunk, symbol, import or export.

    Equal rows count once. A path with several contents gives the records of each, and so do equal paths of two
    repositories (``repo_id``, null if there is no such column)."""
    rows = files.select(_repo(files), F.col(path_col).alias("path"), F.col(content_col).alias("content")).dropna(subset=["path", "content"])
    rows = rows.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isNotNull()).distinct()
    cols = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repo, path, content, language in zip(pdf["repo_id"], pdf["path"], pdf["content"], pdf["language"]):
                at = (repo, path, language)
                for k, (a, b, kind, body, s) in enumerate(chunk_source(language, content)):
                    out.append(("chunk", *at, k, a, b, kind, s.name if s else None, s.signature if s else None, body, a))
                    if s:
                        out.append(("symbol", *at, k, a, b, s.kind, s.name, s.signature, None, s.start))
                imports, exports = imports_exports(language, content.replace("\r\n", "\n"))
                out += [("import", *at, k, None, None, kind, source, None, None, line) for k, (source, kind, line) in enumerate(imports)]
                out += [("export", *at, k, None, None, None, detail, None, None, line) for k, (detail, line) in enumerate(exports)]
            df = pd.DataFrame(out, columns=cols)
            for c in ("ord", "start_line", "end_line", "line"):
                df[c] = df[c].astype("Int32")
            yield df

    return spread(rows, "path").mapInPandas(run, RECORDS)


def line_windows(files: DataFrame, *, path_col: str = "rel_path", content_col: str = "content", size: int = WINDOW_LINES, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Chunks ``(id, file_path, start_line, end_line, kind, body)`` of ``size`` lines that share ``overlap``; with
    ``repo_id`` in front if the files have one.

    Native: the lines are an array, the starts a sequence. The last window covers the tail; an empty
    file has none; CRLF counts as a line feed and a final one opens no line.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    lines = F.split(F.regexp_replace(F.regexp_replace(F.col(content_col), "\r\n", "\n"), r"\n\z", ""), "\n")
    repo = [F.col("repo_id")] if "repo_id" in files.columns else []
    rows = files.filter(F.col(content_col) != "").select(*repo, F.col(path_col).alias("file_path"), lines.alias("lines")).withColumn("n", F.size("lines"))
    last = F.greatest(F.lit(1), F.col("n") - overlap)
    starts = rows.select("*", F.explode(F.sequence(F.lit(1), last, F.lit(size - overlap))).alias("start_line"))
    end = F.least(F.col("n"), F.col("start_line") + size - 1)
    body = F.array_join(F.slice("lines", F.col("start_line"), F.lit(size)), "\n")
    return starts.select(*repo, chunk_id(F.col("file_path"), F.col("start_line"), end).alias("id"), "file_path", "start_line", end.alias("end_line"), F.lit("window").alias("kind"), body.alias("body"))


def chunk_files(files: DataFrame, *, path_col: str = "rel_path", content_col: str = "content") -> DataFrame:
    """Chunks ``(repo_id, id, file_path, start_line, end_line, kind, body)`` of all distinct files: by structure where
    the language is known, by windows elsewhere."""
    parsed = analyse(files, path_col=path_col, content_col=content_col).filter(F.col("record") == "chunk")
    known = parsed.select("repo_id", chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("id"), "file_path", "start_line", "end_line", "kind", "body")
    rest = files.select(_repo(files), F.col(path_col).alias("rel_path"), F.col(content_col).alias("content")).filter(language_of(F.col("rel_path")).isNull()).distinct()
    return known.unionByName(line_windows(rest))
