"""The surface of source code in nine languages: comments, strings, signatures and bodies.

Comments and strings are blanked first, so that signatures are found by regular expressions in code
only. A body is delimited by an indentation stack (Python), by a stack of opening words and ``end``
(Ruby) or by matching brackets (the other languages). Broken code gives what can be recognised.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

_DQ, _SQ = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)', r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
_DQ_LONG, _SQ_LONG = r'"(?:\\.|[^"\\])*(?:"|\Z)', r"'[^']*(?:'|\Z)"
_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_REGEX_AFTER = r"(?<=[=(,:!&|?{;+\[~])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\\\n\[])+/[a-z]*"
_HEREDOC = r"<<[~-]?(?P<q>['\"]?)(?P<h>[A-Za-z_]\w*)(?P=q)"


def _mask_pattern(comment: str, string: str) -> re.Pattern:
    return re.compile(f"(?P<c>{comment})|(?P<s>{string})", re.S | re.M)


MASKS = {
    "python": _mask_pattern(r"#[^\n]*", rf'"""(?:\\.|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\.|[^\\])*?(?:\'\'\'|\Z)|{_DQ}|{_SQ}'),
    "typescript": _mask_pattern(_C_COMMENT, rf"{_DQ}|{_SQ}|`(?:\\.|[^`\\])*(?:`|\Z)|{_REGEX_AFTER}"),
    "rust": _mask_pattern(_C_COMMENT, rf"\br(?P<r>#*)\".*?(?:\"(?P=r)|\Z)|{_DQ_LONG}|'(?:\\u\{{[^}}]*\}}|\\x..|\\.|[^\\'\n])'"),
    "go": _mask_pattern(_C_COMMENT, rf"{_DQ}|`[^`]*(?:`|\Z)|'(?:\\[^\n]|[^'\\\n])[^'\n]*'"),
    "java": _mask_pattern(_C_COMMENT, rf'"""(?:\\.|[^\\])*?(?:"""|\Z)|{_DQ}|{_SQ}'),
    "c": _mask_pattern(_C_COMMENT, rf"{_DQ}|(?<![0-9A-Fa-f]){_SQ}"),
    "cpp": _mask_pattern(_C_COMMENT, rf'\bR"(?P<r>[^()\\\s]{{0,16}})\(.*?(?:\)(?P=r)"|\Z)|{_DQ}|(?<![0-9A-Fa-f]){_SQ}'),
    "ruby": _mask_pattern(r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)|(?<![$?])#[^\n]*|^__END__$.*", rf"{_DQ_LONG}|'(?:\\.|[^'\\])*(?:'|\Z)|%[qQwWiI]?(?:\([^()]*\)|\[[^\[\]]*\]|\{{[^{{}}]*\}}|<[^<>]*>)|{_REGEX_AFTER}|{_HEREDOC}"),
    "bash": _mask_pattern(r"(?:^|(?<=[\s;&|(]))#[^\n]*", rf"\\.|\$'(?:\\.|[^'\\])*(?:'|\Z)|{_DQ_LONG}|{_SQ_LONG}|{_HEREDOC}"),
}
MASKS["javascript"] = MASKS["typescript"]

_BLANK = re.compile(r"[^\n]")

SIGNATURES = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)", re.M),
    "ruby": re.compile(r"^[ \t]*(?:(?:private|public|protected|module_function|private_class_method)[ \t]+)?def[ \t]+(?:\w+\.)?(?P<name>[A-Za-z_]\w*[?!=]?|[+\-*/%<>=!~\[\]]+)", re.M),
    "rust": re.compile(r"\bfn\s+(?P<name>\w+)"),
    "go": re.compile(r"^func\s*(?:\([^)]*\)\s*)?(?P<name>\w+)\s*(?=[\[(])", re.M),
    "bash": re.compile(r"^[ \t]*(?:function[ \t]+(?P<f>[\w:.-]+)[ \t]*(?:\([ \t]*\))?|(?P<name>[\w:.-]+)[ \t]*\([ \t]*\))\s*(?=[{(])", re.M),
}
_CALL = re.compile(r"(?P<name>[A-Za-z_$~][\w$]*(?:::~?\w+)*)\s*(?:<[^<>(){};]*>\s*)?\(")
_ASSIGNED = re.compile(r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s+)?(?:function\b|\()")
#: Words before a bracket that open no function.
_NOT_NAMES = frozenset(
    "if for while switch catch return sizeof new delete else do try throw synchronized super this function typeof await yield case in of instanceof assert defined alignof decltype static_assert __attribute__ noexcept throws with using namespace void match"
    .split()
)
_TAIL = {
    "java": re.compile(r"(?:\s|\[\]|throws\b[\w\s,.<>]*)*\{"),
    "c": re.compile(r"\s*\{"),
    "cpp": re.compile(r"(?:\s|const\b|noexcept\b(?:\([^()]*\))?|override\b|final\b|mutable\b|&&?|->\s*[\w:<>,\s*&]+|:\s*\w[^{};]*)*\{"),
    "typescript": re.compile(r"\s*(?::\s*(?:[^{};=]|=>|\{[^{}]*\}(?=[^{};]*\{))+)?\s*\{"),
}
_PREFIX = {
    "java": re.compile(r"(?:@[\w.]+(?:\s*\([^()]*\))?\s*|[\w.]+(?:\s*<[\w\s,.?<>&\[\]@]*>)?(?:\[\]|\.\.\.)*\s+|<[\w\s,.?<>&]*>\s*)*"),
    "c": re.compile(r"(?:(?:\[\[[^\]]*\]\]|[\w:]+(?:\s*<[\w\s,:*&<>]*>)?|template\s*<[^<>]*>)[\s*&]+)+"),
    "typescript": re.compile(r"(?:@[\w.]+(?:\s*\([^()]*\))?\s*|\b(?:public|private|protected|static|async|readonly|override|abstract|get|set|export|default|declare|function)\b\s*|\*\s*)*"),
}
_PREFIX["cpp"] = _PREFIX["c"]
_NO_PREFIX_WORD = re.compile(r"\b(?:return|new|throw|else|case|await|yield|in|of|goto|delete|typedef|enum|struct|class|union|interface|import|package|using|do)\b")
ANNOTATION = {
    "python": re.compile(r"\s*@"),
    "typescript": re.compile(r"\s*@\w"),
    "rust": re.compile(r"\s*#!?\["),
    "java": re.compile(r"\s*@\w"),
    "cpp": re.compile(r"\s*(?:template\s*<|\[\[)"),
    "c": re.compile(r"\s*(?:\[\[|__attribute__)"),
    "ruby": re.compile(r"\s*(?:sig\b|memoize\b)"),
}
_RUBY_WORD = re.compile(r"(?P<open>\b(?:def|class|module|begin|case|do)\b|(?:^|[;=(\[,{]|\|\||&&|\bthen\b|\belse\b|<<)[ \t]*(?:if|unless|while|until|for)\b)|(?P<end>\bend\b)", re.M)
_LOOP_DO = re.compile(r"^[ \t]*(?:while|until|for)\b[^\n]*?\bdo\b", re.M)


def mask(language: str, src: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """``src`` with comments and strings blanked (line feeds stay), and the spans of both."""
    pattern = MASKS[language]
    out, comments, strings = [], [], []
    at = 0
    waiting: list[str] = []  # ends of the heredocs that open on this line
    for_here = "h" in pattern.groupindex
    while True:
        m = pattern.search(src, at)
        line_end = src.find("\n", at) if waiting else -1
        if waiting and line_end >= 0 and (m is None or m.start() > line_end):
            out.append(src[at : line_end + 1])
            at = line_end + 1
            for word in waiting:
                stop = re.compile(rf"^[ \t]*{re.escape(word)}[ \t]*$", re.M).search(src, at)
                to = stop.end() if stop else len(src)
                out.append(_BLANK.sub(" ", src[at:to]))
                strings.append((at, to))
                at = to
            waiting = []
            continue
        if m is None:
            break
        a, b = m.span()
        if for_here and m.group("h"):
            waiting.append(m.group("h"))
        if language == "rust" and src.startswith("/*", a):  # comments nest
            depth, b = 0, len(src)
            for x in re.finditer(r"/\*|\*/", src[a:]):
                depth += 1 if x.group() == "/*" else -1
                if not depth:
                    b = a + x.end()
                    break
        blank = _BLANK.sub(" ", src[a:b])
        if language == "ruby" and b - a > 1 and m.group("c") is None and blank[-1] != "\n" and not m.group("h"):
            blank = f'"{blank[1:-1]}"'  # a value stands there: a word behind it is a modifier and opens nothing
        out += [src[at:a], blank]
        (comments if m.group("c") is not None else strings).append((a, b))
        at = b if b > a else a + 1
        if b == a:
            out.append(src[a : a + 1])
    out.append(src[at:])
    return "".join(out), comments, strings


def bracket_pairs(code: str) -> dict[int, int]:
    """Places of opening brackets and of those that close them."""
    stack, match = [], {}
    closes = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", code):
        ch = m.group()
        if ch in "([{":
            stack.append((ch, m.start()))
        elif any(x[0] == closes[ch] for x in stack[-4:]):
            while stack:
                o, i = stack.pop()
                if o == closes[ch]:
                    match[i] = m.start()
                    break
    return match


class Lines:
    """Line numbers, from 0, of places in a text, each found in logarithmic time."""

    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def at(self, i: int) -> int:
        return bisect.bisect_right(self.starts, max(0, i)) - 1


def line_start(s: str, i: int) -> int:
    return s.rfind("\n", 0, i) + 1


def _python_body(code: str, at: int, match: dict[int, int]) -> tuple[int, int]:
    """Where the body opens (after the colon) and ends, by a stack of indents that holds the signature's."""
    indent = len(re.match(r"[ \t]*", code[line_start(code, at) :]).group())
    i = code.find("(", at)
    i = match.get(i, i) if i >= 0 else at
    colon = code.find(":", i)
    opens = colon + 1 if colon >= 0 else len(code)
    end = code.find("\n", opens)
    if end < 0:
        return opens, len(code)
    pos, last = end + 1, end
    while pos < len(code):
        stop = code.find("\n", pos)
        stop = len(code) if stop < 0 else stop
        line = code[pos:stop]
        if line.strip():
            if len(line) - len(line.lstrip(" \t")) <= indent:
                break
            last = stop
        pos = stop + 1
    return opens, last


def ruby_loops(code: str) -> frozenset[int]:
    """Places of the ``do`` that belong to a loop, which has its own opening word."""
    return frozenset(m.end() - 2 for m in _LOOP_DO.finditer(code))


def ruby_end(code: str, at: int, loops: frozenset[int]) -> int:
    """End of the body that opens at ``at``, by a stack of opening words and ``end``."""
    stop = code.find("\n", at)
    line = code[at : stop if stop >= 0 else len(code)]
    if re.search(r"\)\s*=\s*\S|def\s+[\w.?!]+\s*=\s+\S", line):  # a body without end
        return at + len(line)
    depth = 0
    for m in _RUBY_WORD.finditer(code, at):
        if m.group("open"):
            before = code[m.start() - 1 : m.start()]
            if before in ".:" and before or code[m.end() : m.end() + 1] == ":" or m.end() - 2 in loops and m.group("open") == "do":
                continue
            depth += 1
        elif code[m.start() - 1 : m.start()] not in (".", ":"):
            depth -= 1
            if not depth:
                return m.end()
    return len(code)


def named_bodies(language: str, code: str, match: dict[int, int]) -> Iterator[tuple[str, int, int, int]]:
    """``(name, start, body's start, end)`` of every function with a body, in order of their starts."""
    if language == "python":
        for m in SIGNATURES[language].finditer(code):
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            opens, end = _python_body(code, m.end(), match)
            yield m.group("name"), at, opens, end
    elif language == "ruby":
        loops = ruby_loops(code)
        for m in SIGNATURES[language].finditer(code):
            d = code.index("def", m.start())
            yield m.group("name"), m.start() + len(m.group()) - len(m.group().lstrip()), m.end(), ruby_end(code, d, loops)
    elif language in ("rust", "go", "bash"):
        for m in SIGNATURES[language].finditer(code):
            if language == "bash":
                yield m.group("name") or m.group("f"), m.start() + len(m.group()) - len(m.group().lstrip()), m.end(), match.get(m.end(), len(code) - 1) + 1
                continue
            i = code.find("(", m.end())
            if i < 0 or i not in match:
                continue
            opens = re.compile(r"[{;]").search(code, match[i])
            if language == "go":  # the braces of types among the results aren't the body's
                opens = re.compile(r"(?:\b(?:struct|interface)\s*\{[^{}]*\}|[^{};\n]|\n(?=[^\n]*\)))*\{").match(code, match[i] + 1)
                if not opens:
                    continue
                b = opens.end() - 1
            else:
                if not opens or opens.group() == ";":
                    continue
                b = opens.start()
            start = line_start(code, m.start())
            start += len(code[start:]) - len(code[start:].lstrip())
            yield m.group("name"), min(start, m.start()), b + 1, match.get(b, len(code) - 1) + 1
    else:
        yield from _braced("typescript" if language == "javascript" else language, code, match)


def _braced(language: str, code: str, match: dict[int, int]) -> Iterator[tuple[str, int, int, int]]:
    found = []
    tail, prefix = _TAIL[language], _PREFIX[language]
    for m in _CALL.finditer(code):
        name, paren = m.group("name"), m.end() - 1
        if name in _NOT_NAMES or paren not in match:
            continue
        after = tail.match(code, match[paren] + 1)
        if not after:
            continue
        # the statement opens after the last boundary that is outside brackets
        back = m.start() - 1
        while back >= 0 and code[back] not in ";{}":
            back -= 1
        lead = re.sub(r"(?m)^[ \t]*#[^\n]*(?:\\\n[^\n]*)*", lambda x: " " * len(x.group()), code[back + 1 : m.start()])
        lead = re.sub(r"\b(?:public|private|protected)\s*:(?!:)|\b(?:default|case\b[^:\n]*)\s*:", lambda x: " " * len(x.group()), lead)
        start = back + 1 + len(lead) - len(lead.lstrip())
        head = lead.strip()
        head = f"{head} " if head else ""
        if not prefix.fullmatch(head) or _NO_PREFIX_WORD.search(re.sub(r"\btemplate\s*<[^<>]*>", "", head)):
            continue
        if language in ("c", "cpp") and not head or language == "java" and re.search(r"\brecord\s*$", head):
            continue
        if language == "java" and not re.search(r"[\w>\]]\s*$", re.sub(r"@[\w.]+(?:\s*\([^()]*\))?", "", head)) and not name[0].isupper():
            continue
        b = after.end() - 1
        found.append((name.rpartition("::")[2], min(start, m.start()), b + 1, match.get(b, len(code) - 1) + 1))
    if language == "typescript":
        for m in _ASSIGNED.finditer(code):
            i = code.find("(", m.end() - 1)
            after = re.compile(r"\s*(?::[^{};=]+)?(?:=>)?\s*\{").match(code, match[i] + 1) if i in match else None
            if after and (code[m.end() - 1] != "(" or "=>" in after.group()):
                start = line_start(code, m.start())
                start += len(code[start:]) - len(code[start:].lstrip())
                b = after.end() - 1
                found.append((m.group("name"), min(start, m.start()), b + 1, match.get(b, len(code) - 1) + 1))
    yield from sorted(found, key=lambda x: x[2])
