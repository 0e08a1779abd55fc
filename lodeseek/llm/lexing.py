"""Token streams of nine programming languages.

``tokenize(language, source)`` gives a list of ``(kind, start, end)``. Keywords and operators are
their own kind; the other kinds are ID, NUM, STR, LABEL and the like. Comments have the kind ``#``
and whatever no token can start with, or that is never closed, the kind ``!``. Line structure is
made explicit where it matters to the grammar: NL, INDENT and DEDENT tokens have no text.
"""

from __future__ import annotations

import re
from functools import lru_cache

COMMENT, ERROR, NEWLINE = "#", "!", "NL"

Token = tuple[str, int, int]

LANGUAGES = ("python", "typescript", "rust", "go", "java", "c", "cpp", "ruby", "bash")


def _words(s: str) -> frozenset[str]:
    return frozenset(s.split())


# The reserved words of each language.
KEYWORDS = {
    "python": _words("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"),
    "typescript": _words("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let async await of as type interface namespace module declare abstract readonly public private protected static get set is keyof infer implements satisfies yield from asserts override accessor unique"),
    "rust": _words("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union"),
    "go": _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"),
    "java": _words("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record yield sealed permits var"),
    "c": _words("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while"),
    "cpp": _words("alignas alignof auto bool break case catch char class const constexpr const_cast continue decltype default delete do double dynamic_cast else enum explicit extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this throw true try typedef typeid typename union unsigned using virtual void volatile while final override co_await co_return co_yield concept requires"),
    "ruby": _words("BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield"),
    "bash": _words("if then elif else fi for while until do done case esac function select time in { } ! [["),
}

_OPERATORS = {
    "python": "**= //= >>= <<= ... -> := ** // << >> <= >= == != += -= *= /= %= &= |= ^= @=",
    "typescript": "... === !== **= <<= &&= ||= ??= => == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << ?? ?. **",
    "rust": "... ..= <<= :: -> => == != <= >= && || += -= *= /= %= &= |= ^= << ..",
    "go": "<<= >>= &^= ... := <- && || == != <= >= ++ -- += -= *= /= %= &= |= ^= << >> &^",
    "java": "... <<= :: -> == != <= >= && || ++ -- += -= *= /= %= &= |= ^= <<",
    "c": "... <<= >>= -> == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << >> ##",
    "cpp": "... <=> ->* <<= :: -> .* == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << ##",
    "ruby": "**= <=> === <<= >>= &&= ||= ... :: => -> == != =~ !~ <= >= && || &. += -= *= /= %= &= |= ^= << >> .. **",
}

_STRING = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"
_SLASHES = r"(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)"
_NUMBER = r"(?P<NUM>0[xXbBoO][0-9A-Fa-f_']+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?\w*|(?:\d[\d_']*(?:\.(?![.\w])|\.\d[\d_']*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[A-Za-z_]*\d*(?!\w))"
_NAME = r"(?P<ID>[^\W\d][\w$]*|\$[\w$]*)"


@lru_cache(maxsize=None)
def _master(language: str) -> re.Pattern:
    ops = "|".join(map(re.escape, _OPERATORS[language].split())) + r"|[-+*/%&|^~!=<>?:.,;@(){}\[\]]"
    if language == "python":
        head = [r"(?P<comment>\#[^\n]*)", r"(?P<join>\\\r?\n)", r"(?P<STR>(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|(?!\"\"\"|''')(?:" + _STRING + "|" + _SINGLE + ")))"]
    elif language == "typescript":
        head = [_SLASHES, "(?P<STR>" + _STRING + "|" + _SINGLE + ")", r"(?P<PRIVATE>\#[^\W\d][\w$]*)"]
    elif language == "rust":
        head = [r"(?P<comment>//[^\n]*)", r"(?P<open>/\*)", r'(?P<STR>b?r(?P<hash>\#*)"[\s\S]*?"(?P=hash)|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?\'(?:[^\'\\\n]|\\(?:[^u\n]|u\{[^}\n]*\}|x..))\')', r"(?P<LIFE>'[^\W\d]\w*)", r"(?P<raw>r\#(?=[^\W\d]))", r"(?P<HASH>\#)"]
    elif language == "go":
        head = [_SLASHES, "(?P<STR>" + _STRING + r"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,9}?)')"]
    elif language == "java":
        head = [_SLASHES, r'(?P<STR>"""[ \t]*\r?\n(?:[^\\]|\\[\s\S])*?"""|(?!"""[ \t]*\r?\n)' + _STRING + "|" + _SINGLE + ")"]
    elif language in ("c", "cpp"):
        raw = r'|(?:u8|[uUL])?R"(?P<mark>[^\s()\\]{0,16})\([\s\S]*?\)(?P=mark)"' if language == "cpp" else ""
        head = [_SLASHES, "(?P<STR>(?:u8|[uUL])?(?:" + _STRING + "|" + _SINGLE + ")" + raw + ")", r"(?P<DIRECTIVE>\#(?!\#)(?:[^\n\\/]|\\\r?\n|\\|/(?!\*)|/\*[\s\S]*?\*/)*)"]
    else:
        raise KeyError(language)
    # blanks in front of a token belong to its match, so that one match is one token
    return re.compile(r"[ \t\r\f\v﻿]*(?:" + "|".join([r"(?P<nl>\n)", *head, _NUMBER, _NAME, f"(?P<OP>{ops})", r"(?P<bad>[\s\S])", r"(?P<stop>\Z)"]) + ")")


def _skip_nested(src: str, at: int) -> int:
    """End of a nested block comment that opens at ``at``, or -1."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(src, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


# Tokens after which a slash divides rather than opening a pattern.
_ENDS_VALUE = _words("ID NUM STR ) ] } this super null true false TPL TPLEND ++ -- PRIVATE REGEX")
_TS_LINE_END = _words("ID NUM STR ) ] } > this super null true false TPL TPLEND ++ -- PRIVATE REGEX return break continue debugger yield from of as type get set is static async readonly declare")
_TS_LINE_START_NOT = _words(") ] } . , ; ? ?. : = => == != === !== <= >= < > && || ?? + - * / % & | ^ ** += -= *= /= instanceof in else catch finally extends implements as satisfies { [ ( TPL TPLHEAD")
_GO_LINE_END = _words("ID NUM STR break continue fallthrough return ++ -- ) ] }")


_TS_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")


def _brace_languages(language: str, src: str) -> list[Token]:
    keywords = KEYWORDS[language]
    tokens, out, n = _master(language).finditer, [], len(src)
    put = out.append
    last, pending = "", True
    ts, go = language == "typescript", language == "go"
    braces: list[bool] = []  # per open brace whether it belongs to a template
    at = 0
    if src.startswith("#!"):
        at = src.find("\n") if "\n" in src else n
        put((COMMENT, 0, at))
    again = True
    while again:
        again = False  # unless a token ends elsewhere than its match
        for m in tokens(src, at):
            kind = m.lastgroup
            if kind == "nl":
                if go and last in _GO_LINE_END:
                    start = m.start("nl")
                    put((";", start, start))
                    last = ";"
                pending = True
                continue
            if kind == "stop":
                break
            if kind in ("hash", "mark"):
                kind = "STR"
            start, end = m.span(kind)
            if kind == "ID":
                word = src[start:end]
                kind = word if word in keywords else "ID"
            elif kind == "OP":
                kind = src[start:end]
                if ts:
                    if kind == "/" or kind == "/=":
                        if last not in _ENDS_VALUE and (r := _TS_REGEX.match(src, start)):
                            kind, at, again = "REGEX", r.end(), True
                    elif kind == "{":
                        braces.append(False)
                    elif kind == "}" and braces and braces.pop():
                        kind, at = _template(src, end, "TPLMID", "TPLEND")
                        again = True
                        if kind == "TPLMID":
                            braces.append(True)
            elif kind == "comment":
                if "\n" in m.group():
                    if go and last in _GO_LINE_END:
                        put((";", start, start))
                        last = ";"
                    pending = True
                put((COMMENT, start, end))
                continue
            elif kind == "open":
                at = _skip_nested(src, start)
                if at < 0:
                    put((ERROR, start, n))
                    return out
                put((COMMENT, start, at))
                again = True
                break
            elif kind == "raw":
                continue
            elif kind == "DIRECTIVE":
                if pending:
                    put((COMMENT, start, end))
                    continue
                kind, at, again = ERROR, start + 1, True  # only white space and comments go before a directive on its line
            elif kind == "bad":
                kind = ERROR
                if ts and src[start] == "`":
                    kind, at = _template(src, end, "TPLHEAD", "TPL")
                    again = True
                    if kind == "TPLHEAD":
                        braces.append(True)
            if again:
                end = at
            if ts and pending and last in _TS_LINE_END and kind not in _TS_LINE_START_NOT and not (kind == "while" and last == "}"):
                put((NEWLINE, start, start))
            pending = False
            put((kind, start, end))
            last = kind
            if again:
                break
    if go and last in _GO_LINE_END:
        put((";", n, n))
    return out


def _template(src: str, at: int, more: str, done: str) -> tuple[str, int]:
    m = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*").match(src, at)
    at = m.end()
    if src.startswith("`", at):
        return done, at + 1
    if src.startswith("${", at):
        return more, at + 2
    return ERROR, len(src)


_INDENT = re.compile(r"[ \t\f﻿]*")
_ODD_NUMBER = re.compile(r"[\d.][\d._]*[A-Za-z]")
_PYTHON_NUMBER = re.compile(r"(?i)0x[\da-f_]+|0b[01_]+|0o[0-7_]+|[\d_.]+(?:e[+-]?[\d_]+)?j?")


def _python(src: str) -> list[Token]:
    keywords = KEYWORDS["python"]
    tokens, out, at, n = _master("python").finditer, [], 0, len(src)
    put = out.append
    depth, indents = 0, [0]
    again = True
    fresh = True
    while again:
        again = False
        if not depth:  # the white space that opens a logical line
            m = _INDENT.match(src, at)
            text = m.group()
            width = len(text)
            if not text.isspace() or text.strip(" "):
                width = 0
                for ch in text:
                    width = (width // 8 + 1) * 8 if ch == "\t" else 0 if ch == "\f" else width + (ch == " ")
            at = m.end()
            if at < n and src[at] not in "#\r\n":
                if width > indents[-1]:
                    indents.append(width)
                    put(("INDENT", at, at))
                while width < indents[-1]:
                    indents.pop()
                    put(("DEDENT", at, at))
                if width != indents[-1]:
                    put((ERROR, at, at + 1))
                    indents.append(width)
                fresh = False
            elif at >= n:
                break
        for m in tokens(src, at):
            kind = m.lastgroup
            if kind == "stop":
                break
            start, end = m.span(kind)
            if kind == "nl":
                if not depth:
                    if not fresh:
                        put((NEWLINE, start, start))
                        fresh = True
                    at, again = end, True
                    break
            elif kind == "ID":
                word = src[start:end]
                put((word if word in keywords else "ID", start, end))
            elif kind == "OP":
                op = src[start:end]
                if op in "([{":
                    depth += 1
                elif op in ")]}":
                    depth = max(0, depth - 1)
                put((op if op not in "?" else ERROR, start, end))
            elif kind == "join":
                pass
            elif kind == "comment":
                put((COMMENT, start, end))
            elif kind == "bad":
                put((ERROR, start, end))
            elif kind == "NUM" and _ODD_NUMBER.match(src, start) and not _PYTHON_NUMBER.fullmatch(src, start, end):
                put((ERROR, start, end))
            else:
                put((kind, start, end))
    if depth:  # the text ends inside a bracket
        return out
    if not fresh:
        put((NEWLINE, n, n))
    out += [("DEDENT", n, n)] * (len(indents) - 1)
    return out


_RUBY = re.compile(
    r"(?P<nl>\r?\n)|(?P<space>[ \t\r\f]+)|(?P<comment>\#[^\n]*)|(?P<join>\\\r?\n)|(?P<doc>(?:(?<=\n)|(?<![\s\S]))=begin\b[\s\S]*?\n=end[^\n]*)|(?P<end_>(?:(?<=\n)|(?<![\s\S]))__END__\r?\n[\s\S]*)"
    r"|(?P<heredoc><<[~-]?(?P<q>[\"'`]?)(?P<tag>[A-Z_][A-Za-z_0-9]*)(?P=q))"
    r"|(?P<LABEL>[^\W\d]\w*[?!]?:(?!:)|\"[^\"\n\\]*\":(?!:))|(?P<SYM>:(?:[^\W\d]\w*[?!=]?(?![=~>])|[^\W\d]\w*[?!]?|\"(?:[^\"\\]|\\.)*\"|\[\]=?|<=>|===?|=~|[+\-*/%<>!~^&|]+))"
    r"|(?P<NUM>0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]?(?!\w))"
    r"|(?P<IVAR>@{1,2}[^\W\d]\w*|\$(?:[^\W\d]\w*|\d+|[!@&~_.,/\;<>$?:\"]))|(?P<ID>defined\?|[^\W\d]\w*(?:[?!](?![=~])|[?!](?===))?)"
    r"|(?P<OP>\*\*=|<=>|===|<<=|>>=|&&=|\|\|=|\.\.\.|::|=>|->|==|!=|=~|!~|<=|>=|&&|\|\||&\.|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\.\.|\*\*|[-+*/%&|^~!=<>?:.,;(){}\[\]])|(?P<bad>[\s\S])"
)
_RUBY_VALUE = _words("ID CONST NUM STR SYM IVAR ) ] } end self nil true false REGEX")
_RUBY_GOES_ON = _words(", . &. :: && || + - * / % & | ^ = == != === =~ !~ <= >= < > << >> .. ... ** += -= *= /= ||= &&= => -> ? : ! ~ and or not ( [ { LABEL NL ;") | {""}
_CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def _ruby_quoted(src: str, at: int, close: str, opener: str = "", interpolate: bool = True) -> int:
    """Position after the end of a quoted literal whose text begins at ``at``, or -1."""
    depth, n = 0, len(src)
    while at < n:
        ch = src[at]
        if ch == "\\":
            at += 2
            continue
        if interpolate and ch == "#" and src.startswith("#{", at):
            nest, at = 1, at + 2
            while at < n and nest:
                if src[at] in "\"'":
                    at = _ruby_quoted(src, at + 1, src[at])
                    if at < 0:
                        return -1
                    continue
                nest += (src[at] == "{") - (src[at] == "}")
                at += 1
            continue
        if ch == close and not depth:
            return at + 1
        if opener and ch == opener:
            depth += 1
        elif ch == close:
            depth -= 1
        at += 1
    return -1


def _ruby(src: str) -> list[Token]:
    keywords = KEYWORDS["ruby"]
    out: list[Token] = []
    at, n, last, stack = 0, len(src), "", []
    waiting: list[tuple[str, bool]] = []
    spaced = True
    while at < n:
        ch = src[at]
        value = last in _RUBY_VALUE
        end = 0
        if ch in "\"'`":
            m = _RUBY.match(src, at) if ch == '"' else None
            if m and m.lastgroup == "LABEL" and last in ("{", ",", "(", "NL", "ID"):
                out.append(("LABEL", at, m.end()))
                last, at, spaced = "LABEL", m.end(), False
                continue
            end = _ruby_quoted(src, at + 1, ch, interpolate=ch != "'")
            kind = "STR"
        elif ch == "%" and (not value or (spaced and last == "ID" and at + 1 < n and src[at + 1] not in " =")):
            m = re.compile(r"%([wWiIqQrsx]?)([(\[{<|!/])").match(src, at)
            if m:
                end = _ruby_quoted(src, m.end(), _CLOSERS.get(m[2], m[2]), m[2] if m[2] in _CLOSERS else "", m[1] not in ("w", "i", "q", "s"))
                kind = "REGEX" if m[1] == "r" else "STR"
        elif ch == "/" and (not value or (last == "ID" and spaced and at + 1 < n and src[at + 1] not in " =")):
            end = _ruby_quoted(src, at + 1, "/")
            if end > 0:
                end = re.compile(r"[a-z]*").match(src, end).end()
            kind = "REGEX"
        elif ch == "?" and not value:
            m = re.compile(r"\?(?:\\.|[^\s\\])(?!\w)").match(src, at)
            if m:
                kind, end = "STR", m.end()
        if end:
            if end < 0:
                out.append((ERROR, at, n))
                return out
            out.append((kind, at, end))
            last, at, spaced = kind, end, False
            continue
        m = _RUBY.match(src, at)
        kind, end = m.lastgroup, m.end()
        if kind == "tag" or m.group("heredoc"):
            if value and not (last == "ID" and spaced):
                kind, end = "OP", at + 2
            else:
                waiting.append((m["tag"], m["heredoc"][2] in "~-"))
                out.append(("STR", at, end))
                last, at, spaced = "STR", end, False
                continue
        if kind in ("space", "join"):
            spaced = True
            at = end
            continue
        if kind == "nl":
            for tag, loose in waiting:
                h = re.compile(rf"^{'[ ]*' if loose else ''}{tag}[ \t]*\r?$".replace("[ ]", "[ \\t]"), re.M).search(src, end)
                if not h:
                    out.append((ERROR, at, n))
                    return out
                end = min(n, h.end() + 1)
            waiting = []
            if last not in _RUBY_GOES_ON and not (stack and stack[-1] in "(["):
                if not re.compile(r"(?:[ \t\r\n]|#[^\n]*\n)*(?:\.(?!\.)|&\.)").match(src, end):
                    out.append((NEWLINE, at, at))
                    last = NEWLINE
            elif last == "|" and stack and stack[-1] == "{" or last == "|":  # the end of block parameters
                out.append((NEWLINE, at, at))
                last = NEWLINE
            at, spaced = end, True
            continue
        if kind in ("comment", "doc", "end_"):
            out.append((COMMENT, at, end))
            at = end
            continue
        if kind == "LABEL" and last == "?":
            m2 = re.compile(r"[^\W\d]\w*[?!]?").match(src, at)
            kind, end = "ID", m2.end()
        if kind == "ID":
            word = src[at:end]
            if last in (".", "&.") or (last == "def" and word in keywords and word != "self"):
                kind = "ID"
            elif word in keywords:
                kind = word
            elif word[0].isupper():
                kind = "CONST"
        elif kind == "OP":
            kind = src[at:end]
            if kind in "([{":
                if kind == "(" and not spaced and last in ("ID", "CONST", "super", "yield", "]", ")", "!"):
                    kind = "CALL("
                if kind == "[" and not spaced and last in _RUBY_VALUE:
                    kind = "AT["
                stack.append(src[at])
            elif kind in ")]}" and stack:
                stack.pop()
            elif kind in ("*", "&", "**", "-", "::", "+") and spaced and last == "ID" and end < n and not src[end].isspace():
                kind = "ARG" + kind
            elif kind == "&" and last in ("(", "CALL(", ",") or kind in ("*", "**") and last in ("(", "CALL(", ",", "[", "AT[", "|", "NL", ""):
                kind = "ARG" + kind
        elif kind == "bad":
            kind = ERROR
        out.append((kind, at, end))
        last, at, spaced = kind, end, False
    if waiting:
        out.append((ERROR, n, n))
    out.append((NEWLINE, n, n))
    return out


_BASH_OP = re.compile(r"(?P<op>;;&|;;|;&|;|&&|\|\||\|&|\||&>>|&>|&(?![>\d])|\(\(|\(|\))|(?P<redir>(?:\d+|\{\w+\})?(?:<<<|<<-?|<>|<&|<|>>|>&|>\||>)(?!\())")
_BASH_PLAIN = re.compile(r"[^\s\"'`$\;&|<>()#]+|#")


class _Bash:
    """Words are taken whole, with their quotes and expansions; ``$(`` ``)`` bodies are kept aside to be read on their own."""

    def __init__(self, src: str):
        self.src, self.n, self.inner = src, len(src), []

    def balanced(self, at: int, open_: str, close: str) -> int:
        """After the bracket that closes the one before ``at``, or -1."""
        depth, src = 1, self.src
        while at < self.n:
            ch = src[at]
            if ch == "\\":
                at += 2
                continue
            if ch in "\"'`" or ch == "$":
                if ch == "'" and open_ == "((":
                    at += 1
                    continue
                nxt = self.piece(at)
                if nxt < 0:
                    return -1
                at = nxt
                continue
            if ch == "#" and open_ == "(" and src[at - 1] in " \t\n(;":
                nl = src.find("\n", at)
                if nl < 0:
                    return -1
                at = nl
                continue
            if ch == open_[0]:
                depth += 1
            elif ch == close[0]:
                depth -= 1
                if not depth:
                    return at + 1
            at += 1
        return -1

    def piece(self, at: int) -> int:
        """After the quoted string or expansion that begins at ``at``, or -1."""
        src = self.src
        ch = src[at]
        if ch == "'":
            end = src.find("'", at + 1)
            return end + 1 if end >= 0 else -1
        if ch == "`":
            at += 1
            while at < self.n and src[at] != "`":
                at += 2 if src[at] == "\\" else 1
            return at + 1 if at < self.n else -1
        if ch == '"':
            at += 1
            while at < self.n:
                c = src[at]
                if c == "\\":
                    at += 2
                elif c == '"':
                    return at + 1
                elif c in "$`":
                    at = self.piece(at)
                    if at < 0:
                        return -1
                else:
                    at += 1
            return -1
        if src.startswith("$((", at):
            end = self.balanced(at + 3, "(", ")")
            if end >= 0 and src.startswith(")", end):
                return end + 1
        if src.startswith("$(", at):
            end = self.balanced(at + 2, "(", ")")
            if end >= 0:
                self.inner.append((at + 2, end - 1))
            return end
        if src.startswith("${", at):
            return self.balanced(at + 2, "{", "}")
        if src.startswith("$'", at):
            at += 2
            while at < self.n and src[at] != "'":
                at += 2 if src[at] == "\\" else 1
            return at + 1 if at < self.n else -1
        if src.startswith('$"', at):
            return self.piece(at + 1)
        m = re.compile(r"\$(?:[^\W\d]\w*|[\d@*#?$!_-]?)").match(src, at)
        return m.end()

    def tokens(self) -> list[Token]:
        src, n, out, at = self.src, self.n, [], 0
        keywords = KEYWORDS["bash"]
        waiting: list[str] = []
        want_tag = False
        tests = 0
        while at < n:
            ch = src[at]
            if ch in " \t\r":
                at += 1
                continue
            if src.startswith("\\\n", at) or src.startswith("\\\r\n", at):
                at += 2
                continue
            if ch == "\n":
                out.append((NEWLINE, at, at))
                at += 1
                for tag in waiting:
                    m = re.compile(rf"^\t*{re.escape(tag)}\r?$", re.M).search(src, at)
                    if not m:
                        at = n
                        break
                    at = min(n, m.end() + 1)
                waiting = []
                continue
            if ch == "#":
                end = src.find("\n", at)
                end = n if end < 0 else end
                out.append((COMMENT, at, end))
                at = end
                continue
            m = _BASH_OP.match(src, at)
            if m and not (ch in "<>" and src.startswith("(", at + 1)):
                if m["redir"]:
                    if tests and m["redir"] in "<>":
                        out.append(("WORD", at, m.end()))
                    else:
                        here = m["redir"].lstrip("0123456789")
                        if here in ("<<", "<<-"):
                            want_tag = True
                        out.append(("REDIR", at, m.end()))
                    at = m.end()
                    continue
                op, end = m["op"], m.end()
                if op == "((":
                    close = self.balanced(at + 2, "(", ")")
                    if close >= 0 and src.startswith(")", close):
                        out.append(("ARITH", at, close + 1))
                        at = close + 1
                        continue
                    op, end = "(", at + 1
                if op in ("&>", "&>>"):
                    op = "REDIR"
                out.append((op, at, end))
                at = end
                continue
            start, plain = at, True
            while at < n:
                c = src[at]
                if c in " \t\r\n;&|":
                    break
                if c in "<>":
                    if src.startswith("(", at + 1) and at == start:
                        at = self.balanced(at + 2, "(", ")")
                        plain = False
                        if at < 0:
                            break
                        continue
                    break
                if c in "()":
                    word = src[start:at]
                    if c == "(" and plain and re.fullmatch(r"[^\W\d]\w*(?:\[[^\]]*\])?\+?=", word):  # an array
                        at = self.balanced(at + 1, "(", ")")
                        if at < 0:
                            break
                        continue
                    if c == "(" and word[-1:] in "?*+@!" and word and plain:  # an extended pattern
                        at = self.balanced(at + 1, "(", ")")
                        if at < 0:
                            break
                        continue
                    break
                if c == "\\":
                    at += 2
                    continue
                if c in "\"'`$":
                    at = self.piece(at)
                    plain = False
                    if at < 0:
                        break
                    continue
                m = _BASH_PLAIN.match(src, at)
                at = m.end() if m else at + 1
            if at < 0:
                out.append((ERROR, start, n))
                return out
            at = min(at, n)
            word = src[start:at]
            if want_tag:
                waiting.append(re.sub(r"[\"'\\]", "", word))
                want_tag = False
            if word == "[[":
                tests += 1
                out.append(("[[", start, at))
            elif word == "]]" and tests:
                tests -= 1
                out.append(("]]", start, at))
            elif plain and word in keywords:
                out.append((word, start, at))
            elif re.match(r"[^\W\d]\w*(?:\[[^\]]*\])?\+?=", word):
                out.append(("ASSIGN", start, at))
            else:
                out.append(("WORD", start, at))
        out.append((NEWLINE, n, n))
        return out


def bash_parts(src: str) -> list[list[Token]]:
    """Tokens of the script, then those of each command substitution, however deep."""
    lexer = _Bash(src)
    out = [lexer.tokens()]
    for a, b in set(lexer.inner):
        body = _Bash(src[a:b])
        out.append([(k, s + a, e + a) for k, s, e in body.tokens()])
    return out


def tokenize(language: str, src: str) -> list[Token]:
    if language == "python":
        return _python(src)
    if language == "ruby":
        return _ruby(src)
    if language == "bash":
        return _Bash(src).tokens()
    return _brace_languages(language, src)


def masked(src: str, tokens: list[Token], keep_strings: bool = False) -> str:
    """``src`` with comments and strings blanked out, line feeds kept."""
    out, at = [], 0
    for kind, a, b in tokens:
        if kind == COMMENT or (kind in ("STR", "TPL", "REGEX") and not keep_strings):
            out += [src[at:a], re.sub(r"[^\n]", " ", src[a:b])]
            at = b
    out.append(src[at:])
    return "".join(out)
