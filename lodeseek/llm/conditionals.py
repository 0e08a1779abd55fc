"""Conditional directives of C and C++.

A file stands for many programs, one per choice of its conditions. ``Conditionals`` gives token streams of
consistent choices such that every branch is part of one, except those that are never compiled: branches
whose condition is constantly false, or that follow a constantly true one. Conditions are compared by their
text, ``defined``, ``!``, ``&&`` and ``||`` are understood, ``#define`` and ``#undef`` are followed. Where
nothing is known a condition holds, so that the first stream reads the first branch of every conditional.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from lodeseek.llm.lexing import COMMENT, Token

_DIRECTIVE = re.compile(r"\s*#\s*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|define|undef|error)\b((?:[^\\]|\\[\s\S])*)")
_DROPPED = re.compile(r"\\\n|/\*[\s\S]*?\*/|//[^\n]*")
_INTEGER = re.compile(r"\b(0[xX][\da-fA-F]+|0[bB][01]+|\d+)[uUlLzZ]*\b")


def _condition(word: str, rest: str, language: str) -> ast.expr | str:
    """The condition of a branch as a tree, or its text where it has no simple form."""
    text = " ".join(_DROPPED.sub(" ", rest).split())
    if word.endswith("def"):
        name = re.match(r"\w*", text)[0]
        text = f"!defined({name})" if word.endswith("ndef") else f"defined({name})"
    text = re.sub(r"\bdefined\s+(\w+)", r"defined(\1)", text)
    if language == "c":  # an identifier that is no macro counts as 0
        text = re.sub(r"(?<!defined\()\b__cplusplus\b", "0", text)
    form = re.sub(r"!(?!=)", " not ", text.replace("&&", " and ").replace("||", " or "))
    form = _INTEGER.sub(lambda m: str(int(m[1], 8 if re.fullmatch(r"0[0-7]+", m[1]) else 10 if m[1].isdigit() else 0)) if not re.fullmatch(r"0\d*[89]\d*", m[1]) else m[0], form)
    try:
        return ast.parse(form.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return text


def _key(c: ast.expr | str) -> str:
    return c if isinstance(c, str) else ast.unparse(c)


def _value(c: ast.expr | str, known: dict[str, bool]) -> bool | None:
    got = known.get(_key(c))
    if got is not None or isinstance(c, str):
        return got
    if isinstance(c, ast.Constant):
        return bool(c.value)
    if isinstance(c, ast.UnaryOp) and isinstance(c.op, ast.Not):
        v = _value(c.operand, known)
        return None if v is None else not v
    if isinstance(c, ast.BoolOp):
        parts = [_value(v, known) for v in c.values]
        decides = isinstance(c.op, ast.Or)
        return decides if decides in parts else None if None in parts else not decides
    if isinstance(c, ast.Compare) and len(c.ops) == 1 and isinstance(c.left, ast.Constant) and isinstance(c.comparators[0], ast.Constant):
        a, b = c.left.value, c.comparators[0].value
        table = {ast.Eq: a == b, ast.NotEq: a != b, ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}
        return table.get(type(c.ops[0]))
    return None


def _assume(c: ast.expr | str, value: bool, known: dict[str, bool]) -> None:
    if isinstance(c, ast.Constant):
        return
    if isinstance(c, ast.UnaryOp) and isinstance(c.op, ast.Not):
        _assume(c.operand, not value, known)
    elif isinstance(c, ast.BoolOp) and isinstance(c.op, ast.And) == value:
        for part in c.values:
            _assume(part, value, known)
    else:
        known[_key(c)] = value


class _Branch:
    def __init__(self, condition, group: "_Group", directive: Token, at: int):
        self.condition, self.group, self.at, self.directive = condition, group, at, directive
        self.items: list = []  # positions of tokens, groups, ("define", name, whether)
        self.error = self.text = False


class _Group:
    def __init__(self, parent: _Branch):
        self.parent, self.branches, self.closed = parent, [], False


class Conditionals:
    """The tokens of a file as a tree of its conditionals; ``bad`` is the first directive out of place, if any."""

    def __init__(self, language: str, src: str, tokens: list[Token]):
        self.tokens = tokens
        self.fixed = {"defined(__cplusplus)": language == "cpp"}
        self.bad: Token | None = None
        self.branches: list[_Branch] = []
        self.root = branch = _Branch(None, None, None, 0)
        for i, (kind, a, b) in enumerate(tokens):
            m = _DIRECTIVE.match(src, a, b) if kind == COMMENT else None
            if not m:
                if kind != COMMENT:
                    branch.items.append(i)
                    branch.text = True
                continue
            word = m[1]
            if word in ("define", "undef"):
                if name := re.match(r"\s*(\w+)", m[2]):
                    branch.items.append(("define", name[1], word == "define"))
            elif word == "error":
                branch.error = True
            elif word.startswith("if"):
                group = _Group(branch)
                branch.items.append(group)
                branch = self._open(_condition(word, m[2], language), group, tokens[i])
            elif branch is self.root or word.startswith("el") and branch.condition is None:
                self.bad = self.bad or tokens[i]
            elif word == "endif":
                branch.group.closed = True
                branch = branch.group.parent
            else:
                branch = self._open(None if word == "else" else _condition(word, m[2], language), branch.group, tokens[i])
        self.unclosed = branch is not self.root

    def _open(self, condition, group: _Group, directive: Token) -> _Branch:
        branch = _Branch(condition, group, directive, len(group.branches))
        group.branches.append(branch)
        self.branches.append(branch)
        return branch

    def _path(self, branch: _Branch) -> list[_Branch]:
        path = []
        while branch.group is not None:
            path.append(branch)
            branch = branch.group.parent
        return path

    def _dead(self, branch: _Branch) -> bool:
        """Never compiled, or nothing to compile: a branch of only an #error."""
        values = [True if b.condition is None else _value(b.condition, self.fixed) for b in branch.group.branches[: branch.at + 1]]
        return values[-1] is False or True in values[:-1] or branch.error and not branch.text

    def _walk(self, forced: list[_Branch], wanted: set[int]) -> tuple[list[int], list[_Branch]]:
        """Positions of the tokens of one choice and the branches it takes, ``wanted`` ones where open."""
        known, choice = dict(self.fixed), {}
        for target in forced:
            for b in self._path(target):
                choice[id(b.group)] = b
                for earlier in b.group.branches[: b.at]:
                    _assume(earlier.condition, False, known)
                if b.condition is not None:
                    _assume(b.condition, True, known)
        known.update(self.fixed)
        kept, taken = [], []
        todo = list(reversed(self.root.items))
        while todo:
            item = todo.pop()
            if isinstance(item, int):
                kept.append(item)
            elif isinstance(item, tuple):
                name = re.compile(rf"\b{item[1]}\b")
                known = {k: v for k, v in known.items() if k in self.fixed or not name.search(k)}
                known[f"defined({item[1]})"] = item[2]
            else:
                branch = self._choose(item, choice.get(id(item)), known, wanted)
                if branch is not None:
                    taken.append(branch)
                    todo.extend(reversed(branch.items))
        return kept, taken

    def _choose(self, group: _Group, forced: _Branch | None, known: dict[str, bool], wanted: set[int]) -> _Branch | None:
        for b in group.branches:
            if forced is not None:
                if b is forced:
                    if b.condition is not None:
                        _assume(b.condition, True, known)
                    return b
                _assume(b.condition, False, known)
                continue
            value = True if b.condition is None else _value(b.condition, known)
            if value is None:
                later = id(b) not in wanted and any(id(x) in wanted for x in group.branches[b.at + 1 :])
                value = not later
                _assume(b.condition, value, known)
            if value:
                return b
        return None

    def first_error(self, check: Callable[[list[int]], int | None]) -> tuple[list[int], int] | None:
        """The stream and the place in it at which ``check`` fails first, over all branches."""
        seen: set[tuple] = set()

        def fails(kept: list[int]) -> int | None:
            kinds = tuple(self.tokens[i][0] for i in kept)
            if kinds in seen:
                return None
            at = check(kept)
            if at is None:
                seen.add(kinds)
            return at

        kept, taken = self._walk([], set())
        if (at := fails(kept)) is not None:
            return kept, at
        covered = {id(b) for b in taken}
        left = [b for b in self.branches if id(b) not in covered and not any(map(self._dead, self._path(b)))]
        while left:
            # a branch is wanted for itself or for what it holds
            wanted = {id(p) for b in left for p in self._path(b)}
            kept, taken = self._walk(left[:1], wanted)
            if fails(kept) is not None:
                # only what fails by itself counts, for not every choice need make sense
                todo = [[b for b in left if b is left[0] or any(b is t for t in taken)]]
                while todo:
                    some = todo.pop()
                    alone, _ = self._walk(some, set())
                    if (at := fails(alone)) is None:
                        continue
                    if len(some) == 1:
                        return alone, at
                    half = len(some) // 2
                    todo += [some[half:], some[:half]]
            covered = {id(b) for b in taken} | {id(left[0])}
            left = [b for b in left if id(b) not in covered]
        return None
