"""Memoised parsing with derivatives.

A grammar is a regular expression over token kinds with named, possibly recursive rules. The
derivative of a grammar by a token is the grammar of what may follow it; a token stream is valid if
the last derivative accepts nothing more. Nodes are hash-consed and every derivative is kept, so the
states a corpus reaches become a lazily built automaton and a known step is one dictionary lookup.

An empty derivative marks the exact token at which a text leaves the language. A derivative that is
not nullable at the end of the stream marks a text that was cut off.
"""

from __future__ import annotations

import re
import sys
from functools import reduce


class Node:
    __slots__ = ("kind", "a", "b", "nullable", "step", "rank")

    def __init__(self, kind, a, b, nullable, rank):
        self.kind, self.a, self.b, self.nullable, self.rank = kind, a, b, nullable, rank
        self.step: dict[str, Node] = {}


class Grammar:
    """Rules are written ``name = alternatives ;`` with ``'kind'`` or KIND for tokens, ``a b``, ``a | b``, ``( )``, ``? * +``."""

    #: Nodes kept at most before the memory is cleared; only speed depends on it.
    MOST_NODES = 400_000

    def __init__(self, text: str, start: str = "file"):
        self.text, self.start_name = text, start
        self._build()

    def _build(self) -> None:
        self.table: dict[tuple, Node] = {}
        self.count = 0
        self.empty = Node("0", None, None, False, -2)
        self.eps = Node("1", None, None, True, -1)
        self.rules: dict[str, Node] = {}
        self._parse(self.text)
        self.start = self._ref(self.start_name)

    # construction -------------------------------------------------------------------------------
    def _node(self, kind, a, b, nullable) -> Node:
        key = (kind, id(a) if isinstance(a, Node) else a, id(b) if isinstance(b, Node) else b)
        node = self.table.get(key)
        if node is None:
            node = self.table[key] = Node(kind, a, b, nullable, self.count)
            self.count += 1
        return node

    def tok(self, k: str) -> Node:
        return self._node("t", k, None, False)

    def _ref(self, name: str) -> Node:
        return self._node("r", name, None, None)

    def seq(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        if a.kind == ".":
            return self.seq(a.a, self.seq(a.b, b))
        return self._node(".", a, b, self._null(a) and self._null(b))

    def alt(self, nodes) -> Node:
        flat: dict[int, Node] = {}
        for x in nodes:
            if x.kind == "|":
                for y in x.a:
                    flat[id(y)] = y
            elif x is not self.empty:
                flat[id(x)] = x
        # alternatives that go on alike share what follows, so that the state stays as small as what tells them apart
        tails: dict[int, list[Node]] = {}
        for x in flat.values():
            if x.kind == ".":
                tails.setdefault(id(x.b), []).append(x)
        for same in tails.values():
            if len(same) > 1:
                for x in same:
                    del flat[id(x)]
                merged = self.seq(self.alt([x.a for x in same]), same[0].b)
                flat[id(merged)] = merged
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        parts = tuple(sorted(flat.values(), key=lambda x: x.rank))
        key = ("|", tuple(map(id, parts)))
        node = self.table.get(key)
        if node is None:
            node = self.table[key] = Node("|", parts, None, any(map(self._null, parts)), self.count)
            self.count += 1
        return node

    def star(self, a: Node) -> Node:
        return self.eps if a in (self.empty, self.eps) else self._node("*", a, None, True)

    def _null(self, x: Node) -> bool:
        """Whether x accepts nothing; names are looked up once all rules are known."""
        if x.nullable is None:
            if x.kind == "r":
                if x.a not in self.rules:
                    return False
                x.nullable = False  # the least solution: a rule is not nullable by way of itself
                x.nullable = self._null(self.rules[x.a])
        return bool(x.nullable)

    def _parse(self, text: str) -> None:
        words = re.findall(r"'[^']*'|[A-Za-z_][\w]*|[()|?*+;=]", re.sub(r"(?m)^\s*--.*$", "", text))
        parsed: dict[str, object] = {}
        at = 0

        def alternatives():
            nonlocal at
            options = [sequence()]
            while words[at] == "|":
                at += 1
                options.append(sequence())
            return ("|", options) if len(options) > 1 else options[0]

        def sequence():
            nonlocal at
            items = []
            while words[at] not in ("|", ")", ";"):
                w = words[at]
                at += 1
                if w == "(":
                    item = alternatives()
                    at += 1
                elif w[0] == "'":
                    item = ("t", w[1:-1])
                elif w.isupper():
                    item = ("t", w)
                else:
                    item = ("r", w)
                while words[at] in ("?", "*", "+"):
                    item = (words[at], item)
                    at += 1
                items.append(item)
            return (".", items)

        while at < len(words):
            name = words[at]
            at += 2
            parsed[name] = alternatives()
            at += 1
        # which rules accept nothing, by iteration; nodes are built afterwards with that known
        known = dict.fromkeys(parsed, False)

        def null(x) -> bool:
            k, v = x
            if k == "t":
                return False
            if k == "r":
                return known[v]
            if k == "|":
                return any(map(null, v))
            if k == ".":
                return all(map(null, v))
            return k in "?*" or null(v)

        changed = True
        while changed:
            changed = False
            for name, x in parsed.items():
                if not known[name] and null(x):
                    known[name] = changed = True
        for name in parsed:
            self._ref(name).nullable = known[name]

        def build(x) -> Node:
            k, v = x
            if k == "t":
                return self.tok(v)
            if k == "r":
                return self._ref(v)
            if k == "|":
                return self.alt([build(y) for y in v])
            if k == ".":
                return reduce(lambda acc, y: self.seq(y, acc), [build(y) for y in reversed(v)], self.eps)
            inner = build(v)
            if k == "?":
                return self.alt([self.eps, inner])
            return self.star(inner) if k == "*" else self.seq(inner, self.star(inner))

        for name, x in parsed.items():
            self.rules[name] = build(x)

    # derivation ---------------------------------------------------------------------------------
    def derive(self, x: Node, t: str) -> Node:
        got = x.step.get(t)
        if got is not None:
            return got
        k = x.kind
        if k == "t":
            got = self.eps if x.a == t else self.empty
        elif k == ".":
            got = self.seq(self.derive(x.a, t), x.b)
            if self._null(x.a):
                got = self.alt([got, self.derive(x.b, t)])
        elif k == "|":
            got = self.alt([self.derive(y, t) for y in x.a])
        elif k == "*":
            got = self.seq(self.derive(x.a, t), x)
        elif k == "r":
            got = self.derive(self.rules[x.a], t)
        else:
            got = self.empty
        x.step[t] = got
        return got

    def first_error(self, kinds: list[str]) -> int | None:
        """Index of the token at which the stream leaves the language, ``len(kinds)`` if it ends too soon, else None."""
        if self.count > self.MOST_NODES:
            self._build()
        # derivatives are as deep as the text is nested
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, 10_000 + 20 * len(kinds)))
        try:
            state, empty = self.start, self.empty
            for i, t in enumerate(kinds):
                nxt = state.step.get(t)
                state = nxt if nxt is not None else self.derive(state, t)
                if state is empty:
                    return i
            return None if self._null(state) else len(kinds)
        finally:
            sys.setrecursionlimit(before)
