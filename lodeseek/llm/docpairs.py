"""Functions paired with their documentation.

Comments and strings are blanked first (their places are remembered), so that signatures are found
by regular expressions in code only. A body is delimited by an indentation stack (Python), by a
stack of opening words and ``end`` (Ruby) or by matching brackets (the other languages). A comment
belongs to a function if it ends on the line directly above its signature or one of its annotations;
Python's docstring is the string that opens the body; the first function of a record also has the
record's own description.

A description is trivial if, without comment signs, markup and lines that open with a tag, fewer
than four runs of letters remain, if it only repeats the function's name, or if it opens with a
to-do marker.

Defined results: null or empty code gives no pair, an unknown language none either; a repeated
record gives repeated pairs, a function that occurs twice in a record one pair for each; CRLF counts
as a line feed; other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.code import ANNOTATION, MASKS, Lines, bracket_pairs, line_start, mask, named_bodies
from lodeseek.sources.tables import spread

MIN_WORDS = 4
#: Words that open a note about missing documentation.
TODO_MARKERS = ("TODO", "FIXME", "XXX", "HACK", "TBD")

class Function(NamedTuple):
    name: str
    start: int  # of the first annotation, in characters
    end: int
    descriptions: list[str]


def _comment_blocks(code: str, comments: list[tuple[int, int]], src: str, lines: Lines) -> dict[int, tuple[int, int, int]]:
    """``(first line, start, end)`` of each comment by the line on which it ends; adjacent line comments are one; those beside code don't count."""
    blocks: dict[int, tuple[int, int, int]] = {}
    singles: set[int] = set()
    for a, b in comments:
        ls, le = line_start(code, a), code.find("\n", b)
        le = len(code) if le < 0 else le
        if code[ls:a].strip() or code[b:le].strip():
            continue
        first, last = lines.at(a), lines.at(b)
        if not src.startswith(("/*", "=begin"), a):
            singles.add(last)
            if first - 1 in singles:
                first, a, _ = blocks.pop(first - 1)
        blocks[last] = (first, a, b)
    return blocks


def functions(language: str, src: str) -> list[Function]:
    """Functions that ``src`` defines, each with its comment and its docstring."""
    if language not in MASKS or not src:
        return []
    src = src.replace("\r\n", "\n")
    code, comments, strings = mask(language, src)
    match = bracket_pairs(code)
    lines = Lines(src)
    starts = lines.starts
    above = _comment_blocks(code, comments, src, lines)
    annotation = ANNOTATION.get(language)
    opened, commented = dict(strings), dict(comments)
    # lines that open an annotation, and the bracketed lines it goes on for
    covers: dict[int, int] = {}
    if annotation:
        for k, s in enumerate(starts):
            e = starts[k + 1] if k + 1 < len(starts) else len(code)
            if annotation.match(code, s, e):
                i = code.find("(", s, e)
                covers[lines.at(match[i] if i >= 0 and i in match else s)] = k
    out = []
    for name, start, opens, end in named_bodies(language, code, match):
        line = lines.at(start)
        at = [line]
        if language in ("java", "typescript", "javascript", "c", "cpp"):
            at += range(line + 1, lines.at(max(start, opens - 1)) + 1)
        while line - 1 in covers:
            line = covers[line - 1]
            at.append(line)
        # a comment between annotations and signature
        k = at[0]
        while k - 1 in above:
            k = above[k - 1][0]
            if k - 1 not in covers:
                break
            k = covers[k - 1]
            at.append(k)
        texts = [src[a:b] for x in dict.fromkeys(at) if x - 1 in above for _, a, b in [above[x - 1]]]
        if language == "python":
            i = opens
            while i < end:
                i = _GAP.match(src, i).end()
                if i not in commented:
                    break
                i = commented[i]
            prefix = _STRING_PREFIX.match(src, i)
            if prefix and prefix.end() in opened and i < end:
                texts.append(re.sub(r"^('''|\"\"\"|'|\")|('''|\"\"\"|'|\")$", "", src[prefix.end() : opened[prefix.end()]]))
        out.append(Function(name, starts[line], end, texts))
    return out


_GAP, _STRING_PREFIX = re.compile(r"[ \t\n]*"), re.compile(r"[rRuUbB]{0,2}(?=['\"])")
_SIGNS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|/{2,}!?|\*+(?!/)|#+!?|=begin\b|=end\b|--+)?[ \t]*|[ \t]*\*+/[ \t]*$", re.M)
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|\{@\w*|[`*{}|~]|&[a-z]+;")
_TAG_LINE = re.compile(r"^[ \t]*[@:\\][A-Za-z].*$", re.M)
_LETTERS = re.compile(r"[^\W\d_]+")
_TODO = re.compile(rf"\W*(?:(?:{'|'.join(TODO_MARKERS)})(?![^\W_])|(?i:todo|fixme)[ \t]*[:(])")


def plain(description: str) -> str:
    """A description without comment signs, tag lines and markup."""
    text = _SIGNS.sub("", description.replace("\r", ""))
    return _MARKUP.sub(" ", _TAG_LINE.sub("", text)).strip()


def trivial(description: str, name: str, min_words: int = MIN_WORDS) -> bool:
    text = plain(description)
    if len(_LETTERS.findall(text)) < min_words or _TODO.match(text):
        return True
    squeeze = lambda s: "".join(c for c in s.lower() if c.isalnum())
    return squeeze(text) == squeeze(name)


def described(language: str, src: str, field: str | None) -> list[tuple[str, str, str, int]]:
    """``(name, description, code, line)`` of the functions with a description that is not trivial; ``field`` is the first one's."""
    out = []
    clean = src.replace("\r\n", "\n")
    lines = Lines(clean)
    for k, f in enumerate(functions(language, src)):
        texts = ([field] if k == 0 and field else []) + f.descriptions
        good = next((t for t in texts if not trivial(t, f.name)), None)
        if good is not None:
            out.append((f.name, plain(good), clean[f.start : f.end], lines.at(f.start) + 1))
    return out


def documented_functions(
    df: DataFrame,
    *,
    id_col: str = "record_id",
    code_col: str = "code",
    language_col: str = "language",
    docstring_col: str | None = "docstring",
) -> DataFrame:
    """Rows ``(id, language, func_name, description, code, line)``, one for each documented function."""
    doc = F.col(docstring_col) if docstring_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.lower(language_col).alias("language"), doc.alias("doc"), F.col(code_col).alias("code"))
    rows = rows.filter(F.col("language").isin(*MASKS) & (F.col("code") != ""))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for key, language, doc, code in zip(pdf["id"], pdf["language"], pdf["doc"], pdf["code"]):
                got += [(key, language, *x) for x in described(language, code, doc if isinstance(doc, str) else None)]
            if got:
                yield pd.DataFrame(got, columns=["id", "language", "func_name", "description", "code", "line"])

    return spread(rows, "id").mapInPandas(run, f"id {kind}, language string, func_name string, description string, code string, line int")
