"""Source files that do not parse.

Every file is turned into a token stream and parsed with memoised derivatives of its language's
grammar. A file is invalid if a token cannot be formed, if the derivative becomes empty (the failing
token is reported) or if the last derivative is not nullable (the file was cut off).

Defined results: null language or content and languages without a grammar are skipped; an empty
file is valid; a repeated file counts once; a byte order mark and CRLF are ignored; C and C++ read
every branch of their conditional directives that can be compiled, and those have to be balanced.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.conditionals import Conditionals
from lodeseek.llm.grammars import grammar
from lodeseek.llm.lexing import COMMENT, ERROR, LANGUAGES, Token, bash_parts, tokenize
from lodeseek.sources.tables import spread


# Words with a kind of their own where a grammar asks for it.
_SOFT = {
    "python": {w: w for w in ("type", "match", "case")},
    "rust": {"_": "_", "$": "$"},
    "c": dict.fromkeys(("typeof", "__typeof", "__typeof__", "typeof_unqual", "__attribute", "__attribute__", "alignas", "_Alignas", "_Atomic", "__declspec"), "SPECIFIER"),
}


def _kinds(language: str, src: str, tokens: list[Token]) -> tuple[list[str], list[Token]]:
    kept = [t for t in tokens if t[0] != COMMENT]
    if soft := _SOFT.get(language):
        return [soft.get(src[a:b], k) if k == "ID" else k for k, a, b in kept], kept
    return [t[0] for t in kept], kept


def syntax_error(language: str, src: str) -> tuple[int, str] | None:
    """Line (from 1) and reason of the first violation, or None."""
    if language not in LANGUAGES or not src or src.isspace():
        return None
    src = src.removeprefix("﻿").replace("\r\n", "\n")
    if language in ("c", "cpp"):
        return _conditional_error(language, src, tokenize(language, src))
    streams = bash_parts(src) if language == "bash" else [tokenize(language, src)]
    for tokens in streams:
        kinds, kept = _kinds(language, src, tokens)
        at = grammar(language).first_error(kinds)
        if at is not None:
            return _reported(src, kept, at)
    return None


def _reported(src: str, kept: list[Token], at: int) -> tuple[int, str]:
    if at >= len(kept):
        return src.count("\n") + 1, "cut off"
    kind, a, b = kept[at]
    line = src.count("\n", 0, a) + 1
    text = src[a : min(b, a + 40)].split("\n")[0]
    return line, f"not a token: {text}" if kind == ERROR else f"unexpected {text or kind}"


def _conditional_error(language: str, src: str, tokens: list[Token]) -> tuple[int, str] | None:
    """As ``syntax_error``, over the branches of all conditional directives."""
    choices = Conditionals(language, src, tokens)
    if choices.bad is not None:
        _, a, b = choices.bad
        a += len(src[a:b]) - len(src[a:b].lstrip())
        return src.count("\n", 0, a) + 1, f"unexpected {src[a : min(b, a + 40)].split(chr(10))[0].rstrip()}"
    found = choices.first_error(lambda kept: grammar(language).first_error(_kinds(language, src, [tokens[i] for i in kept])[0]))
    if found is not None:
        return _reported(src, [tokens[i] for i in found[0]], found[1])
    return (src.count("\n") + 1, "cut off") if choices.unclosed else None


def unparsable(df: DataFrame, *, path_col: str = "rel_path", content_col: str = "content", language_col: str = "language", repo_col: str = "repo_id") -> DataFrame:
    """Rows ``(repo_id, language, rel_path, line, reason)`` of the invalid files."""
    rows = df.select(F.col(repo_col).alias("repo_id"), F.col(language_col).alias("language"), F.col(path_col).alias("rel_path"), F.col(content_col).alias("content"))
    rows = rows.filter(F.col("language").isin(*LANGUAGES) & (F.col("content") != ""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for repo, lang, path, content in zip(pdf["repo_id"], pdf["language"], pdf["rel_path"], pdf["content"]):
                if (e := syntax_error(lang, content)) is not None:
                    got.append((repo, lang, path, *e))
            if got:
                yield pd.DataFrame(got, columns=["repo_id", "language", "rel_path", "line", "reason"])

    return spread(rows, "rel_path").mapInPandas(run, "repo_id string, language string, rel_path string, line int, reason string")


def unparsable_rates(files: DataFrame, invalid: DataFrame) -> DataFrame:
    """Share of invalid files per repository and language, each path counted once."""
    total = files.filter(F.col("language").isNotNull()).select("repo_id", "language", "rel_path").distinct().groupBy("repo_id", "language").agg(F.count("*").alias("files"))
    bad = invalid.select("repo_id", "language", "rel_path").distinct().groupBy("repo_id", "language").agg(F.count("*").alias("invalid"))
    return total.join(bad, ["repo_id", "language"], "left").select(
        "repo_id", "language", "files", F.coalesce("invalid", F.lit(0)).alias("invalid"), (F.coalesce("invalid", F.lit(0)) / F.col("files")).alias("rate")
    )
