"""Splitting oversized items at natural boundaries.

A text of more than ``max_lines`` lines or ``max_bytes`` bytes of UTF-8 is cut into pieces within
both limits. Every line end gets a boundary strength; a sparse-table range-maximum index over the
strengths answers, for each piece, which line end is the strongest in the window of permissible
lengths (ties go to the right), and the next piece starts ``overlap`` lines before that cut.

A line longer than ``max_bytes`` by itself is first cut into fragments at character boundaries (at
white space where there is some in the last quarter); its fragments keep the line's number, and each
counts as one in the overlap, which is given in lines or, after such a cut, in fragments.

Defined results: a null or empty text gives no piece; a text within the limits gives one piece, its
own, without passing through Python; CRLF is kept as stored (a line ends at its line feed, and a
final line feed opens no further line); the pieces without their overlaps, joined, are the text
again. The overlap is cut short only where it would keep a piece from advancing past its
predecessor. Repeated rows give repeated pieces. Columns other than those named are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.sources.tables import spread

MAX_LINES = 200
MAX_BYTES = 8192
OVERLAP = 5
#: A piece is at least this share of what the limits would allow, if a boundary stronger than none lies there.
MIN_FILL = 0.5

_DEFINITION = re.compile(r"\s*(?:def|class|module|fn|func|function|impl|struct|enum|trait|interface|pub|public|private|protected|static|export|@|#\[|/\*\*)")
_CLOSE = re.compile(r"\s*(?:\}[;,)]*|end|fi|done|esac)\s*$")


def line_count(text: Column) -> Column:
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("int")


def oversized(text: Column, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> Column:
    return (F.octet_length(text) > max_bytes) | (line_count(text) > max_lines)


def split_lines(text: str) -> list[str]:
    """Lines with their line feeds."""
    lines = text.split("\n")
    out = [x + "\n" for x in lines[:-1]]
    if lines[-1]:
        out.append(lines[-1])
    return out


def fragments(line: str, max_bytes: int) -> list[str]:
    """``line`` cut to at most ``max_bytes`` bytes each, never inside a character."""
    raw = line.encode("utf-8", "surrogatepass")
    out, at = [], 0
    while len(raw) - at > max_bytes:
        end = at + max_bytes
        while end > at + 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        space = max(raw.rfind(b" ", at + max_bytes * 3 // 4, end), raw.rfind(b"\t", at + max_bytes * 3 // 4, end))
        if space > at:
            end = space + 1
        out.append(raw[at:end].decode("utf-8", "surrogatepass"))
        at = end
    out.append(raw[at:].decode("utf-8", "surrogatepass"))
    return out


def boundary_strengths(units: list[str]) -> np.ndarray:
    """Strength of a cut after each unit: what comes before and after it decides."""
    indent = [len(u) - len(u.lstrip(" \t")) if u.strip() else -1 for u in units]
    strength = np.zeros(len(units), dtype=np.int16)
    for i, u in enumerate(units):
        nxt = units[i + 1] if i + 1 < len(units) else ""
        s = 0
        if u.endswith("\n"):
            s = 1
            if not u.strip():
                s = 6
            elif _CLOSE.match(u.rstrip("\r\n")):
                s = 5
            if nxt.strip():
                if indent[i + 1] == 0 and not _CLOSE.match(nxt.rstrip("\r\n")):
                    s += 3
                if _DEFINITION.match(nxt):
                    s += 3
                if indent[i] >= 0 and indent[i + 1] < indent[i]:
                    s += 1
            else:
                s -= 1  # the blank line itself is the better place
        strength[i] = s
    return strength


class RangeMax:
    """Sparse table: the rightmost index of the maximum over any index range, O(n log n) to build, O(1) to ask."""

    def __init__(self, values: np.ndarray):
        self.values = values
        level = np.arange(len(values))
        self.levels = [level]
        width = 1
        while 2 * width <= len(values):
            a, b = level[:-width], level[width:]
            level = np.where(values[b] >= values[a], b, a)
            self.levels.append(level)
            width *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """Over lo..hi, both inclusive."""
        k = (hi - lo + 1).bit_length() - 1
        a, b = self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]
        return int(b if self.values[b] >= self.values[a] else a)


def cut(text: str, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """Pieces ``(first line, last line, shared lines, body)``, lines counted from 0."""
    units: list[str] = []
    line_of: list[int] = []
    for k, line in enumerate(split_lines(text)):
        parts = [line] if len(line) * 4 <= max_bytes or len(line.encode("utf-8", "surrogatepass")) <= max_bytes else fragments(line, max_bytes)
        units += parts
        line_of += [k] * len(parts)
    n = len(units)
    if not n:
        return []
    size = np.fromiter((len(u.encode("utf-8", "surrogatepass")) for u in units), dtype=np.int64, count=n)
    total = np.concatenate(([0], np.cumsum(size)))
    lines = np.asarray(line_of)
    index = RangeMax(boundary_strengths(units))
    out, start, shared = [], 0, 0
    while True:
        last = int(np.searchsorted(total, total[start] + max_bytes, side="right")) - 2
        last = min(last, int(np.searchsorted(lines, lines[start] + max_lines, side="left")) - 1)
        if last >= n - 1:
            out.append((int(lines[start]), int(lines[-1]), shared, "".join(units[start:])))
            return out
        fresh = start + shared  # the first unit that no earlier piece holds
        lo = max(fresh, start + int((last - start + 1) * MIN_FILL) - 1)
        end = index.argmax(min(lo, last), last)
        out.append((int(lines[start]), int(lines[end]), shared, "".join(units[start : end + 1])))
        # step back by the overlap, as far as the shared lines leave room for a fresh unit
        back = max(start + 1, end + 1 - overlap)
        while back <= end and (total[end + 2] - total[back] > max_bytes or lines[end + 1] - lines[back] >= max_lines):
            back += 1
        shared = end + 1 - back
        start = back


def split_oversized(
    df: DataFrame,
    *,
    id_col: str = "id",
    text_col: str = "body",
    start_col: str | None = "start_line",
    max_lines: int = MAX_LINES,
    max_bytes: int = MAX_BYTES,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Pieces ``(id, piece, pieces, start_line, end_line, shared, body)``; ``pieces`` > 1 marks what was cut."""
    if overlap < 0 or max_lines < 1 or max_bytes < 4:
        raise ValueError("overlap must be at least 0, max_lines at least 1 and max_bytes at least 4")
    first = F.coalesce(F.col(start_col), F.lit(1)) if start_col else F.lit(1)
    rows = df.select(F.col(id_col).cast("string").alias("id"), first.cast("int").alias("first"), F.col(text_col).alias("body")).filter(F.col("body") != "")
    big = oversized(F.col("body"), max_lines, max_bytes)
    whole = rows.filter(~big).select(
        "id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.col("first").alias("start_line"), (F.col("first") + line_count(F.col("body")) - 1).alias("end_line"), F.lit(0).alias("shared"), "body"
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for key, at, body in zip(pdf["id"], pdf["first"], pdf["body"]):
                parts = cut(body, max_lines, max_bytes, overlap)
                got += [(key, i, len(parts), at + a, at + b, s, t) for i, (a, b, s, t) in enumerate(parts)]
            yield pd.DataFrame(got, columns=["id", "piece", "pieces", "start_line", "end_line", "shared", "body"])

    cut_up = rows.filter(big).mapInPandas(pieces, "id string, piece int, pieces int, start_line int, end_line int, shared int, body string")
    return whole.unionByName(cut_up)


def oversized_ids(pieces: DataFrame) -> DataFrame:
    """Ids of which the operator made more than one piece."""
    return pieces.filter(F.col("pieces") > 1).select("id").distinct()


__all__ = ["RangeMax", "boundary_strengths", "cut", "fragments", "line_count", "oversized", "oversized_ids", "split_lines", "split_oversized", "spread"]
