"""Garbled text from wrong character encodings.

For every legacy encoding under which UTF-8 bytes may have been read, the characters of a text are
mapped back to the bytes they stood for, and a byte-structure automaton (the well-formed multibyte
sequences of UTF-8, written as a regular expression over bytes) finds the maximal well-formed spans.
Only those spans are decoded; the rest of the text stays as it is. What is decoded must look like
text: assigned characters of any script, letters of scripts that go together, no mark without
something to stand on. A span of a single sequence is believed only where its surroundings do not
explain it: that keeps quotation marks after capitals, dashes before accented letters and drawn boxes
from being taken for damage. Decoded spans are searched again, so text that was garbled twice is
restored in two steps.

Text in a Cyrillic legacy encoding that was read as another single-byte encoding has no byte
structure; there, runs of letters are mapped back to bytes and read under the other encodings, and
the reading that is likelier by the frequencies of Russian letters wins, by a margin.

Replacement characters and cut-off sequences are reported as damage that cannot be restored.

Every span names the route by which it was found: ``bytes`` (the automaton, for well-formed sequences),
``cut off`` (the automaton, stopped inside the sequence of a punctuation mark), ``frequency`` (the letter
frequencies, the one route that is not the automaton's) and ``replaced`` (replacement characters).

Defined results: null, empty and pure ASCII texts have no damage and never reach Python; a repeated
row counts once in ``garbled_ids``; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.sources.tables import spread

#: Single-byte encodings under which UTF-8 is commonly misread, in the order in which they are tried.
SINGLE_BYTE = ("cp1252", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "cp866", "koi8_r")
#: Double-byte encodings of the same kind.
DOUBLE_BYTE = ("gbk",)
#: Letter frequencies of Russian in percent, from public tables.
RUSSIAN = dict(
    о=10.97, е=8.45, а=8.01, и=7.35, н=6.70, т=6.26, с=5.47, р=4.73, в=4.54, л=4.40, к=3.49, м=3.21, д=2.98, п=2.81, у=2.62, я=2.01,
    ы=1.90, ь=1.74, г=1.70, з=1.65, б=1.59, ч=1.44, й=1.21, х=0.97, ж=0.94, ш=0.73, ю=0.64, ц=0.48, щ=0.36, э=0.32, ф=0.26, ъ=0.04, ё=0.04,
)
#: How much likelier (log) another reading of a Cyrillic run must be.
MARGIN = 3.0

#: UTF-8 as a byte automaton; group 1 of a cut-off sequence is what is left of a punctuation mark.
_SEQUENCE = r"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
WELL_FORMED = re.compile(f"(?:{_SEQUENCE})+")
_CUT_OFF = re.compile(r"\xe2[\x80\x82\x84](?![\x80-\xbf])")
_CUT_OFF_IN = {"cp1252", "cp1250", "cp1251", "cp1254", "cp437"}
_QUOTES = frozenset("«»‹›“”„‘’‚–—…• ")


#: Letters of two bytes outside Latin, Greek and Cyrillic: fewer than three of them are as likely a capital and a quotation mark, twice.
_RARE_PAIR = re.compile("[\u0250-\u036f\u0530-\u07ff]")


class Damage(NamedTuple):
    start: int
    end: int
    encoding: str
    restored: str | None
    route: str = "bytes"


#: Scripts whose letters legacy encodings mix, so that text garbled twice shows them side by side.
_MIXED = frozenset(("LATIN", "GREEK", "CYRILLIC"))
#: Scripts that are written together.
_TOGETHER = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "KATAKANA-HIRAGANA": "CJK", "FULLWIDTH": "CJK", "HALFWIDTH": "CJK", "IDEOGRAPHIC": "CJK", "HANGUL": "CJK", "BOPOMOFO": "CJK"}


@lru_cache(maxsize=1 << 16)
def _kind(ch: str) -> tuple[bool, str, bool]:
    """``(plausible, script of a letter or mark, mark)``."""
    o, category = ord(ch), unicodedata.category(ch)
    if 0x80 <= o < 0xA0:  # control characters that stand for bytes of text garbled twice
        return True, "", False
    if category[0] == "C" and category != "Cf":
        return False, "", False
    if category[0] == "L" and o < 0x250:
        return True, "LATIN", False
    if category[0] not in "LM" or category == "Lm" or 0x2100 <= o < 0x2150 or "VARIATION SELECTOR" in (name := unicodedata.name(ch, "")) or name.startswith("COMBINING"):
        return True, "", False
    script = name.partition(" ")[0]
    return True, _TOGETHER.get(script, script), category[0] == "M"


def _plausible(ch: str) -> bool:
    return _kind(ch)[0]


def _coherent(decoded: str) -> bool:
    """Whether the characters are in use, the letters of scripts that go together, and the first no mark."""
    scripts = set()
    for i, ch in enumerate(decoded):
        plausible, script, mark = _kind(ch)
        if not plausible or (mark and not i):
            return False
        if script:
            scripts.add(script)
    return scripts <= _MIXED or len(scripts) == 1


class _Legacy:
    """Characters of one single-byte encoding and the bytes they stood for."""

    def __init__(self, name: str):
        self.name = name
        self.table = {}
        for b in range(0x80, 0x100):
            try:
                self.table[ord(bytes([b]).decode(name))] = b
            except UnicodeDecodeError:
                pass
        if name.startswith("cp125"):  # undefined bytes are often kept as control characters
            for b in range(0x80, 0xA0):
                self.table.setdefault(b, b)
        self.leads = frozenset(chr(c) for c, b in self.table.items() if 0xC2 <= b <= 0xF4)
        self.rest = frozenset(chr(c) for c, b in self.table.items() if 0x80 <= b <= 0xBF)
        # a character that is a byte elsewhere but not here must not pass for its own code point
        self.map = {c: 0xFFFF for c in range(0x80, 0x100)} | self.table


@lru_cache(maxsize=None)
def _legacy(name: str) -> _Legacy:
    return _Legacy(name)


def _letter(ch: str) -> bool:
    return ch.isalpha()


def _latin(ch: str) -> bool:
    return ch.isalpha() and ord(ch) < 0x250


def _own_word(text: str, x: Damage, enc: str) -> bool:
    """Whether the span is made of letters only under an encoding whose leads are Cyrillic letters."""
    return enc in ("cp866", "koi8_r") and all("Ѐ" <= c <= "ӿ" for c in text[x.start : x.end])


def _believable(text: str, a: int, b: int, decoded: str, enc: str) -> bool:
    if not _coherent(decoded):
        return False
    before, after = text[a - 1 : a], text[b : b + 1]
    if enc in ("cp437", "cp850", "cp866", "koi8_r"):  # a drawn box goes on
        if any(x and 0x2500 <= ord(x) <= 0x259F for x in (before, after)):
            return False
        if _own_word(text, Damage(a, b, enc, None), enc):
            return False
    if len(decoded) > 1:
        if len(decoded) < 3 and all(_RARE_PAIR.match(x) for x in decoded):
            return False
        if enc in ("koi8_r", "cp866", "cp850", "cp437", "mac_roman", "cp1251", "cp1250") and all(x in _QUOTES for x in decoded):
            return True
        return any(_letter(x) for x in decoded) or enc in ("cp1252", "cp1251", "cp1250", "cp1254", "mac_roman", "cp437")
    o, source = ord(decoded), text[a:b]
    near_latin = _latin(before or " ") or _latin(after or " ")
    if b - a > 2:  # a lone letter of another script than its neighbours' is as likely what stands there
        return not decoded.isalpha() or (_kind(decoded)[1] in _MIXED and near_latin)
    if o >= 0x180 and decoded not in "ƒƠơƯưȘșȚț":  # one rare, Cyrillic or Greek letter alone is as likely two characters that belong there
        return False
    if o >= 0x100:
        return near_latin and source[1] not in _QUOTES
    if enc == "cp1252" or enc == "cp1254":
        return source[1] not in _QUOTES or source[0] in "ÂÃ" or near_latin
    if enc in ("cp1250", "cp1251"):
        return source[0] in "ÂĂÃВГ" and (source[1] not in _QUOTES or near_latin)
    return True


def _structured(text: str, chars: frozenset) -> Iterator[Damage]:
    for name in SINGLE_BYTE:
        enc = _legacy(name)
        if not (chars & enc.leads and chars & enc.rest):
            continue
        as_bytes = text.translate(enc.map)
        sure, weak = [], []
        for m in WELL_FORMED.finditer(as_bytes):
            a, b = m.span()
            decoded = m.group().encode("latin-1").decode("utf-8")
            (sure if _believable(text, a, b, decoded, name) else weak).append(Damage(a, b, name, decoded))
        if name in _CUT_OFF_IN:
            sure += (Damage(*m.span(), name, None, "cut off") for m in _CUT_OFF.finditer(as_bytes))
        if sure:  # a lone sequence counts beside others of its encoding
            yield from sure
            yield from (x for x in weak if _coherent(x.restored) and not _own_word(text, x, name))
    if any("⺀" <= c <= "﫿" or "︰" <= c <= "﹯" for c in chars):
        yield from _double_byte(text)


_WIDE = re.compile(r"[⺀-鿿豈-﫿︰-﹯-]+")
_BYTES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|[\x20-\x7e])*")


def _double_byte(text: str) -> Iterator[Damage]:
    """Runs of wide characters whose bytes are UTF-8 of narrow ones. A lone sequence without a Latin
    neighbour counts only if every wide run of the text turns out that way."""
    for name in DOUBLE_BYTE:
        sure, weak, whole = [], [], True
        for m in _WIDE.finditer(text):
            a, b = m.span()
            try:
                raw = m.group().encode(name)
            except UnicodeEncodeError:
                whole = False
                continue
            wide = [x for x in raw.decode("utf-8", "replace") if ord(x) > 0x7F] if _BYTES.fullmatch(raw) else []
            if wide and all(_plausible(x) and ord(x) < 0x2E80 for x in wide):
                strong = len(raw) > 4 or _latin(text[a - 1 : a] or " ") or _latin(text[b : b + 1] or " ") or any(ord(x) >= 0x2010 for x in wide)
                (sure if strong else weak).append(Damage(a, b, name, raw.decode("utf-8")))
            elif raw[:2] in (b"\xe2\x80", b"\xe2\x82") and len(raw) <= 6:
                sure.append(Damage(a, b, name, None, "cut off"))
            else:
                whole = False
        if sure or (weak and whole):
            yield from sure
            yield from weak if whole else ()
            return


def _readings() -> dict[str, list[tuple[str, dict[int, str]]]]:
    """Per script in which a run of letters is found, the other readings of its bytes."""
    out: dict[str, list] = {"latin": [], "cyrillic": []}
    for script, wrong, right in (("latin", "cp1252", "cp1251"), ("latin", "cp1252", "koi8_r"), ("cyrillic", "cp1251", "koi8_r"), ("cyrillic", "koi8_r", "cp1251")):
        table = {}
        for b in range(0x80, 0x100):
            try:
                table[ord(bytes([b]).decode(wrong))] = bytes([b]).decode(right)
            except UnicodeDecodeError:
                pass
        out[script].append((f"{right} as {wrong}", table))
    return out


_READINGS = _readings()
_THREE = re.compile("[À-ÿ¸¨£³]{3}")
_RUNS = {"latin": re.compile(r"(?<![A-Za-z])[À-ÿ¸¨£³]+(?:[ ,.:;-]{1,2}[À-ÿ¸¨£³]+)*(?![A-Za-z])"), "cyrillic": re.compile(r"[Ѐ-ӿ]+(?:[ ,.:;-]{1,2}[Ѐ-ӿ]+)*")}
_LOG = {c: math.log(f / 100) for c, f in RUSSIAN.items()}
_RARE = math.log(0.00005)


def _likelihood(s: str, capital: float = 0.1) -> float:
    """Log likelihood of the letters, with a price on capitals after small letters and on other capitals."""
    total, previous = 0.0, ""
    for ch in s:
        if ch.isalpha():
            total += _LOG.get(ch.lower(), _RARE)
            if ch.isupper():
                total -= 1.5 if previous.islower() else capital
        previous = ch
    return total


def _reread(text: str, script: str) -> Iterator[Damage]:
    sure, weak = [], []
    for m in _RUNS[script].finditer(text):
        run = m.group()
        if script == "cyrillic" and not any(c.isupper() for c in run[1:]):
            continue  # small letters throughout: what Russian looks like, and no other reading of it
        if script == "latin" and not _THREE.search(run):
            continue
        capital = 0.1 if script == "cyrillic" else 1.5
        own = _likelihood(run) if script == "cyrillic" else len(run) * -5.0
        best, name = own, None
        for reading, table in _READINGS[script]:
            if all(ord(c) in table or ord(c) < 0x80 for c in run):
                other = run.translate(table)
                if all("Ѐ" <= c <= "ӿ" or ord(c) < 0x80 for c in other) and (score := _likelihood(other, capital)) > best:
                    best, name, fixed = score, reading, other
        if name:
            (sure if best > own + MARGIN or script == "latin" else weak).append(Damage(*m.span(), name, fixed, "frequency"))
    if sure:
        yield from sure
        yield from weak


def find_damage(text: str) -> list[Damage]:
    """Damaged spans in order, none overlapping; of overlapping readings the longest span, then the first encoding."""
    if text.isascii():
        return []
    chars = frozenset(text)
    found = list(_structured(text, chars))
    if any("À" <= c <= "ÿ" for c in chars):
        found += _reread(text, "latin")
    if any("А" <= c <= "Я" for c in chars):
        found += _reread(text, "cyrillic")
    if "�" in chars:
        found += (Damage(m.start(), m.end(), "lost", None, "replaced") for m in re.finditer("�+", text))
    found.sort(key=lambda x: (x.start - x.end, x.start))
    taken: list[Damage] = []
    starts: list[tuple[int, int]] = []
    for x in found:
        i = bisect.bisect(starts, (x.start, x.end))
        if (i and starts[i - 1][1] > x.start) or (i < len(starts) and starts[i][0] < x.end):
            continue
        starts.insert(i, (x.start, x.end))
        taken.append(x)
    return sorted(taken)


def restore(text: str, rounds: int | None = None) -> str:
    """``text`` with every restorable span decoded, again and again as long as there is one (``rounds`` times at most, if given)."""
    seen = {text}  # a round need not shorten the text
    while rounds is None or rounds > 0:
        parts, at = [], 0
        for x in find_damage(text):
            if x.restored is not None:
                parts += [text[at : x.start], x.restored]
                at = x.end
        if not parts:
            break
        text = "".join(parts) + text[at:]
        if text in seen:
            break
        seen.add(text)
        rounds = None if rounds is None else rounds - 1
    return text


def garbled(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Rows ``(id, spans, lost, by_frequency, encoding, restored)`` of the damaged texts.

    ``spans`` counts the damaged spans, ``lost`` those that cannot be restored and ``by_frequency`` those that
    the automaton has no part in; ``encoding`` is that of the first span; ``restored`` is the text with the others decoded (null if not asked for).
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") > F.length("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for key, text in zip(pdf["id"], pdf["text"]):
                if found := find_damage(text):
                    got.append((key, len(found), sum(x.restored is None for x in found), sum(x.route == "frequency" for x in found), found[0].encoding, restore(text) if with_text else None))
            if got:
                yield pd.DataFrame(got, columns=["id", "spans", "lost", "by_frequency", "encoding", "restored"])

    return spread(rows, "id").mapInPandas(run, f"id {kind}, spans int, lost int, by_frequency int, encoding string, restored string")


def garbled_ids(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return garbled(df, id_col=id_col, text_col=text_col, with_text=False).select("id").distinct()
