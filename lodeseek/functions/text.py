"""Column expressions over text, identifiers, paths and vectors; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and the language each stands for.
EXTENSIONS = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "py": "python", "go": "go",
    "sh": "bash", "bash": "bash", "java": "java", "c": "c", "h": "c", "rb": "ruby",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp",
}
MAX_FILE_BYTES, MAX_LINE_BYTES = 1 << 20, 4096
SNIPPET_CHARS = 2000
INDEX_BYTES = 8192


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def code_tokens(c: Column) -> Column:
    """Identifier words: camel case and acronyms are split, digits stay with the letters before them."""
    humps = F.regexp_replace(c, r"([\p{Ll}0-9])(\p{Lu})", "$1 $2")
    return _words(F.regexp_replace(humps, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2"))


def plain_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, not split further; what the hashing embedder sees."""
    return _words(c)


def looks_like_identifier(word: Column) -> Column:
    return word.rlike(r"_|[0-9]|\p{Ll}\p{Lu}")


def adaptive_weights(query: Column) -> tuple[Column, Column]:
    """(lexical, vector) weights: an identifier favours the lexical side, a phrase the vector side."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    n = F.size(words)
    identifier = (n == 1) & looks_like_identifier(F.element_at(words, 1))
    # a null query has no words
    lexical = F.when(F.coalesce(identifier, F.lit(False)), 2.0).otherwise(1.0)
    return lexical, F.when(F.coalesce(n, F.lit(0)) >= 2, 2.0).otherwise(1.0)


def sane_weight(w: Column) -> Column:
    """Negative weights count as 0, those that are no finite number as 1."""
    d = w.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 1.0).when(d < 0, 0.0).otherwise(d)


def language_of(path: Column) -> Column:
    """By extension, case-sensitive; null for any other."""
    ext = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return table[ext]


def relative_path(path: Column, root: str) -> Column:
    """Forward slashes, relative to ``root``; null for what lies outside it."""
    p = F.regexp_replace(F.regexp_replace(path, r"^file:/*", "/"), r"\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(base)), F.substring(p, len(base) + 1, 1 << 30))


def within_size(length: Column, most: int = MAX_FILE_BYTES) -> Column:
    return length <= most


def no_long_line(content: Column, most: int = MAX_LINE_BYTES) -> Column:
    return ~F.exists(F.split(content, "\n"), lambda line: F.octet_length(line) > most)


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_chunk_id(c: Column) -> tuple[Column, Column, Column]:
    """(path, start, end); the last colon separates, nulls where the id has another form."""
    pattern = r"^(?s)(.*):(\d{1,9})-(\d{1,9})$"
    ok = c.rlike(pattern)
    return tuple(F.when(ok, F.regexp_extract(c, pattern, i).cast(t)) for i, t in ((1, "string"), (2, "int"), (3, "int")))


def overlap_fraction(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Shared lines of two inclusive ranges over the length of the shorter one."""
    shared = F.least(a2, b2) - F.greatest(a1, b1) + 1
    return F.when(shared <= 0, 0.0).otherwise(shared / F.least(a2 - a1 + 1, b2 - b1 + 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; two empty ones have nothing in common."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, those of unequal length or of norm 0."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    bad = (F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0)
    return F.when(bad, 0.0).otherwise(_dot(a, b) / norm)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def first_line(c: Column) -> Column:
    """First line that isn't blank, trimmed; null if there is none."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\r\t]", " "))), lambda x: x != "")
    return F.get(lines, 0)


def snippet(body: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.substring(body, 1, chars)


def index_text(body: Column, most: int | None = INDEX_BYTES) -> Column:
    """``body`` up to ``most`` bytes of UTF-8, never ending inside a character; whole for ``None``."""
    if most is None:
        return body
    cut = F.substring(F.encode(body, "utf-8"), 1, most)
    # at most three bytes of a cut-off character stand at the end
    fits = F.coalesce(*[F.try_validate_utf8(F.substring(cut, 1, most - i).cast("string")) for i in range(4)])
    return F.when(F.octet_length(body) <= most, body).otherwise(fits)
