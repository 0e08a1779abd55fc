"""Generated, minified, vendored and data files among source files.

Every file gets evidence for each of five labels (handwritten, generated, minified, vendored, blob)
from its name, from notes in its comments, from the shape of its content and from its likeness to a
whole file of a reference collection. Belief propagation over the directory trees combines that with
what is known of parents and siblings: directories are labelled too, by their names and by what they
hold, and a file and its directory, or a directory and its parent, prefer labels that go together.
The trees have no cycles, so one pass up and one pass down give the exact marginals.

The passes go level by level. A directory's message is a sum of log-messages over what it holds, so
a level is one groupBy with partial aggregation, whatever the number of files in one directory.

Defined results: null paths are skipped; null or empty contents give no evidence of their own; a
repeated row counts once, rows of one path with different contents are judged one by one and the
path counts if any of them does; no reference collection means no likeness; other columns are
ignored. A reference collection of up to ``reference_limit`` token runs goes to every worker; beyond it,
files and reference meet in a shuffled join on ``LIKENESS_HASHES`` min-hashes and are compared on whole
sets, which misses a pair of likeness 0.5 with probability 2 to the power of minus that number.

A note stands in a comment, be it a line of its own or within a block, and may be as long as ``NOTE``
characters anywhere in a comment of any length.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.code import mask
from lodeseek.functions.text import EXTENSIONS
from lodeseek.llm.neardup import min_hashes
from lodeseek.sources.durable import written
from lodeseek.sources.tables import spread

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
HAND, GEN, MIN, VEND, BLOB = range(5)
#: Log-odds of a file for being handwritten before anything is known of it.
PRIOR = 2.0
#: Log-compatibility of a file (column) with its directory (row): an ordinary directory may hold anything,
#: one of generated or of other people's code holds hardly anything else.
DIR_FILE = ((0.0, -0.3, -0.3, -0.3, -0.3), (-8.0, 0.0, -2.0, -2.0, -2.0), (-3.0, -2.0, 0.0, -2.0, -2.0), (-8.0, -2.0, -1.0, 0.0, -2.0), (-3.0, -2.0, -2.0, -2.0, 0.0))
#: The same of a directory with its parent.
DIR_DIR = ((0.0, -3.0, -3.0, -3.0, -3.0), (-12.0, 0.0, -3.0, -3.0, -3.0), (-3.0, -3.0, 0.0, -3.0, -3.0), (-12.0, -3.0, -3.0, 0.0, -3.0), (-3.0, -3.0, -3.0, -3.0, 0.0))
#: Log-odds of the root for being an ordinary directory.
ROOT_PRIOR = 6.0
#: Share of token runs that two files must have in common to be the same file but for small edits.
LIKENESS = 0.5
#: Token runs of the reference collection that may be sent to every worker (8 bytes each).
REFERENCE_LIMIT = 2_000_000
LIKENESS_HASHES = 20
#: The longest note, in characters; windows of twice that size with half overlap are searched.
NOTE = 300

# Names of directories that hold other people's code or the output of tools.
VENDOR_DIRS = r"_?vendor|vendors|vendored|third[-_]?party|node_modules|bower_components|external|externals|extern|deps|contrib|site-packages|godeps|pods|carthage"
GENERATED_DIRS = r"generated|_+generated_+|generated[-_](?:src|sources?|code)|gen[-_]src|autogen|gen"
# Marks in file names.
MINIFIED_NAME = r"[.-]min\.(?:\w+)$|\.bundle\.(?:\w+)$|[.-]packed\.(?:\w+)$"
GENERATED_NAME = r"\.(?:generated|g|gen|pb|designer)\.\w+$|_pb2(?:_grpc)?\.py$|\.pb\.go$|_generated\.\w+$|_gen\.go$"

_COMMENT = re.compile(r"^[ \t]*(?://+!?|#+(?!\[|include|define|if|endif|else|pragma|undef)|/\*+!?|\*+(?!/)|--+|<!--|;+|%+|=begin\b)[ \t]*(.*?)[ \t]*(?:\*+/|-->)?[ \t]*$", re.M)
_TOOLISH = r"(?:auto(?:matically|matisch|matiquement|máticamente|maticamente)?[- ]?)"
#: What a note says that stands in a file made by a tool, in several languages. A sentence on other
#: code ("reads generated code", "the generated x is checked elsewhere") has none of these forms.
GENERATED_NOTE = re.compile(
    r"code generated by\b|@generated\b|<auto-?generated|auto-?generated (?:by|from|file|code|using)|auto-generated\b.*\b(?:lost|edit|modif)"
    r"|this (?:file|code|module) (?:was|is|has been) (?:automatically |machine |auto-?)?(?:generated|produced|created|emitted) (?:by|from|with|using)\b"
    r"|(?:this (?:file|code) (?:was|is) automatically (?:generated|created))"
    r"|^do not (?:edit|modify)\b\W*(?:by hand\b|manually\b|this file\b|$|(?:rendered|generated|produced|created|built|written|emitted)\b)"
    r"|^(?:generated|rendered|produced|emitted|compiled|built|created) (?:by|from|on|with|at|using)\b.*(?:edit|modif|chang|overwrit|regenerat|re-?run|instead|\d+\.\d+|\.\w+$)"
    r"|machine[- ](?:written|generated|made|produced)\b|^output of\b.*(?:edit|overwrit|regenerat|re-?run|chang)"
    r"|(?:manual )?(?:edits|changes)\b.*\b(?:are|will be|get) (?:overwritten|lost|discarded)|edit the (?:source )?\w+ instead|re-?run \w+(?: \w+)? to (?:refresh|update|regenerate)"
    r"|(?:fichier|code) (?:est |a été )?(?:généré|produit|créé) (?:automatiquement|par)"
    r"|(?:datei|code) (?:wurde|ist|wird) (?:automatisch|maschinell|von \w+) (?:erzeugt|generiert|erstellt)|automatisch (?:erzeugt|generiert|erstellt)(?:e|er|es)? (?:datei|code|von|aus)"
    r"|(?:archivo|fichero|código) (?:fue |ha sido |es )?(?:generado|creado|producido) (?:automáticamente|por)"
    r"|(?:arquivo|ficheiro|código) (?:foi |é )?(?:gerado|criado|produzido) (?:automaticamente|por)"
    r"|(?:file|codice) (?:è stato )?generato (?:automaticamente|da)"
    r"|(?:файл|код) (?:был )?(?:автоматически )?(?:сгенерирован|создан|сформирован)(?: автоматически)?|автоматически (?:сгенерирован|создан)",
    re.I,
)
VENDOR_NOTE = re.compile(
    r"^vendored (?:from|copy of|code)\b|^third[- ]party (?:code|library|source|file)\b|(?:copied|taken|imported|adapted) (?:verbatim|unchanged|unmodified|as is|wholesale)\b.*\b(?:from|of)\b"
    r"|^(?:copied|taken|imported) from \S+ (?:at |v|@|version |tag |rev|\d)|^imported snapshot of\b|^\S+ v?\d+(?:\.\d+)+\b\W*\bre-?distributed\b|^re-?distributed (?:under|with|from)\b|^(?:verbatim|unmodified|exact) copy of\b|^(?:upstream|origin|source) ?: ?(?:https?:|\w+[-/]\w+)|keep in sync with upstream",
    re.I,
)
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d+|[^\w\s]")
_WORDY = re.compile(r"[A-Za-z_]\w*")
_PAYLOAD = re.compile(r"[A-Za-z0-9+/=_-]{48,}")
_NUMBERS = re.compile(r"(?<![\w.])(?:(?:0x[0-9a-fA-F]++|[-+]?\d++(?:\.\d++)?)[uUlLfF]*+\s*+,\s*+){8,}")
_PROSE = (".md", ".txt", ".rst", ".adoc", ".markdown")
_CONFIG = (".json", ".toml", ".yaml", ".yml", ".ini", ".cfg", ".xml", ".csv", ".lock", ".properties")


#: Parts of words of which every note holds one; a text without any has no note.
_HINTS = (
    "generated", "edit", "modify", "rendered", "produced", "emitted", "compiled", "built by", "built from", "built on", "built with", "built at", "built using", "created", "machine", "output of", "changes", "re-run", "rerun",
    "généré", "produit", "créé", "erzeugt", "generiert", "erstellt", "generado", "creado", "producido", "gerado", "criado", "produzido", "generato", "сгенерирован", "создан", "сформирован",
    "vendored", "third", "copied", "taken", "imported", "adapted", "snapshot", "copy of", "upstream", "origin", "source", "distributed",
)
_BLOCK = re.compile(r"/\*.*?\*/|<!--.*?-->|^=begin\b.*?^=end\b", re.S | re.M)


@lru_cache(maxsize=256)
def _hint_pattern(words: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, words)), re.I)


def _comment_text(content: str, a: int, b: int, blocks: list[tuple[int, int]]) -> str:
    """What a comment says on the line from a to b; nothing if the line is no comment."""
    line = content[a:b]
    if m := _COMMENT.match(line):
        return m.group(1)
    i = bisect.bisect(blocks, (a, b)) - 1
    return line.strip(" \t*") if i >= 0 and blocks[i][1] >= b else ""


def _comment_blocks(content: str, language: str | None) -> list[tuple[int, int]]:
    if language:  # what only looks like a comment in a string is none
        return mask(language, content)[1]
    return [m.span() for m in _BLOCK.finditer(content)]


def note_evidence(content: str, path: str = "") -> tuple[float, float]:
    """Evidence for generated and vendored from the notes in comments."""
    gen = vend = 0.0
    low = content.lower()
    hints = tuple(w for w in _HINTS if w in low)
    if not hints or not any(x in content for x in ("//", "#", "/*", "--", ";", "%", "*", "=begin")):
        return gen, vend
    done, blocks = -1, None
    for hint in _hint_pattern(hints).finditer(content):
        if hint.start() < done:
            continue  # on a line already read
        a = content.rfind("\n", max(0, done), hint.start()) + 1
        a = a or max(0, done)
        done = content.find("\n", hint.start())
        done = len(content) if done < 0 else done
        if blocks is None:
            blocks = _comment_blocks(content, EXTENSIONS.get(path.rpartition(".")[2])) if any(x in content for x in ("/*", "<!--", "=begin")) else []
        text = _comment_text(content, a, done, blocks)
        for i in range(0, max(1, len(text) - NOTE), NOTE):
            if not gen and GENERATED_NOTE.search(text, i, i + 2 * NOTE):
                gen = 9.0
            if not vend and VENDOR_NOTE.search(text, i, i + 2 * NOTE):
                vend = 9.0
        if gen and vend:
            break
    return gen, vend


def shape_evidence(content: str, name: str) -> tuple[float, float, float]:
    """Evidence for generated, minified and blob from the shape of the content."""
    n = len(content)
    if n < 48 or name.endswith(_PROSE):
        return 0.0, 0.0, 0.0
    config = name.endswith(_CONFIG)
    lines = [x for x in content.split("\n") if x.strip()]
    payload = sum(len(m.group()) for m in _PAYLOAD.finditer(content) if _dense(m.group()))
    numbers = sum(len(m.group()) for m in _NUMBERS.finditer(content))
    blob = 8.0 if (payload + numbers) > 0.6 * n else 0.0
    stripped = content.lstrip()
    if not config and not blob and (stripped[:1] in "{[" and _is_json(stripped)):
        blob = 8.0
    if not config and not blob and _is_delimited(lines):
        blob = 6.0
    # minified: long lines of dense code with short names
    longest = max(map(len, lines), default=0)
    body = sum(len(x) for x in lines if len(x) > 200)
    spaces = sum(map(content.count, (" ", "\t", "\n")))
    mini = 0.0
    if not blob and not config and longest > 200 and body > 0.7 * n and spaces < 0.12 * n and n > 300:
        marks = sum(map(content.count, ";{}()=,:"))
        mini = 8.0 if marks > 0.12 * n else 3.0
    # generated: a few line forms over and over, told apart by numbers only
    gen = 0.0
    if not blob and not mini and not config and len(lines) >= 24:
        forms = Counter(re.sub(r"\d+", "0", _WORDY.sub("w", x.strip())) for x in lines)
        strict = Counter(re.sub(r"[0-9A-Fa-fx]*\d[0-9A-Fa-f]*", "0", x.strip()) for x in lines)
        numbered = sum(c for f, c in strict.items() if "0" in f and c >= 8)
        if numbered > 0.6 * len(lines):
            gen = 8.0
        elif len(forms) < 0.12 * len(lines) and sum(c for _, c in forms.most_common(3)) > 0.8 * len(lines) and sum(any(ch.isdigit() for ch in x) for x in lines) > 0.6 * len(lines):
            gen = 6.0
    return gen, mini, blob


def _dense(s: str) -> bool:
    """Whether a long run of word characters is data: many different characters, digits among them."""
    return len(set(s)) >= 10 and sum(c.isdigit() for c in s) >= len(s) * 0.05 or bool(re.fullmatch(r"[0-9a-fA-F]+", s))


def _is_json(s: str) -> bool:
    if len(s) < 200:
        return False
    import json

    try:
        return isinstance(json.loads(s), (dict, list))
    except ValueError:
        quoted = len(re.findall(r'"[^"\n]*"\s*:', s))
        return quoted > 20 and quoted > 0.8 * s.count("\n") and not re.search(r"\b(?:def|function|class|return|import|fn|func)\b", s)


def _is_delimited(lines: list[str]) -> bool:
    """Rows of a table: the same number of separators in every line and nothing of code."""
    if len(lines) < 20:
        return False
    for sep in (",", "\t", ";", "|"):
        counts = Counter(x.count(sep) for x in lines)
        k, c = counts.most_common(1)[0]
        if k >= 2 and c > 0.95 * len(lines) and not any(ch in "".join(lines[:20]) for ch in "(){}="):
            return True
    return False


def token_runs(content: str, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of k tokens, layout aside."""
    tokens = _TOKEN.findall(content)
    if len(tokens) < k:
        return np.empty(0, dtype=np.uint64)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.get(t) or seen.setdefault(t, xxhash.xxh64_intdigest(t)) for t in tokens), dtype=np.uint64, count=len(tokens))
    n = len(ids) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = (h ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return np.unique(h)


def name_evidence(path: str) -> tuple[float, float, float]:
    """Evidence for generated, minified and vendored from the file's own name."""
    name = path.rpartition("/")[2]
    return (7.0 if re.search(GENERATED_NAME, name, re.I) else 0.0), (7.0 if re.search(MINIFIED_NAME, name, re.I) else 0.0), 0.0


def file_evidence(path: str, content: str | None, likeness: float) -> list[float]:
    content = (content or "").replace("\r\n", "\n")
    e = [PRIOR, 0.0, 0.0, 0.0, 0.0]
    g, m, v = name_evidence(path)
    ng, nv = note_evidence(content, path)
    sg, sm, sb = shape_evidence(content, path.lower())
    e[GEN] = max(g, ng) + (sg if not (g or ng) else 0.5 * sg)
    e[MIN] = max(m, sm)
    e[VEND] = max(v, nv, 9.0 if likeness >= LIKENESS else 0.0)
    e[BLOB] = sb
    return e


def _evidence(runs: np.ndarray, owners: np.ndarray, sizes: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            given = pdf["likeness"].fillna(0.0).tolist() if "likeness" in pdf else None
            for path, content in zip(pdf["path"], pdf["content"]):
                like = 0.0
                if given is not None:
                    like = given[len(out)]
                elif content and len(runs):
                    own = token_runs(content)
                    i = np.searchsorted(runs, own, side="left")
                    j = np.searchsorted(runs, own, side="right")
                    hit = np.flatnonzero(j > i)
                    if len(hit):
                        at = np.concatenate([np.arange(a, b) for a, b in zip(i[hit], j[hit])])
                        common = np.bincount(owners[at], minlength=len(sizes))
                        like = float((common / (sizes + len(own) - common)).max())
                out.append(file_evidence(path, content, like))
            e = np.array(out, dtype=np.float64).reshape(-1, 5)
            paths = [p.replace("\\", "/") for p in pdf["path"]]
            dirs = [p.rpartition("/")[0] for p in paths]
            yield _frame({"path": pdf["path"], "dir": dirs, "depth": [d.count("/") + 1 if d else 0 for d in dirs]}, e=e, u=_up(DIR_FILE, e))

    return run


def _columns(*prefixes: str) -> str:
    return ", ".join(f"{p}{i} double" for p in prefixes for i in range(5))


def _names(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(5)]


def _frame(cols: dict, **blocks: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(cols | {f"{p}{i}": x[:, i] for p, x in blocks.items() for i in range(5)})


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _up(table: tuple, child: np.ndarray) -> np.ndarray:
    """Message to the parent: for each of its labels, the sum over the child's."""
    return _log_sum(child[:, None, :] + np.array(table)[None], axis=2)


def _down(table: tuple, cavity: np.ndarray) -> np.ndarray:
    """Message to a child: for each of its labels, the sum over the parent's, without what the child said."""
    return _log_sum(cavity[:, :, None] + np.array(table)[None], axis=1)


_VENDOR_DIR, _GENERATED_DIR = re.compile(rf"(?:{VENDOR_DIRS})$", re.I), re.compile(rf"(?:{GENERATED_DIRS})$", re.I)


def dir_evidence(path: str) -> list[float]:
    name = path.rpartition("/")[2]
    return [ROOT_PRIOR if not path else 0.0, 12.0 if _GENERATED_DIR.match(name) else 0.0, 0.0, 12.0 if _VENDOR_DIR.match(name) else 0.0, 0.0]


def _collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a directory knows from below (b) and what it tells its parent (u)."""
    for pdf in batches:
        if len(pdf):
            b = pdf[_names("s")].to_numpy() + np.array([dir_evidence(d) for d in pdf["dir"]])
            yield _frame({"dir": pdf["dir"], "parent": [d.rpartition("/")[0] for d in pdf["dir"]]}, b=b, u=_up(DIR_DIR, b))


def _distribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            cavity = pdf[_names("p")].to_numpy() - pdf[_names("u")].to_numpy()
            yield _frame({"dir": pdf["dir"]}, b=pdf[_names("b")].to_numpy() + _down(DIR_DIR, cavity))


def _labels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Handwritten if that is likelier than all the rest together, else the likeliest of the rest; and how likely."""
    p = np.exp(x - _log_sum(x, axis=1)[:, None])
    hand = p[:, HAND] >= 0.5
    return np.array(LABELS, dtype=object)[np.where(hand, HAND, 1 + p[:, 1:].argmax(axis=1))], np.where(hand, p[:, HAND], 1 - p[:, HAND])


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            e = pdf[_names("e")].to_numpy()
            alone, _ = _labels(e)
            label, confidence = _labels(e + _down(DIR_FILE, pdf[_names("b")].to_numpy() - pdf[_names("u")].to_numpy()))
            yield pd.DataFrame({"rel_path": pdf["path"], "label": label, "confidence": confidence, "alone": alone})


def label_files(files: DataFrame, reference: DataFrame | None = None, *, path_col: str = "rel_path", content_col: str = "content", reference_col: str = "content", reference_limit: int = REFERENCE_LIMIT) -> DataFrame:
    """Rows ``(rel_path, label, confidence, alone)`` of all distinct files; confidence is the marginal of
    being handwritten, or of not being so; ``alone`` is the label that the file's own evidence would give."""
    rows = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).filter(F.col("path").isNotNull())
    known = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    if reference is not None:
        sets = written(_reference_sets(reference, reference_col), "reference")
        total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if total > reference_limit:
            rows = _likeness(rows.distinct(), sets)
        else:
            known = _collected(sets)
    evidence = spread(rows, "path").mapInPandas(_evidence(*known), "path string, dir string, depth int, " + _columns("e", "u"))
    return _propagate(written(evidence.distinct(), "evidence"))


def _run_rows(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [token_runs(x) if x else np.empty(0, dtype=np.uint64) for x in pdf["content"]]


def _reference_sets(reference: DataFrame, col: str) -> DataFrame:
    """Rows ``(r, n, mh, runs)`` of the distinct reference texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [(k, s) for k, s in zip(pdf["k"], _run_rows(pdf)) if len(s)]
            if sets:
                mins = min_hashes([s for _, s in sets], LIKENESS_HASHES).view(np.int64)
                yield pd.DataFrame({"r": [k for k, _ in sets], "n": [len(s) for _, s in sets], "mh": list(mins), "runs": [s.view(np.int64) for _, s in sets]})

    texts = reference.select(F.col(col).alias("content")).filter(F.col("content") != "").distinct()
    return texts.select(F.xxhash64("content").alias("k"), "content").mapInPandas(run, "r long, n long, mh array<long>, runs array<long>")


def _collected(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs in order, their owners, and the sizes of the sets; the caller has checked how many there are."""
    got = [np.asarray(r[0], dtype=np.int64).view(np.uint64) for r in sets.select("runs").collect()]
    if not got:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    runs = np.concatenate(got)
    owners = np.repeat(np.arange(len(got)), [len(x) for x in got])
    order = np.argsort(runs, kind="stable")
    return runs[order], owners[order], np.array([len(x) for x in got])


def _likeness(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` with the ``likeness`` of each file to the reference text most like it."""

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [(k, s) for k, s in zip(pdf["f"], _run_rows(pdf)) if len(s)]
            if sets:
                mins = min_hashes([s for _, s in sets], LIKENESS_HASHES).view(np.int64)
                yield pd.DataFrame({"f": [k for k, _ in sets], "mh": list(mins)})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            like = []
            for own, other in zip(_run_rows(pdf), pdf["runs"]):
                other = np.asarray(other, dtype=np.int64).view(np.uint64)
                common = len(np.intersect1d(own, other, assume_unique=True))
                like.append(common / (len(own) + len(other) - common))
            yield pd.DataFrame({"f": pdf["f"], "likeness": like})

    keyed = rows.withColumn("f", F.xxhash64("path", "content"))
    a = spread(keyed.select("f", "content").filter(F.col("content") != ""), "f").mapInPandas(marks, "f long, mh array<long>").select("f", F.posexplode("mh").alias("j", "h"))
    b = sets.select("r", F.posexplode("mh").alias("j", "h"))
    pairs = a.join(b, ["j", "h"]).select("f", "r").distinct()
    met = pairs.join(keyed.select("f", "content"), "f").join(sets.select("r", "runs"), "r").select("f", "content", "runs")
    best = met.mapInPandas(compare, "f long, likeness double").groupBy("f").agg(F.max("likeness").alias("likeness"))
    return keyed.join(best, "f", "left").select("path", "content", "likeness")


def _propagate(files: DataFrame) -> DataFrame:
    """The passes over the trees, from the deepest directories to the roots and back."""
    held = written(files.groupBy("dir", "depth").agg(*[F.sum(f"u{i}").alias(f"s{i}") for i in range(5)]), "held")
    deepest = held.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    up: dict[int, DataFrame] = {}
    below = None
    for depth in range(deepest, -1, -1):
        level = held.filter(F.col("depth") == depth).select("dir", *_names("s"))
        if below is not None:
            level = level.unionByName(below.select(F.col("parent").alias("dir"), *[F.col(f"u{i}").alias(f"s{i}") for i in range(5)]))
        sums = level.groupBy("dir").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(5)])
        up[depth] = below = written(sums.mapInPandas(_collect, "dir string, parent string, " + _columns("b", "u")), f"up{depth}")
    full = [up[0].select("dir", *_names("b"))]
    for depth in range(1, deepest + 1):
        above = full[-1].select(F.col("dir").alias("parent"), *[F.col(f"b{i}").alias(f"p{i}") for i in range(5)])
        full.append(written(up[depth].join(above, "parent").mapInPandas(_distribute, "dir string, " + _columns("b")), f"down{depth}"))
    dirs = full[0]
    for x in full[1:]:
        dirs = dirs.unionByName(x)
    return files.drop("depth").join(dirs, "dir").mapInPandas(_decide, "rel_path string, label string, confidence double, alone string")


def not_handwritten(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("label") != LABELS[HAND])


__all__ = ["LABELS", "file_evidence", "label_files", "not_handwritten", "note_evidence", "shape_evidence", "token_runs"]
