"""Walking a directory tree as a DataFrame, with the rules of ignore files and the gates of a scan.

``binaryFile`` lists and reads the files; length and path filters are pushed into the listing, so a
file that is too large is never read. Ignore files are read first and applied as a predicate.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.functions.text import MAX_FILE_BYTES, MAX_LINE_BYTES, language_of, no_long_line, relative_path

STATE_DIR = ".lodeseek"
IGNORE_FILES = (".gitignore", ".ignore")


@lru_cache(maxsize=4096)
def ignore_pattern(rule: str) -> re.Pattern | None:
    """The regular expression of one ignore rule over a path relative to the rule's directory."""
    rule = rule.rstrip("\n")
    rule = re.sub(r"(?<!\\) +$", "", rule)
    if not rule or rule.startswith("#"):
        return None
    rule = rule.removeprefix("!")
    only_dir = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.removeprefix("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + r"(?:.*/)?", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + r"/.+", i + 3
        elif rule[i] == "*":
            out, i = out + r"[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + r"[^/]", i + 1
        elif rule[i] == "[" and (j := rule.find("]", i + 2)) > 0:
            out, i = out + "[" + rule[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]", j + 1
        elif rule[i] == "\\" and i + 1 < len(rule):
            out, i = out + re.escape(rule[i + 1]), i + 2
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return re.compile(("" if anchored else r"(?:.*/)?") + out + (r"/.*" if only_dir else r"(?:/.*)?") + r"\Z", re.S)


def ignored(path: str, rules: list[tuple]) -> bool:
    """Whether ``path`` is ignored; ``rules`` gives directories and their lines, outer first, and for a directory above
    the root the way from it to the root. Hidden names are ignored always."""
    parts = path.split("/")
    if any(part.startswith(".") for part in parts):
        return True
    for n in range(1, len(parts) + 1):  # what lies in an ignored directory can't be taken back
        sub, verdict = "/".join(parts[:n]), False
        for base, lines, *above in rules:
            if base and not sub.startswith(base + "/"):
                continue
            rel = f"{above[0]}/{sub}" if above else sub[len(base) + 1 :] if base else sub
            for line in lines:
                p = ignore_pattern(line)
                if p and p.match(rel + ("/" if n < len(parts) and line.rstrip().endswith("/") else "")):
                    verdict = not line.startswith("!")
        if verdict:
            return True
    return False


def global_ignore_file(home: str | None = None) -> str:
    """The ignore file of all of a user's trees: what ``core.excludesFile`` names, or ``ignore`` in git's folder."""
    home = home or os.path.expanduser("~")
    folder = os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config"), "git")
    for config in (os.path.join(home, ".gitconfig"), os.path.join(folder, "config")):
        section = ""
        for line in _lines(config):
            if m := re.match(r"\s*\[\s*(\w+)", line):
                section = m.group(1).lower()
            elif section == "core" and (m := re.match(r"\s*excludesfile\s*=\s*\"?([^\"#;]+)", line, re.I)):
                return os.path.join(home, m.group(1).strip().removeprefix("~/"))
    return os.path.join(folder, "ignore")


def read_rules(root: str, home: str | None = None) -> list[tuple]:
    """Ignore files of the user, above ``root`` and below it, outer ones first. Ignored directories are not entered."""
    root = os.path.abspath(root)
    found: list[tuple] = []
    if lines := _lines(global_ignore_file(home)):
        found.append(("", lines))
    above, up = [], root
    while os.path.dirname(up) != up:
        up = os.path.dirname(up)
        above.append(up)
    for d in reversed(above):
        if lines := [x for f in IGNORE_FILES for x in _lines(os.path.join(d, f))]:
            found.append(("", lines, os.path.relpath(root, d).replace(os.sep, "/")))
    if lines := _lines(os.path.join(root, ".git", "info", "exclude")):
        found.append(("", lines))
    for d, dirs, _ in os.walk(root):
        base = os.path.relpath(d, root).replace(os.sep, "/")
        base = "" if base == "." else base
        if lines := [x for f in IGNORE_FILES for x in _lines(os.path.join(d, f))]:
            found.append((base, lines))
        near = [r for r in found if not r[0] or (base + "/").startswith(r[0] + "/")]
        dirs[:] = sorted(x for x in dirs if not ignored(f"{base}/{x}/_".lstrip("/"), near))
    return found


def _lines(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read().splitlines()
    except OSError:
        return []


def walk(spark: SparkSession, root: str, *, repo_id: str | None = None, max_bytes: int = MAX_FILE_BYTES, max_line: int = MAX_LINE_BYTES) -> DataFrame:
    """Rows ``(repo_id, rel_path, content, language, mtime, length)`` of the files that pass all gates:
    not ignored, not the engine's own, within both sizes, valid UTF-8 (NUL bytes are)."""
    root = os.path.realpath(root)
    rules = read_rules(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{root}")
    rows = raw.filter(F.col("length") <= max_bytes).select(relative_path(F.col("path"), root).alias("rel_path"), "content", "modificationTime", "length")
    rows = rows.filter(F.col("rel_path").isNotNull() & ~F.startswith("rel_path", F.lit(STATE_DIR + "/")))

    @F.pandas_udf("boolean")
    def hidden(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: ignored(p, rules))

    text = rows.filter(~hidden("rel_path")).withColumn("content", F.try_validate_utf8(F.col("content").cast("string")))
    kept = text.filter(F.col("content").isNotNull() & no_long_line(F.col("content"), max_line))
    rid = F.lit(repo_id) if repo_id else F.sha2(F.lit(root), 256)
    return kept.select(rid.alias("repo_id"), "rel_path", "content", language_of(F.col("rel_path")).alias("language"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length"))


def read_records(spark: SparkSession, path: str, take: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(records (ord, docstring, code), malformed (ord, line))`` of a JSON-lines file; blank lines are
    neither; ``take`` keeps the first so many usable records by their place in the file."""

    # lines keep their order within a split; a split's first place follows from the lines of those before it
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("at"))
    sizes = lines.groupBy("f", "s").agg(F.count("*").alias("k"))
    before = sizes.select("f", "s", (F.sum("k").over(Window.orderBy("f", "s")) - F.col("k")).alias("before"))  # one row for each split
    placed = lines.withColumn("n", F.row_number().over(Window.partitionBy("f", "s").orderBy("at")) - 1).join(before, ["f", "s"])
    lines = placed.select((F.col("before") + F.col("n")).alias("ord"), "value").filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", "docstring string, code string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.filter(F.col("r._bad").isNull() & F.col("r.docstring").isNotNull() & F.col("r.code").isNotNull())
    usable = good.select("ord", "r.docstring", "r.code").filter((F.trim("docstring") != "") & (F.trim("code") != ""))
    records = usable.orderBy("ord").limit(take) if take is not None else usable
    return records, parsed.filter(F.col("r._bad").isNotNull()).select("ord", F.col("value").alias("line"))
