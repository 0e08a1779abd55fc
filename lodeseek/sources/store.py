"""The index on disk: tables in buckets of files, and versions that say which directory holds which bucket.

A file belongs to the bucket of the hash of its repository and path, and so does all that is derived from
it: chunks, vectors, postings, symbols, imports, exports and the counts that the corpus statistics are
summed from. A reindex rewrites the buckets that hold a file that is new, changed or gone; the others stay
where an earlier version wrote them. A version is one small manifest, published by renaming a pointer
last, so readers never see half of one, an interrupted build leaves the old version in force, and a failed
first build leaves none. ``prune`` deletes directories that the current version doesn't name.

Several repositories share a store; rows carry ``repo_id`` and are joined on (repo_id, path), and a
reindex touches no repository but those it is given. Within a bucket tables are sorted by the column they
are looked up by, so that Parquet's statistics prune row groups. The manifest carries schema version,
embedder and the length to which bodies are indexed; all are checked on opening.
"""

from __future__ import annotations

import json
import os
import tempfile
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.hashing import Embedder, embed_rows
from lodeseek.functions.text import chunk_id, code_tokens, index_text, language_of
from lodeseek.operators.delta import changes, latest
from lodeseek.operators.retrieval import postings
from lodeseek.operators.structure import RECORDS, analyse, line_windows
from lodeseek.sources import files as fs
from lodeseek.sources.durable import shuffles_removed

SCHEMA_VERSION = 2
#: The column a table is sorted by within its buckets.
SORTED_BY = {"chunks": "id", "vectors": "id", "postings": "term", "symbols": "chunk_id", "imports": "file_path", "exports": "file_path", "files": "path", "counts": "n"}
#: Files of a bucket when an index is first built, and the bounds of the number of buckets.
FILES_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 2000, 4, 4096
#: Parquet files that a bucket may have on average before a reindex brings its rows together again.
PARTS_PER_BUCKET = 8
#: Keys of repeated or vanished files that are sent to every executor; more meet the rows in a shuffle.
KEYS_SENT = 500_000
CODEC = "zstd"


class StoreError(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def pointer(self) -> str:
        return f"{self.path}/CURRENT"

    def exists(self) -> bool:
        return fs.exists(self.spark, self.pointer)

    def version(self) -> str:
        name = fs.read_text(self.spark, self.pointer)
        if name is None:
            raise StoreError(f"no index at {self.path}; run a reindex")
        return name.strip()

    def meta(self) -> dict:
        """The manifest of the current version."""
        version = self.version()
        found = fs.read_json(self.spark, f"{self.path}/{version}/manifest.json") or fs.read_json(self.spark, f"{self.path}/{version}/meta.json")
        if found is None:
            raise StoreError(f"version {version} of the index at {self.path} has no manifest; run a reindex with force")
        return found

    def verify(self, embedder: Embedder | None = None) -> dict:
        """Refuses another schema, and an embedder other than the one that is stamped (none stamped is accepted)."""
        meta = self.meta()
        schema = meta.get("schema_version", 0)
        if schema > SCHEMA_VERSION:
            raise StoreError(f"the index has schema {schema}, this is {SCHEMA_VERSION}; run a reindex with force")
        if schema < SCHEMA_VERSION:
            raise StoreError(f"the index has schema {schema}, this is {SCHEMA_VERSION}; migrate it or run a reindex with force")
        if embedder is not None and meta.get("embedder_id") is not None and (meta["embedder_id"], meta["embedder_dim"]) != (embedder.id, embedder.dim):
            raise StoreError(f"the index was built with {meta['embedder_id']}/{meta['embedder_dim']}, not {embedder.id}/{embedder.dim}; run a reindex with force")
        return meta

    def bucket(self, repo: Column, path: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(repo, path), F.lit(buckets)).cast("int")

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table of the current version, or those of its ``buckets``."""
        return self._read(self.meta(), name, buckets)

    def _read(self, meta: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
        dirs = sorted({d for b, d in meta["tables"][name]["buckets"].items() if buckets is None or int(b) in buckets})
        schema = meta["tables"][name]["schema"]
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{d}" for d in dirs])

    def describe(self) -> DataFrame:
        """One row for each column of each table: its type, and the number of buckets and of directories."""
        meta = self.meta()
        rows = []
        for name, t in sorted(meta["tables"].items()):
            for i, field in enumerate(self._read(meta, name).schema):
                rows.append((name, i, field.name, field.dataType.simpleString(), len(t["buckets"])))
        return self.spark.createDataFrame(rows, "table string, ord int, column string, type string, buckets int")

    def publish(self, tables: dict[str, DataFrame], embedder: Embedder, buckets: int, *, touched: set[int] | None = None, most_bytes: int | None = None) -> str:
        """Writes the rows of ``tables``, each with its ``bucket``, and makes them the current version. With ``touched``
        only those buckets are replaced, and the others are those of the version before."""
        draft = Draft(self, buckets, touched)
        for name, df in tables.items():
            draft.add(name, df)
        return draft.publish(embedder, most_bytes)

    def prune(self) -> int:
        """Deletes what no bucket of the current version lies in; readers of older versions must be gone."""
        version, meta = self.version(), self.meta()
        used = {d for t in meta["tables"].values() for d in t["buckets"].values()}
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = 0
        for old in system.listStatus(p):
            name = old.getPath().getName()
            if not name.startswith("v-") or name == version:
                continue
            held = {d for d in used if d.startswith(f"{name}/")}
            if not held:
                system.delete(old.getPath(), True)
                gone += 1
                continue
            for t in system.listStatus(old.getPath()):
                for b in system.listStatus(t.getPath()) if t.isDirectory() else ():
                    if b.isDirectory() and f"{name}/{t.getPath().getName()}/{b.getPath().getName()}" not in held:
                        system.delete(b.getPath(), True)
                        gone += 1
        return gone


class Draft:
    """A version in the making: tables are added one by one, and what is there can be read before it is published."""

    def __init__(self, store: Store, buckets: int, touched: set[int] | None = None):
        self.store, self.buckets, self.touched = store, buckets, touched
        self.version = f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        self.before = store.meta()["tables"] if touched is not None else {}
        self.listed: dict[str, dict] = {}

    def add(self, name: str, df: DataFrame, *, laid: bool = False) -> None:
        """Rows that are ``laid`` lie together by bucket where they are read, and are written without a shuffle."""
        store, at, touched = self.store, f"{self.version}/{name}", self.touched
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "bucket")
        if not laid:
            df = df.repartition(min(self.buckets, len(touched) if touched else self.buckets), "bucket")
        with shuffles_removed(store.spark):
            df.sortWithinPartitions("bucket", SORTED_BY[name]).write.option("compression", CODEC).partitionBy("bucket").parquet(f"{store.path}/{at}")
        kept = {b: d for b, d in self.before.get(name, {"buckets": {}})["buckets"].items() if int(b) not in (touched or ())} if touched is not None else {}
        made = {str(b): f"{at}/bucket={b}" for b in (touched if touched is not None else range(self.buckets)) if fs.exists(store.spark, f"{store.path}/{at}/bucket={b}")}
        self.listed[name] = {"schema": schema, "buckets": kept | made}

    def written(self, name: str) -> DataFrame:
        """The rows that ``add`` wrote, each with its ``bucket``."""
        return self.store.spark.read.schema(f"{self.listed[name]['schema']}, bucket int").parquet(f"{self.store.path}/{self.version}/{name}")

    def publish(self, embedder: Embedder, most_bytes: int | None) -> str:
        store = self.store
        manifest = {"schema_version": SCHEMA_VERSION, "embedder_id": embedder.id, "embedder_dim": embedder.dim, "buckets": self.buckets, "most_bytes": most_bytes, "tables": self.listed}
        fs.replace_text(store.spark, f"{store.path}/{self.version}/manifest.json", json.dumps(manifest))
        fs.replace_text(store.spark, store.pointer, self.version)
        return self.version


def corpus_counts(store: Store, meta: dict | None = None) -> DataFrame:
    """One row ``(n, total, avgdl)``: the buckets' counts, summed."""
    counts = store._read(meta or store.meta(), "counts")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).withColumn("avgdl", F.try_divide("total", "n"))


def _built(files: DataFrame, stage: str) -> dict[str, DataFrame]:
    """What is read off the files themselves, each of which is parsed once. All rows carry ``repo_id`` and ``file_path``."""
    analyse(files).write.partitionBy("record").parquet(f"{stage}/records")
    records = files.sparkSession.read.schema(RECORDS).parquet(f"{stage}/records")
    ids = chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"))
    place = ["repo_id", "file_path"]
    known = records.filter(F.col("record") == "chunk").select(*place, ids.alias("id"), "start_line", "end_line", "kind", "body")
    rest = line_windows(files.filter(language_of(F.col("rel_path")).isNull())).select(*place, "id", "start_line", "end_line", "kind", "body")
    return {
        "chunks": known.unionByName(rest),
        "symbols": records.filter(F.col("record") == "symbol").select(*place, ids.alias("chunk_id"), "name", "signature", "kind", "line"),
        "imports": records.filter(F.col("record") == "import").select(*place, "ord", F.col("name").alias("source"), "kind", "line"),
        "exports": records.filter(F.col("record") == "export").select(*place, "ord", F.col("name").alias("detail"), "line"),
        "files": files.select("repo_id", F.col("rel_path").alias("path"), F.sha2("content", 256).alias("content_hash"), "mtime", "language"),
    }


def _derived(chunks: DataFrame, embedder: Embedder, most_bytes: int | None) -> dict[str, DataFrame]:
    """What is made of chunks ``(bucket, repo_id, file_path, id, body)``: vectors, postings, and counts by bucket."""
    place = ["bucket", "repo_id", "file_path", "id"]
    # chunks of distinct ids have their terms counted in place; only what repeats an id has to be brought together
    distinct = not chunks.groupBy("repo_id", "file_path", "id").count().filter("count > 1").head(1)
    vectors = embed_rows(chunks.select(*place, index_text(F.col("body"), most_bytes).alias("text")), embedder, keep=place, text_col="text")
    terms = postings(chunks.select(F.struct(*place).alias("at"), "body"), id_col="at", most_bytes=most_bytes, distinct_ids=distinct)
    return {
        "vectors": vectors,
        "postings": terms.select("chunk_id.bucket", "chunk_id.repo_id", "chunk_id.file_path", "term", F.col("chunk_id.id").alias("chunk_id"), "tf", "dl"),
        "counts": _counts(chunks, most_bytes),
    }


def _counts(chunks: DataFrame, most_bytes: int | None) -> DataFrame:
    length = F.greatest(F.coalesce(F.size(code_tokens(index_text(F.col("body"), most_bytes))), F.lit(0)), F.lit(0)).cast("long")
    return chunks.select("bucket", length.alias("dl")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("dl").alias("total"))


def _staged(df: DataFrame, path: str) -> DataFrame:
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sent(keys: DataFrame) -> DataFrame:
    """``keys`` for a join that leaves the other side where it is, if there are not too many."""
    return F.broadcast(keys) if keys.count() <= KEYS_SENT else keys


def _newest(files: DataFrame, stage: str) -> DataFrame:
    """The row of each path that counts. Contents are moved only for paths that occur more than once."""
    keys = ["repo_id", "rel_path"]
    order = F.col("mtime").desc_nulls_last(), F.col("content")
    repeated = _staged(files.groupBy(*keys).count().filter("count > 1").select(*keys), stage)
    n = repeated.limit(KEYS_SENT + 1).count()
    if n > KEYS_SENT:
        return latest(files, keys, *order)
    if n == 0:
        return files
    repeated = F.broadcast(repeated)
    return files.join(repeated, keys, "left_anti").select(*files.columns).unionByName(latest(files.join(repeated, keys, "left_semi").select(*files.columns), keys, *order))


def reindex(store: Store, files: DataFrame, embedder: Embedder, *, force: bool = False, most_bytes: int | None = None, buckets: int | None = None, repos: list[str] | None = None) -> dict:
    """Brings the index up to ``files (repo_id, rel_path, content, language, mtime)`` and reports.

    The repositories of ``files``, or the ``repos`` named, are brought up to date; others stay as they are. With
    ``force``, or without an index, the index is built of ``files`` alone; otherwise only the buckets of files that
    are new, changed or gone are rewritten. Of rows with one repository and path the one with the latest ``mtime``
    counts, of those the one with the smallest content. Whole bodies are indexed, or their first ``most_bytes``
    bytes (``text.INDEX_BYTES`` in the reference); an index keeps to what it was built with.
    """
    began = time.monotonic()
    spark = store.spark
    stage = f"{store.path}/stage-{uuid.uuid4().hex}"
    files = _newest(files.filter(F.col("repo_id").isNotNull() & F.col("rel_path").isNotNull() & F.col("content").isNotNull()), f"{stage}/repeated")
    full = force or not store.exists()
    touched = gone = None
    if full:
        n, work = buckets, files
    else:
        meta = store.verify(embedder)
        n, most_bytes = meta["buckets"], meta["most_bytes"]
        old = store.table("files")
        own = spark.createDataFrame([(r,) for r in repos], "repo_id string") if repos else files.select("repo_id").distinct()
        now = files.select("repo_id", F.col("rel_path").alias("path"), F.sha2("content", 256).alias("content_hash"))
        diff = changes(now, old.join(own, "repo_id", "left_semi")).filter(F.col("change") != "same")
        diff = _staged(diff.withColumn("bucket", store.bucket(F.col("repo_id"), F.col("path"), n)), f"{stage}/diff")
        # no more rows than there are buckets
        touched = {r[0] for r in diff.select("bucket").distinct().collect()}
        if not touched:
            fs.delete(spark, stage)
            return {"files_indexed": 0, "chunks": 0, "incremental": True, "buckets_written": 0, "duration_ms": int((time.monotonic() - began) * 1000)}
        gone = _sent(diff.filter(F.col("change").isin("deleted", "changed")).select("repo_id", F.col("path").alias("file_path")))
        fresh = _sent(diff.filter(F.col("change").isin("new", "changed")).select("repo_id", F.col("path").alias("rel_path")))
        work = files.join(fresh, ["repo_id", "rel_path"], "left_semi")
    # files and chunks are needed several times; they are written once and read again
    work = _staged(work, f"{stage}/work")
    indexed = work.count()
    n = n or max(LEAST_BUCKETS, min(MOST_BUCKETS, indexed // FILES_PER_BUCKET))
    draft = Draft(store, n, touched)

    def add(name: str, made: DataFrame, laid: bool = False) -> None:
        """With what the touched buckets keep. A table is moved between tasks only if its buckets are in many parts."""
        if not full and name != "counts":
            path = "path" if name == "files" else "file_path"
            kept = store.table(name, touched)
            laid = laid and len(kept.inputFiles()) <= PARTS_PER_BUCKET * len(touched)
            kept = kept.withColumn("bucket", store.bucket(F.col("repo_id"), F.col(path), n)).join(gone.withColumnRenamed("file_path", path), ["repo_id", path], "left_anti")
            made = kept.unionByName(made)
        draft.add(name, made, laid=laid)

    made = {}
    for name, df in _built(work, stage).items():
        path = F.col("path") if name == "files" else F.col("file_path")
        made[name] = df.withColumn("bucket", store.bucket(F.col("repo_id"), path, n))
    if full:
        add("chunks", made.pop("chunks"))
        chunks = draft.written("chunks")
    else:
        chunks = _staged(made.pop("chunks").repartition(min(n, len(touched)), "bucket"), f"{stage}/chunks")
        add("chunks", chunks, laid=True)
    for name, df in made.items():
        add(name, df)
    for done in ("work", "records"):
        fs.delete(spark, f"{stage}/{done}")
    total = chunks.count()
    made = _derived(chunks, embedder, most_bytes)
    for name in ("vectors", "postings"):
        add(name, made[name], laid=True)
    add("counts", made["counts"] if full else _counts(draft.written("chunks"), most_bytes))
    draft.publish(embedder, most_bytes)
    fs.delete(spark, stage)
    return {"files_indexed": indexed, "chunks": total, "incremental": not full, "buckets_written": n if full else len(touched), "duration_ms": int((time.monotonic() - began) * 1000)}


def migrate(store: Store, embedder: Embedder, repo_id: str | None = None) -> bool:
    """Brings an index of schema 1, one unbucketed table each without repositories, to this schema; True if there was
    anything to do. Rows without a repository, or of files that are listed under none, get ``repo_id``."""
    meta = store.meta()
    schema = meta.get("schema_version", 0)
    if schema == SCHEMA_VERSION:
        return False
    if schema > SCHEMA_VERSION:
        raise StoreError(f"the index has schema {schema}, this is {SCHEMA_VERSION}; run a reindex with force")
    base = f"{store.path}/{store.version()}"
    old = {name: store.spark.read.parquet(f"{base}/{name}") for name in ("chunks", "symbols", "imports", "exports", "files")}
    files = old["files"].withColumn("repo_id", F.coalesce("repo_id", F.lit(repo_id or "")))
    n = max(LEAST_BUCKETS, min(MOST_BUCKETS, files.count() // FILES_PER_BUCKET))
    of = files.groupBy(F.col("path").alias("file_path")).agg(F.min("repo_id").alias("repo_id"))
    made = {"files": files.withColumn("bucket", store.bucket(F.col("repo_id"), F.col("path"), n))}
    for name in ("chunks", "symbols", "imports", "exports"):
        rows = old[name].join(of, "file_path", "left").withColumn("repo_id", F.coalesce("repo_id", F.lit(repo_id or "")))
        made[name] = rows.withColumn("bucket", store.bucket(F.col("repo_id"), F.col("file_path"), n))
    made |= _derived(made["chunks"], embedder, meta.get("most_bytes"))
    store.publish(made, embedder, n, most_bytes=meta.get("most_bytes"))
    return True


_BUILDING: dict[str, threading.Lock] = {}
_GUARD = threading.Lock()


def open_or_build(store: Store, files, embedder: Embedder) -> dict:
    """The manifest of a store that may be searched with the embedder; built of ``files()`` if there is none yet.
    Of several callers in one driver one builds and the others wait."""
    with _GUARD:
        lock = _BUILDING.setdefault(store.path, threading.Lock())
    with lock:
        if not store.exists():
            reindex(store, files(), embedder)
    return store.verify(embedder)


def _replace(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(fd, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


class Registry:
    """Which trees are indexed where: a small sorted JSON file. Entries whose index is gone are dropped on loading."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> dict[str, str]:
        try:
            with open(self.path) as f:
                text = f.read()
        except OSError:
            return {}
        entries = json.loads(text) if text.strip() else {}
        return {k: v for k, v in sorted(entries.items()) if os.path.exists(v)}

    def save(self, entries: dict[str, str]) -> None:
        _replace(os.path.abspath(self.path), json.dumps(dict(sorted(entries.items())), indent=2))

    def register(self, root: str, index: str) -> None:
        self.save(self.load() | {os.path.realpath(root): index})

    def remove(self, root: str) -> None:
        self.save({k: v for k, v in self.load().items() if k != os.path.realpath(root)})

    def get(self, root: str) -> str | None:
        return self.load().get(os.path.realpath(root))
