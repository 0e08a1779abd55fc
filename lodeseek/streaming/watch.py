"""Watching: reindexing on change events, with debounce, and change detection as a stateful stream."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeseek.sources.repo import STATE_DIR

DEBOUNCE_MS = 300
#: Events that can change what is indexed. Reads can't.
RELEVANT = ("create", "modify", "remove", "any")


def relevant(events: DataFrame, state_dir: str = STATE_DIR) -> DataFrame:
    """``events (ts, kind, path)`` that call for a reindex: a change of something outside the engine's own folder,
    or an error of the watcher (kind null), after which anything may have changed."""
    own = (F.col("path") == state_dir) | F.startswith("path", F.lit(state_dir + "/"))
    return events.filter(F.col("kind").isNull() | (F.col("kind").isin(*RELEVANT) & ~F.coalesce(own, F.lit(False))))


def bursts(events: DataFrame, gap_ms: int = DEBOUNCE_MS, *, ts_col: str = "ts", keys: tuple[str, ...] = (), watermark: str | None = None) -> DataFrame:
    """One row per run of events with at most ``gap_ms`` between neighbours: start, end, count.

    Works on a stream as well, with ``watermark`` as the time that late events are waited for.
    """
    if events.isStreaming:
        events = events.withWatermark(ts_col, watermark or "10 seconds")
    # a stream has no sessions without a key; one for all events takes its place
    every = () if keys or not events.isStreaming else (F.substring(F.col(ts_col).cast("string"), 1, 0).alias("_all"),)
    g = events.filter(F.col(ts_col).isNotNull()).groupBy(*keys, *every, F.session_window(ts_col, f"{gap_ms} milliseconds").alias("w"))
    end = F.expr(f"w.end - interval {gap_ms} milliseconds")
    return g.agg(F.count("*").alias("events")).select(*keys, F.col("w.start").alias("started"), end.alias("ended"), "events")


def watch(stream: DataFrame, handle: Callable[[], None], checkpoint: str, *, every: str = f"{DEBOUNCE_MS} milliseconds", once: bool = False, calls: Callable[[DataFrame], bool] | None = None):
    """Runs ``handle`` (an incremental, hence idempotent, reindex) once before the stream and once per
    micro-batch with relevant events, or for which ``calls`` is true. An error of one batch is printed and the next goes on."""
    calls = calls or (lambda df: not relevant(df).isEmpty())
    handle()

    def batch(df: DataFrame, n: int) -> None:
        if calls(df):
            try:
                handle()
            except Exception as e:
                print(f"reindex of batch {n} failed: {e}", flush=True)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def tree_mark(spark: SparkSession, root: str) -> tuple[int, int]:
    """Number of the tree's files and a sum over their paths, times and lengths; contents aren't read."""
    root = os.path.realpath(root)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{root}").select("path", "modificationTime", "length")
    rel = F.substring("path", len(f"file:{root}/") + 1, 1 << 30)
    own = listed.filter(~F.startswith(rel, F.lit(STATE_DIR + "/")))
    n, total = own.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("path", "modificationTime", "length"), F.lit(1 << 31)))).first()
    return n, total or 0


def watch_tree(spark: SparkSession, root: str, handle: Callable[[], None], checkpoint: str, *, every: str = "1 second"):
    """``watch`` of a tree that nothing sends events of: a ticking stream compares the tree's listing with the last
    one, and changes between two ticks call for one reindex. Events of another source go to ``watch`` itself."""
    last = [tree_mark(spark, root)]  # taken before the first reindex, so that nothing in between is missed
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def changed(df: DataFrame) -> bool:
        now = tree_mark(spark, root)
        if now == last[0]:
            return False
        last[0] = now
        return True

    return watch(ticks, handle, checkpoint, every=every, calls=changed)


def content_changes(files: DataFrame, *, forget_after_ms: int | None = None) -> DataFrame:
    """A stream ``(path, content_hash)`` turned into ``(path, change)`` with new or changed; a state per path
    holds the last hash, so a file seen again with the same content gives nothing. With ``forget_after_ms`` the
    state of a path that was not seen for so long is dropped, and the path is new when it comes again."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get[0] if state.exists else None
        out = []
        for pdf in batches:
            for h in pdf["content_hash"]:
                if h != old:
                    out.append((key[0], "new" if old is None else "changed"))
                    old = h
        if old is not None:
            state.update((old,))
            if forget_after_ms is not None:
                state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(out, columns=["path", "change"])

    rows = files.filter(F.col("path").isNotNull() & F.col("content_hash").isNotNull()).select("path", "content_hash")
    return rows.groupBy("path").applyInPandasWithState(step, "path string, change string", "hash string", "append", GroupStateTimeout.NoTimeout if forget_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def default_store(root: str) -> str:
    return os.path.join(os.path.realpath(root), STATE_DIR)
