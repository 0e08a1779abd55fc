import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodeseek.streaming.watch import bursts, content_changes, relevant, watch

T = datetime(2025, 1, 1)


def test_relevant(spark):
    rows = [("create", "a.py"), ("modify", ".lodeseek/x"), ("access", "a.py"), (None, None), ("any", ".lodeseek"), ("remove", "b"), ("modify", None)]
    got = relevant(spark.createDataFrame(rows, "kind string, path string")).collect()
    assert [(r.kind, r.path) for r in got] == [("create", "a.py"), (None, None), ("remove", "b"), ("modify", None)]


def test_bursts(spark):
    at = [0, 100, 399, 700, 1000, 1301]
    df = spark.createDataFrame([(T + timedelta(milliseconds=x),) for x in at] + [(None,)], "ts timestamp")
    got = sorted((r.started, r.ended, r.events) for r in bursts(df).collect())
    ms = lambda x: T + timedelta(milliseconds=x)
    assert got == [(ms(0), ms(399), 3), (ms(700), ms(1000), 2), (ms(1301), ms(1301), 1)]


def test_watch_runs_once_before_and_per_batch(spark, tmp_path):
    src, calls = tmp_path / "events", []
    src.mkdir()
    (src / "1.json").write_text('{"ts": "2025-01-01T00:00:00Z", "kind": "modify", "path": "a"}\n')
    stream = spark.readStream.schema("ts timestamp, kind string, path string").json(str(src))

    def handle():
        calls.append(time.time())
        if len(calls) == 2:
            raise RuntimeError("one failure does not end the watch")

    q = watch(stream, handle, str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert len(calls) == 2 and q.exception() is None
    (src / "2.json").write_text('{"ts": "2025-01-01T00:00:01Z", "kind": "access", "path": "a"}\n')
    watch(stream, lambda: calls.append(0), str(tmp_path / "cp"), once=True).awaitTermination()
    assert len(calls) == 3  # the run before the stream; reads call for none


def test_content_changes_keep_state(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    seen = []
    for n, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2"), ("c", "1")])):
        (src / f"{n}.csv").write_text("\n".join(",".join(r) for r in rows))
        stream = spark.readStream.schema("path string, content_hash string").csv(str(src))
        q = content_changes(stream).writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(out)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(seen) == [("a", "new"), ("b", "changed"), ("b", "new"), ("c", "new")]


def test_streaming_bursts_with_watermark(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    (src / "1.json").write_text("\n".join(f'{{"ts": "2025-01-01T00:00:{s:02d}Z"}}' for s in (0, 1, 2, 30, 59)))
    stream = spark.readStream.schema("ts timestamp").json(str(src))
    got = []
    q = bursts(stream, 2000, watermark="1 second").writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend(r.events for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(got) == [1, 3]


def test_static_session_window(spark):
    df = spark.range(3).select(F.lit(T).alias("ts"), (F.col("id") % 2).alias("k"))
    assert sorted((r.k, r.events) for r in bursts(df, keys=("k",)).collect()) == [(0, 2), (1, 1)]
