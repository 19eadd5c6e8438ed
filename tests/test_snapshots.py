"""Snapshots: crashes before the commit, batches that come again, untouched buckets; and days that are delivered again."""

import json

import pytest
from pyspark.sql import functions as F

from siftwave.operators import lookup as L
from siftwave.sources.snapshots import SnapshotTable


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def counts(target, rows):
    return L.count_upsert(target, rows, "key")


def test_versions_and_buckets(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), "key string, count long", "key", buckets=8)
    assert t.read().count() == 0 and t.versions() == []
    hits = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    assert t.commit(hits("a", "b", "a", "c", "d", "e", None), counts) == 1
    before = t.manifest()["buckets"]
    assert t.commit(hits("a", "f"), counts) == 2
    after = t.manifest()["buckets"]
    touched = {str(r[0]) for r in hits("a", "f").select(t.bucket()).collect()}
    assert {b for b in after if after[b] != before.get(b)} == touched and len(touched) < len(after)
    assert {k: n for k, n in (tuple(r) for r in t.read().collect()) if k} == {"a": 3, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}
    assert dict(r for r in rows_of(t.read(1).filter("key is not null"))) == {"a": 2, "b": 1, "c": 1, "d": 1, "e": 1}
    t.commit(hits("a", "b"), lambda old, new: old.join(new, "key", "left_anti"))
    assert "a" not in {r["key"] for r in t.read().collect()}


def test_crash_before_the_commit(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, str(tmp_path / "t"), "key string, count long", "key", buckets=4)
    one = spark.createDataFrame([("a",), ("b",)], "key string")
    t.commit(one, counts)
    good = rows_of(t.read())
    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.commit(one, counts)
    assert rows_of(t.read()) == good and t.versions() == [1]
    t.commit(one, counts)
    assert dict(rows_of(t.read())) == {"a": 2, "b": 2}
    late = t.manifest() | {"version": 2}
    with pytest.raises(RuntimeError):
        t._publish(late)
    assert dict(rows_of(t.read())) == {"a": 2, "b": 2}


def test_replayed_batches(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), "key string, count long", "key", buckets=4)
    src = str(tmp_path / "in")
    spark.createDataFrame([("a",), ("b",), ("a",)], "key string").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("key string").parquet(src)
    t.commit_stream(stream(), counts, "hits", f"{tmp_path}/ck", available_now=True).awaitTermination()
    assert dict(rows_of(t.read())) == {"a": 2, "b": 1}
    # The checkpoint is lost after the commit: batch 0 is handed over again.
    t.commit_stream(stream(), counts, "hits", f"{tmp_path}/ck2", available_now=True).awaitTermination()
    assert dict(rows_of(t.read())) == {"a": 2, "b": 1} and t.versions() == [1]
    t.commit_stream(stream(), counts, "other", f"{tmp_path}/ck3", available_now=True).awaitTermination()
    assert dict(rows_of(t.read())) == {"a": 4, "b": 2}


def test_days_delivered_again(spark, tmp_path):
    from siftwave.operators.compare import daily_trend
    from siftwave.streaming.daily import delivered, keep_days, watch_deliveries

    src = tmp_path / "in"
    src.mkdir()

    def put(name, *n):
        (src / name).write_text(json.dumps(dict(zip(("tp", "fn", "fp", "tn"), n, strict=True))))

    def run(ck="ck"):
        keep_days(watch_deliveries(spark, str(src)), f"{tmp_path}/out", f"{tmp_path}/{ck}", available_now=True).awaitTermination()

    put("20260101_A.json", 10, 2, 1, 40)
    put("20260101_B.json", 5, 0, 0, 5)
    put("20260102_A.json", 7, 1, 1, 9)
    put("notes.json", 9, 9, 9, 9)
    run()
    trend = lambda: spark.read.parquet(f"{tmp_path}/out/trend").withColumn("date", F.col("date").cast("string"))
    first = {r["date"]: r["tp"] for r in trend().collect()}
    assert first == {"20260101": 15, "20260102": 7}
    put("20260101_A-corrected.json", 11, 1, 1, 40)  # the same day and source under another name
    run()
    now = delivered(spark, f"{tmp_path}/out")
    want = {tuple(r[c] for c in ("date", "sources", "tp", "fn", "f1", "kappa")) for r in daily_trend(now).collect()}
    assert {tuple(r[c] for c in ("date", "sources", "tp", "fn", "f1", "kappa")) for r in trend().collect()} == want
    assert {(r["date"], r["source"], r["tp"]) for r in now.collect()} == {("20260101", "A", 11), ("20260101", "B", 5), ("20260102", "A", 7)}
    run("ck2")  # everything again, as after a lost checkpoint: the newest file of a day and source wins
    assert {(r["date"], r["source"], r["tp"]) for r in delivered(spark, f"{tmp_path}/out").collect()} == {("20260101", "A", 11), ("20260101", "B", 5), ("20260102", "A", 7)}
