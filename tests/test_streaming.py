"""Streaming forms over files that are all there: sources, sinks and keyed state."""

import json

from pyspark.sql import functions as F


def memory(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def write(path, name, doc):
    with open(f"{path}/{name}", "w") as f:
        json.dump(doc, f)


def test_watched_reports_go_to_a_table(spark, tmp_path):
    from siftwave.streaming.sinks import emit, in_batches, watch_reports

    src = tmp_path / "in"
    src.mkdir()
    write(src, "20260101_A.json", {"tp": 1, "fn": 2})
    write(src, "20260102_B.json", {"tp": 3, "fn": 4})
    write(src, "notes.json", {"tp": 9, "fn": 9})
    run = lambda: emit(watch_reports(spark, str(src), "tp long, fn long"), f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True).awaitTermination()
    run()
    write(src, "20260103_A.json", {"tp": 5, "fn": 6})
    run()  # only the new file is read
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("date", "source", "tp", "fn").collect())
    assert got == [("20260101", "A", 1, 2), ("20260102", "B", 3, 4), ("20260103", "A", 5, 6)]
    seen = {}
    in_batches(watch_reports(spark, str(src), "tp long, fn long", files_at_once=2), lambda df, n: seen.update({n: df.count()}), f"{tmp_path}/ck2", available_now=True).awaitTermination()
    assert len(seen) > 1 and sum(seen.values()) == 3


def test_keyed_streams(spark, tmp_path):
    from siftwave.streaming.counters import daily_matrix, hold_counts, latest, once

    rows = [(1, "a", "2026-01-01 10:00:00", True, True), (2, "a", "2026-01-01 11:00:00", True, False), (3, "b", "2026-01-02 10:00:00", False, True), (4, "a", "2026-01-09 10:00:00", None, None)]
    df = spark.createDataFrame(rows, "seq long, key string, ts string, human_spam boolean, machine_spam boolean").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/rows")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/rows")
    assert {r["key"]: (r["seq"], r["machine_spam"]) for r in memory(latest(stream(), "key", "seq", "machine_spam"), "update", "newest")} == {"a": (4, None), "b": (3, True)}
    assert {r["key"]: (r["seen"], r["locked"]) for r in memory(hold_counts(stream(), "key", 3), "update", "held")} == {"a": (3, True), "b": (1, False)}
    assert sorted(r["key"] for r in memory(once(stream(), "ts", "30 days", "key").select("key"), "append", "once")) == ["a", "b"]
    days = {str(r["date"]): (r["tp"], r["fn"], r["fp"], r["tn"]) for r in memory(daily_matrix(stream(), "ts"), "update", "days")}
    assert days == {"2026-01-01": (1, 1, 0, 0), "2026-01-02": (0, 0, 1, 0), "2026-01-09": (0, 0, 0, 1)}
