"""Keyed streaming state: event order against the batch windows, restarts, late rows, gaps and expiry."""

import random
import time

import pytest
from pyspark.sql import functions as F

from siftwave.operators import windows as W
from siftwave.streaming import state as S


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(*S.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(S.ROCKSDB[0])
    spark.conf.set("spark.sql.shuffle.partitions", before)


def land(spark, rows, schema, path):
    """One more file of a streamed folder."""
    df = spark.createDataFrame(rows, schema)
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)


def run(build, spark, tmp_path, schema, name):
    """Reads what is new since the last run of `name`, and returns all that was ever emitted."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = build(src).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return [r.asDict() for r in spark.read.parquet(f"{tmp_path}/{name}").collect()]


def stamp(second):
    return f"2026-01-01 00:{second // 60:02d}:{second % 60:02d}"


def test_event_order_over_restarts(rocks, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"k{rng.randrange(4)}", stamp(10 * i), rng.random() < 0.6) for i in range(60)]
    schema = "seq long, key string, ts string, failed boolean"
    typed = "seq long, key string, ts timestamp, failed boolean"
    folder = f"{tmp_path}/in"
    mixed = rows[:]
    for a in range(0, 60, 6):  # disorder of up to a minute
        mixed[a : a + 6] = rng.sample(mixed[a : a + 6], 6)
    strikes = lambda df: S.strikes_in_order(df, "key", "ts", "seq", "failed", "70 seconds")
    land(rocks, mixed[:30], schema, folder)
    first = run(strikes, rocks, tmp_path, typed, "strikes")
    assert 0 < len(first) < 30  # the newest rows wait
    land(rocks, mixed[30:], schema, folder)
    land(rocks, [(999, "end", "2026-01-01 02:00:00", False)], schema, folder)
    land(rocks, [(1000, "k0", stamp(3), True), (1001, "end", "2026-01-01 02:00:01", False)], schema, folder)  # k0's row is far too late
    got = {(r["key"], r["seq"]): (r["fails"], r["state"]) for r in run(strikes, rocks, tmp_path, typed, "strikes") if r["key"] != "end"}
    df = rocks.createDataFrame(rows, schema)
    want = {(r["key"], r["seq"]): (r["fails"], r["state"]) for r in W.three_strike(df, "key", "seq", "failed").collect()}
    assert got == want
    held = run(lambda df: S.holds_in_order(df, "key", "ts", "seq", "70 seconds", 5), rocks, tmp_path, typed, "holds")
    want = {(r["key"], r["seq"]): (r["seen"], r["locked"]) for r in W.running_hold(df, "key", "seq", 5).collect()}
    assert {(r["key"], r["seq"]): (r["seen"], r["locked"]) for r in held if r["key"] != "end"} == want


def test_results_in_order(rocks, tmp_path):
    rng = random.Random(6)
    schema, typed = "job string, idx long, ts string, body string", "job string, idx long, ts timestamp, body string"
    rows = [(job, i, stamp(i), f"{job}{i}") for job in "ab" for i in range(20)]
    lost = [r for r in rows if r[:2] != ("b", 7)]
    rng.shuffle(lost)
    for part in (lost[:15], lost[15:25] + lost[:5], lost[25:]):
        land(rocks, part, schema, f"{tmp_path}/in")
    ordered = lambda df: S.in_index_order(df, "job", "idx", "ts", "body", "60 seconds", 60_000)
    got = run(ordered, rocks, tmp_path, typed, "ordered")
    assert sorted(r["idx"] for r in got if r["job"] == "a") == list(range(20))
    assert sorted(r["idx"] for r in got if r["job"] == "b") == list(range(7))  # the rest waits behind the gap
    for part in ([("c", 0, stamp(600), "c0")], [("c", 1, stamp(601), "c1")]):
        land(rocks, part, schema, f"{tmp_path}/in")
    got = run(ordered, rocks, tmp_path, typed, "ordered")
    assert sorted(r["idx"] for r in got if r["job"] == "b") == [i for i in range(20) if i != 7]
    assert all(r["payload"] == f"{r['job']}{r['idx']}" for r in got)


def test_order_within_micro_batches(rocks, tmp_path):
    """What a batch emits of a job ascends, and follows what earlier batches emitted."""
    schema, typed = "job string, idx long, ts string, body string", "job string, idx long, ts timestamp, body string"
    order = [2, 0, 1, 4, 3]
    for i in order:
        land(rocks, [("a", i, stamp(i), str(i))], schema, f"{tmp_path}/in")
    seen = []
    src = rocks.readStream.schema(typed).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    S.in_index_order(src, "job", "idx", "ts", "body", "1 hour", 10).writeStream.foreachBatch(lambda df, n: seen.extend(r["idx"] for r in df.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert seen == list(range(5))


def test_expiry(rocks, tmp_path):
    schema = "key string, ts string"
    typed = "key string, ts timestamp"
    counts = {}
    land(rocks, [("a", stamp(0)), ("a", stamp(1)), ("b", stamp(2))], schema, f"{tmp_path}/in")
    src = rocks.readStream.schema(typed).parquet(f"{tmp_path}/in")
    keep = lambda df, n: counts.update({r["key"]: r["n"] for r in df.collect()})
    q = S.counts_with_expiry(src, "key", 6000).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()

    def wait_for(n):
        for _ in range(80):
            if counts.get("a") == n:
                return True
            time.sleep(0.5)

    try:
        assert wait_for(2) and counts["b"] == 1
        time.sleep(8)
        land(rocks, [("a", stamp(3))], schema, f"{tmp_path}/in")
        assert wait_for(1)
    finally:
        q.stop()
