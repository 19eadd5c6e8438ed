"""Progress events against a plain replay, in one batch and as a stream; pages against sorting."""

import random

from pyspark.sql import functions as F

from siftwave.operators.progress import Pages, merge_progress
from siftwave.streaming import state as S


def replay(events):
    logs = {}
    for seq, message, reason in sorted(events):
        message = message or ""
        open_ = [k for k in sorted(logs) if logs[k][0] == message and logs[k][1] is None]
        if reason is not None and open_:
            logs[open_[0]] = (message, seq, reason)
        elif reason is None:
            logs[seq] = (message, None, None)
        elif not any(m == message and r == reason for m, _, r in logs.values()):
            logs[seq] = (message, seq, reason)
    return {(k, *v) for k, v in logs.items()}


def some_events(n):
    rng = random.Random(n)
    return [(i, rng.choice(["a", "b", "", None, "c"]), rng.choice([None, None, "x", "y", "z"])) for i in range(n)]


SCHEMA = "seq long, message string, reason string"


def test_merge_progress(spark):
    for n in (0, 7, 200):
        events = some_events(n)
        got = {tuple(r) for r in merge_progress(spark.createDataFrame(events, SCHEMA)).select("log", "message", "result", "reason").collect()}
        assert got == replay(events)


def test_progress_stream(spark, tmp_path):
    spark.conf.set(*S.ROCKSDB)
    events = some_events(60)
    for a in range(0, 60, 20):
        spark.createDataFrame(events[a : a + 20], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = {}
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keep = lambda df, n: last.update({r["log"]: (r["message"], r["result"], r["reason"]) for r in df.collect()})
    S.progress_stream(src).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset(S.ROCKSDB[0])
    assert {(k, *v) for k, v in last.items()} == replay(events)


def test_pages(spark):
    rows = [(i, (i * 7919) % 501) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, x long")
    pages = Pages(df, -F.col("x"), "id", parts=8)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert pages.total == 1000
    for number in (1, 2, 7, 34, 500):
        got = sorted((r["pos"], r["id"], r["x"]) for r in pages.page(number, 30).collect())
        assert got == [(i + 1, *order[i]) for i in range((number - 1) * 30, min(number * 30, 1000))]
    plan = pages.page(17, 30)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan or "_part" in plan.split("PartitionFilters")[1][:200]
    assert len({f for f in pages.page(17, 30).select(F.input_file_name()).distinct().collect()}) <= 2
    assert Pages(df.limit(0), "id").page(1, 10).count() == 0
