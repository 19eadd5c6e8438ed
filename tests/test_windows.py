"""Global positions and running sums over many partitions, from the written output."""

import random

from pyspark.sql import functions as F


def test_positions_are_a_permutation(spark, tmp_path):
    from siftwave.operators.windows import global_position

    rows = spark.range(100_000, numPartitions=8).select(F.xxhash64("id").alias("k"), "id")
    for n in ("8", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        global_position(rows, "k", "id").write.parquet(f"{tmp_path}/{n}")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for n in ("8", "13"):
        got = spark.read.parquet(f"{tmp_path}/{n}").toPandas().sort_values("pos")
        assert got["pos"].tolist() == list(range(1, 100_001)) and got["k"].is_monotonic_increasing
    assert global_position(rows.limit(0), "k", "id").count() == 0


def test_running_state_of_hot_keys(spark):
    from siftwave.operators.compare import occurrence_index
    from siftwave.operators.windows import running_hold, three_strike

    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", None, "b", f"k{i}"]), rng.choice([True, True, None, False])) for i in range(4000)]
    df = spark.createDataFrame(rows, "o long, key string, bad boolean").repartition(8)
    seen, fails, good, want = {}, {}, {}, {}
    for o, k, bad in rows:
        f = fails.get(k, 0)
        state = "shared" if good.get(k) else "forced" if f + bool(bad) >= 3 and (bad or f >= 3) else "failed" if bad else "success"
        want[o] = (seen.get(k, 0) + 1, f, state)
        seen[k], fails[k], good[k] = seen.get(k, 0) + 1, f + bool(bad), good.get(k) or not bad
    hold = {r["o"]: (r["seen"], r["locked"]) for r in running_hold(df, "key", "o").collect()}
    strike = {r["o"]: (r["fails"], r["state"]) for r in three_strike(df, "key", "o", "bad").collect()}
    occ, far = ({r["o"]: r["occ"] for r in occurrence_index(df, "key", "o", large).collect()} for large in (100_000, 3))
    assert occ == far
    for o, (n, f, state) in want.items():
        assert hold[o] == (n, n >= 10) and strike[o] == (f, state) and occ[o] == n
