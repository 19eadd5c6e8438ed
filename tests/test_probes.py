"""Probes of any number and length against plain Python."""

import random

from siftwave.operators.filters import probe_logs


def test_probes(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc가 ") for _ in range(rng.choice([0, 1, 5, 70, 300]))) for _ in range(60)] + [None]
    held = [t[i : i + n] for t in texts if t for n in (1, 3, 11, 12, 13, 40, 90) for i in (0, max(0, len(t) - n), 60) if len(t) >= i + n]
    probes = sorted({*held, "", "nowhere", "not in any of these texts"}) + ["nowhere"]
    logs = spark.createDataFrame(list(enumerate(texts)), "id long, message string")
    want = sorted((p, next((i for i, t in enumerate(texts) if t is not None and p in t), -1)) for p in probes)
    for bound in (10_000, 0):
        got = probe_logs(logs, spark.createDataFrame([(p,) for p in probes], "probe string"), max_broadcast=bound).collect()
        assert sorted((r["probe"], -1 if r["id"] is None else r["id"]) for r in got) == want


def test_more_than_ten_thousand_probes(spark):
    logs = spark.range(10_500).selectExpr("id", "concat('log number ', id, '.') AS message")
    got = probe_logs(logs, logs.selectExpr("concat('number ', id, '.') AS probe"))
    assert got.count() == 10_500 and got.filter("id is null or probe <> concat('number ', id, '.')").count() == 0
