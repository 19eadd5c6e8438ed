"""Dictionary matches against a plain search, for texts and signatures of any bytes and lengths."""

import random

from pyspark.sql import functions as F

from siftwave.operators import lookup as L


def rows(rng, n):
    alphabet = "abcdé漢 "
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)]


def test_match_signature(spark):
    rng = random.Random(2)
    texts = [*rows(rng, 150), "x" * 5000, "", None]
    pieces = [t[a : a + rng.choice([4, 5, 8, 9, 20, 40])] for t in texts if t for a in (rng.randrange(len(t)),)]
    signatures = [(s, i % 7) for i, s in enumerate([*pieces, "abc", "", *pieces[:5]])]
    m = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string").repartition(3)
    s = spark.createDataFrame([*signatures, (None, 1)], "signature string, created_at int")
    got = {r["id"]: r["signature"] for r in L.match_signature(m, s).collect()}
    for i, t in enumerate(texts):
        hits = [(c, len(x), x.encode()) for x, c in signatures if len(x) >= 4 and x in (t or "")]
        assert got[i] == (max(hits)[2].decode() if hits else None), i
    assert len(got) == len(texts)
    none = L.match_signature(m, s.limit(0)).collect()
    assert len(none) == len(texts) and not any(r["signature"] for r in none)
    assert L.match_signature(m.limit(0), s).count() == 0


def test_found_signatures_through_a_crowded_bitmap(spark, monkeypatch):
    """A bitmap in which nearly every hash has its bit gives the same rows."""
    from siftwave.functions import byte_hash

    rng = random.Random(3)
    texts = rows(rng, 60)
    m = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    s = spark.createDataFrame([(t[:6],) for t in texts if len(t) >= 6], "signature string").distinct().withColumn("x", F.lit(1))
    hits = lambda: sorted((r["id"], r["signature"]) for r in L.found_signatures(m, s).filter("signature is not null").collect())
    want = hits()
    small = byte_hash.bitmap_of
    monkeypatch.setattr(L, "bitmap_of", lambda df: small(df, 64))
    assert hits() == want and len(want) >= len(s.collect())


def test_runtime_signatures(spark):
    rng = random.Random(4)
    texts = [*rows(rng, 80), "same words here", "same words here", "x same words here", None]
    minted = [t[:9] if t and i % 3 != 1 else None for i, t in enumerate(texts)]
    m = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, minted, strict=True))], "id long, body string, minted string")
    got = {r["id"]: r["reused"] for r in L.runtime_signatures(m).collect()}
    for i, t in enumerate(texts):
        first = next((k for k in minted[:i] if k and len(k) >= 4 and k in (t or "")), None)
        assert got[i] == first
