"""Benchmark decontamination: a prefix-filtered set join over item-sized windows.

A window is `window` consecutive words of an item; a shorter item is one window. Containment of a whole
window needs each of its shingles, so the necessary prefix is one token: the shingle that is rarest over
all documents. Windows with a shingle that no document has are gone before the join. A document position
that meets a prefix token must leave room for the window on both sides (positional and length bounds),
and then all words of the window are compared.

All document work is in one pass of built-in functions per join: words are exploded once, and only
verified positions and one row per document are shuffled. The windows are broadcast within `max_bytes`, which
their words are measured against; beyond it, token and place of each document word meet them in a shuffle
(without the words), and only documents with a meeting are compared with their windows.

Defined cases: null or empty texts have no words and are clean; items without words are in no document;
a null item_id is written as the empty string; rows equal in doc_id and text are one document; an empty
table on either side gives clean documents or none; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.common import ascii_words, keyed, same_row, scratch_table, small_side

SHINGLE = 3


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """words (of the window), items (ids that hold it), sorted."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), ascii_words(F.col("text").cast("string")).alias("words"))
    starts = words.filter(F.size("words") > 0).select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("at"))
    cut = starts.select("item", F.slice("words", F.col("at") + 1, window).alias("window"))
    return cut.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def shingles_of(windows: DataFrame, size: int) -> DataFrame:
    """window, items, off and the token at off: a hash of `size` words, or of all in a shorter window."""
    s = F.least(F.size("window"), F.lit(size))
    at = windows.select("window", "items", s.alias("s"), F.explode(F.sequence(F.lit(0), F.size("window") - s)).alias("off"))
    return at.select("window", "items", "s", "off", token(F.col("window"), F.col("off"), size, F.col("s")).alias("token"))


def token(words, at, size: int, s=None):
    """Hash of the words from `at` on: `size` of them, or as many as the column `s` says."""
    one = lambda n: F.xxhash64(F.lit(n), *[F.get(words, at + i) for i in range(n)])
    return one(size) if s is None else reduce(lambda rest, n: F.when(s == n, one(n)).otherwise(rest), range(1, size), one(size))


def positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each word and shingle size: doc_id, th, words, at, token. Texts without words have one row, at null."""
    rows = keyed(docs).select("doc_id", "th", ascii_words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "th", "words", F.posexplode_outer("words").alias("at", "word")).drop("word")
    if len(sizes) == 1:
        return rows.withColumn("token", token(F.col("words"), F.col("at"), sizes[0]))
    return rows.withColumn("token", F.explode(F.array(*[token(F.col("words"), F.col("at"), n) for n in sizes])))


def meetings(docs: DataFrame, index: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """doc_id, th, words, at, window, items, off: places whose token is that of a window, and one row more for each document."""
    if small:
        return positions(docs, sizes).join(F.broadcast(index), "token", "left")
    near = positions(docs, sizes).select("doc_id", "th", "at", "token").join(index, "token")
    rows = keyed(docs).select("doc_id", "th", ascii_words(F.col("text")).alias("words"))
    found = rows.join(near, same_row(rows, near)).select(rows["doc_id"], rows["th"], "words", "at", "window", "items", "off")
    return rows.join(near.limit(0).select("at", "window", "items", "off"), F.lit(False), "left").union(found)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = SHINGLE, share: int = 20, max_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, hit_items (sorted), contaminated, hit_spans (start, end) of each document."""
    all_shingles = scratch_table(shingles_of(windows_of(items, window), shingle), "bench-shingles")
    sizes = sorted(r[0] for r in all_shingles.select("s").distinct().collect()) or [shingle]
    tokens = all_shingles.select("token").distinct()
    seen = positions(docs, sizes).select("token").join(small_side(tokens, 16 * all_shingles.count(), max_bytes), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = all_shingles.join(seen, "token", "left").groupBy("window", "items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("rarest"))
    index = scratch_table(ranked.filter("rarest.n > 0").select("window", "items", "rarest.token", "rarest.off"), "bench-prefixes")
    held = lambda c: F.octet_length(F.array_join(c, "")) + 16 * F.size(c)
    n_bytes = index.agg(F.sum(held("window") + held("items") + 64)).first()[0] or 0

    found = meetings(docs, index, sizes, n_bytes <= max_bytes)
    start, n = F.col("at") - F.col("off"), F.size("window")
    fits = (start >= 0) & (start + n <= F.size("words"))
    whole = F.coalesce(fits & (F.slice("words", F.greatest(start, F.lit(0)) + 1, n) == F.col("window")), F.lit(False))
    rows = found.select("doc_id", "th", "at", F.size("words").alias("n_words"), whole.alias("whole"), start.alias("start"), (start + n).alias("end"), "items")
    rows = rows.filter(F.col("whole") | F.coalesce(F.col("at") == 0, F.lit(True)))
    hit = lambda c: F.when(F.col("whole"), c)
    per_doc = rows.groupBy("doc_id", "th").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(hit(F.struct("start", "end")))).alias("hit_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(hit(F.col("items")))))).alias("hit_items"),
    )
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    grown = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"))
    counted = per_doc.withColumn("n_hit", F.aggregate("hit_spans", none, grown)["n"])
    bad = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return counted.select("doc_id", "th", "n_words", "n_hit", "hit_items", bad.alias("contaminated"), "hit_spans")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP3_SQL = f"""
WITH b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 13) AS n, list_slice(w, i + 1, i + 13) AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
p AS (
  SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, win.item FROM p JOIN win ON p.n = win.n AND p.win = win.win),
hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
