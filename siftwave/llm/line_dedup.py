"""Line dedup: hashes range-partitioned with a secondary sort by document and position.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least
`min_chars` characters in at least `min_docs` documents are repeated. Policy "all" drops their lines
everywhere, "first" keeps the first occurrence by (doc_id, text hash, position). The result is a
compressed keep bitmap per document: the runs (start, len) of kept lines.

Hot lines: range bounds are taken over (hash, document), so a line in a third of all documents spreads
over many partitions; documents are counted per range first and only the counts of a key meet.

Defined cases: null or empty text is one empty line, which is never dropped; a null doc_id is a
document of its own for each different text; rows equal in doc_id and text count as one document and
each gets the same answer; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.common import ASCII_SPACE, LOWER, UPPER, keyed, same_row, scratch_table, small_side, text_hash

RUNS = "array<struct<start:int,len:int>>"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos and the two hashes of each line's key, with the key's length."""
    lines = keyed(docs).select("doc_id", "th", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    key = F.translate(F.trim("line", F.lit(ASCII_SPACE)), UPPER, LOWER)
    return lines.select("doc_id", "th", "pos", key.alias("key")).select("doc_id", "th", "pos", F.xxhash64("key").alias("k1"), F.hash("key").alias("k2"), F.char_length("key").alias("chars"))


def repeated_keys(lines: DataFrame, min_docs: int = 10) -> DataFrame:
    """k1, k2, n_docs and first (doc_id, th, pos) of the keys in at least `min_docs` documents."""
    order = ["k1", "k2", "doc_id", "th"]
    spread = lines.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    per_doc = spread.groupBy(*order).agg(F.min("pos").alias("pos"))
    per_key = per_doc.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "th", "pos")).alias("first"))
    return per_key.filter(F.col("n_docs") >= min_docs)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, policy: str = "all", max_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, th and dropped (sorted line numbers) of each document that loses lines.

    Texts are cut into lines once; range bounds, counts and hits are read from the written hashes."""
    lines = scratch_table(lines_of(docs).filter(F.col("chars") >= min_chars).drop("chars"), "lines")
    keys = scratch_table(repeated_keys(lines, min_docs), "line-keys")
    # A row of keys is of fixed size (about 48 bytes), so the bound on rows is one on bytes.
    hits = lines.join(small_side(keys, keys.count(), max_broadcast), ["k1", "k2"])
    if policy == "first":
        hits = hits.filter(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    return hits.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def keep_runs(dropped, n_lines):
    """Runs of kept lines between the dropped ones, linear in their number."""
    ends = F.concat(dropped, F.array(n_lines))
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda d: d + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("len")))
    return F.filter(runs, lambda r: r["len"] > 0)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, policy: str = "all", max_broadcast: int = 1_000_000, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `columns`, text (before), n_lines, n_dropped, keep_runs and kept_text of every row of `docs`."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_hash("text").alias("th"), *columns)
    maps = keep_bitmaps(docs, min_docs, min_chars, policy, max_broadcast)
    both = rows.join(maps, same_row(rows, maps), "left").select(rows["doc_id"], rows["text"], *[rows[c] for c in columns], F.split(rows["text"], "\n", -1).alias("lines"), "dropped")
    both = both.select("doc_id", "text", *columns, "lines", F.size("lines").alias("n_lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    runs = both.select("doc_id", "text", *columns, "lines", "n_lines", F.size("dropped").alias("n_dropped"), keep_runs(F.col("dropped"), F.col("n_lines")).alias("keep_runs"))
    kept = F.array_join(F.flatten(F.transform("keep_runs", lambda r: F.slice("lines", r["start"] + 1, r["len"]))), "\n")
    return runs.select("doc_id", "text", *columns, F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), "keep_runs", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(kept).alias("kept_text"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and keep_runs: the kept lines as start:length, comma-joined."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = F.array_join(F.transform("keep_runs", lambda r: F.concat_ws(":", r["start"], r["len"])), ",")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), runs.alias("keep_runs"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.key = f.key),
g AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m WHERE NOT dropped),
r AS (SELECT doc_id, min(pos) - 1 AS a, count(*) AS n FROM g GROUP BY doc_id, run),
s AS (SELECT doc_id, string_agg(a || ':' || n, ',' ORDER BY a) AS runs FROM r GROUP BY doc_id)
SELECT m.doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256, coalesce(any_value(s.runs), '') AS keep_runs
FROM m LEFT JOIN s ON s.doc_id = m.doc_id GROUP BY m.doc_id
"""
