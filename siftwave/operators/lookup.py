"""Dictionaries: substring and suffix matches, last-wins lookups, inserts, counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.functions.byte_hash import Spans, bitmap_of, blocks, mix, passes
from siftwave.sources.files import scratch

#: Bytes of texts that are hashed together.
TOGETHER = 1 << 20


def _prefix_size(size: np.ndarray) -> np.ndarray:
    """The largest power of two that a signature of so many bytes has."""
    return 1 << (np.frexp(size)[1] - 1)


def keyed_signatures(signatures: DataFrame) -> DataFrame:
    """The rows of `signatures` with size (a power of two), the hash of so many first bytes and the signature as bytes."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lengths = np.array([len(t) for t in texts], np.int64)
            start, size = np.cumsum(lengths) - lengths, _prefix_size(np.maximum(lengths, 1))
            hashes = mix(Spans(np.frombuffer(b"".join(texts), np.uint8)).hash(start, start + size) + size.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int32)), pa.array(hashes.view(np.int64)), *batch.columns], names=["size", "hash", "sig", *rest])

    rest = [c for c in signatures.columns if c != "signature"]
    kinds = "".join(f", `{c}` {signatures.schema[c].dataType.simpleString()}" for c in rest)
    return signatures.select(F.col("signature").cast("binary"), *rest).mapInArrow(tasks, f"size int, hash long, sig binary{kinds}")


def signature_places(messages: DataFrame, sizes: list[int], bitmap) -> DataFrame:
    """id, size, hash and part (the next 2 * size - 1 bytes) of each place of a message where a signature may start; and a row with nulls for each message."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary())], names=["id", "size", "hash", "part"])
            for first, end in blocks(texts, TOGETHER):
                whole = b"".join(texts[first:end])
                bounds, spans = np.cumsum([0, *map(len, texts[first:end])]), Spans(np.frombuffer(whole, np.uint8))
                for size in sizes:
                    if len(whole) >= size:
                        hashes = mix(spans.windows(size) + np.uint64(size))
                        at = np.flatnonzero(passes(bitmap.value, hashes))
                        text = np.searchsorted(bounds, at, side="right") - 1
                        inside = at + size <= bounds[text + 1]
                        at, text = at[inside], text[inside]
                        parts = [whole[i:j] for i, j in zip(at.tolist(), np.minimum(at + 2 * size - 1, bounds[text + 1]).tolist(), strict=True)]
                        columns = [batch.column(0).take(pa.array(text + first)), pa.array(np.full(len(at), size, np.int32)), pa.array(hashes[at].view(np.int64)), pa.array(parts, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "hash", "part"])

    kind = messages.schema["id"].dataType.simpleString()
    return messages.select("id", F.col("body").cast("binary").alias("body")).mapInArrow(tasks, f"id {kind}, size int, hash long, part binary")


def found_signatures(messages: DataFrame, signatures: DataFrame, gram: int = 4) -> DataFrame:
    """id, signature and the other columns of `signatures` for each place of a message (id, body) that holds one of at least `gram` characters;
    and at least one row with nulls for a message without any.

    A text is hashed at every byte, once for each power of two among the lengths of the signatures. Only places whose hash is in a
    bitmap of the signatures' first bytes become rows, so what is shuffled are places where a signature starts, with few others, for a
    dictionary of any size; a small one is broadcast by Spark. A signature shares half its bytes at least with what it is joined by."""
    keyed = scratch(keyed_signatures(signatures.filter(F.char_length("signature") >= gram)), "signatures")
    sizes = sorted(r["size"] for r in keyed.select("size").distinct().collect())  # powers of two
    places = signature_places(messages, sizes, bitmap_of(keyed.select("hash")))
    both = places.join(keyed, ["size", "hash"], "left")
    hit = F.coalesce(F.startswith("part", "sig"), F.lit(False))
    rest = [c for c in keyed.columns if c not in ("size", "hash", "sig")]
    return both.select("id", F.when(hit, F.col("sig").cast("string")).alias("signature"), *[F.when(hit, F.col(c)).alias(c) for c in rest])


def match_signature(messages: DataFrame, signatures: DataFrame, gram: int = 4) -> DataFrame:
    """The newest, then longest signature (at least `gram` characters) that each message holds.

    Messages: id, body (without white space). Signatures: signature, created_at. A message has one row, null without a match."""
    found = found_signatures(messages, signatures.select("signature", "created_at"), gram)
    order = F.when(F.col("signature").isNotNull(), F.struct("created_at", F.char_length("signature").alias("size"), "signature"))
    return found.groupBy("id").agg(F.max(order).alias("best")).select("id", "best.signature")


def suffix_match(urls: DataFrame, domains: DataFrame, host: str = "host") -> DataFrame:
    """Rows whose host is a domain or below one: every suffix of the host is looked up. Adds domain (the longest)."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    rows = urls.withColumn("domain", F.explode(suffixes)).join(domains.select("domain").distinct(), "domain")
    keys = [c for c in urls.columns]
    return rows.groupBy(*keys).agg(F.max_by("domain", F.char_length("domain")).alias("domain"))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")


def insert_ignore(target: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """New snapshot of `target` with rows of unknown, non-empty keys; and (inserted, ignored) counts."""
    good = rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
    fresh = good.dropDuplicates([key]).join(target.select(key), key, "left_anti")
    counts = good.agg(F.count(F.lit(1)).alias("n")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("inserted"))).select("inserted", (F.col("n") - F.col("inserted")).alias("ignored"))
    return target.unionByName(fresh.select(*target.columns)), counts


def count_upsert(target: DataFrame, hits: DataFrame, key: str, count: str = "count") -> DataFrame:
    """Counters plus the number of hits; new keys start at theirs."""
    n = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_hits"))
    return target.select(key, count).join(n, key, "full_outer").select(key, (F.coalesce(count, F.lit(0)) + F.coalesce("_hits", F.lit(0))).alias(count))


def keep_newest(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col(ts).desc_nulls_last(), F.col(tie).desc())
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def first_wins(df: DataFrame, key: str, order: str, *keep: str) -> DataFrame:
    """The first sighting of each key with its other columns."""
    return df.groupBy(key).agg(F.min_by(F.struct(order, *keep), order).alias("first")).select(key, "first.*")


def like(c: Column, q: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(c).contains(q.lower())


def safe_lookup(urls: DataFrame, safe: DataFrame, key: str = "domain_path") -> DataFrame:
    """Rows whose domain path is stored as SAFE; rows flagged `short` never match."""
    known = safe.filter("status = 'SAFE'").select(key).distinct()
    return urls.filter(~F.coalesce(F.col("short"), F.lit(False))).join(known, key, "left_semi")


def share_by_url(rows: DataFrame, key: str, scorer) -> DataFrame:
    """Scores each different key once and gives its columns to all rows; null and empty keys aren't scored."""
    once = rows.filter(F.coalesce(F.col(key), F.lit("")) != "").select(key).distinct()
    return rows.join(scorer(once), key, "left")


def runtime_signatures(messages: DataFrame, gram: int = 4) -> DataFrame:
    """id, reused: the signature of the earliest message before this one that the message holds; null without one.

    Messages: id, body, minted (the signature it gave, or null; at least `gram` characters count)."""
    minted = messages.filter(F.char_length("minted") >= gram).groupBy(F.col("minted").alias("signature")).agg(F.min("id").alias("seq"))
    earlier = F.when(F.col("seq") < F.col("id"), F.struct("seq", "signature"))
    return found_signatures(messages, minted, gram).groupBy("id").agg(F.min(earlier).alias("first")).select("id", F.col("first.signature").alias("reused"))


def add_rows(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A new snapshot with rows of unknown keys."""
    return insert_ignore(target, rows, key)[0]


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key).distinct(), key, "left_anti")


def set_values(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of equal keys and are added otherwise; columns that are null or empty there keep the old value."""
    rest = [c for c in target.columns if c != key]
    both = target.join(rows.select(key, *[F.col(c).alias(f"new_{c}") for c in rest if c in rows.columns]), key, "full")
    given = lambda c: F.when(F.col(f"new_{c}").cast("string") != "", F.col(f"new_{c}"))
    return both.select(key, *[F.coalesce(given(c), F.col(c)).alias(c) if c in rows.columns else F.col(c) for c in rest])


def whitelist_upsert(target: DataFrame, verdicts: DataFrame, key: str = "domain_path") -> DataFrame:
    """Hit counts of safe domain paths plus one for each safe verdict: not spam, confirmed safe, not mismatched, no shortener."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    good = verdicts.filter(~yes("is_spam") & yes("confirmed_safe") & ~yes("mismatched") & ~yes("short") & (F.coalesce(F.col(key), F.lit("")) != ""))
    return count_upsert(target, good, key, "hit_count")
