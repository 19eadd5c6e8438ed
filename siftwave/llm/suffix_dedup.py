"""Suffix-array dedup: suffixes range-partitioned by sampled splitters, sorted in buckets, compared with their neighbours.

A window is a string of `size` bytes. Windows that start in two places are repeated; every byte of a repeated window goes.
A suffix array of every byte would be many times the texts. This one is sparse: of the `GRAM`-byte strings inside
a window the one with the least hash is its anchor, so equal windows have equal anchors at equal places. Neighbouring windows
mostly share their anchor; such a stretch of window starts, with the bytes that they cover, is a region.

1. Regions (about one for 80 bytes) are written with a key (the leading bytes of the suffix at the anchor, then a hash of the anchor) and
   a hash of all bytes of the region. They are range-partitioned by (key, hash, document, place), with Spark's sampled
   splitters, and sorted in their bucket. A splitter may fall inside a group of equal keys, so a passage of any number of
   copies spreads over buckets; first and last rows of buckets are compared across the borders.
2. A neighbour of equal key and hash: all windows of the region are repeated. A key without an equal neighbour: none is. What is left,
   and one row at each border between equal regions and others, are regions at the ends of shared passages.
3. These fetch their bytes and go to a bucket by key. There the windows are sorted by key and hash, and
   neighbours of equal key and hash are compared byte by byte. Keys at a bucket's border in step 1 and keys with over `GROUP_ROWS` regions,
   which one task must not get, are opened into windows instead, which are sorted and compared with their neighbours as in step 1, by their leading bytes and hash.
4. The repeated starts of a document become spans, and its bytes outside them are kept.

The sort in a bucket compares columns of leading bytes and hashes in turn instead of single bytes. In steps 1 and 2, equality is that
of 64 bits of hash within equal keys; in the opened windows of 64 bits of leading bytes and 64 of hash.

Defined cases: texts shorter than `size`, empty and null ones lose nothing; repeated rows are places of their own, so they lose all
that is long enough; a null doc_id is a document for each text; a removal may cut a character, so what is kept is binary;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.functions.byte_hash import Spans, blocks, mix
from siftwave.llm.common import scratch_table, text_hash

SIZE, GRAM = 200, 40
#: Regions of one key that one task compares at most; windows of longer texts are cut into slices of so many starts.
GROUP_ROWS, SLICE = 20_000, 1 << 20
TOGETHER = 2 << 20
_PLACE = np.uint64((1 << 22) - 1)
_SIGN = np.uint64(1 << 63)
ORDER = ["grp", "body", "doc_id", "th", "lo"]


def slices(texts: list[bytes], size: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pieces of all texts that hold each window once, the text of each piece and the place of its first byte."""
    pieces, owner, base = [], [], []
    for k, t in enumerate(texts):
        for a in range(0, max(len(t) - size + 1, 0), SLICE):
            pieces.append(t[a : a + SLICE + size - 1])
            owner.append(k)
            base.append(a)
    return pieces, np.array(owner, np.int64), np.array(base, np.int64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by doubling."""
    have, step = values, 1
    while 2 * step <= width:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    rest = width - step
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def regions_of(pieces: list[bytes], size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Piece, first window start in it, number of further starts, key and body hash of each region."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    bounds = np.cumsum([0, *map(len, pieces)])
    spans = Spans(data)
    grams = mix(spans.windows(gram))
    least = sliding_least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), size - gram + 1) & _PLACE
    piece = np.repeat(np.arange(len(pieces)), np.diff(bounds))[: len(least)]
    inside = np.arange(len(least)) + size <= bounds[piece + 1]
    new = np.r_[True, (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])] & inside
    first = np.flatnonzero(new)
    last = np.minimum(np.r_[first[1:], len(least)] - 1, bounds[piece[first] + 1] - size)
    anchor = least[first].astype(np.int64)
    lead = (data[anchor].astype(np.uint64) << np.uint64(56)) | (data[anchor + 1].astype(np.uint64) << np.uint64(48)) | (data[anchor + 2].astype(np.uint64) << np.uint64(40))
    key = lead | (mix(grams[anchor] + np.uint64(1)) >> np.uint64(24))
    return piece[first], first - bounds[piece[first]], last - first, (key ^ _SIGN).view(np.int64), mix(spans.hash(first, last + size)).view(np.int64)


def regions(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """doc_id, th, lo (first window start), more (starts after it), grp (key) and body (hash) of each region of each document."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            pieces, owner, base = slices(texts, size)
            for a, b in blocks(pieces, TOGETHER):
                piece, lo, more, key, body = regions_of(pieces[a:b], size, gram)
                at = pa.array(owner[a + piece])
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array((lo + base[a + piece]).astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(key), pa.array(body)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "lo", "more", "grp", "body"])

    return with_id(docs).select("doc_id", "th", F.col("text").cast("binary")).mapInArrow(tasks, "doc_id long, th long, lo int, more int, grp long, body long")


def with_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash("text").alias("th"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def neighbours(sorted_regions: DataFrame) -> DataFrame:
    """The sorted regions with a neighbour of their key, and the first and last one of each bucket.

    equal: a neighbour of the bucket has the same key and body; other: one has the same key and another body; edge: 1 first, 2 last, 3 both."""
    kind = "doc_id long, th long, lo int, more int, grp long, body long, bucket int, equal boolean, other boolean, edge int"

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row is judged once the row after it is known; two rows wait from batch to batch, the first of them judged already.
        held, begun = None, False
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                yield from judged(table, 0 if held is None or not begun else 1, table.num_rows - 1, not begun)
                begun = begun or table.num_rows > 1
                held = table.slice(max(table.num_rows - 2, 0)) if table.num_rows > 1 else table
        if held is not None:
            yield from judged(held, held.num_rows - 1, held.num_rows, not begun, True)

    def judged(table: pa.Table, start: int, end: int, first: bool, last: bool = False) -> Iterator[pa.RecordBatch]:
        if end <= start:
            return
        key, body = table.column("grp").to_numpy(), table.column("body").to_numpy()
        same, twin = key[1:] == key[:-1], (key[1:] == key[:-1]) & (body[1:] == body[:-1])
        equal = np.r_[False, twin] | np.r_[twin, False]
        other = np.r_[False, same & ~twin] | np.r_[same & ~twin, False]
        edge = np.zeros(len(key), np.int32)
        edge[start] += first
        edge[end - 1] += 2 * last
        at = np.flatnonzero(equal | other | (edge > 0))
        at = at[(at >= start) & (at < end)]
        out = table.take(pa.array(at))
        columns = [out.column(i).combine_chunks() for i in range(out.num_columns)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(equal[at]), pa.array(other[at]), pa.array(edge[at])], names=[*table.column_names, "equal", "other", "edge"])

    return sorted_regions.mapInArrow(tasks, kind)


def compared(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Steps 1 and 2: the judged rows, and the keys that lie on a border between buckets (as many as there are borders at most)."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    near = scratch_table(neighbours(placed.withColumn("bucket", F.spark_partition_id())), name)
    ends = sorted(near.filter("edge > 0").select("bucket", "edge", "grp", "body").collect())  # two rows for each bucket at most
    # What the rows on either side of a border are to each other.
    fixes: dict[tuple[int, int], list[bool]] = {}
    border = []
    lasts, firsts = [e for e in ends if e[1] & 2], [e for e in ends if e[1] & 1]
    for a, b in zip(lasts[:-1], firsts[1:], strict=True):
        if a[2] == b[2]:
            border.append((a[2],))
            for e in (a, b):
                both = fixes.setdefault((e[0], e[1]), [False, False])
                both[0] |= a[3] == b[3]
                both[1] |= a[3] != b[3]
    fixed = F.broadcast(spark.createDataFrame([(*k, *v) for k, v in fixes.items()], "bucket int, edge int, fix_equal boolean, fix_other boolean"))
    joined = near.join(fixed, ["bucket", "edge"], "left").withColumn("equal", F.col("equal") | F.coalesce("fix_equal", F.lit(False))).withColumn("other", F.col("other") | F.coalesce("fix_other", F.lit(False)))
    return joined.drop("fix_equal", "fix_other"), spark.createDataFrame(sorted(set(border)), "grp long")


def with_bytes(docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """`rows` (doc_id, th, lo, more, grp, hot) with the bytes of their region: one join by document, the regions of a document as one row."""
    wanted = rows.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "more", "grp", "hot")).alias("wanted"))
    texts = with_id(docs)
    both = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["th"] == wanted["th"]))
    both = both.select(texts["doc_id"], texts["th"], F.col("text").cast("binary").alias("text"), "wanted")
    # Bytes are cut before rows are made, as each row would carry the whole text.
    cut = F.expr(f"transform(wanted, w -> struct(w.lo, w.more, w.grp, w.hot, substring(text, w.lo + 1, w.more + {size}) as data))")
    return both.select("doc_id", "th", cut.alias("cut")).select("doc_id", "th", F.explode("cut").alias("w")).select("doc_id", "th", "w.*")


def repeated_windows(keys: np.ndarray, data: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Region and start in it of the windows that another region of the same key has in the same bytes. `keys` are sorted."""
    whole = np.frombuffer(b"".join(data), np.uint8)
    bounds = np.cumsum([0, *map(len, data)])
    hashes = Spans(whole, 1).windows(size)
    region = np.repeat(np.arange(len(data)), np.diff(bounds))[: len(hashes)]
    start = np.flatnonzero(np.arange(len(hashes)) + size <= bounds[region + 1])
    region, hashes = region[start], hashes[start]
    key = keys[region]
    hashes = mix(hashes) + mix(key.view(np.uint64))
    order = np.argsort(hashes, kind="stable")
    left, right = order[:-1], order[1:]
    like = np.flatnonzero((key[left] == key[right]) & (hashes[left] == hashes[right]))
    windows = np.lib.stride_tricks.sliding_window_view(whole, size) if len(whole) >= size else np.zeros((0, size), np.uint8)
    hit = np.zeros(len(order), bool)
    for a in range(0, len(like), 50_000):
        l, r = left[like[a : a + 50_000]], right[like[a : a + 50_000]]
        same = (windows[start[l]] == windows[start[r]]).all(axis=1)
        hit[l[same]] = hit[r[same]] = True
    return region[hit], start[hit] - bounds[region[hit]]


def bucket_windows(rows: DataFrame, size: int) -> DataFrame:
    """Step 3: doc_id, th and stretches [a, b) of repeated window starts; and the single windows of keys that are too large, with lead and hash."""
    kind = "doc_id long, th long, a int, b int, lead long, hash long"
    names = ["doc_id", "th", "a", "b", "lead", "hash"]

    def starts(table: pa.Table, region: np.ndarray, at: np.ndarray, length: np.ndarray, lead=None, hashes=None) -> pa.RecordBatch:
        rows = table.select(["doc_id", "th"]).take(pa.array(region))
        a = (table.column("lo").to_numpy()[region] + at).astype(np.int32)
        none = pa.nulls(len(a), pa.int64())
        columns = [rows.column(0).combine_chunks(), rows.column(1).combine_chunks(), pa.array(a), pa.array((a + length).astype(np.int32)), none if lead is None else pa.array(lead), none if hashes is None else pa.array(hashes)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def opened(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for a in range(0, table.num_rows, 2000):
            part = table.slice(a, 2000).combine_chunks()
            data = part.column("data").to_pylist()
            whole, bounds = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
            hashes = mix(Spans(whole, 1).windows(size)).view(np.int64)
            region = np.repeat(np.arange(len(data)), np.diff(bounds))[: len(hashes)]
            start = np.flatnonzero(np.arange(len(hashes)) + size <= bounds[region + 1])
            lead = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(whole, 8)[start]).view(">i8").astype(np.int64).ravel()
            yield starts(part, region[start], start - bounds[region[start]], np.ones(len(start), np.int64), lead, hashes[start])

    def closed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        region, at = repeated_windows(table.column("grp").to_numpy(), table.column("data").to_pylist(), size)
        order = np.lexsort((at, region))
        region, at = region[order], at[order]
        head = np.flatnonzero(np.r_[True, (np.diff(region) != 0) | (np.diff(at) != 1)]) if len(at) else np.zeros(0, np.int64)
        if len(head):
            yield starts(table, region[head], at[head], np.diff(np.r_[head, len(at)]))

    def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole groups of keys, about 4,000 regions at a time."""
        table = table.combine_chunks()
        key, hot = table.column("grp").to_numpy(), table.column("hot").to_numpy(zero_copy_only=False)
        borders = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        at = 0
        while at < len(borders) - 1:
            end = max(int(np.searchsorted(borders, borders[at] + 4000, side="right")) - 1, at + 1)
            part = table.slice(borders[at], borders[end] - borders[at])
            if borders[end] - borders[at] > GROUP_ROWS:
                yield from opened(part)
            else:
                flags = hot[borders[at] : borders[end]]
                if flags.any():
                    yield from opened(part.filter(pa.array(flags)))
                if not flags.all():
                    yield from closed(part.filter(pa.array(~flags)).combine_chunks())
            at = end

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        large = None  # the key that is being opened, as more than GROUP_ROWS of its regions came
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4000:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("grp").to_numpy()
                if large is not None:
                    n = int(np.searchsorted(key, large, side="right"))
                    yield from opened(table.slice(0, n))
                    table, key = table.slice(n).combine_chunks(), key[n:]
                # The last key may go on in the next batch.
                cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
                if cut:
                    yield from settled(table.slice(0, cut))
                rest = table.slice(cut)
                large = large if not len(key) else None
                if rest.num_rows > GROUP_ROWS:
                    large = int(key[-1])
                    yield from opened(rest)
                    rest = rest.slice(0, 0)
                held = rest.combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if large is not None:
                n = int(np.searchsorted(table.column("grp").to_numpy(), large, side="right"))
                yield from opened(table.slice(0, n))
                table = table.slice(n)
            if table.num_rows:
                yield from settled(table)

    # A hot key's rows needn't meet, so they are dealt out by document too.
    spread = F.when(F.col("hot"), F.xxhash64("doc_id", "th")).otherwise(F.lit(0))
    return rows.repartition("grp", spread).sortWithinPartitions("grp").mapInArrow(tasks, kind)


def repeated_starts(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, th and stretches [a, b) of starts of repeated windows; stretches may overlap."""
    near, border = compared(scratch_table(regions(docs, size, gram), "regions"), "neighbours")
    whole = near.filter("equal").select("doc_id", "th", F.col("lo").alias("a"), (F.col("lo") + F.col("more") + 1).alias("b"))
    ends = near.filter("other").join(F.broadcast(border.withColumn("hot", F.lit(True))), "grp", "left")
    rows = with_bytes(docs, ends.select("doc_id", "th", "lo", "more", "grp", F.coalesce("hot", F.lit(False)).alias("hot")), size)
    found = scratch_table(bucket_windows(rows, size), "windows")
    # A window is a region of one start; sorted like those, it is next to its equals, however many.
    single = found.filter(F.col("hash").isNotNull()).select("doc_id", "th", F.col("a").alias("lo"), F.lit(0).alias("more"), F.col("lead").alias("grp"), F.col("hash").alias("body"))
    hot = compared(single, "window-neighbours")[0].filter("equal").select("doc_id", "th", F.col("lo").alias("a"), (F.col("lo") + 1).alias("b"))
    return whole.union(found.filter(F.col("hash").isNull()).select("doc_id", "th", "a", "b")).union(hot)


def drop_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs: start and len) and kept (binary) of every row of `docs`."""
    if not 8 <= gram < size:
        raise ValueError("gram must be at least 8 and less than size")
    found = repeated_starts(docs, size, gram).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("starts"))
    rows = with_id(docs)
    both = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["th"] == found["th"]), "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int64())]))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own, keep, done = [], [], 0
                for a, b in sorted((s["a"], s["b"] + size - 1) for s in starts or ()):
                    if own and a <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], b)
                    else:
                        own.append([a, b])
                for a, b in own:
                    keep.append(text[done:a])
                    done = b
                spans.append([{"start": a, "len": b - a} for a, b in own])
                kept.append(b"".join([*keep, text[done:]]) if own else text)
            n = pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return both.select(rows["doc_id"], F.col("text").cast("binary").alias("data"), "starts").mapInArrow(tasks, "doc_id long, n_bytes long, spans array<struct<start:long,len:long>>, kept binary")


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["len"])
    found = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
p AS (SELECT i, unnest(range(0, len(x) // 2 - 199)) AS p FROM d WHERE len(x) >= 400),
w AS (SELECT p.i, p.p, md5(substr(d.x, 2 * p.p + 1, 400)) AS h FROM p JOIN d ON d.i = p.i),
r AS (SELECT i, p FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
g AS (SELECT i, p, lag(p) OVER (PARTITION BY i ORDER BY p) AS q FROM r),
b AS (SELECT i, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY i ORDER BY p) AS n FROM g),
s AS (SELECT i, n, min(p) AS a, max(p) + 200 AS z FROM b GROUP BY i, n),
k AS (SELECT d.i, s.a, s.z, lag(s.z, 1, 0) OVER (PARTITION BY d.i ORDER BY s.a) AS y, d.x FROM s JOIN d ON d.i = s.i),
t AS (SELECT i, string_agg(substr(x, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS x, sum(z - a) AS removed, count(*) AS n FROM k GROUP BY i)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(t.removed, 0)::BIGINT AS n_removed, coalesce(t.n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t.x, d.x))) AS kept_sha256
FROM d LEFT JOIN t ON t.i = d.i
"""
