"""Periodic run detection: recursive frequency splitting, then a scan of the lags of what survives.

A run is a stretch of words with smallest period q (words q apart are identical), of at least
max(`least`, `ratio` * q) words, that no neighbouring word extends. Every word of a run stands in it at
least `ratio` times. So a word that stands less often in its segment belongs to no run: it splits the
segment, the parts are counted anew, until nothing changes.

The lag scan takes lags q from 2^k up to 2^(k+1) together. Stretches of 2^(k+1) words get names, by doubling
(the name of a pair of names); each position has as lag the distance to the next stretch of its name in the segment.
As the stretch is longer than the lag, q is the smallest period there, and neighbouring positions of one
lag make up exactly one run that no neighbour extends. Positions whose stretch stands nowhere else in the segment
leave the scan, so a text of n words takes n log n steps at worst, whatever its periods.

Everything happens inside one document: no shuffle, no state between tasks. Documents are taken together in
blocks of about `together` bytes, which bounds memory by that and by the longest text.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; repeated rows and null ids need
no care and give one row each; an empty table gives an empty result; other columns than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNS = "array<struct<start:long,length:long,period:long>>"
#: What a word is split at, as in bytes.split(): blank, tab, and \n to \r.
SPACES = r"[\x20\x09-\x0D]+"


def split_by_frequency(words: np.ndarray, owner: np.ndarray, ratio: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that survive, and the segment of each. `words` are numbered per document, so equal numbers share their owner."""
    pos = np.flatnonzero(np.bincount(words, minlength=1)[words] >= ratio) if len(words) else np.zeros(0, np.int64)
    seg = owner[pos]
    stable, stable_seg, base = [], [], 0
    while len(pos):
        # Segments are stretches of neighbouring positions; too short ones go.
        new = np.r_[True, (np.diff(pos) != 1) | (np.diff(seg) != 0)]
        seg = np.cumsum(new) - 1
        long_enough = np.bincount(seg)[seg] >= least
        pos, seg = pos[long_enough], seg[long_enough]
        if not len(pos):
            break
        _, which, count = np.unique(seg * (np.int64(words.max()) + 1) + words[pos], return_inverse=True, return_counts=True)
        keep = count[which] >= ratio
        hurt = np.zeros(seg[-1] + 1, bool)
        hurt[seg[~keep]] = True
        whole = ~hurt[seg]
        stable.append(pos[whole])
        stable_seg.append(seg[whole] + base)
        base += int(seg[-1]) + 1
        pos, seg = pos[keep & ~whole], seg[keep & ~whole]
    if not stable:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos, seg = np.concatenate(stable), np.concatenate(stable_seg)
    order = np.argsort(pos, kind="stable")
    return pos[order], seg[order]


def scan_lags(words: np.ndarray, seg: np.ndarray, ratio: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs; `seg` numbers the segments, whose words stand together."""
    n = len(words)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 1  # words in a named stretch
    at, name = np.arange(n), words.astype(np.int64)
    longest = int(np.bincount(np.unique(seg, return_inverse=True)[1]).max()) if n else 0
    while len(at) and size <= max(longest // ratio, 1):
        # Stretches of twice the size: pairs of names, where both are still in the scan and in one segment.
        here = np.full(n + size, -1, np.int64)
        here[at] = name
        after = here[at + size]
        same = (after >= 0) & (seg[np.minimum(at + 2 * size - 1, n - 1)] == seg[at]) & (at + 2 * size <= n)
        at, first, after = at[same], name[same], after[same]
        size *= 2
        if not len(at):
            break
        name = np.unique(first * (after.max() + 1) + after, return_inverse=True)[1].astype(np.int64)
        order = np.lexsort((at, name))
        a, b = at[order][:-1], at[order][1:]
        twins = (name[order][1:] == name[order][:-1]) & (seg[a] == seg[b])
        lag = np.zeros(n, np.int64)
        lag[a[twins]] = b[twins] - a[twins]
        lag[(lag < size // 2) | (lag >= size)] = 0
        border = np.flatnonzero(np.r_[True, np.diff(lag) != 0, True])
        start, period = border[:-1], lag[border[:-1]]
        # A lag can't go on over the end of a segment: the last stretch of one has no twin behind it.
        length = np.diff(border) + period + size - 1
        fits = (period > 0) & (length >= np.maximum(least, ratio * period))
        found.append((start[fits], length[fits], period[fits]))
        alive = np.zeros(n, bool)
        alive[a[twins]] = alive[b[twins]] = True
        stay = alive[at]
        at, name = at[stay], name[stay]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def find_runs(texts: list[bytes], ratio: int = 4, least: int = 6) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and runs (rows of start, length, period, by start and period) of each text."""
    split = [t.split() for t in texts]
    bounds = np.cumsum([0, *map(len, split)])
    numbers = np.zeros(bounds[-1], np.int64)
    base = 0
    for k, words in enumerate(split):
        own: dict[bytes, int] = {}
        numbers[bounds[k] : bounds[k + 1]] = [own.setdefault(w, len(own)) for w in words]
        numbers[bounds[k] : bounds[k + 1]] += base
        base += len(own)
    pos, seg = split_by_frequency(numbers, np.repeat(np.arange(len(split)), np.diff(bounds)), ratio, least)
    start, length, period = scan_lags(np.unique(numbers[pos], return_inverse=True)[1], seg, ratio, least)
    start = pos[start]
    order = np.lexsort((period, start))
    rows = np.stack([start, length, period], axis=1)[order] if len(start) else np.zeros((0, 3), np.int64)
    cut = np.searchsorted(rows[:, 0], bounds)
    for k, words in enumerate(split):
        yield words, rows[cut[k] : cut[k + 1]] - np.array([bounds[k], 0, 0])


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by blanks, without those that a run repeats after its first period."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, ratio: int = 4, least: int = 6, columns: tuple[str, ...] = ("doc_id",), together: int = 4 << 20) -> DataFrame:
    """`columns`, n_words, runs and collapsed (the text without repeated periods) of every row of `docs`."""
    if ratio < 3:
        raise ValueError("the lag scan finds runs of at least three periods")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            at = 0
            while at < len(texts):
                end, total = at, 0
                while end < len(texts) and (end == at or total + len(texts[end]) <= together):
                    total += len(texts[end])
                    end += 1
                n, runs, kept = [], [], []
                for words, rows in find_runs(texts[at:end], ratio, least):
                    n.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in rows.tolist()])
                    kept.append(collapse(words, rows))
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                own = [batch.column(i).slice(at, end - at) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=[*columns, "n_words", "runs", "kept"])
                at = end

    rows = docs.select(*columns, F.col("text").cast("binary").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(tasks, f"{kinds}, n_words long, runs {RUNS}, kept binary")
    return out.select(*columns, "n_words", "runs", F.col("kept").cast("string").alias("collapsed"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document by crc32 of its id goes on with its own words periodically, as the contract of op13 says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACES), "")
    cut = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    a = F.col("g") % F.size("w")
    placed = cut.withColumn("a", F.when(F.size("w") > 0, a))
    p = 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8))
    placed = placed.withColumn("p", p)
    again = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p + 1 as int)))), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def greatest_run(runs: Column) -> Column:
    """The run of greatest length / period, compared by cross products; of equal ones the first in (start, period) order, as runs are sorted."""
    wide = lambda c: c.cast("decimal(19,0)")
    more = lambda best, r: wide(r["length"]) * wide(best["period"]) > wide(best["length"]) * wide(r["period"])
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The contract's columns."""
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", greatest_run(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
