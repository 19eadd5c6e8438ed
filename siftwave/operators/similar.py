"""Vector neighbours: exact k nearest by cosine distance, with bounds that spare most of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwave.sources.files import scratch

#: Angles are computed with an error of less than this.
SLACK = 1e-6


def usable(df: DataFrame) -> DataFrame:
    """id, v (array of doubles) and dim of the rows whose vector has a direction: not null, empty or zero, without null, NaN or infinite parts."""
    v = F.col("v").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.coalesce(good, F.lit(False))).select("id", v.alias("v"), F.size(v).alias("dim"))


def unit(column, dim: int) -> np.ndarray:
    """Rows of length 1. They are scaled by their greatest part first, so that no square overflows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Angles and distances are computed for so many pairs at a time, however many rows a batch or pivots a corpus has.
TOGETHER = 1 << 20


def row_slices(rows: int, others: int) -> Iterator[slice]:
    """The rows in slices of which each has at most TOGETHER pairs with the others (at least one row)."""
    step = max(1, TOGETHER // max(others, 1))
    return (slice(a, min(a + step, rows)) for a in range(0, rows, step))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def cells(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The corpus with cell, the nearest pivot, and the angle to it."""
    shared, dim = corpus.sparkSession.sparkContext.broadcast(pivots), pivots.shape[1]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in row_slices(b.num_rows, len(shared.value)):
                rows = b.slice(at.start, at.stop - at.start)
                far = angles(unit(rows.column(1), dim), shared.value)
                near = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(far)), near])], names=["id", "v", "cell", "angle"])

    return corpus.select("id", "v").mapInArrow(tasks, "id long, v array<double>, cell int, angle double")


def visits(queries: DataFrame, pivots: np.ndarray, sizes: np.ndarray, radius: np.ndarray, k: int) -> DataFrame:
    """id, v and cell of the cells that a query must look at. Queries without `bound` (the distance of their k-th hit so far) get the nearest
    cells that hold k other rows; those with one get all other cells that may hold something nearer: by the triangle inequality of angles,
    nothing in a cell is nearer than the angle to its pivot less its radius."""
    shared, dim = queries.sparkSession.sparkContext.broadcast((pivots, sizes, radius)), pivots.shape[1]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, size, reach = shared.value
        for batch in batches:
            for part in row_slices(batch.num_rows, len(pivot)):
                b = batch.slice(part.start, part.stop - part.start)
                far = angles(unit(b.column(1), dim), pivot)
                order = np.argsort(far, axis=1, kind="stable")
                held = np.cumsum(size[order], axis=1)
                first = np.zeros(far.shape, bool)
                np.put_along_axis(first, order, (held - size[order] <= k) & (size[order] > 0), axis=1)
                bound = b.column(2).to_numpy(zero_copy_only=False)
                known = ~np.isnan(bound)
                limit = np.arccos(np.clip(1 - np.where(known, bound, 0), -1.0, 1.0)) + SLACK
                later = ~first & (size > 0) & (far - reach <= limit[:, None])
                query, cell = np.nonzero(np.where(known[:, None], later, first))
                for c in row_slices(len(query), dim):  # a row carries its vector
                    at = pa.array(query[c])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell[c].astype(np.int32))], names=["id", "v", "cell"])

    return queries.select("id", "v", "bound").mapInArrow(tasks, "id long, v array<double>, cell int")


def hits_in_cells(looks: DataFrame, corpus: DataFrame, dim: int, k: int, block: int) -> DataFrame:
    """query_id, hit_id, distance: the k best of each block of a cell for each query that looks at the cell.

    A large cell, and a cell that many queries look at, are cut into blocks, and each pair of blocks is one group."""
    counts = corpus.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(looks.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell")
    parts = counts.select("cell", F.ceil(F.col("n") / block).cast("int").alias("cb"), F.ceil(F.col("m") / block).cast("int").alias("qb"))
    own, other = (F.pmod(F.xxhash64("id"), F.col(c)).cast("int") for c in ("cb", "qb"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    b = corpus.join(F.broadcast(parts), "cell").select("id", "v", "cell", own.alias("c"), every("qb").alias("q"))
    a = looks.join(F.broadcast(parts), "cell").select("id", "v", "cell", other.alias("q"), every("cb").alias("c"))

    def nearest(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if queries.num_rows and rows.num_rows:
            ids, asked, held = rows.column("id").to_numpy(), queries.column("id").to_numpy(), unit(rows.column("v"), dim)
            mine = unit(queries.column("v"), dim)
            for row, own in ((row, own) for at in row_slices(len(mine), len(held)) for row, own in zip(1 - mine[at] @ held.T, asked[at], strict=True)):
                row[ids == own] = np.inf
                at = np.argpartition(row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                at = np.flatnonzero(row <= row[at].max())  # ties with the k-th go by id
                at = at[np.lexsort((ids[at], row[at]))][:k]
                at = at[np.isfinite(row[at])]
                out[0].append(np.full(len(at), own))
                out[1].append(ids[at])
                out[2].append(row[at])
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "hit_id": pa.array(columns[1].astype(np.int64)), "distance": pa.array(columns[2].astype(np.float64))})

    keys = ("cell", "c", "q")
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(nearest, "query_id long, hit_id long, distance double")


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "hit_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn(queries: DataFrame, corpus: DataFrame, k: int = 3, block: int = 8192, most_pivots: int = 2048, seed: int = 3) -> DataFrame:
    """query_id, hit_id, distance, rank, visited: the k nearest rows of `corpus` (id, v) for each of `queries`, ties by id; a query isn't its own hit.

    The corpus is dealt into cells around pivots, which are rows drawn from it (about one for `block` / 8 rows, at most `most_pivots`). A query first looks
    at its nearest cells; the k-th distance found there then rules out all cells that can't hold anything nearer. `visited` is the share of the
    corpus' cells that the query looked at. Vectors of different lengths are not compared; rows without a direction (see usable) neither ask nor answer."""
    asked, rows = usable(queries), scratch(usable(corpus), "corpus")
    found = None
    for dim, n in rows.groupBy("dim").agg(F.count(F.lit(1))).collect():  # one row for each length of vectors, of which there are few
        wanted = int(min(most_pivots, max(1, 8 * n // block)))
        drawn = rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(wanted).select("v").toArrow()
        pivots = np.unique(unit(drawn.column("v"), dim), axis=0)
        own = scratch(cells(rows.filter(F.col("dim") == dim), pivots), "cells")
        sizes, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for c, m, r in own.groupBy("cell").agg(F.count(F.lit(1)), F.max("angle")).collect():  # at most `most_pivots` rows
            sizes[c], radius[c] = m, r + SLACK
        mine = asked.filter(F.col("dim") == dim)
        first = scratch(visits(mine.withColumn("bound", F.lit(float("nan"))), pivots, sizes, radius, k), "visits")
        near = scratch(best_hits(hits_in_cells(first, own, dim, k, block), k), "near")
        bound = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("bound"))
        later = scratch(visits(mine.join(bound, "id"), pivots, sizes, radius, k), "visits")
        share = first.union(later).groupBy(F.col("id").alias("query_id")).agg((F.count(F.lit(1)) / int((sizes > 0).sum())).alias("visited"))
        all_hits = near.drop("rank").union(hits_in_cells(later, own, dim, k, block))
        out = best_hits(all_hits, k).join(share, "query_id")
        found = out if found is None else found.union(out)
    return found if found is not None else queries.sparkSession.createDataFrame([], "query_id long, hit_id long, distance double, rank int, visited double")


def gap_stats(hits: DataFrame, label: str = "label") -> DataFrame:
    """d1, d2, gap of each query's neighbours and the number of spam labels among them; one hit: d2 = d1."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("distance")))
    out = hits.groupBy("query_id").agg(at(1).alias("d1"), F.coalesce(at(2), at(1)).alias("d2"), F.count(F.when(F.col(label) > 0, 1)).alias("spam_count"))
    return out.withColumn("gap", F.col("d2") - F.col("d1"))
