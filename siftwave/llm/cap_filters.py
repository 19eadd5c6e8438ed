"""Embedding near-duplicates by spherical-cap filters.

Filter directions are structured random product codes: the space is rotated at random and cut into blocks,
each block has a small random code, and a direction is one codeword of each block. A vector's relevant
directions, those of its spherical cap, are list-decoded by pruning over the blocks, without looking at the rest of
the code. The cap of each vector is as wide as it takes for a fixed number of directions, so no vector is without
filters. Vectors of one label that share a direction are compared there in double precision, so nothing below `threshold` is linked.

Vectors are scaled by a power of two, which is exact, so very large and very small ones compare like others;
they travel as 4-byte floats where that loses nothing, else as doubles. Each carries its sorted directions: a
pair that meets in several filters counts in the first one they share. A filter gives back one row for each
vector (links counted there, least vector reached there), never its pairs, so a family of near copies costs
rows in proportion to its members.

The code grows with the vectors of the largest label, so filters stay small. The number of directions is calibrated when
the code is made: of planted pairs whose cosine is the threshold itself, the wanted share must meet, whatever the size of the code.
Equal vectors of a label are one, with a count. A filter with many vectors is
split into blocks of about `block` rows and each pair of blocks is compared on its own; small ones are packed, so
no group grows with the data.

Recall at the threshold is tested for several dimensions and sizes; what is missed is a pair that shares no filter.

Defined cases: null labels, and vectors that are null, empty, zero or hold nulls, NaN or infinity are linked
with nothing (n_links 0, their own component, kept); vectors of different lengths are not compared; labels of any
type are compared as text; rows equal in vec_id count as separate copies of one id; a null vec_id links as a copy
but names no component (null where nothing else does); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwave.llm.common import scratch_table
from siftwave.llm.components import components

THRESHOLD = 0.93


class ProductCode:
    """Directions made of one codeword for each of `blocks` slices of the rotated space."""

    def __init__(self, dim: int, words: int, blocks: int = 3, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.edges = np.linspace(0, dim, blocks + 1).astype(int)
        self.words = [rng.standard_normal((words, b - a)) for a, b in zip(self.edges, self.edges[1:], strict=False)]
        norm = np.sqrt(len(self.words))
        self.words = [w / np.linalg.norm(w, axis=1, keepdims=True) / norm for w in self.words]

    @classmethod
    def fitted(cls, dim: int, n: int, threshold: float, recall: float = 0.98, crowd: int = 64, seed: int = 12) -> tuple[ProductCode, int]:
        """A code for `n` vectors and the number of directions for each: of planted pairs whose cosine is `threshold` itself, the share
        `recall` has a common one. About `crowd` vectors share a direction.

        Blocks have four dimensions at least, as a block of one has two codewords in all. In few dimensions a sizeable share of all pairs are
        links, so more than 4,096 codewords a block would not make filters smaller than the families in them. A list has 1,024 directions at most."""
        rng = np.random.default_rng(seed)
        x, z = rng.standard_normal((2, 500, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = threshold * x + np.sqrt(1 - threshold**2) * z
        blocks, relevant = min(3, max(1, dim // 4)), 20
        for _ in range(4):
            words = int(np.ceil((n * relevant / crowd) ** (1 / blocks)))
            code = cls(dim, min(max(8, words), 4096), blocks)
            pairs = [list(zip(*code.parts(v), strict=True)) for v in (x, y)]
            need = np.inf
            for most in (64, 256, 1024):
                # The list length from which on each pair meets: the place of its first common direction, in the list where it comes later.
                firsts = []
                for a, b in zip(*pairs, strict=True):
                    _, i, j = np.intersect1d(code.best(a, most), code.best(b, most), assume_unique=True, return_indices=True)
                    firsts.append(np.maximum(i, j).min() + 1 if len(i) else np.inf)
                need = np.quantile(firsts, recall, method="higher")
                if np.isfinite(need):
                    break
            found = int(min(max(need, 4), 1024))
            if found <= 2 * relevant:
                break
            relevant = found
        return code, found

    def best(self, own: list[np.ndarray], most: int) -> np.ndarray:
        """The `most` directions of a vector with the greatest inner products, greatest first (the whole code if that is smaller)."""
        top, step = sum(p.max() for p in own), 0.04
        number, total = self.decode(own, top - step)
        while len(number) < most and step < 4:
            step *= 1.3
            number, total = self.decode(own, top - step)
        return number[np.lexsort((number, -total))[:most]]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        """Inner products with each block's codewords."""
        y = x @ self.rotation
        return [y[:, a:b] @ w.T for (a, b), w in zip(zip(self.edges, self.edges[1:], strict=False), self.words, strict=True)]

    @staticmethod
    def decode(parts: list[np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and inner products of all directions whose inner product is at least `reach`: a block's codewords go on only while the best of the rest could still reach it."""
        rest = np.append(np.cumsum([p.max() for p in parts[::-1]])[::-1], 0.0)
        total, number = np.zeros(1), np.zeros(1, np.int64)
        for k, p in enumerate(parts):
            total = total[:, None] + p[None, :]
            i, j = np.nonzero(total >= reach - rest[k + 1])
            total, number = total[i, j], number[i] * len(p) + j
        return number, total


def packed(v) -> bytes | None:
    """A vector over a power of two, as the bytes of floats if that is exact, else of doubles; None where it can't be compared."""
    x = None if v is None else np.asarray(v, np.float64)
    if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
        return None
    x = np.ldexp(x, -np.frexp(np.abs(x).max())[1]) + 0.0
    with np.errstate(under="ignore"):
        short = x.astype(np.float32)
    return short.tobytes() if np.array_equal(short, x) else x.tobytes()


def unpacked(b: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64).astype(np.float64)


@F.pandas_udf(T.BinaryType())
def as_bytes(v: pd.Series) -> pd.Series:
    return v.map(packed)


def filters_of(dim: int, code: ProductCode | None, relevant: int):
    """id, v and filters, the sorted directions, of each vector; none is without directions."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [np.zeros(1, np.int64)] * part.num_rows
            if code and part.num_rows:
                x = np.stack([unpacked(v.as_buffer(), dim) for v in part.column("v")])
                inner = code.parts(x / np.linalg.norm(x, axis=1, keepdims=True))
                for i in range(len(x)):
                    found[i] = np.sort(code.best([p[i] for p in inner], relevant))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "label", "copies", "v")), pa.array(found, pa.list_(pa.int64()))], names=["id", "label", "copies", "v", "filters"])

    return run


def earlier_directions(mine: list[np.ndarray], filter_: int) -> np.ndarray:
    """A row of bits for each list of directions: those below `filter_` that two or more lists hold."""
    before = [f[f < filter_] for f in mine]
    owner = np.repeat(np.arange(len(mine)), [len(f) for f in before])
    _, column, n = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    bits = np.zeros((len(mine), -(-int((n > 1).sum()) // 64) * 64), np.uint8)
    kept = n[column] > 1
    bits[owner[kept], place[column[kept]]] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def links_in_groups(threshold: float, dim: int, step: int = 100_000):
    """id, n (links whose first shared filter this is) and least (the smallest id reached here), of rows with links; a link counts for all copies of the other vector.

    Rows of one (label, filter, p, q) are compared: all pairs of a block (side 2), or block p (side 0) with block q (1)."""

    def run(group: pa.Table) -> pa.Table:
        ids, side = group.column("id").to_numpy(), group.column("side").to_numpy()
        keys = [group.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("label", "filter", "p", "q")]
        copies = group.column("copies").to_numpy()
        filters, lists, vectors = group.column("filter").to_numpy(), group.column("filters").combine_chunks(), group.column("v")
        blobs = [v.as_buffer() for v in vectors]
        short = all(len(b) == 4 * dim for b in blobs)
        whole = np.frombuffer(b"".join(blobs), np.float32).reshape(-1, dim).astype(np.float64) if short else np.stack([unpacked(b, dim) for b in blobs])
        sizes = np.sqrt(np.einsum("ij,ij->i", whole, whole))
        order = np.lexsort([ids, *keys])
        edges = np.flatnonzero(np.any([np.diff(k[order]) != 0 for k in keys], axis=0)) + 1
        out: list[tuple] = []
        for at in np.split(order, edges):
            if len(at) < 2:
                continue
            x, size = whole[at], sizes[at]
            near = (x @ x.T) / (size[:, None] * size) >= threshold
            if side[at[0]] != 2:
                near &= side[at][:, None] != side[at]
            i, j = np.nonzero(near)
            i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            mine = [lists[int(r)].values.to_numpy() for r in at]
            n, bits = np.zeros(len(at), np.int64), earlier_directions(mine, int(filters[at[0]]))
            for s in range(0, len(i), step):
                a, b = i[s : s + step], j[s : s + step]
                new = ~(bits[a] & bits[b]).any(1)
                np.add.at(n, a[new], copies[at[b[new]]])
                np.add.at(n, b[new], copies[at[a[new]]])
            least = np.arange(len(at))
            while True:  # rows are sorted by id, so the smallest place is the smallest id
                before = least.copy()
                np.minimum.at(least, i, least[j])
                np.minimum.at(least, j, least[i])
                least = least[least]
                if (least == before).all():
                    break
            met = np.union1d(i, j)
            out.append((ids[at][met], n[met], ids[at][least[met]]))
        got = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("id", "n", "least"), got, strict=True)})

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = 0.98, block: int = 1024, relevant: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of `vectors`. `relevant` sets the directions of a vector by hand. A code is made for each length of vectors, of which there should be few."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), as_bytes("embedding").alias("v"), F.size("embedding").alias("dim"))
    rows = scratch_table(rows.withColumn("h", F.when(F.col("label").isNotNull(), F.md5("v"))), "vectors")
    # Copies: one vector goes on for each label and value, under a number of its own, as ids may repeat.
    key = ["label", "h", "dim"]
    classes = rows.filter("h is not null").groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.min("v").alias("v"))
    classes = scratch_table(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    seen = classes.select("id", F.col("copies").alias("n"), F.col("id").alias("least")).limit(0)
    per_label = classes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"))
    for dim, n, largest in per_label.groupBy("dim").agg(F.sum("n"), F.max("n")).collect():
        code, fitted = ProductCode.fitted(dim, largest, threshold, recall) if dim > 1 else (None, 1)
        each = relevant or fitted
        own = classes.filter(F.col("dim") == dim).select("id", "label", "copies", "v")
        own = scratch_table(own.mapInArrow(filters_of(dim, code, each), "id long, label string, copies long, v binary, filters array<long>"), "filters")
        found = own.select("id", "label", F.explode("filters").alias("filter"))
        counts = found.groupBy("label", "filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        placed = found.join(counts, ["label", "filter"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        meets = meets.select("label", "filter", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "id", F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
        groups = max(1, n * each // (4 * block))
        meets = meets.join(own.drop("label"), "id").withColumn("g", F.pmod(F.xxhash64("label", "filter", "p", "q"), F.lit(groups)))
        seen = seen.union(meets.groupBy("g").applyInArrow(links_in_groups(threshold, dim), "id long, n long, least long"))
    seen = scratch_table(seen, "vector-links")
    groups = components(seen.select(F.col("id").alias("a"), F.col("least").alias("b")).distinct())
    counted = classes.join(seen.groupBy("id").agg(F.sum("n").alias("far")), "id", "left").join(groups, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    names = counted.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = counted.join(names, "component").select(*key, (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", *key).join(named, key, "left").withColumn("component_id", F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id").withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_cap_filters(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Exact links, for tests: the filters may miss a few.
EXACT_SQL = """
SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id > b.vec_id
WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.93
"""
