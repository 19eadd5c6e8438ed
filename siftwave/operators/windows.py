"""Order-dependent state as windows, and positions in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.sources.files import scratch


def order_keys(order: tuple[Column | str, ...]) -> dict[str, Column]:
    return {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """`df` in a global order, written once: _part (its range) and _row (from 0 inside it).

    Sizes and ranks must come from one written table: a plan that deals the rows twice may sample other bounds."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = order_keys(order)
    dealt = df.withColumns(keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*keys)
    rows = scratch(dealt.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    return rows.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def sums_before(df: DataFrame, key: str, order: str, **values: Column) -> DataFrame:
    """Adds, for each name in `values`, the sum of that column over the earlier rows of the same key.

    A hot key is cut by range partitions: sums run inside them, and keys that lie in several partitions (fewer than
    there are partitions) get the totals of the partitions before."""
    rows = numbered(df.withColumns({f"_v_{c}": v.cast("long") for c, v in values.items()}), key, order)
    own = rows.groupBy("_part", key).agg(*[F.sum(f"_v_{c}").alias(f"_t_{c}") for c in values])
    cut = own.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_k"))
    parts = own.join(F.broadcast(cut), F.col(key).eqNullSafe(F.col("_k"))).select("_k", F.col("_part").alias("_p"), *[f"_t_{c}" for c in values])
    earlier = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(parts.select("_k", "_p", *[F.sum(f"_t_{c}").over(earlier).alias(f"_b_{c}") for c in values]))
    inside = Window.partitionBy("_part", key).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_s_{c}": F.sum(f"_v_{c}").over(inside) for c in values}).join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    zero = F.lit(0).cast("long")
    return out.select(*df.columns, *[(F.coalesce(f"_s_{c}", zero) + F.coalesce(f"_b_{c}", zero)).alias(c) for c in values])


def running_hold(df: DataFrame, key: str, order: str, lock_at: int = 10, stored: str | None = None) -> DataFrame:
    """n-th sighting of a key (with what is stored of it) and whether it is locked from there on."""
    rows = sums_before(df, key, order, _before=F.lit(1))
    seen = F.col("_before") + 1 + (F.coalesce(F.col(stored), F.lit(0)) if stored else 0)
    return rows.withColumn("seen", seen).withColumn("locked", F.col("seen") >= lock_at).drop("_before")


def three_strike(df: DataFrame, key: str, order: str, failed: str, limit: int = 3) -> DataFrame:
    """Attempts on a key in order: the first success is shared from there on; `limit` failures before any force spam."""
    bad = F.coalesce(F.col(failed), F.lit(False))
    past = sums_before(df, key, order, fails=bad.cast("int"), _good=(~bad).cast("int"))
    done = F.col("_good") > 0
    stuck = ~done & (F.col("fails") + bad.cast("int") >= limit) & (bad | (F.col("fails") >= limit))
    state = F.when(done, "shared").when(stuck, "forced").when(bad, "failed").otherwise("success")
    return past.withColumn("state", state).drop("_good")


def first_samples(df: DataFrame, rule: str, order: str, n: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(rule).orderBy(order)).cast("long")).filter(F.col("nth") <= n)


def global_position(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """Rank from 1 in a total order without one task holding all rows: places in range partitions plus the sizes of those before.

    The order must be total (end it with a unique column)."""
    rows = numbered(df, *order)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(base), F.col("_part") == F.col("_p")).withColumn(name, F.col("_base") + F.col("_row") + 1).drop("_part", "_p", "_row", "_base")


def page(df: DataFrame, number: int, size: int, sort: str, allowed: list[str], default: str, tie: str, ascending: bool = False) -> DataFrame:
    """One page of a table by a whitelisted column."""
    c = F.col(sort if sort in allowed else default)
    return df.orderBy(c.asc() if ascending else c.desc(), F.col(tie).asc()).offset((number - 1) * size).limit(size)
