"""Progress of a run: results claim the rows that wait for them; and pages of a long table by an index."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.operators.windows import order_keys
from siftwave.sources.files import scratch_path


def merge_progress(events: DataFrame) -> DataFrame:
    """log, message, result, reason: the log rows that a sequence of events leaves.

    Events: seq (their order), message, reason (null: the message only waits; else a result). A result goes to the first row of equal message that waits.
    Without one it makes a row of its own, but not if a result with the same message and reason came before. `log` is the seq of the event that made the row,
    `result` that of the event that filled it.

    A result finds nothing waiting exactly where the waiting rows less the results so far fall to a new low below zero, so the n-th of the other
    results belongs to the n-th waiting row."""
    rows = events.select("seq", F.coalesce("message", F.lit("")).alias("message"), "reason", F.col("reason").isNotNull().alias("done")).withColumn("key", F.md5("message"))
    upto = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    level = rows.withColumn("level", F.sum(F.when(F.col("done"), -1).otherwise(1)).over(upto))
    claims = F.col("done") & (F.col("level") >= F.least(F.lit(0), F.coalesce(F.min("level").over(before), F.lit(0))))
    same = Window.partitionBy("key", "reason").orderBy("seq")
    told = level.withColumn("claims", claims).withColumn("again", F.col("done") & (F.row_number().over(same) > 1))
    nth = told.withColumns({"n": F.sum(F.col("claims").cast("int")).over(upto), "w": F.sum((~F.col("done")).cast("int")).over(upto)})
    waiting = nth.filter("not done").select("key", F.col("w").alias("n"), F.col("seq").alias("log"), "message")
    claimed = nth.filter("claims").select("key", "n", F.col("seq").alias("result"), "reason")
    own = nth.filter("done and not claims and not again").select(F.col("seq").alias("log"), "message", F.col("seq").alias("result"), "reason")
    return waiting.join(claimed, ["key", "n"], "left").select("log", "message", "result", "reason").union(own)


class Pages:
    """Any page of a sorted table at the price of the partitions that hold it.

    The table is range-partitioned and sorted once, and written with a folder for each range; the sizes of the ranges (one number each)
    tell which ranges a page lies in, and only those are read."""

    def __init__(self, df: DataFrame, *order: Column | str, parts: int | None = None):
        self.spark, self.columns = df.sparkSession, df.columns
        keys = order_keys(order)
        n = parts or max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = df.withColumns(keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*keys)
        path = f"{scratch_path(self.spark)}/pages-{uuid.uuid4().hex}"
        row = F.monotonically_increasing_id()
        dealt.withColumns({"_row": row.bitwiseAND(F.lit((1 << 33) - 1)), "_part": F.shiftright(row, 33).cast("int")}).write.partitionBy("_part").parquet(path)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        self.rows = self.spark.read.schema(f"{kinds}, _row long, _part int").parquet(path)
        sizes = {r["_part"]: r["n"] for r in self.rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.parts = sorted(sizes)
        self.ends = list(accumulate(sizes[p] for p in self.parts))

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def page(self, number: int, size: int) -> DataFrame:
        """Rows (number - 1) * size + 1 and so on, with pos, their place from 1. Pages beyond the end are empty."""
        first, last = (number - 1) * size, min(number * size, self.total)
        if number < 1 or first >= last:
            return self.rows.select(*self.columns, F.lit(0).cast("long").alias("pos")).limit(0)
        a, b = bisect_right(self.ends, first), bisect_right(self.ends, last - 1)
        base = F.create_map(*[F.lit(x) for i in range(a, b + 1) for x in (self.parts[i], self.ends[i - 1] if i else 0)])
        some = self.rows.filter(F.col("_part").isin(self.parts[a : b + 1])).withColumn("pos", (base[F.col("_part")] + F.col("_row") + 1).cast("long"))
        return some.filter(F.col("pos").between(first + 1, last)).select(*self.columns, "pos")
