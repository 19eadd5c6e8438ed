"""Structured Streaming forms of the counters; each takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hold_counts(df: DataFrame, key: str, lock_at: int = 10) -> DataFrame:
    """Sightings of each key so far and whether it is locked (update mode).

    A plain streaming count: tasks add up their own rows before the shuffle, so a hot key is no large group."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("seen")).withColumn("locked", F.col("seen") >= lock_at)


def latest(df: DataFrame, key: str, order: str, *keep: str) -> DataFrame:
    """The newest row of each key (update mode); ties go to the largest values."""
    fields = F.struct(order, *keep)
    return df.groupBy(key).agg(F.max(fields).alias("m")).select(key, "m.*")


def once(df: DataFrame, ts: str, keep_for: str, *keys: str) -> DataFrame:
    """Drops repeats within `keep_for` of event time; older keys leave the state."""
    return df.withWatermark(ts, keep_for).dropDuplicatesWithinWatermark(list(keys))


def daily_matrix(df: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Confusion counts for each day of event time; days close once `late` has gone by."""
    h, m = F.coalesce("human_spam", F.lit(False)), F.coalesce("machine_spam", F.lit(False))
    day = df.withWatermark(ts, late).groupBy(F.window(ts, "1 day"))
    counts = day.agg(F.count_if(h & m).alias("tp"), F.count_if(h & ~m).alias("fn"), F.count_if(~h & m).alias("fp"), F.count_if(~h & ~m).alias("tn"))
    return counts.select(F.col("window.start").cast("date").alias("date"), "tp", "fn", "fp", "tn")


def three_strikes(df: DataFrame, key: str, failed: str, limit: int = 3) -> DataFrame:
    """State of each key's attempts (update mode): attempts, failures before the first success, state.

    A success ends the sequence (`open`), the `limit`-th failure before one blocks the key (`blocked`), else it
    is `trying`. Rows of a key count in order of `seq` within an Arrow batch, batches in order of arrival."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, failures, now = state.get if state.exists else (0, 0, "trying")
        for part in parts:
            attempts += len(part)
            if now == "trying":
                bad = part.sort_values("seq")[failed].fillna(False).astype(bool).to_numpy()
                good_at = int((~bad).argmax()) if (~bad).any() else len(bad)
                if failures + good_at >= limit:
                    failures, now = limit, "blocked"
                else:
                    failures += good_at
                    now = "open" if good_at < len(bad) else now
        state.update((attempts, failures, now))
        yield pd.DataFrame({key: [k[0]], "attempts": [attempts], "failures": [failures], "state": [now]})

    kind = df.schema[key].dataType.simpleString()
    fields = "attempts long, failures long, state string"
    rows = df.select(key, "seq", failed)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {fields}", fields, "update", GroupStateTimeout.NoTimeout)
