"""Batches of messages for a scorer callback, with its errors kept as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def score_batches(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], fields: str, key: str = "seq", text: str = "message", reason: str = "reason", batch: int = 2000) -> DataFrame:
    """`key` and the scorer's `fields` for each row of `df`, in batches of at most `batch` rows.

    The scorer gets the rows of a batch and returns theirs in the same order. If it fails, the batch is scored row by
    row, and rows that fail alone get nulls and the error as their reason. A scorer that returns another number of
    rows has failed. Empty texts are scored like others; nothing is cached from one batch to the next."""
    names = [f.split()[0] for f in fields.split(",")]
    if reason not in names:
        raise ValueError(f"the scorer's fields must hold {reason}")

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        got = scorer(rows)
        if len(got) != len(rows):
            raise ValueError(f"{len(got)} results for {len(rows)} rows")
        return got[names].reset_index(drop=True)

    def one(row: pd.DataFrame) -> pd.DataFrame:
        try:
            return ask(row)
        except Exception as e:  # noqa: BLE001 (whatever a callback raises becomes its row's reason)
            return pd.DataFrame([{n: f"{type(e).__name__}: {e}" if n == reason else None for n in names}])

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {fields}"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, batch):  # only the rows of a batch become Python objects
                rows = part.slice(at, batch).to_pandas()
                try:
                    got = ask(rows)
                except Exception:  # noqa: BLE001
                    got = pd.concat([one(rows.iloc[i : i + 1].reset_index(drop=True)) for i in range(len(rows))], ignore_index=True)
                got.insert(0, key, rows[key])
                yield pa.RecordBatch.from_pandas(got, schema=kinds, preserve_index=False)

    return df.select(key, text).mapInArrow(run, schema)
