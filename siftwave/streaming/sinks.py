"""Streaming sources and sinks: a folder of daily reports, results as they finish, bounded micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwave.operators.windows import global_position
from siftwave.sources.files import date_and_source, file_name


def watch_reports(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """New JSON files of a folder as a stream: date and source of the file name, and the columns of `schema`; files with other names are left out."""
    rows = spark.readStream.schema(schema).option("multiLine", "true").option("maxFilesPerTrigger", files_at_once).json(path)
    named = rows.select("*", date_and_source(file_name(F.col("_metadata.file_path"))).alias("name"))
    return named.filter("name is not null").select("name.date", "name.source", *rows.columns)


def emit(results: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends each finished row to a Parquet table, exactly once across restarts (the checkpoint keeps what was written)."""
    out = results.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def parts_of(batch: DataFrame, order: str, most: int = 2000) -> Iterator[DataFrame]:
    """A batch in parts of at most `most` rows, in order of a unique column."""
    placed = global_position(batch, order, name="_pos").persist()
    try:
        for first in range(0, placed.count(), most):
            yield placed.filter(F.col("_pos").between(first + 1, first + most)).drop("_pos")
    finally:
        placed.unpersist()


def in_batches(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Hands each micro-batch and its number to `handle`; what a batch caches is let go when it ends. A batch may come again after a failure, so handlers should be keyed by its number."""

    def once(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            handle(batch, number)
        finally:
            batch.unpersist()

    out = rows.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
