"""Daily files that may be delivered again: the last delivery of a day and source counts, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwave.operators.compare import daily_trend
from siftwave.sources.files import date_and_source, file_name
from siftwave.streaming.sinks import in_batches

COUNTS = ("tp", "fn", "fp", "tn")
FILES = "date string, source string, tp long, fn long, fp long, tn long, delivered timestamp"


def deliver(files: DataFrame, path: str) -> None:
    """Takes over a delivery (date, source, tp, fn, fp, tn, delivered), and computes the metrics of its days anew.

    Both tables are partitioned, and only partitions that the delivery names are overwritten: files by date and source, the trend by date.
    So the same delivery again changes nothing, and other days aren't read."""
    spark = files.sparkSession
    newest = files.groupBy("date", "source").agg(F.max_by(F.struct(*COUNTS, "delivered"), "delivered").alias("f")).select("date", "source", "f.*")
    swap = lambda df, name, *keys: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/{name}")
    swap(newest, "files", "date", "source")
    days = files.select("date").distinct()
    swap(daily_trend(delivered(spark, path).join(F.broadcast(days), "date", "left_semi")), "trend", "date")


def delivered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{path}/files")


def watch_deliveries(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """New and changed JSON files of a folder as deliveries; a file with another name than date and source is left out."""
    rows = spark.readStream.schema("tp long, fn long, fp long, tn long").option("multiLine", "true").option("maxFilesPerTrigger", files_at_once).json(path)
    named = rows.select("*", date_and_source(file_name(F.col("_metadata.file_path"))).alias("name"), F.col("_metadata.file_modification_time").alias("delivered"))
    return named.filter("name is not null").select("name.date", "name.source", *COUNTS, "delivered")


def keep_days(deliveries: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Takes over every micro-batch of deliveries; one that comes again after a failure overwrites what it wrote before."""
    return in_batches(deliveries, lambda df, _: deliver(df, path) if df.take(1) else None, checkpoint, available_now)
