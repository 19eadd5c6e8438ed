"""Helpers shared by the training-data operators: words, row identity, scratch tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII characters outside A-Z, a-z and 0-9.
ASCII_BREAKS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
#: The white space that line keys and shingle words are cut at.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ascii_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters. Null and empty texts have none.

    One translate() lower-cases and blanks all separators, so the split needs no regular expression.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + ASCII_BREAKS, LOWER + " " * len(ASCII_BREAKS))
    return F.array_remove(F.split(spaced, " "), "")


def text_hash(column: str) -> Column:
    """Hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and th, a hash of the text that tells rows of one doc_id apart."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_hash("text").alias("th"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (doc_id, th) that also pairs null ids."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["th"] == right["th"])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local sessions where that is unset (tests), an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-siftwave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cuts lineage: writes a table into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/siftwave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Files that finished steps shuffled stay on disk until the driver happens to collect its garbage: asks for that now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcast hint when `rows`, counted before, is within the bound; else left to a shuffled join."""
    return F.broadcast(df) if rows <= max_rows else df
