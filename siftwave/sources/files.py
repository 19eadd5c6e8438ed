"""File sources and sinks: message lines in several encodings, JSON reports, output tables, exports."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Fixed order in which encodings are tried for a whole file; the last one fits everything.
ENCODINGS = ("utf-8", "cp949", "euc-kr", "latin-1")


@F.pandas_udf(IntegerType())
def _fitting(lines: pd.Series) -> pd.Series:
    """A bit for each encoding that can decode the line."""

    def bits(line):
        if line is None or line.isascii():
            return (1 << len(ENCODINGS)) - 1
        found = 0
        for i, encoding in enumerate(ENCODINGS):
            try:
                line.decode(encoding)
                found |= 1 << i
            except UnicodeDecodeError:
                pass
        return found

    return lines.map(bits)


@F.pandas_udf(StringType())
def _decoded(lines: pd.Series, encodings: pd.Series) -> pd.Series:
    return pd.Series([line.decode(e) if line is not None else None for line, e in zip(lines, encodings, strict=True)], dtype=object)


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, encoding, line of text files: each file in the first encoding that fits all of its lines.

    Files are read in splits, so a file larger than a task's memory is no trouble; only one row of bits a file
    is joined back."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw"))
    bits = raw.groupBy("file").agg(F.bit_and(_fitting("raw")).alias("bits"))
    encoding = F.coalesce(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, e) for i, e in enumerate(ENCODINGS)])
    return raw.join(bits.select("file", encoding.alias("encoding")), "file").select("file", "encoding", _decoded("raw", "encoding").alias("line"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_tag(name: Column, default: str = "") -> Column:
    """Date and batch letter of a message file's name, else a date of eight digits, else the default."""
    part = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return F.coalesce(part(r"(?i)(?:kisa|trap)_([0-9]{8}_[A-Z])"), part(r"([0-9]{8})"), F.lit(default))


def family(name: Column) -> Column:
    """TRAP or MAIN for text files, SHEET for others."""
    return F.when(~F.lower(name).endswith(".txt"), "SHEET").when(F.lower(name).contains("trap"), "TRAP").otherwise("MAIN")


def date_and_source(name: Column) -> Column:
    """A struct of date and source; null where the name has none."""
    pattern = r"([0-9]{8})_([A-Za-z0-9]+)"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("date"), F.regexp_extract(name, pattern, 2).alias("source")))


def message_fields(line: Column) -> Column:
    """A struct of message and url of a tab-separated line; no url is an empty one."""
    parts = F.split(F.regexp_replace(line, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), "\t")
    return F.struct(F.get(parts, F.lit(0)).alias("message"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("url"))


def scan_messages(spark: SparkSession, path: str) -> DataFrame:
    """file, family, tag, message, url; lines of spaces alone are left out."""
    name = file_name(F.col("file"))
    lines = decoded_lines(spark, path).withColumn("m", message_fields(F.col("line"))).filter("m.message <> ''")
    return lines.select("file", family(name).alias("family"), file_tag(name).alias("tag"), "m.message", "m.url")


def scan_reports(spark: SparkSession, path: str, log_schema: str) -> tuple[DataFrame, DataFrame]:
    """Logs of JSON reports (file, key, log) and the files that are no JSON (file).

    Logs may be a list or an object; null entries are left out. The key is the sheet row less two where a log has
    one, else its place."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    logs = F.get_json_object("value", "$.logs")
    files = files.withColumn("parsed", F.try_parse_json("value")).withColumn("logs", logs)
    listed = F.from_json("logs", f"array<struct<{log_schema}>>")
    keyed = F.map_values(F.from_json("logs", f"map<string,struct<{log_schema}>>"))
    entries = F.when(F.col("logs").startswith("["), listed).otherwise(keyed)
    good = files.filter("parsed is not null").select("file", F.posexplode(entries).alias("at", "log")).filter("log is not null")
    key = F.coalesce(F.col("log.excel_row_number") - 2, F.col("at")) if "excel_row_number" in log_schema else F.col("at")
    return good.select("file", key.cast("long").alias("key"), "log"), files.filter("parsed is null").select("file")


def report_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/:*?"<>|\s]+', "_")


def write_report(logs: DataFrame, path: str, name: str) -> None:
    """Logs as JSON under the cleaned name, which is the folder's partition value."""
    logs.withColumn("report", report_name(F.lit(name))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report").json(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """path, length and modificationTime, newest first; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime").orderBy(F.desc("modificationTime"), "path")


def write_tables(frames: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each name; empty ones keep their columns."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def find_table(tables: dict[str, list[str]], token: str, marker: str) -> str | None:
    """Of named tables with their columns: the first whose name holds `token`, else the first with the column `marker`, else the second, else the only one."""
    names = list(tables)
    by_name = next((n for n in names if token in n), None)
    return by_name or next((n for n in names if marker in tables[n]), None) or (names[1] if len(names) > 1 else next(iter(names), None))


def dump_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header; line breaks and quotes inside cells are kept."""
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def export_text(diffs: DataFrame, path: str, kind: str | None = None) -> None:
    """The messages of disagreements (of one kind) as lines."""
    rows = diffs.filter(F.col("kind") == kind) if kind else diffs
    rows.select(F.regexp_replace("message", r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def word_list(spark: SparkSession, path: str, builtin: list[str]) -> DataFrame:
    """domain, source: the built-in domains and those of a text list (lower case, no comments); built-in ones win."""
    listed = spark.read.text(path).select(F.lower(F.trim("value")).alias("domain")).filter("domain <> '' and not startswith(domain, '#')").distinct()
    own = spark.createDataFrame([(d,) for d in builtin], "domain string")
    rows = own.select("domain", F.lit("builtin").alias("source")).union(listed.join(F.broadcast(own), "domain", "left_anti").select("domain", F.lit("list").alias("source")))
    return rows.distinct()


def chunks(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """One row for each window of `size` characters, a step of `size - overlap` apart; null and empty texts give none."""
    step = size - overlap
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")))
    rows = df.filter(n > 0).withColumn("chunk", F.explode(starts))
    return rows.withColumn(text, F.substring(F.col(text), F.col("chunk") * step + 1, F.lit(size)))


def scratch_path(spark: SparkSession) -> str:
    """The library's folder below the shared one of spark.checkpoint.dir. Local sessions without one (tests) get a temporary folder; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", "") or "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-siftwave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/siftwave"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: a table in the shared folder."""
    spark, path = df.sparkSession, f"{scratch_path(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
