"""A table of versions: updates are written beside the old files and become visible by one manifest.

Rows live in buckets by a hash of their key. An update reads and writes only the buckets that its keys fall in; the
manifest of a version names the folder of every bucket. A crash before the manifest leaves the last version as it was, with some files that
no manifest names. A manifest carries the number of the last micro-batch of each source, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwave.streaming.sinks import in_batches


class SnapshotTable:
    """Rows of `schema` with a unique `key` (null keys have a bucket like others) under `path`, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.empty = spark.createDataFrame([], schema)

    # ---- manifests

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, folder = self._fs(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """buckets (number to folder) and batches (source to number) of a version, the last one by default."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": {}, "batches": {}}
        version = known[-1] if version is None else version
        lines = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).collect()  # one small file
        return json.loads(lines[0]["value"])

    def _publish(self, manifest: dict) -> None:
        """Writes a manifest under another name and renames it; a version that another writer has published meanwhile is an error."""
        name = f"{self.path}/manifests/{manifest['version']:012d}.json"
        fs, target = self._fs(name)
        _, draft = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} was published by another writer")

    # ---- rows

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)["buckets"].values())

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in sorted(folders)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.empty

    def bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def commit(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], source: str = "", batch: int | None = None) -> int:
        """Publishes merge(old rows, new rows) of the buckets that `rows` fall in, and returns the version. A `batch` of `source` that is not
        newer than the last one published changes nothing."""
        now = self.manifest()
        if batch is not None and batch <= now["batches"].get(source, -1):
            return now["version"]
        touched = sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # at most `buckets` numbers
        old = self._rows([f for b, f in now["buckets"].items() if int(b) in touched])
        folder = f"data/{uuid.uuid4().hex}"
        merged = merge(old, rows).select(*self.empty.columns).withColumn("_bucket", self.bucket())
        merged.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, _ = self._fs(self.path)
        places = {str(b): f"{folder}/_bucket={b}" for b in touched}
        places = {b: p for b, p in places.items() if fs.exists(self._fs(f"{self.path}/{p}")[1])}  # a bucket may have lost its last row
        kept = {b: f for b, f in now["buckets"].items() if int(b) not in touched}
        batches = now["batches"] | ({source: batch} if batch is not None else {})
        self._publish({"version": now["version"] + 1, "buckets": kept | places, "batches": batches})
        return now["version"] + 1

    def commit_stream(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], source: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Each micro-batch becomes one version, once: a batch that is handed over again after a failure is known by its number."""
        return in_batches(rows, lambda df, n: self.commit(df, merge, source, n), checkpoint, available_now)
