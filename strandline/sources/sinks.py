"""Writers: keyed tables, derived tables, run records, snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.index import delete_where, upsert

_POINTER = "_current"


def hadoop_path(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class VersionedTable:
    """A Parquet table of which every write makes a new version; readers follow a pointer that moves when the version is whole.

    A job that dies leaves the former version in force. Earlier versions are the snapshots.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: list[str] | None = None) -> None:
        self.spark, self.path, self.by = spark, path.rstrip("/"), partition_by or []

    def versions(self) -> list[str]:
        fs, p = hadoop_path(self.spark, f"{self.path}/{_POINTER}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def current(self) -> str | None:
        """The version in force: pointers are empty files named by number and version, the last one counts."""
        v = self.versions()
        return v[-1].split("-", 1)[1] if v else None

    def exists(self) -> bool:
        return self.current() is not None

    def read(self, version: str | None = None) -> DataFrame:
        v = version or self.current()
        if v is None:
            raise FileNotFoundError(f"{self.path} has no version")
        return self.spark.read.parquet(f"{self.path}/{v}")

    def write(self, frame: DataFrame) -> str:
        n, v = len(self.versions()), uuid.uuid4().hex
        w = frame.write.partitionBy(*self.by) if self.by else frame.write
        w.parquet(f"{self.path}/{v}")
        fs, p = hadoop_path(self.spark, f"{self.path}/{_POINTER}/{n:08d}-{v}")
        fs.create(p, False).close()
        return v

    def upsert(self, incoming: DataFrame, key: str) -> str:
        return self.write(upsert(self.read(), incoming, key) if self.exists() else incoming.dropDuplicates([key]))

    def delete(self, keys: DataFrame, on: list[str]) -> str:
        return self.write(delete_where(self.read(), keys, on))


def derive(source: VersionedTable, target: VersionedTable, change) -> int:  # noqa: ANN001
    """Write ``change`` of the source as a new table; refuses if both are one, the source is missing or the target is there. Returns the rows, which must be as many."""
    if source.path == target.path:
        raise ValueError("source and target are the same table")
    if not source.exists():
        raise FileNotFoundError(source.path)
    if target.exists():
        raise FileExistsError(target.path)
    target.write(change(source.read()))
    n, m = source.read().count(), target.read().count()
    if n != m:
        raise RuntimeError(f"{m} of {n} rows arrived")
    return m


def append_metrics(frame: DataFrame, path: str) -> None:
    """Append run records as JSON lines."""
    frame.write.mode("append").json(path)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON object with sorted keys, for configurations and summaries."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_results(rows: DataFrame, summary: dict, directory: str) -> None:
    """Rows as JSON lines beside a summary."""
    rows.write.json(f"{directory}/rows")
    write_record(rows.sparkSession, summary, f"{directory}/summary")


def build_config(frame: DataFrame, version: str, options: dict) -> dict:
    """The record of a build: its version, options, rows and schema; only for a build with rows."""
    n = frame.count()
    if not n:
        raise ValueError("nothing was built")
    return {"version": version, "options": options, "rows": n, "fields": {f.name: f.dataType.simpleString() for f in frame.schema.fields}}


def stats(frame: DataFrame) -> DataFrame:
    """One row: points and documents of a collection."""
    return frame.agg(F.count(F.lit(1)).alias("points"), F.count_distinct("doc_code").alias("documents"))
