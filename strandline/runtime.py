"""What operators need from the session: tables, lineage cuts, joins safe against hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many keys of a join are spread over tasks; a sketch of so many counters finds them.
HOT_KEYS, SKETCH = 1_000, 10_000
#: Rows of a key that a task may take, or one in so many of all rows where that is more.
ROWS_PER_TASK, SHARE_PER_TASK = 50_000, 5_000

_written: list[str] = []


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``); where none is set and all is one process (tests) a temporary one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context.get() if context.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def file_system(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's part of the shared folder, which is deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p.getParent())
    _written.append(path)
    return path


def written(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = frame.sparkSession
    path = shared_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, label: str, directory: str, names: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes of the named tables of a directory, written once an application and made anew when a file of them changes."""
    state = [spark.sparkContext.applicationId, label]
    for n in names:
        fs, p = file_system(spark, f"{directory}/{n}.parquet")
        files = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, "*.parquet")) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]
        state += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    key = tuple(state)
    if key not in _stored:
        path = shared_path(spark, label)
        build().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def release(spark: SparkSession) -> None:
    """Delete what this process has written to the shared folder so far. Frames that read it can no longer be used."""
    _stored.clear()
    while _written:
        fs, p = file_system(spark, _written.pop())
        fs.delete(p, True)


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """__key, __salts: digests of the keys that hold more rows than one task should take, and over how many tasks to spread them.

    A sketch counts, whose size does not depend on the rows, so nothing but sketches is shuffled
    and at most ``HOT_KEYS`` rows come out. Its counts are estimates; they decide where rows are
    worked on, never which.
    """
    key = F.xxhash64(*[F.col(f"`{c}`") for c in on])
    counted = rows.select(key.alias("k")).agg(F.expr(f"approx_top_k(k, {HOT_KEYS}, {SKETCH})").alias("top"), F.count(F.lit(1)).alias("total"))
    part = F.greatest(F.lit(ROWS_PER_TASK), F.col("total") / SHARE_PER_TASK)
    each = counted.select(F.explode("top").alias("t"), part.alias("part"))
    return each.select(F.col("t.item").alias("__key"), F.ceil(F.col("t.count") / F.col("part")).cast("int").alias("__salts")).where("__salts > 1")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", repeats: bool = False) -> DataFrame:
    """Equi-join of a side with hot keys (``big``) and one with at most few rows per key.

    The rows of a hot key are spread by their own content over as many parts as its measured load
    asks for, and the rows of ``small`` with that key are copied to each part; other rows are left
    alone. ``big`` is read twice, so it should be a table. ``how``: inner, left, left_semi or
    left_anti. Null keys match nothing, as in any equi-join. Where rows of ``big`` may be equal in
    every column, set ``repeats``: equal rows then travel as one with their number.
    """
    names = big.columns
    if repeats:
        big = big.groupBy(*[f"`{c}`" for c in names]).agg(F.count(F.lit(1)).alias("__times"))
    key = F.xxhash64(*[F.col(f"`{c}`") for c in on])
    hot = F.broadcast(hot_keys(big, on))  # at most HOT_KEYS rows
    content = F.xxhash64(*[F.col(f"`{c}`") for c in names if not _is_map(big, c)])
    left = big.withColumn("__key", key).join(hot, "__key", "left").withColumn("__salt", F.pmod(content, F.coalesce("__salts", F.lit(1))).cast("int")).drop("__key", "__salts")
    right = small.withColumn("__key", key).join(hot, "__key", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__key", "__salts")
    out = left.join(right, [*on, "__salt"], how).drop("__salt")
    return out.withColumn("__times", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times") if repeats else out


def _is_map(frame: DataFrame, name: str) -> bool:
    return dict(frame.dtypes)[name].startswith("map")


def micros(frame: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without a zone; null stays null."""
    if dict(frame.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(f"`{name}`"))


def only(frame: DataFrame, names: Iterable[str]) -> DataFrame:
    """The named columns, quoted, so that extra columns of any name do no harm."""
    return frame.select(*[F.col(f"`{n}`") for n in names])
