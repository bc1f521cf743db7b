"""References to records that do not exist.

Parents are range-partitioned on (key, time of birth), each range is kept as sorted arrays, and
batches of references probe the arrays of their range by binary search. A key too large for one
range simply spans several: what the earlier ranges of that key hold is carried along as one
number (the latest end of life so far), so no key is ever collected into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.runtime import written

#: Parent entries in one sorted range, and references probed against it in one task. The driver
#: keeps four numbers a range: 10^10 parents make 50,000 ranges, 1.6 MB.
ROWS_PER_RANGE = 200_000
REFS_PER_TASK = 500_000
FOREVER = 2**63 - 1
NEVER = -(2**63)


def key_hash(*parts: Column) -> Column:
    """A 64-bit key of several parts; a null part differs from any string."""
    marked = [F.coalesce(F.concat(F.lit("1"), p.cast("string")), F.lit("0")) for p in parts]
    return F.xxhash64(F.concat_ws("\x1f", *marked))


def _codes(h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(h, t) as 16-byte strings that sort like the pairs."""
    both = np.empty((len(h), 2), dtype=">u8")
    both[:, 0] = h.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    both[:, 1] = t.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return both.view("S16").reshape(-1)


def _running_max(h: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Running maximum of ``gone`` within runs of equal ``h``."""
    out = np.empty_like(gone)
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else []
    for a, b in zip(starts, [*starts[1:], len(h)]):
        out[a:b] = np.maximum.accumulate(gone[a:b]) if b - a > 1 else gone[a:b]
    return out


RANGE_SCHEMA = "lo_h long, lo_t long, hi_h long, hi_max long, h array<long>, t array<long>, m array<long>"


def _ranges(rows_per_range: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, t, g = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
            m = _running_max(h, g)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (h, t, m)]
            ends = [pa.array([int(x)], pa.int64()) for x in (h[0], t[0], h[-1], m[-1])]
            return pa.RecordBatch.from_arrays([*ends, *lists], ["lo_h", "lo_t", "hi_h", "hi_max", "h", "t", "m"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= rows_per_range:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return build


def _probe(refs: pd.DataFrame, h: np.ndarray, t: np.ndarray, m: np.ndarray, carry_h, carry_max: int, next_h) -> np.ndarray:
    """The kind of each reference of a range; None for a reference in order."""
    rh, rt = refs["__h"].to_numpy(np.int64), refs["__t"].to_numpy(np.int64)
    at = np.searchsorted(_codes(h, t), _codes(rh, rt), side="right") - 1
    inside = np.clip(at, 0, max(0, len(h) - 1))
    after = np.clip(at + 1, 0, max(0, len(h) - 1))
    begun = (at >= 0) & (h[inside] == rh) if len(h) else np.zeros(len(rh), bool)
    carried = (rh == carry_h) if carry_h is not None else np.zeros(len(rh), bool)
    end = np.where(begun, m[inside] if len(h) else NEVER, NEVER)
    end = np.where(carried, np.maximum(end, carry_max), end)
    later = (at + 1 < len(h)) & (h[after] == rh) if len(h) else np.zeros(len(rh), bool)
    if next_h is not None:
        later |= (at + 1 >= len(h)) & (rh == next_h)
    known = begun | carried
    alive = known & ((end > rt) | (end == FOREVER))
    return np.where(alive, None, np.where(known, "deleted", np.where(later, "late", "missing")))


def orphan_references(refs: DataFrame, parents: DataFrame, rows_per_range: int = ROWS_PER_RANGE, refs_per_task: int = REFS_PER_TASK) -> DataFrame:
    """Every reference with ``kind``: 'missing', 'late', 'deleted', or null for one in order.

    ``refs`` has ``key`` and ``at`` (longs; a null time stands for the end of time) beside any
    other columns, ``parents`` has ``key``, ``born`` and ``gone`` (longs; null birth: always
    there, null end: still there). A key that no parent has is 'missing'; one whose parents were
    all born after ``at`` is 'late'; one with parents born by then, all gone by then, is
    'deleted'. References with a null key and parents with a null key are left out. Repeated
    parents change nothing, repeated references come out as often as they went in. An empty
    ``parents`` makes every reference 'missing'.
    """
    spark = refs.sparkSession
    p = parents.where("key is not null").select(
        F.col("key").alias("h"),
        F.coalesce("born", F.lit(NEVER)).alias("t"),
        F.coalesce("gone", F.lit(FOREVER)).alias("g"),
    )
    # one row for each (key, birth): the merge happens before the shuffle where it can
    p = p.groupBy("h", "t").agg(F.max("g").alias("g"))
    ranges = written(
        p.repartitionByRange("h", "t").sortWithinPartitions("h", "t").mapInArrow(_ranges(rows_per_range), RANGE_SCHEMA),
        "ranges",
    )
    edges = sorted(tuple(r) for r in ranges.select("lo_h", "lo_t", "hi_h", "hi_max").collect())
    n = len(edges)
    lo_h, lo_t = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)
    carry: list[tuple[int | None, int]] = [(None, NEVER)]
    for before, now in zip(edges, edges[1:]):
        if before[2] != now[0]:
            carry.append((None, NEVER))
        else:  # the key goes on; when it fills the whole earlier range, so does its carry
            earlier = carry[-1][1] if carry[-1][0] == before[2] and before[0] == before[2] else NEVER
            carry.append((now[0], max(before[3], earlier)))
    after = [e[0] for e in edges[1:]] + [None]

    keep = [f for f in refs.schema.fields if f.name not in ("key", "at")]
    routed_schema = T.StructType([*keep, T.StructField("__h", T.LongType()), T.StructField("__t", T.LongType())])
    routed = refs.where("key is not null").select(*[F.col(f"`{f.name}`") for f in keep], F.col("key").alias("__h"), F.coalesce("at", F.lit(FOREVER)).alias("__t"))
    if not n:
        return routed.select(*[F.col(f"`{f.name}`") for f in keep], F.lit("missing").alias("kind"))
    codes = _codes(lo_h, lo_t)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, t = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("__h", "__t"))
            r = np.maximum(np.searchsorted(codes, _codes(h, t), side="right") - 1, 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r, pa.int32())], [*b.schema.names, "__r"])

    routed = written(routed.mapInArrow(route, T.StructType([*routed_schema.fields, T.StructField("__r", T.IntegerType())])), "refs")
    load = {r["__r"]: r["count"] for r in routed.groupBy("__r").count().collect()}
    parts = {r: -(-c // refs_per_task) for r, c in load.items()}
    widest = max(parts.values(), default=1)

    where = spark.createDataFrame(
        [(i, *edges[i][:2], parts[i]) for i in range(n) if i in parts],
        "__r int, lo_h long, lo_t long, parts int",
    )
    # one row a range on both sides
    sides = ranges.join(where, ["lo_h", "lo_t"]).withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sides = sides.select("__r", "__s", "h", "t", "m")
    if widest == 1:
        salted = routed.withColumn("__s", F.lit(0))
    else:
        hot = spark.createDataFrame([(r, k) for r, k in parts.items() if k > 1], "__r int, __k int")
        # positions in a written table are the same whenever a task is run again
        salted = routed.withColumn("__at", F.monotonically_increasing_id()).join(hot, "__r", "left").withColumn("__s", F.pmod(F.col("__at"), F.coalesce("__k", F.lit(1))).cast("int")).drop("__at", "__k")

    out = T.StructType([*keep, T.StructField("kind", T.StringType())])
    names = [f.name for f in out.fields]

    bounds = spark.sparkContext.broadcast([(*carry[i], after[i]) for i in range(n)])

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return left.assign(kind=None)[names]
        r = right.iloc[0]
        arrays = [np.asarray(r[c], np.int64) for c in ("h", "t", "m")]
        left["kind"] = _probe(left, *arrays, *bounds.value[int(r["__r"])])
        return left[names]

    return salted.groupBy("__r", "__s").cogroup(sides.groupBy("__r", "__s")).applyInPandas(probe, out)
