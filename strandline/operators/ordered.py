"""Ordered computations over long groups, in two levels so that no group is confined to a task.

A group is cut into blocks of consecutive positions; windows run within blocks, and only one row a
block takes part in the window over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.runtime import salted_join

#: Positions in a block.
BLOCK = 10_000


def carry_forward(rows: DataFrame, key: list[str], position: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Add, for each named value, its last non-null value up to and including the row."""
    b = "__block"
    cut = rows.withColumn(b, F.floor(F.col(position) / block).cast("long")).withColumns({f"__v_{n}": c for n, c in values.items()})
    within = Window.partitionBy(*key, b).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(within) for n in values})
    latest = cut.groupBy(*key, b).agg(*[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(position))).alias(f"__e_{n}") for n in values])
    before = Window.partitionBy(*key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    start = latest.select(*key, b, *[F.last(f"__e_{n}", ignorenulls=True).over(before).alias(f"__s_{n}") for n in values])
    joined = local.join(start, [*key, b], "left")
    return joined.withColumns({n: F.coalesce(f"__l_{n}", f"__s_{n}") for n in values}).drop(b, *[f"__{p}_{n}" for n in values for p in "vls"])


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def running(rows: DataFrame, key: list[str], position: str, value: Column, name: str, how: str = "sum", block: int = BLOCK) -> DataFrame:
    """Add the running sum, minimum or maximum of ``value`` over the rows of the key up to and including this one; nulls are passed over."""
    b, v, merge = "__block", "__value", _MERGE[how]
    cut = rows.withColumn(b, F.floor(F.col(position) / block).cast("long")).withColumn(v, value)
    local = cut.withColumn("__own", merge(v).over(Window.partitionBy(*key, b).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    start = cut.groupBy(*key, b).agg(merge(v).alias("__total")).withColumn("__start", merge("__total").over(before)).drop("__total")
    joined = local.join(start, [*key, b], "left")
    both = F.coalesce("__own", F.lit(0)) + F.coalesce("__start", F.lit(0)) if how == "sum" else {"min": F.least, "max": F.greatest}[how]("__own", "__start")
    return joined.withColumn(name, both).drop(b, v, "__own", "__start")


def nearest(left: DataFrame, right: DataFrame, key: list[str], at: str, to: str, order: str) -> DataFrame:
    """For each row of ``left`` the row of ``right`` with the same key whose ``to`` is nearest to ``at``; ties go to the smallest ``order``.

    As-of style in both directions over the distinct positions of both sides, carried along in
    blocks of positions, so a key with any number of rows is spread. A left row without a partner,
    or with a null ``at``, comes out with nulls. ``left`` has no column in common with ``right``
    but the key. Null keys match nothing.
    """
    other = [c for c in right.columns if c not in key]
    # of equal positions only the first by order can be chosen
    best = right.where(F.col(to).isNotNull()).groupBy(*key, F.col(to).cast("double").alias("__p")).agg(F.min_by(F.struct(*other), order).alias("__r"))
    mine = left.withColumn("__p", F.col(at).cast("double"))
    points = mine.where("__p is not null").select(*key, "__p").distinct().join(best, [*key, "__p"], "full_outer")
    ahead = carry_forward(points, key, "__p", {"__a": F.col("__r")}).withColumn("__q", -F.col("__p"))
    both = carry_forward(ahead, key, "__q", {"__b": F.col("__r")})
    a, b = F.col("__a"), F.col("__b")
    da, db = F.abs(F.col("__p") - F.col(f"__a.{to}")), F.abs(F.col("__p") - F.col(f"__b.{to}"))
    nearer = (da < db) | ((da == db) & (F.col(f"__a.{order}") <= F.col(f"__b.{order}")))
    pick = F.when(a.isNull(), b).when(b.isNull(), a).when(nearer, a).otherwise(b)
    picked = both.select(*key, "__p", pick.alias("__n")).where("__n is not null")
    return salted_join(mine, picked, [*key, "__p"], "left").select(*left.columns, "__n.*")
