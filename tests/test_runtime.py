"""Joins, numbering and shared tables under hot keys."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline import runtime
from strandline.functions import models
from strandline.operators import index, score


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(runtime, "ROWS_PER_TASK", 500)


def sides(spark):
    big = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"), (F.col("id") % 7).alias("v"))
    return big, spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), ("none", 4), (None, 5)], "k string, w int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("repeats", [False, True])
def test_salted_joins_equal_plain_ones(spark, small_tasks, how, repeats):
    big, small = sides(spark)
    plain = Counter(map(tuple, big.join(small, ["k"], how).collect()))
    assert Counter(map(tuple, runtime.salted_join(runtime.written(big, "big"), small, ["k"], how, repeats=repeats).collect())) == plain
    assert runtime.salted_join(big.limit(0), small, ["k"], how).count() == 0


def test_the_load_of_a_hot_key_is_measured_and_spread(spark, small_tasks):
    big, small = sides(spark)
    hot = runtime.hot_keys(big, ["k"]).collect()
    assert len(hot) == 1 and 6 <= hot[0]["__salts"] <= 7
    # a third of all rows under one key, in as many parts as its load asks for
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id"))
    joined = runtime.salted_join(runtime.written(rows, "rows"), small.limit(1), ["k"])
    assert joined.count() == 3000 and max(Counter(r[0] for r in joined.select(F.pmod(F.xxhash64("k", "id"), F.lit(6))).collect()).values()) < 700


def test_equal_rows_of_a_third_of_all_are_one_row_on_the_way(spark, small_tasks):
    rows = runtime.written(spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k")), "rows")
    assert runtime.salted_join(rows, spark.createDataFrame([("hot", 1)], "k string, w int"), ["k"], repeats=True).count() == 3000


def test_ordinals_of_a_hot_group_are_spread_and_gapless(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 900)).alias("g"), F.xxhash64("id").alias("o"), F.col("id"))
    got = index.ordinals(rows.repartition(5), ["g"], ["o", "id"], "n").collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["n"], r["o"]))
    assert len(got) == 6000 and all([n for n, _ in sorted(v)] == list(range(len(v))) and [o for _, o in sorted(v)] == sorted(o for _, o in v) for v in by.values())


def test_stored_tables_are_made_once_and_released(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    made = []
    build = lambda: (made.append(1), spark.range(5))[1]
    assert [runtime.stored(spark, "x", str(tmp_path), ["t"], build).count() for _ in range(2)] == [5, 5] and len(made) == 1
    spark.range(9).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert runtime.stored(spark, "x", str(tmp_path), ["t"], build).count() == 5 and len(made) == 2
    path = runtime.written(spark.range(1), "gone").inputFiles()[0]
    runtime.release(spark)
    fs, p = runtime.file_system(spark, path)
    assert not fs.exists(p)


def test_persistent_models_try_again_with_more_room():
    calls = []

    def factory():
        def run(texts, budget):
            calls.append((list(texts), budget))
            if len(calls) == 1:
                raise ConnectionError
            return [(t[:budget], "length" if len(t) > budget else "stop") for t in texts]

        return run

    assert models.persistent(factory, budgets=(3, 6))()(["ab", "abcd", "abcdefgh"]) == ["ab", "abcd", "abcdef"]
    assert calls == [(["ab", "abcd", "abcdefgh"], 3), (["ab", "abcd", "abcdefgh"], 3), (["abcd", "abcdefgh"], 6)]
    always = lambda: lambda texts, budget: 1 / 0
    with pytest.raises(ZeroDivisionError):
        models.persistent(always, attempts=2)()(["a"])


def test_returns_name_what_they_miss(spark):
    claims = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "item string, claim int")
    back = spark.createDataFrame([("a", 0), ("a", 0), ("a", 7), ("z", 0), ("b", 0), (None, 0)], "item string, claim int")
    got = sorted((str(r["item"]), r["claim"], r["state"]) for r in score.matched_returns(back, claims, spark.createDataFrame([("a",)], "item string")).collect())
    assert got == [("None", 0, "no such item"), ("a", 0, "matched"), ("a", 0, "matched"), ("a", 7, "no such claim"), ("b", 0, "no answer"), ("z", 0, "no such item")]
