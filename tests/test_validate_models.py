import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import models
from strandline.operators import validate

FRAME = "anchor_id string, class string, claims array<struct<tier:string>>"


def test_every_problem_of_a_frame_is_named(spark):
    rows = [("a", "x", [("required",)]), ("b", "x", [("optional",)]), ("c", None, [("required",)]), ("d", "y", None), ("d", "y", None), (None, "x", [("required",)])]
    got = {(r["subject"], r["problem"]) for r in validate.frame_problems(spark.createDataFrame(rows, FRAME), {"x": 3, "y": 2}, 9).collect()}
    assert got == {("b", "no required claim"), ("c", "no class"), ("d", "no required claim"), ("d", "written more than once"), ("(no id)", "no id"), ("class y", "expected 2, found 1"), ("class (none)", "expected 0, found 1"), ("total", "expected 9, found 5")}


def test_weights():
    assert validate.weight_problems({"a": 2, "b": 1}, 3, ["a", "b"], ["c"]) == []
    assert validate.weight_problems({"a": 2, "q": 2}, 3, ["a", "b"], ["a"]) == ["no weight for b", "weight for q, which is not scored", "weights add up to 4, not 3", "a is scored and unscored"]


def test_probes_and_gate(spark):
    p = spark.createDataFrame([("1", "q", ["c"], "figure_only"), ("2", " ", [], "x"), ("3", None, None, None)], "id string, question string, claims array<string>, arm string")
    assert sorted((r["id"], r["problem"]) for r in validate.malformed_probes(p).collect()) == sorted((i, x) for i in "23" for x in ("no question", "no claims", "unknown arm"))
    ok = spark.createDataFrame([("ACCEPTED",)], "verdict string")
    validate.require_accepted(ok)
    for bad in (ok.limit(0), spark.createDataFrame([("SMOKE",)], "verdict string")):
        with pytest.raises(RuntimeError, match="not accepted"):
            validate.require_accepted(bad)


def test_reach_roles_and_items(spark):
    hits = spark.createDataFrame([("A", "i", "D", "1", True), ("A", "i", "D", "2", False), ("A", "j", "D", "1", True), ("A", "k", "D", "3", False)], "config string, anchor_id string, doc string, clause string, hit boolean")
    items = spark.createDataFrame([("i", 0.5), ("j", 1.0), ("k", None)], "item string, coverage double")
    assert {tuple(r) for r in validate.by_reach(hits, items).collect()} == {("some", 1, 0.5), ("all", 1, 1.0), ("none", 1, None)}
    roles = spark.createDataFrame([("i", "D", "1", "primary"), ("i", "D", "2", "hop1"), ("i", "D", "2", "hop1")], "anchor_id string, doc string, clause string, role string")
    assert {(r["role"], r["spans"], r["reached"]) for r in validate.recall_by_role(hits, roles).collect()} == {("primary", 1, 1), ("hop1", 1, 0), ("none", 2, 1)}
    s = spark.createDataFrame([(r, i, v) for i, vs in {"a": (1.0, 0.0, 1.0), "b": (1.0, 1.0, 1.0)}.items() for r, v in enumerate(vs)], "run int, item string, score double")
    assert {r["item"]: (r["runs"], r["difficulty"], r["discrimination"], r["flips"]) for r in validate.item_statistics(s).collect()} == {"a": (3, 0.666667, 1.0, 2), "b": (3, 1.0, None, 0)}


def test_power_grows_with_the_gain(spark):
    low, high = (validate.power(spark, 100, 0.6, g, 200).collect()[0]["power"] for g in (0.0, 0.25))
    assert low < 0.1 < 0.8 < high


def test_models_plug_in(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,), ("b a",)], "t string").repartition(2)
    v = {r["t"]: r["v"] for r in df.select("t", models.embedder(models.HashEncoder)(F.col("t")).alias("v")).collect()}
    assert v[None] is None and v["a b"] == v["b a"] and abs(sum(x * x for x in v["a b"]) - 1) < 1e-6 and set(v[""]) == {0.0}

    def broken():
        def run(texts, *_):
            if "bad" in texts:
                raise OSError("no service")
            return [float(len(t)) for t in texts]

        return run

    t = spark.createDataFrame([("bad",), ("xx",), ("y",)], "t string").coalesce(1)
    assert [r[0] for r in t.select(models.scorer(broken, batch=1)(F.col("t"), F.col("t"))).collect()] == [None, 2.0, 1.0]
    pair = spark.createDataFrame([("a b", "b c"), ("a", "a b")], "q string, p string")
    assert [tuple(r) for r in pair.select(models.scorer(models.overlap_scorer)(F.col("q"), F.col("p")), models.judge(models.containing_judge)(F.col("q"), F.col("p"))).collect()] == [(0.5, "NO"), (1.0, "YES")]


def test_whole_texts_are_encoded(spark):
    long = "pump " * 2_000 + "valve mast " * 400
    df = spark.createDataFrame([(long,), ("pump",)], "t string")
    v = {r["t"]: r["v"] for r in df.select("t", models.embedder(models.HashEncoder)(F.col("t")).alias("v")).collect()}
    assert np.allclose(v[long], models.HashEncoder()([long])[0], atol=1e-6) and not np.allclose(v[long], v["pump"], atol=1e-3)


def test_windows_of_an_encoder_with_a_limit(spark):
    def limited():
        def run(texts, *_):
            assert len(texts) <= 2 and all(len(t) <= 10 for t in texts)
            return [[float(t.count("a")), float(t.count("b"))] for t in texts]

        return run

    assert models.windows("aa bb cc dd", 6) == ["aa bb ", "cc dd"] and models.windows("x" * 7, 3) == ["xxx", "xxx", "x"] and models.windows("", 3) == [""]
    texts = ["a", "aaaa bbbb aaaa bbbb", "a" * 25 + "b" * 25, "", None]
    v = {r["t"]: r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", models.embedder(limited, batch=2, limit=10)(F.col("t")).alias("v")).collect()}
    assert v[None] is None and v["a"] == [1.0, 0.0] and v[""] == [0.0, 0.0]
    assert np.allclose(v[texts[1]], [2**-0.5] * 2) and np.allclose(v[texts[2]], [2**-0.5] * 2)


def test_late_interaction(spark):
    t = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[2.0, 0.0], [0.5, 3.0]]), ([], [[1.0]]), (None, None)], "q array<array<float>>, p array<array<float>>")
    assert [r[0] for r in t.select(models.max_sim(F.col("q"), F.col("p"))).collect()] == [5.0, None, None]
