import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.orphans import key_hash, orphan_references

SCHEMA_P, SCHEMA_R = "key long, born long, gone long", "rid long, key long, at long"


def brute(refs, parents):
    out = []
    for rid, key, at in refs:
        if key is None:
            continue
        at = 10**18 if at is None else at
        rows = [(b if b is not None else -(10**18), g) for k, b, g in parents if k == key]
        begun = [(b, g) for b, g in rows if b <= at]
        kind = "missing" if not rows else "late" if not begun else None if any(g is None or g > at for _, g in begun) else "deleted"
        out.append((rid, kind))
    return sorted(out)


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_against_brute_force_with_hot_keys_and_tiny_ranges(spark, size):
    rng = random.Random(size)
    key = lambda: rng.choice([1, 1, 1, 2, -5, 2**62, None, rng.randrange(40)])
    parents = [(key(), rng.choice([None, *range(50)]), rng.choice([None, *range(50), *range(50)])) for _ in range(150)]
    refs = [(i, key(), rng.choice([None, *range(-2, 60)])) for i in range(300)]
    got = orphan_references(spark.createDataFrame(refs, SCHEMA_R), spark.createDataFrame(parents, SCHEMA_P), rows_per_range=size, refs_per_task=20)
    assert sorted(map(tuple, got.select("rid", "kind").collect())) == brute(refs, parents)


def test_empty_tables_and_extra_columns(spark):
    refs = spark.createDataFrame([(1, 5, 3)], SCHEMA_R)
    none = spark.createDataFrame([], SCHEMA_P)
    assert [tuple(r) for r in orphan_references(refs, none).collect()] == [(1, "missing")]
    parents = spark.createDataFrame([(5, 1, None, "x")], SCHEMA_P + ", rid string")
    assert orphan_references(refs.limit(0), parents).count() == 0
    assert [tuple(r) for r in orphan_references(refs.withColumn("h", F.lit(1)), parents).collect()] == [(1, 1, None)]


def test_key_hash_tells_null_from_text(spark):
    rows = spark.createDataFrame([("a", None), (None, "a"), ("a", ""), ("a", "0"), ("a1", None)], "x string, y string")
    assert rows.select(key_hash(F.col("x"), F.col("y"))).distinct().count() == 5
