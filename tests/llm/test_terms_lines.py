import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm.lines import documents_with_lines, repeated_lines, repeated_positions, without_lines
from strandline.llm.terms import term_counts


@pytest.mark.parametrize("block", [2, 5, 10_000])
def test_ngram_counts_equal_brute_force(spark, block):
    rng = random.Random(block)
    rows = [([rng.choice("aaabcé ") for _ in range(rng.randrange(9))], rng.choice(["r1", "r1", "r1", "r2", None, f"x{rng.randrange(4)}"])) for _ in range(60)]
    rows += [(None, "r1"), (["a", None, "b"], "r2"), (["", "x" * 5000], "r1")] + rows[:3]
    occ, recs = Counter(), {}
    for toks, r in rows:
        toks = [t for t in toks or [] if t is not None]
        for n in (1, 2, 3):
            for i in range(len(toks) - n + 1):
                g = tuple(toks[i : i + n])
                occ[g] += 1
                recs.setdefault(g, set()).add(r)
    df = spark.createDataFrame(rows, "t array<string>, r string").withColumn("gram", F.lit(1)).repartition(3)
    got = {tuple(r["gram"]): (r["occurrences"], r["records"]) for r in term_counts(df, "t", "r", 3, block).collect()}
    assert got == {g: (n, len(recs[g] - {None})) for g, n in occ.items()}


def test_equal_rows_of_a_third_of_all_are_one_entry(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.array(F.lit("h"), F.lit("c"))).otherwise(F.array(F.concat(F.lit("w"), F.col("id") % 700))).alias("t"), F.when(F.col("id") % 3 == 0, "hot").otherwise("r").alias("r"))
    got = {tuple(r["gram"]): (r["occurrences"], r["records"]) for r in term_counts(df, "t", "r", 2).collect()}
    assert got[("h", "c")] == got[("h",)] == (1000, 1) and got[("w1",)] == (len([i for i in range(3000) if i % 3 and i % 700 == 1]), 1)


def test_no_rows(spark):
    assert term_counts(spark.createDataFrame([], "t array<string>, r string"), "t", "r", 2).count() == 0


ROWS = "id string, src string, text string, day date"


def docs(spark, rows):
    df = spark.createDataFrame(rows, "id string, src string, text string").withColumn("day", F.lit("2024-01-01").cast("date")).withColumn("key", F.lit("clash"))
    return documents_with_lines(df, "id", F.col("src"), "text", F.col("day")), df


def test_lines_repeated_in_a_source(spark):
    rows = [(f"a{i}", "s", f"SECTION: x\nPage {i} of 9\n\nbody {chr(97 + i)} words\n  PAGE {i}\tOF 12 ") for i in range(6)]
    rows += [("b", "s", None), ("c", None, "Page 1 of 9"), ("d", "other", "Page 1 of 9"), ("e", "s", ""), ("f", "s", "z" * 100_000)] + rows[:2]
    d, df = docs(spark, rows)
    got = sorted(map(tuple, repeated_positions(d, repeated_lines(d, 6, 0.1)).collect()))
    assert got == sorted((f"a{i}", n) for i in range(6) for n in (1, 4))
    clean = {r["id"]: r["cleaned"] for r in without_lines(df, F.col("src"), "text", repeated_lines(d, 6, 0.1)).collect()}
    assert clean["a0"] == "SECTION: x\n\nbody a words" and clean["b"] is None and clean["c"] == "Page 1 of 9" and clean["e"] == ""


def test_copies_count_as_ids_but_not_as_clusters(spark):
    d, _ = docs(spark, [(f"a{i}", "s", "the same line") for i in range(7)])
    assert repeated_lines(d, 6, 0.1).count() == 1
    assert repeated_lines(d, 6, 0.1, least_clusters=2).count() == 0
    assert repeated_lines(d.limit(0), 6, 0.1).count() == 0


def test_share_of_the_ids(spark):
    rows = [(f"a{i}", "s", "x" if i < 6 else f"y{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)]
    d, _ = docs(spark, rows)
    assert repeated_lines(d, 6, 0.1).count() == 1
    d, _ = docs(spark, [*rows, ("b", "s", "q")])
    assert repeated_lines(d, 6, 0.1).count() == 0
