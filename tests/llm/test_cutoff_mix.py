import random

import numpy as np
from pyspark.sql import functions as F

from strandline.llm.cutoff import longer_sentences, strict_prefixes, truncated, truncation_by_source
from strandline.llm.mix import deal, mixed, quotas, shares, token_counts

OPEN = [
    "It ends in the mid", "It ends in the middle of a", "The valve was clo...", "The valve was [...]", "Le boîtier est prot�", "One row. See AB-", "All is well. The", "The inertia &hel", "When it opens,",
    "| a | b | c |\n| d | e", "| a | b | c |\n| d | e |", "Das Ventil …", "was found at 498", "- list\nThe next sentence is not",
]
WHOLE = [
    None, "", "  ", "It ends.", "Does it end?", "He said \"yes.\"", "Text.\n- an entry without stop", "Text.\n1. an entry", "| a | b |\n| c | d |", "Text.\nAXSS-E-ST-42-05, issue 3", "Text.\nStatus: open",
    "Text.\nKeywords: one, two", "Text.\n(closed by the board on day 3)", "Text.\n-- end of note 4 --", "El fin. ",
]


def test_how_texts_end(spark):
    rows = [(i, t, "s") for i, t in enumerate(OPEN + WHOLE)]
    got = {r["key"]: r["cut"] for r in truncated(spark.createDataFrame(rows, "id long, t string, s string").withColumn("base", F.lit(1)), "id", "t", "s").collect()}
    assert [t for i, t, _ in rows if got[i] != (t in OPEN)] == []


def test_strict_prefixes_equal_brute_force(spark):
    rng = random.Random(3)
    head = "the same header of every text in this lot, "
    texts = [head * rng.choice([0, 1, 1, 5]) + "".join(rng.choice("ab") for _ in range(rng.randrange(16, 24))) for _ in range(150)]
    texts += [t[: rng.randrange(len(t) + 1)] for t in texts[:80]] + ["", "short", "shor", "s", "é" * 40, "é" * 33, "é", "x" * 70_000, "x" * 69_999, "y" * 20, "y" * 20 + "\n- a", "y" * 20 + "z", "q", "q\nr"]
    df = spark.createDataFrame([(t,) for t in texts + [None]], "t string").repartition(5)
    want = {a for a in texts if a and any(b != a and b.startswith(a) for b in texts)}
    got = {r["text"]: r["follows"] for r in strict_prefixes(df, "t").collect()}
    assert set(got) == want and all(any(b.startswith(a + f) for b in texts) for a, f in got.items())
    assert got["y" * 20] == "z" and got["q"] == "\n"


def test_a_longer_copy_is_evidence(spark):
    whole = "The header of a long enough text.\n- entry with a last word"
    rows = [(1, whole, "s"), (2, whole[:-2], "s"), (3, whole[: whole.index("\n")], "s"), (4, None, None)]
    j = truncated(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s")
    assert {r["key"]: r["continued"] for r in j.collect()} == {1: False, 2: True, 3: False, 4: False}
    assert {r["source"]: (r["texts"], r["cut"]) for r in truncation_by_source(j).collect()} == {"s": (3, 1), None: (1, 0)}
    assert truncated(spark.createDataFrame([], "id long, t string, s string"), "id", "t", "s").count() == 0


def test_a_longer_sentence_is_evidence(spark):
    rows = [(1, "First one. The valve of the pump shall be clo", "s"), (2, "Another. The valve of the pump shall be closed.", "s"), (3, "It is open. The valve of the tank shall be", "s"), (4, None, None), (5, "", "s"), (6, "The", "s"), (None, "The valve of the tank shall be here.", "s")]
    df = spark.createDataFrame(rows * 2, "id long, t string, s string")
    assert [r.key for r in longer_sentences(df, "id", "t").collect()] == [1]


def test_equal_texts_of_a_third_of_all_rows_travel_once(spark):
    rows = [(i, "the same text of all, which ends in the mid" if i % 3 == 0 else f"text number {i} which is a longer one") for i in range(3000)] + [(9000, "the same text of all, which ends in the middle.")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("s", F.lit("x"))
    got = truncated(df, "id", "t", "s").where("continued")
    assert {r.key for r in got.collect()} == {i for i in range(0, 3000, 3)}


def test_quotas():
    size, share, cap = {"a": 100, "b": 10, "c": 0}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 1, "b": 3, "c": 9}
    assert quotas(size, share, cap) == {"a": 60.0, "b": 30.0}
    assert quotas(size, share, cap, 120) == {"b": 30.0, "a": 90.0}
    assert quotas(size, share, cap, 1000) == {"a": 100.0, "b": 30.0}
    assert quotas({}, share, cap) == {}


def test_the_tree_is_exact_in_both_margins():
    for shards in (1, 3, 8):
        out = deal([10, 0, 37], shards, np.random.default_rng(1))
        assert out.sum(axis=0).tolist() == [10, 0, 37] and set(out.sum(axis=1)) <= {47 // shards, 47 // shards + 1} and (out >= 0).all()


def test_mix_reaches_its_shares_within_repeats(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b"]), rng.randrange(1, 50)) for i in range(3000)] + [(9000 + i, "tiny", 40) for i in range(20)] + [(9990, None, 5), (9991, "a", 0), (9992, "unlisted", 7)]
    sizes = spark.createDataFrame(rows, "key long, source string, tokens long").withColumn("shard", F.lit("x"))
    targets = spark.createDataFrame([("hot", 0.5, 1), ("a", 0.2, 1), ("b", 0.2, 1), ("tiny", 0.1, 4), ("none", 0.3, 2)], "source string, target_share double, max_repeats int")
    mix = mixed(sizes, targets, blocks=8, shards=4).collect()
    total = sum(r["tokens"] for r in mix)
    by = {s: sum(r["tokens"] for r in mix if r["source"] == s) for s in ("hot", "a", "b", "tiny")}
    assert all(abs(by[s] / total - w) < 0.005 for s, w in (("hot", 0.5), ("a", 0.2), ("b", 0.2), ("tiny", 0.1)))
    uses = [(r["key"], r["copy"]) for r in mix]
    assert len(uses) == len(set(uses)) and max(r["copy"] for r in mix if r["source"] == "tiny") == 3 and {r["copy"] for r in mix if r["source"] != "tiny"} == {0}
    assert {r["shard"] for r in mix} == {0, 1, 2, 3}
    report = {r["source"]: r for r in shares(mixed(sizes, targets, blocks=8), sizes.select("source", "tokens"), targets).collect()}
    assert report["none"]["tokens"] == 0 and abs(report["hot"]["share"] - 0.5) < 0.005 and report["tiny"]["repeats"] == 4
    assert mixed(sizes.limit(0), targets).count() == 0 and mixed(sizes, targets.limit(0)).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "s", "Hello world"), (2, None, None), (3, "s", ""), (4, "s", "a " * 50_000)], "id long, src string, t string")
    assert [(r["key"], r["tokens"]) for r in token_counts(df, "id", "src", "t").orderBy("key").collect()] == [(1, 2), (2, 0), (3, 0), (4, 50_001)]
