import hashlib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline import runtime
from strandline.operators import contract, graph, measure, score
from strandline.plans import measure as measure_plans
from strandline.plans import registry
from strandline.plans import score as plans

FRAME = "anchor_id string, claims array<struct<id string, tier string, text string, evidence array<struct<anchor string, span string>>>>, _anchor struct<spans array<struct<doc_code string, clause string, text string, point_id string, role string>>>"


def test_bands_and_causes(spark):
    t = spark.createDataFrame([(0.05, 1), (0.2, 10), (0.5, None), (0.51, 9), (None, None)], "f double, s int").select(measure.band(F.col("f")), measure.cause(F.col("s")))
    assert [tuple(r) for r in t.collect()] == [("specific", "large-clause"), ("loose", "sticky-label"), ("degenerate", "unknown"), ("free", "large-clause"), (None, "unknown")]


def test_specificity_names_what_it_cannot_measure(spark):
    chunks = spark.createDataFrame([("A", "1", f"s{i}") for i in range(12)] + [(" A", "2", "x"), (None, None, None)], "doc_code string, clause string, section string")
    spans = spark.createDataFrame([("i", "A", "1"), ("i", "A", "9"), ("j", "B", "1")], "anchor_id string, doc string, clause string")
    t = measure.specificity(spans, measure.label_counts(chunks))
    assert {(r["doc"], r["clause"]): (r["n"], r["of"], r["band"], r["cause"]) for r in t.collect()} == {("A", "1"): (12, 13, "free", "sticky-label"), ("A", "9"): (0, 13, "specific", "unknown"), ("B", "1"): (None, None, None, None)}
    assert {r["band"]: (r["spans"], r["sticky"]) for r in measure.band_counts(t).collect()} == {"specific": (1, 0), "loose": (0, 0), "degenerate": (0, 0), "free": (1, 1), "unmeasurable": (1, 0)}


def test_coverage_asks_pages_only_where_there_can_be_one(spark):
    cols = "doc_code string, document_revision string, crumb string, clause string, page_number int, modals array<string>, element_type string, refs array<string>, req_ids array<string>"
    rows = [("A", "C", "x", "1", None, [], "definition", [], []), ("B", "", "x", "1", 0, [], "text", None, None), ("D", "C", "", None, None, None, "text", [], [])]
    got = {r["doc"]: r for r in measure.label_coverage(spark.createDataFrame(rows, cols).withColumn("severity", F.lit(9))).collect()}
    assert got["A"]["page_number"] is None and got["A"]["verdict"] == "ok" and got["B"]["page_number"] == 1.0 and got["B"]["verdict"] == "PROFILE MISMATCH"
    assert got["D"]["generic_breaches"] == ["clause", "crumb", "page_number"] and got["D"]["verdict"] == "PARSE PROBLEM"


def test_recall_gains_and_losses(spark):
    need = spark.createDataFrame([("i", "A", "1"), ("i", "A", "2"), ("j", "B", "1")], "anchor_id string, doc string, clause string")
    ctx = spark.createDataFrame([("a", "i", "A", "1"), ("a", "i", "A", "1"), ("b", "i", "A", "2"), ("b", "j", "B", "1"), ("b", "i", "A", "1"), ("a", "j", "X", "")], "config string, anchor_id string, doc string, clause string")
    hits = measure.reached(need, ctx)
    assert {r["config"]: tuple(r)[1:] for r in measure.recall(hits).collect()} == {"a": (1, 3, 0, 1, 2), "b": (3, 3, 2, 0, 2)}
    assert {tuple(r) for r in measure.gains_losses(hits, "a").collect()} == {("b", "gain", "i", "A", "2"), ("b", "gain", "j", "B", "1")}
    assert {tuple(r) for r in measure.gains_losses(hits, "b").collect()} == {("a", "loss", "i", "A", "2"), ("a", "loss", "j", "B", "1")}


def test_rank_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "c", 2)], "qid string, key string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "z"), ("p", "a")], "qid string, key string")
    got = {r["qid"]: tuple(r)[1:] for r in measure.rank_metrics(ranked, rel, 3).collect()}
    ndcg = round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6)
    assert got == {"q": (0.5, round(1 / 3, 6), 0.5, ndcg), "p": (0.0, 0.0, 0.0, 0.0)}


def test_migration_states(spark):
    body = "one two three four five six seven eight nine ten"
    chunks = spark.createDataFrame([("1", "A", "1", f"X {body}\n y"), ("2", "A", "2", "short Words here"), ("3", "A", "3", "short words HERE too"), ("4", "N", "7", "moved words of the old document stand here now"), ("5", "A", "1", None)], "id string, doc string, clause string, text string")
    ev = lambda *x: [{"anchor": a, "span": s} for a, s in x]
    item = ("i", [{"id": "c", "tier": "required", "text": "t", "evidence": ev(("A 1", body[4:40].upper()), ("A  9", "two  three\tfour five six seven eight nine"), ("A 2", "short words"), ("A 2", ""), (None, "x"), ("O 7", "words of the old document stand here"), ("A 1", "none of it is there at all in any text"))}],
            {"spans": [{"doc_code": "A", "clause": "5", "text": "short words here too", "point_id": "p", "role": "primary"}]})
    frame = spark.createDataFrame([item, ("n", None, None), ("e", [], {"spans": []})], FRAME)
    alias = measure.doc_aliases(spark.createDataFrame([("f", "O"), ("g", "A")], "source_file string, doc_code string"), spark.createDataFrame([("f", "N"), ("g", "A")], "source_file string, doc_code string"))
    dec = measure.decide(measure.frame_refs(frame), chunks, alias)
    got = {(r["field"], r["ref"]): (r["state"], r["new"]) for r in dec.collect()}
    assert got == {
        ("evidence", 0): ("unchanged", "1"), ("evidence", 1): ("RELABELLED", "1"), ("evidence", 2): ("AMBIGUOUS", "2"), ("evidence", 3): ("UNRESOLVED", "2"), ("evidence", 4): ("UNRESOLVED", ""),
        ("evidence", 5): ("RELABELLED", "7"), ("evidence", 6): ("UNRESOLVED", "1"), ("spans", 0): ("RELABELLED", "3"),
    }
    out = {r["anchor_id"]: r for r in measure.migrate(frame, dec).collect()}
    e = out["i"]["claims"][0]["evidence"]
    assert (e[1]["anchor"], e[1]["anchor_before"]) == ("A 1", "A  9") and (e[0]["anchor"], e[0]["anchor_before"]) == ("A 1", None) and e[5]["anchor"] == "N 7"
    s = out["i"]["_anchor"]["spans"][0]
    assert (s["clause"], s["clause_before"], s["point_id_stale"]) == ("3", "5", "p") and out["n"]["claims"] is None and out["e"]["claims"] == []


def test_resolution_equals_brute_force(spark):
    rng = random.Random(9)
    words = ["pump", "valve", "the", "of", "Mast"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    chunks = [(str(i), rng.choice(["A", "A", "B"]), rng.choice("123"), text(60)) for i in range(60)]
    refs = []
    for i in range(120):
        c = rng.choice(chunks)[3]
        a = rng.randrange(len(c) - 3)
        refs.append((f"i{i}", "spans", -1, 0, rng.choice("AB"), "1", c[a : a + rng.choice([3, 12, 40, 90, 400])].replace(" ", "  ")))
    schema = "anchor_id string, field string, claim int, ref int, doc string, clause string, span string"
    got = measure.resolve(spark.createDataFrame(refs, schema), spark.createDataFrame(chunks, "id string, doc string, clause string, text string"))
    norm = lambda s: " ".join(s.lower().split())
    want = {r[0]: sorted({c[2] for c in chunks if c[1] == r[4] and norm(r[6]) and norm(r[6]) in norm(c[3])}) for r in refs}
    assert {r["anchor_id"]: list(r["labels"]) for r in got.collect()} == want


def test_resolution_of_a_hot_document_in_parts(spark, monkeypatch):
    monkeypatch.setattr(runtime, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(measure, "LETTERS", 500)
    rng = random.Random(4)
    words = ["pump", "valve", "the", "of", "Mast", "Über", "a-b"]
    chunks = [(str(i), rng.choice(["A"] * 9 + ["B"]), rng.choice("123"), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 30])))) for i in range(200)]
    texts = [" ".join(c[3].lower().split()) for c in chunks]
    spans = [t[a : a + rng.choice([1, 4, 9, 14, 20, 40])].strip() for t in texts if t for a in [rng.randrange(len(t))]]
    refs = [(str(i), rng.choice("AABC"), s) for i, s in enumerate([*spans, "pump pump pump of the nowhere"])]
    got = measure.resolve(spark.createDataFrame(refs, "ref string, doc string, span string"), spark.createDataFrame(chunks, "id string, doc string, clause string, text string"))
    want = {}
    for ref, doc, span in refs:
        hit = [c[2] for c, t in zip(chunks, texts) if span and c[1] == doc and span in t]
        want[ref] = sorted(set(hit)), len(hit)
    assert {r["ref"]: (list(r["labels"]), r["n_chunks"]) for r in got.collect()} == want


def _shuffled(spark, run):
    """Bytes that ``run`` shuffles where nothing is broadcast by size."""
    sc = spark.sparkContext._jsc.sc()

    def now():
        sc.listenerBus().waitUntilEmpty()
        time.sleep(0.3)
        spark.range(1).collect()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = now()
        run()
        return now() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def _wordy(n, docs):
    """Chunks of random words and their letters."""
    rng = random.Random(2)
    rows = [(f"id{i}", f"AXSS-E-HB-{i % docs}", str(i % 5), " ".join(f"{rng.randrange(10**6):x}" for _ in range(300)), f"f{i % docs}") for i in range(n)]
    return rows, sum(len(r[3]) for r in rows)


def test_resolution_shuffles_texts_once_and_no_digests(spark):
    rows, letters = _wordy(400, 7)
    chunks = spark.createDataFrame([r[:4] for r in rows], "id string, doc string, clause string, text string")
    refs = spark.createDataFrame([(r[1], r[3][20:90]) for r in rows], "doc string, span string")
    assert 0 < _shuffled(spark, lambda: measure.resolve(refs, chunks).write.format("noop").mode("overwrite").save()) < 1.5 * letters


def test_decisions_of_a_migration_are_kept_without_spans_and_labels(spark, sf):
    registry.QUERIES["migrated_frame"](spark, sf).collect()
    kept = spark.read.parquet(next(p for p in reversed(runtime._written) if "/decisions-" in p))
    assert not {"span", "labels"} & set(kept.columns) and [r[0] for r in kept.select("state").distinct().collect()] == ["RELABELLED"]


def test_alias_decisions_shuffle_texts_once(spark, tmp_path):
    rows, letters = _wordy(400, 7)
    # repeated rows count once, so a span still has one label
    spark.createDataFrame(rows + rows[:9], "id string, doc_code string, clause string, text string, source_file string").write.parquet(str(tmp_path / "chunk_index.parquet"))
    frame = [(r[0], [], {"spans": [{"doc_code": r[1], "clause": r[2], "text": r[3][20:90], "point_id": "p", "role": "primary"}]}) for r in rows]
    spark.createDataFrame(frame, FRAME).write.parquet(str(tmp_path / "frame_items.parquet"))
    got = []
    sent = _shuffled(spark, lambda: got.extend(registry.QUERIES["alias_decisions"](spark, str(tmp_path)).collect()))
    assert len(got) == 400 and {r["state"] for r in got} == {"RELABELLED"} and sent < 1.5 * letters


def test_alias_decisions_shuffle_spans_to_their_texts_only(spark, tmp_path, monkeypatch):
    rows, letters = _wordy(400, 7)
    spark.createDataFrame([*rows, (None, None, None, None, None)], "id string, doc_code string, clause string, text string, source_file string").write.parquet(str(tmp_path / "chunk_index.parquet"))
    frame = [(r[0], [], {"spans": [{"doc_code": r[1], "clause": r[2], "text": r[3][20:-20], "point_id": "p", "role": "primary"}]}) for r in rows]
    # items that repeat count once, one without an id too
    frame += [*frame[:9], (None, *frame[0][1:]), (None, *frame[0][1:])]
    spark.createDataFrame(frame, FRAME).write.parquet(str(tmp_path / "frame_items.parquet"))
    ask = lambda: registry.QUERIES["alias_decisions"](spark, str(tmp_path)).collect()
    got = []
    sent = _shuffled(spark, lambda: got.extend(ask()))
    assert len(got) == 401 and {r["state"] for r in got} == {"RELABELLED"} and sent < 4 * letters
    monkeypatch.setattr(measure_plans, "REPEATED_IDS", 0)
    assert sorted(map(repr, ask())) == sorted(map(repr, got))


V = "item string, class string, tier string, verdict boolean"


def test_null_verdicts_are_never_no(spark):
    v = spark.createDataFrame([("a", "x", "required", True), ("a", "x", "required", False), ("a", "x", "optional", None), ("b", "x", "required", None), ("b", "x", "required", True), ("c", "y", "required", True)], V)
    assert {r["item"]: (r["coverage"], r["all_required"]) for r in score.item_coverage(v).collect()} == {"a": (0.5, False), "b": (None, None), "c": (1.0, True)}
    assert {r["item"]: (r["n"], r["coverage"]) for r in score.mean_of_known(v, ["item"]).collect()} == {"a": (2, 0.5), "b": (1, 1.0), "c": (1, 1.0)}


def test_macro_floor_and_weights(spark):
    rows = [(f"x{i}", "x", 1.0, True) for i in range(3)] + [(f"y{i}", "y", 0.5, False) for i in range(4)] + [("z", "z", 0.0, False), ("n", "x", None, None)]
    items = spark.createDataFrame(rows, "item string, class string, coverage double, all_required boolean")
    c = score.class_means(items)
    assert {r["class"]: (r["n"], r["scored"]) for r in c.collect()} == {"x": (3, True), "y": (4, True), "z": (1, False)}
    w = spark.createDataFrame([("x", 3), ("y", 1), ("q", 9)], "class string, weight int")
    assert tuple(score.macro(c, w).collect()[0]) == (2, 0.75, 0.875, 0.5)
    assert score.macro(c, w.where("class = 'q'")).collect()[0]["weighted"] is None and score.macro(c.limit(0)).collect()[0]["macro"] is None


def test_bootstrap_properties(spark):
    const = spark.createDataFrame([(f"i{i}", "x", 0.7) for i in range(5)], "item string, class string, v double")
    assert tuple(score.bootstrap(const, "class", "v", 100).collect()[0]) == (0.7, 0.7, 100)
    rng = random.Random(1)
    mixed = spark.createDataFrame([(f"i{i}", rng.choice("xy"), rng.random()) for i in range(40)] + [("n", "x", None)], "item string, class string, v double")
    a, b = (score.bootstrap(mixed.repartition(k), "class", "v", 200).collect() for k in (1, 5))
    assert a == b and 0.3 < a[0]["lo"] < a[0]["hi"] < 0.7
    assert score.bootstrap(mixed.limit(0), "class", "v", 10).count() == 0
    items = spark.createDataFrame([(f"i{i}", "x" if i < 20 else "y", 1.0, True) for i in range(39)], "item string, class string, coverage double, all_required boolean")
    assert {r["class"]: (r["lo"], r["withheld"]) for r in score.class_blocks(items, 50).collect()} == {"x": (1.0, None), "y": (None, "n=19 < 20")}


@pytest.mark.parametrize("pos,hit,want", [(400, 380, "ACCEPTED"), (399, 399, "SMOKE"), (400, 300, "NOT ACCEPTED")])
def test_judge_ladder(spark, pos, hit, want):
    rows = [("reviewer", True, i < hit, False) for i in range(pos)] + [("reviewer", False, False, False)] * 10 + [("constructed", False, False, True)] * 300
    t = spark.createDataFrame(rows, "kind string, label boolean, judge boolean, matcher boolean")
    assert score.judge_validation(t).collect()[0]["verdict"] == want
    assert score.judge_validation(t, limited=True).collect()[0]["verdict"] == "SMOKE"
    if want == "ACCEPTED":
        assert score.judge_validation(t.union(spark.createDataFrame([("reviewer", True, None, True)], t.schema))).collect()[0]["verdict"] == "NOT ACCEPTED"


def test_arms(spark):
    run = lambda *rows: score.arm_verdict(spark.createDataFrame(rows, "arm string, coverage double")).collect()[0]["verdict"]
    assert run(("text_control", 0.59), ("figure_only", 0.1)).startswith("inconclusive: controls")
    assert run(("text_control", 0.9), ("figure_only", None)).startswith("inconclusive: no figure")
    assert run(("text_control", 0.9), ("figure_only", 0.1)) == "gap confirmed" and run(("text_control", 0.7), ("figure_only", 0.7)) == "prediction did not hold"


def test_statistics(spark):
    t = spark.createDataFrame([(3, 1), (0, 0), (10, 0), (600, 500)], "a long, b long").select(score.sign_test(F.col("a"), F.col("b")))
    exact = lambda a, b: min(1.0, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b)) if a + b else 1.0
    assert [r[0] for r in t.collect()] == [round(exact(*x), 6) for x in [(3, 1), (0, 0), (10, 0), (600, 500)]]
    lo, hi = score.wilson(F.col("a"), F.col("b"))
    shares = [(27, 40), (0, 10), (10, 10)]
    for (k, n), (x, y) in zip(shares, spark.createDataFrame(shares, "a long, b long").select(lo, hi).collect()):
        # both ends are where the share lies 1.96 standard deviations away
        assert x <= k / n <= y and all(abs((k / n - e) ** 2 - 1.959963984540054**2 * e * (1 - e) / n) < 1e-5 for e in (x, y))
    assert tuple(spark.createDataFrame([(0, 0)], "a long, b long").select(lo, hi).collect()[0]) == (None, None)
    s = spark.range(2000).select(score.split_of(F.col("id"), {"a": 0.5, "b": 0.3, "c": 0.2}).alias("s")).groupBy("s").count()
    n = {r["s"]: r["count"] for r in s.collect()}
    assert abs(n["a"] - 1000) < 100 and abs(n["b"] - 600) < 90 and abs(n["c"] - 400) < 80


def test_negatives_are_of_other_items(spark):
    claims = spark.createDataFrame([(f"i{i % 30}", i) for i in range(120)], "item string, claim int")
    got = score.constructed_negatives(claims.select("item").distinct(), claims, buckets=4).collect()
    assert all(r["item"] != r["of"] for r in got) and {sum(1 for r in got if r["item"] == f"i{k}") for k in range(30)} == {3} and len({(r["item"], r["of"], r["claim"]) for r in got}) == 90


def test_negatives_are_as_many_as_there_are(spark):
    claims = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 3), (None, 4), ("c", None)], "item string, claim int")
    answers = spark.createDataFrame([("a",), ("b",), ("z",), ("z",), (None,)], "item string")
    got = [tuple(r) for r in score.constructed_negatives(answers, claims, buckets=3).collect()]
    assert sorted(got) == [("a", "b", 3), ("b", "a", 1), ("b", "a", 2), ("z", "a", 1), ("z", "a", 2), ("z", "b", 3)]
    assert score.constructed_negatives(answers, claims.limit(0)).count() == 0


def test_closure_with_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    reached = graph.closure(spark.createDataFrame([("a",), (None,)], "doc string"), links)
    assert {(r["doc"], r["step"]) for r in reached.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(15)], "src string, dst string")
    assert graph.closure(spark.createDataFrame([("0",)], "doc string"), chain).agg(F.max("step")).first()[0] == 15
    d = graph.dangling(links, spark.createDataFrame([("b",), ("c",), ("a",)], "doc string"))
    assert {r["src"]: r["colour"] for r in d.collect()} == {"a": "GREEN", "b": "GREEN", "c": "RED", "x": "RED"}


def test_collisions_and_fidelity(spark):
    a = spark.createDataFrame([("1", "TC", "tele command"), ("2", "TC", "Tele Command"), ("3", "TC", "test case"), ("1", "TM", "tele metry"), ("2", "TM", "tele data")], "doc string, short string, expansion string")
    assert [tuple(r) for r in graph.acronym_collisions(a).collect()] == [("TC", 3, 2, "tele command", "test case")]
    rng = random.Random(2)
    rows = [(f"d{i}", f"S{i % 25}", " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 5)))) for i in range(90)] + [("d", "S0", None), ("d", "S1", " ")]
    got = {r["short"] for r in graph.acronym_collisions(spark.createDataFrame(rows, "doc string, short string, expansion string")).collect()}
    sets = {}
    for _, k, e in rows:
        if e and e.strip():
            sets.setdefault(k, set()).add(frozenset(e.split()))
    assert got == {k for k, v in sets.items() if any(not a & b for a in v for b in v)} != set()
    m = spark.createDataFrame([(["shall", "may"], ["shall"]), (None, ["can"]), ([], [])], "source_modals array<string>, answer_modals array<string>")
    assert [(r["lost"], r["added"], r["faithful"]) for r in graph.modal_fidelity(m).collect()] == [(["may"], [], False), ([], ["can"], False), ([], [], True)]


def test_contract_names_each_problem(spark):
    schema = "answer string, status string, confidence double, error string, sources array<struct<doc string, clause string>>, ranked array<struct<point_id string>>"
    good, src, rk = "supported_answer", [("d", "1")], [("p",)]
    rows = [("a", good, 0.0, None, src, rk), ("a", "odd", 1.7, None, src, rk), (None, None, None, "timeout", None, None), ("a", good, None, None, src * 2, rk), (None, good, None, "", [("d", None)], [(None,)])]
    t = spark.createDataFrame(rows, schema)
    got = [r[0] for r in t.select(contract.problems(t)).collect()]
    assert got == [[], ["status is not permitted", "confidence is not in 0..1"], [], ["ranked is shorter than sources"], ["missing required field: answer", "every source needs clause", "every ranked entry needs point_id"]]
    assert contract.problems(t.drop("ranked")) is not None and "model" in contract.normalised(t).columns
    contract.register("p", lambda q: q)
    assert contract.pipeline("p")("x") == "x"
    with pytest.raises(KeyError, match="no pipeline"):
        contract.pipeline("q")


def test_truncated_claims(spark):
    texts = ["The supplier shall record the test in the log before the final review", "Short one at once", "Pumps in the loop and valves in the rack of the big hall", "The unit shall be tested in interaction with the other unit in", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(contract.truncate_claim(F.col("t"))).collect()]
    assert tuple(got[0]) == ("The supplier shall record the test in the log", "before the final review") and got[1:3] == [None, None] and tuple(got[3]) == ("The unit shall be tested in interaction", "with the other unit in") and got[4:] == [None, None]


def _u(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def _mixed(base, n):
    """The n-th 32-bit number of a stream, by the definition."""
    x = (base + n * 2654435769) % 2**32
    for shift, by in ((16, 2246822507), (13, 3266489909)):
        x = (x ^ (x >> shift)) * by % 2**32
    return x ^ (x >> 16)


def _replicates(values, n):
    """class -> means by replicate, drawn one by one; values: class -> its values."""
    out = {}
    for c, v in values.items():
        v = sorted(v)
        out[c] = [sum(v[len(v) * _mixed(int(_u(42, c, r) * 2**32), s) >> 32] for s in range(len(v))) / len(v) for r in range(n)]
    return out


def _ends(means):
    a = sorted(round(m, 9) for m in means)
    return round(a[int(0.025 * len(a))], 6), round(a[int(0.975 * len(a)) - 1], 6), len(a)


def test_full_replicates_equal_brute_force(spark, sf):
    items = [r for r in plans.item_coverage(spark, sf).orderBy("item").collect() if r["coverage"] is not None]
    values, differences = {}, {}
    for r in items:
        values.setdefault(r["class"], []).append(r["coverage"])
        differences.setdefault(r["class"], []).append((0.0 if _u("pair", r["item"]) < 0.2 else r["coverage"]) - r["coverage"])
    means = _replicates(values, 10_000)
    close = lambda got, want: all(abs(a - b) < 2e-6 for a, b in zip(got, want, strict=True))
    run = lambda name: registry.QUERIES[name](spark, sf).collect()
    assert close(run("bootstrap_macro")[0], _ends([sum(m) / len(m) for m in zip(*means.values())]))
    weighted = {c: m for c, m in means.items() if c in plans.WEIGHTS}
    total = sum(plans.WEIGHTS[c] for c in weighted)
    assert close(run("bootstrap_weighted")[0], _ends([sum(plans.WEIGHTS[c] * x for c, x in zip(weighted, m)) / total for m in zip(*weighted.values())]))
    paired = _replicates(differences, 1_000)
    assert close(run("paired_bootstrap")[0], _ends([sum(m) / len(m) for m in zip(*paired.values())]))
    assert {r["class"] for r in run("class_blocks")} == set(values)


def test_class_intervals_have_full_replicates(spark, monkeypatch):
    rows = [(f"i{i:02}", c, ((i * 7) % 5) / 4) for c in ("x", "y") for i in range(20)]
    items = spark.createDataFrame(rows, "item string, class string, coverage double").withColumn("all_required", F.col("coverage") == 1.0)
    monkeypatch.setattr(plans, "item_coverage", lambda *_: items)
    means = _replicates({c: [v for _, k, v in rows if k == c] for c in ("x", "y")}, 10_000)
    got = {r["class"]: (r["lo"], r["hi"]) for r in registry.QUERIES["class_blocks"](spark, "").collect()}
    assert {c: _ends(m)[:2] for c, m in means.items()} == got


def test_full_power_equals_brute_force(spark, sf):
    r = registry.QUERIES["sample_power"](spark, sf).collect()[0]
    n, over = r["n"], 0
    for k in range(1_000):
        u = lambda i: _mixed(int(_u(42, k) * 2**32), i) / 2**32  # noqa: B023, E731
        runs = [(u(2 * i) < r["base"], u(2 * i + 1) < r["base"] + r["gain"]) for i in range(n)]
        up, down = sum(b and not a for a, b in runs), sum(a and not b for a, b in runs)
        over += (up - down) / max(up + down, 1) ** 0.5 > 1.959963984540054
    assert r["power"] == round(over / 1_000, 6)
