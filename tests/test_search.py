import math
import random

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import index, search
from strandline.plans import search as ps


def test_routes(spark):
    want = {
        "AXSS-E-ST-40": ("identifier", "AXSS-E-ST-40", None), "axss-e-st-40c rev.1 clause 4.2": ("identifier", "AXSS-E-ST-40", "4.2"), "AXSS-E-ST-40-05 5.1.2": ("identifier", "AXSS-E-ST-40-05", "5.1.2"),
        "what does AXSS-E-ST-40 say": ("general", None, None), "What does TC stand for?": ("definitional", "TC", None), "define annular ring": ("definitional", "annular ring", None), "what is an annular ring?": ("definitional", "annular ring", None),
        "what is the factor of safety for a tank": ("general", None, None), "": ("general", None, None), None: ("general", None, None), "x" * 5000: ("general", None, None),
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", search.route(F.col("t")).alias("r")).collect()
    assert {r["t"]: tuple(r["r"]) for r in rows} == want


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid string, key string, rank int")


def test_fusion_scores_ties_and_boost(spark):
    a, b = ranked(spark, [("q", "x", 0), ("q", "y", 1)]), ranked(spark, [("q", "y", 0), ("q", "z", 1), ("p", "x", 0)])
    got = search.fuse({"dense": (a, 1.0), "sparse": (b, 1.0)}, 9).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["key"]) for r in got] == [("p", "x"), ("q", "y"), ("q", "x"), ("q", "z")]
    assert abs(got[1]["score"] - (1 / 61 + 1 / 60)) < 1e-9
    up = search.fuse({"dense": (a, 1.0), "sparse": (b, 1.0)}, 1, lambda m: m.withColumn("score", F.col("score") * F.when(F.col("key") == "z", 3.0).otherwise(1.0)))
    assert {(r["qid"], r["key"]) for r in up.collect()} == {("p", "x"), ("q", "z")}
    assert search.fuse({"dense": (a.limit(0), 1.0), "sparse": (b.limit(0), 1.0)}, 9).count() == 0


def test_dedup_keeps_the_first_and_cuts(spark):
    t = ranked(spark, [("q", k, i) for i, k in enumerate("abcd")]).withColumn("label", F.when(F.col("key").isin("a", "c"), None).otherwise(F.col("key")))
    assert [(r["key"], r["place"]) for r in search.dedup_cut(t, ["label"], 2).orderBy("place").collect()] == [("a", 0), ("b", 1)]


def test_sparse_and_idf_equal_brute_force(spark):
    rng = random.Random(4)
    docs = {f"d{i:02}": " ".join(rng.choice(["the", "pump", "valve", "mast", "AXSS-E-ST-10", "x"]) for _ in range(rng.randrange(12))) for i in range(40)}
    qs = {"q1": "the pump", "q2": "mast AXSS-E-ST-10 mast", "q3": "", "q4": "unknown"}
    posts = index.postings(spark.createDataFrame(list(docs.items()), "id string, t string"), "id", "t")
    q = index.postings(spark.createDataFrame(list(qs.items()), "id string, t string"), "id", "t")
    tf = lambda t: {w: [x for x in t.lower().split() if len(x) > 1].count(w) for w in t.lower().split() if len(w) > 1}
    want = set()
    for k, t in qs.items():
        s = sorted(((-sum(n * tf(d).get(w, 0) for w, n in tf(t).items()), i) for i, d in docs.items()))
        want |= {(k, i, -v, r) for r, (v, i) in enumerate(x for x in s if x[0] < 0) if r < 5}
    vectors = index.search_vectors(posts, index.idf(posts))
    for per_pass in (1, 1000):
        got = search.sparse_lists(q.withColumnRenamed("key", "qid"), vectors.repartition(3), 5, {"a": ("tf", "tf"), "b": ("tf", "tf")}, per_pass).collect()
        assert {(r["qid"], r["key"], r["score"], r["rank"]) for r in got if r["list"] == "a"} == want and len(got) == 2 * len(want)
    own = index.term_vectors(spark.createDataFrame([*docs.items(), ("none", None)], "id string, t string").repartition(3), "id", "t")
    table = index.idf_of_vectors(own)
    flat = lambda t: {(r["key"], r["terms"], r["tf"], round(r["w"], 9)) for r in t.select("key", F.explode(F.arrays_zip("terms", "tf", "w")).alias("p")).select("key", "p.*").collect()}
    assert flat(index.unit_vectors(own, table)) == flat(index.unit_vectors(own, table, 1)) == flat(vectors)
    assert index.unit_vectors(own.limit(0), table).count() == 0
    assert search.sparse_lists(q.limit(0).withColumnRenamed("key", "qid"), vectors, 5, {"a": ("tf", "tf")}).count() == 0
    pairs = search.sparse_scores(q.withColumnRenamed("key", "qid"), posts).collect()
    assert {(k, i, v) for k, i, v, _ in want} <= {tuple(r) for r in pairs}
    n = sum(1 for d in docs.values() if tf(d))
    assert all(abs(r["idf"] - math.log(1 + n / r["df"])) < 1e-9 for r in index.idf(posts).collect())
    assert all(abs(r[0] - 1) < 1e-9 for r in index.weighted(posts, index.idf(posts)).groupBy("key").agg(F.sum(F.col("w") * F.col("w"))).select("sum((w * w))").collect())
    v = {r["key"]: r for r in index.sparse_vectors(posts).collect()}
    assert v.keys() == {k for k, d in docs.items() if tf(d)} and all(list(r["indices"]) == sorted(r["indices"]) for r in v.values())


def test_dense_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(-3, 4, (60, 5)).astype(float)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(100, None), (101, []), (102, [1.0, 2.0]), (103, [0.0] * 5), (104, [float(x) for x in m[3]])]
    d = spark.createDataFrame(rows, "key int, vector array<double>").repartition(3)
    got = search.dense_top_k(d.where("key % 7 = 0 or key > 99").withColumnRenamed("key", "qid"), d, 4, per_pass=3)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    live = {k: unit(v) for k, v in rows if v and any(v)}
    want = set()
    for q in [k for k in live if k % 7 == 0 or k > 99]:
        s = sorted((-round(float(live[q] @ v), 9), k) for k, v in live.items() if len(v) == len(live[q]))[:4]
        want |= {(q, k, r) for r, (_, k) in enumerate(s)}
    assert {(r["qid"], r["key"], r["rank"]) for r in got.collect()} == want
    assert search.dense_top_k(d.limit(0).withColumnRenamed("key", "qid"), d, 4).count() == 0


def test_filter_widens_only_without_a_hit(spark):
    docs = spark.createDataFrame([("1", "A", "4.1"), ("2", "A", None), ("3", "B", "4.1"), ("4", None, "4.1")], "key string, doc_code string, clause string")
    q = spark.createDataFrame([("a", "A", "4.1"), ("b", "A", "9"), ("c", "B", None), ("d", "C", "1"), ("e", None, None)], "qid string, a string, b string")
    got = {(r["qid"], r["key"], r["route"]) for r in search.filtered_or_wider(q, docs).collect()}
    assert got == {("a", "1", "identifier"), ("b", "1", "identifier(document)"), ("b", "2", "identifier(document)"), ("c", "3", "identifier")}


def test_rerank_falls_back_whole(spark):
    t = ranked(spark, [("q", "a", 0), ("q", "b", 1), ("p", "a", 0), ("p", "b", 1)])
    s = F.when(F.col("key") == "b", 1.0).when(F.col("qid") == "q", 0.5)
    got = {(r["qid"], r["key"]): (r["rank"], r["rerank"]) for r in search.rerank(t, s).collect()}
    assert got == {("q", "a"): (1, "ok"), ("q", "b"): (0, "ok"), ("p", "a"): (0, "failed: original order"), ("p", "b"): (1, "failed: original order")}


def test_round_robin_and_context(spark):
    t = spark.createDataFrame([("a1", "x"), ("a2", "x"), ("a3", "y"), ("a4", None)], "k string, c string")
    assert [r["k"] for r in search.round_robin(t, "k", "c", 3).collect()] == ["a4", "a1", "a3"]
    c = ranked(spark, [("q", "a", 0), ("q", "b", 1)]).withColumn("place", F.col("rank"))
    assert search.context(c, F.upper("key"), F.col("key")).collect()[0][1] == "[A]\na\n---\n[B]\nb"


def test_ledger(spark):
    led = spark.createDataFrame([("c", "same", "1"), ("c", "changed", "1"), ("c", "gone", "1"), ("c", "unknown", None)], "collection string, path string, sha256 string")
    now = spark.createDataFrame([("c", "same", "1"), ("c", "changed", "2"), ("c", "new", "1"), ("d", "same", "1"), ("c", "unknown", None)], "collection string, path string, sha256 string")
    plan = {(r["collection"], r["path"]): r["action"] for r in index.load_plan(now, led).collect()}
    assert plan == {("c", "same"): "skip", ("c", "changed"): "update", ("c", "gone"): "remove", ("c", "new"): "ingest", ("d", "same"): "ingest", ("c", "unknown"): "update"}
    assert {r["action"] for r in index.load_plan(now, led, force=True).collect()} == {"update", "remove", "ingest"}


def test_content_ids_survive_a_move(spark):
    a = spark.createDataFrame([("s", "x", 1), ("s", "y", 2), ("s", "x", 3)], "src string, b string, p int")
    b = spark.createDataFrame([("s", "new", 0), ("s", "x", 11), ("s", "x", 13), ("s", "y", 20)], "src string, b string, p int")
    ids = lambda t: {(r["b"], r["content_id"]) for r in index.content_ids(t, "src", "b", ["p"]).collect()}
    assert ids(a) < ids(b) and len(ids(b)) == 4


def test_each_route_of_retrieval(spark):
    docs = spark.createDataFrame([("1", "AXSS-E-ST-10", "4.1", "text"), ("2", "AXSS-E-ST-10", "4.2", "text"), ("3", "AXSS-E-ST-20", "3.1", "definition"), ("4", "AXSS-E-ST-20", "5", "text")], "key string, doc_code string, clause string, element_type string")
    q = spark.createDataFrame([("id", "axss-e-st-10 4.2"), ("wide", "AXSS-E-ST-10 9.9"), ("def", "what is a pump?"), ("gen", "how long is a pump kept under load")], "qid string, text string")
    asked = []

    def lists(table, n):
        asked.append(n)
        seen = {r["qid"]: r["text"] for r in table.collect()}
        assert seen["def"] == "pump" and seen["gen"].startswith("how long")
        rows = [(i, k, r) for i in seen for r, k in enumerate("4312")]
        dense = spark.createDataFrame([(i, k, 1.0 - r / 10, r) for i, k, r in rows], "qid string, key string, score double, rank int")
        return {"dense": dense, "sparse": dense}

    got = {}
    for r in search.retrieve(q, lists, docs, 3).orderBy("qid", "rank").collect():
        got.setdefault((r["qid"], r["route"]), []).append(r["key"])
    assert asked == [6]
    # the definition overtakes only where a definition is asked for
    assert got == {("id", "identifier"): ["2"], ("wide", "identifier(document)"): ["1", "2"], ("def", "definitional"): ["3", "4", "1"], ("gen", "general"): ["4", "3", "1"]}


def test_best_rows_of_a_task_with_ties_equal_a_full_sort():
    rng = np.random.default_rng(3)
    best, score = search._Best(7, 5), rng.integers(0, 4, (7, 400)).astype(float)
    score[rng.random(score.shape) < 0.3] = -np.inf
    score[6] = -np.inf
    keys = np.array([f"k{i:03}" for i in rng.permutation(400)], object)
    for a in range(0, 400, 23):
        best.add(score[:, a : a + 23], keys[a : a + 23])
        if a % 46 == 0:
            best.cut()
    q, s, k = best.cut()
    want = [(i, -v, x) for i in range(7) for v, x in sorted((-v, x) for v, x in zip(score[i], keys) if v > -np.inf)[:5]]
    assert list(zip(q.tolist(), s.tolist(), k.tolist())) == want


def test_a_document_with_more_rows_than_the_lists_hold(spark):
    # twenty rows of the asked document, fifty others that are nearer to the question
    rows = [(f"x{i:02}", "AXSS-E-ST-10", "1", "AXSS-E-ST-10 " + "filler word " * (40 - i)) for i in range(20)] + [(f"o{i:02}", "AXSS-E-ST-20", "1", "AXSS-E-ST-10") for i in range(50)]
    t = spark.createDataFrame(rows, "key string, doc_code string, clause string, body string")
    q = spark.createDataFrame([("q", "axss-e-st-10")], "qid string, text string")
    got = ps.routed(ps.SearchIndex.of(index.postings(t, "key", "body")), q, t.withColumn("element_type", F.lit("text")), 5).orderBy("rank").collect()
    assert [r["key"] for r in got] == ["x19", "x18", "x17", "x16", "x15"] and all(r["score"] > 0 for r in got)


def test_identifier_queries_rank_all_their_rows(spark):
    # the other document's rows name the code most densely and fill the list of the whole corpus
    rng = random.Random(7)
    word = lambda n: " ".join(rng.choice(["pump", "valve", "mast", "seal"]) for _ in range(n))
    rows = [(f"o{i:02}", "AXSS-E-ST-20", "1", "AXSS-E-ST-10") for i in range(12)]
    rows += [(f"a{i}", "AXSS-E-ST-10", "4.1" if i < 6 else "4.2", f"{word(9 - i)} AXSS-E-ST-10") for i in range(9)] + [("a9", "AXSS-E-ST-10", "4.1", "pump")]
    t = spark.createDataFrame(rows, "key string, doc_code string, clause string, body string")
    texts = {"code": "axss-e-st-10", "clause": "AXSS-E-ST-10 4.1", "general": "where is a mast with a pump"}
    q = spark.createDataFrame(list(texts.items()), "qid string, text string")
    posts = index.postings(t, "key", "body")
    got = {}
    for r in ps.routed(ps.SearchIndex.of(posts), q, t.withColumn("element_type", F.lit("text")), 4).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["key"], r["score"], r["route"]))
    tf = {}
    for r in posts.collect():
        tf.setdefault(r["key"], {})[r["term"]] = r["tf"]
    idf = {w: math.log(1 + len(tf) / sum(w in x for x in tf.values())) for x in tf.values() for w in x}

    def unit(counts):
        w = {k: n * idf[k] for k, n in counts.items() if k in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {k: x / size for k, x in w.items()}

    for qid, own in (("code", [r[0] for r in rows if r[1] == "AXSS-E-ST-10"]), ("clause", [r[0] for r in rows if r[1:3] == ("AXSS-E-ST-10", "4.1")])):
        asked = unit({"axss-e-st-10": 1})
        want = sorted((-round(sum(v * unit(tf[k]).get(w, 0.0) for w, v in asked.items()), 9), k) for k in own)[:4]
        assert [(k, -s) for s, k in want] == [(k, s) for k, s, _ in got[qid]] and {r for *_, r in got[qid]} == {"identifier"}
    assert [k for k, *_ in got["code"]] == ["a8", "a7", "a6", "a5"] and len(got["general"]) == 4
