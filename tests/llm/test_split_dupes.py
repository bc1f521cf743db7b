import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import dupes
from strandline.llm.dupes import copies, duplicate_groups
from strandline.llm.split import CUTS, boundaries, pieces, split_oversized


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n!?1", max_size=400), st.integers(5, 60))
def test_pieces_cover_the_text_within_the_limit(s, limit):
    overlap = limit // 5
    found = pieces(s, limit, overlap)
    assert all(e - o <= limit and e - a <= limit - overlap and a - o <= overlap for o, a, e, _ in found)
    kept = {i for _, a, e, _ in found for i in range(a, e)}
    assert all(s[i].isspace() for i in range(len(s)) if i not in kept)
    assert sum(e - a for _, a, e, _ in found) == len(kept) and [f[1] for f in found] == sorted(f[1] for f in found)


def test_strongest_boundary_near_the_middle():
    unit = "a. " + "word " * 300 + "end.\n"
    assert {c for *_, c in pieces(unit * 4)} == {"structural", "end"}
    assert {c for *_, c in pieces(("word " * 300 + "\n") * 4)} == {"paragraph", "end"}
    assert {c for *_, c in pieces("word and. " * 800)} == {"sentence", "end"}
    assert {c for *_, c in pieces("x" * 9000)} == {"hard_max", "end"}
    assert len(pieces("x" * 6800)) == 2 and pieces("") == []


def test_a_boundary_far_from_the_middle_is_not_near():
    found = pieces("intro\n1.1 unit " + "w " * 9000)
    assert min(e - a for _, a, e, _ in found) > 1700 and {c for *_, c in found} == {"hard_max", "end"}
    # units that fit are enough, however they lie
    text = "x" * 100 + "\n" + "a. " + "y " * 1600 + "\n" + "b. " + "z. " * 1000
    assert {c for *_, c in pieces(text)} == {"structural", "end"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a. unit\n", "1.2 text ", "word. ", "word ", "\n", "xxxxxxxxxxxxxxxxxx"]), max_size=60), st.integers(12, 60))
def test_the_weakest_cut_is_the_one_the_text_needs(parts, limit):
    s, core = "".join(parts), limit - limit // 5
    found = [c for *_, c in pieces(s, limit, limit // 5)]
    if len(found) > 1:
        fits = [k for k, p in enumerate(boundaries(s)) if all(len(s[x:y].strip()) <= core for x, y in zip([0, *p], [*p, len(s)]))]
        assert max(CUTS.index(c) for c in found if c != "end") == (min(fits) if fits else 3)


def test_only_oversized_texts_come_out(spark):
    rows = [("a", "x" * 3600), ("b", "x" * 3601), ("c", None), ("d", ""), ("e", "q. " * 200_000)]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("key", F.lit(0)).withColumn("cut", F.lit("?"))
    got = split_oversized(df, "id", "text")
    assert {(r["key"], r["record_cut"]) for r in got.collect()} == {("b", "hard_max"), ("e", "sentence")}
    assert got.where("length(text) > 3600").count() == 0 and split_oversized(df.limit(0), "id", "text").count() == 0


def key_of(text, crumb):
    body = [x for i, x in enumerate((text or "").split("\n"))]
    at = next((i for i, x in enumerate(body) if x.strip().lower().startswith("section:")), None)
    if at is not None:
        del body[at]
    norm = lambda s: "".join(c.upper().lower() if len(c.upper()) == 1 else c for c in s if c.isalnum())
    return norm("\n".join(body)), tuple(sorted(p for p in map(norm, (crumb or "").split("|")) if p))


def test_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ["SECTION: q\nAbc def", "ABC, def\nsection: other", "abc d ef 1", "abc def1", None, "", "SECTION: only", "x" * 50_000, "Abc-Def", "straße", "STRASSE"]
    crumbs = ["a | B", "b|A", "a|b|", None, "", "|", "b | a | a"]
    rows = [(f"k{i:03}", rng.choice(texts), rng.choice(crumbs)) for i in range(200)] + [(None, "abc def", "a")]
    rows += rows[:20]
    want = {}
    for k, t, c in rows:
        if k:
            want.setdefault(key_of(t, c), set()).add(k)
    want = {(min(v), k) for v in want.values() if len(v) > 1 for k in v}
    df = spark.createDataFrame(rows, "id string, text string, crumb string").withColumn("root", F.lit(1)).withColumn("key", F.lit(2)).repartition(3)
    groups = duplicate_groups(df, "id", "text", "crumb")
    assert {(r["keep"], r["key"]) for r in groups.collect()} == want
    assert sum(r["copies"] for r in copies(groups).collect()) == len(want)
    assert duplicate_groups(df.limit(0), "id", "text", "crumb").count() == 0


def test_a_digest_that_stands_for_two_records(spark, monkeypatch):
    rows = [(f"k{i}", "abc" if i % 2 else "xyz", "a") for i in range(6)] + [("z", "other", "a")]
    df = spark.createDataFrame(rows, "id string, text string, crumb string")
    monkeypatch.setattr(dupes, "root_digest", lambda leaf, parts: F.unhex(F.md5(F.lit("one"))))
    got = {(r["keep"], r["key"]) for r in duplicate_groups(df, "id", "text", "crumb").collect()}
    assert got == {("k0", k) for k in ("k0", "k2", "k4")} | {("k1", k) for k in ("k1", "k3", "k5")}
