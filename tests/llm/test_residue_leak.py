import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import leak
from strandline.llm.leak import Index, Words, _probe, leaks, words_of
from strandline.llm.residue import reasons, residue

RESIDUE = {
    "Figure 3: {{title}}": "placeholder", "A view of ${unit.name} from above": "placeholder", "Plot of <%= x %> against time": "placeholder",
    "[TITLE TO BE ADDED]": "placeholder", "p. 9 - [Bild einfügen]": "placeholder", "__figure_name__": "placeholder", "{0}": "placeholder", "<INSERT NAME HERE>": "placeholder",
    "%(name)s in use": "placeholder", "[[label]]": "placeholder", "<<figure text>> on a bench": "placeholder", "@@REF@@": "placeholder",
    "Lorem ipsum dolor sit amet": "filler", "bla bla bla bla bla": "filler", "xxxx xxx xxxxx xxxx": "filler", "Your caption goes here.": "filler", "Dolor sit amet consectetur elit magna": "filler",
    "[légende à compléter]": "placeholder", "Block diagram of XXXX with two branches": "placeholder", "{{" + "a" * 500 + "}}": "placeholder", "Side view of the ____": "placeholder",
    "502 Bad Gateway": "message", "[12] Access denied: ask the owner": "message", '{"error": 5}': "message", "Traceback (most recent call last): x": "message",
    "Please enable JavaScript to see this.": "notice", "Page 4: This viewer needs scripts to run": "notice", "Your browser does not support this": "notice",
}
CLEAN = [
    None, "", "  \n", "None.", "n/a", "Side view", "There are no figures on this page.", "Connection of a rack with a placeholder plug on port 3.",
    "State diagram in which access denied leads back to idle", "Screen layout of the console with scripts disabled and two lamps", "Set of modes {A, B, C3} drawn as circles.",
    "Flow chart of the error handling: after a 404 reply the operator retries", "Template for the verification matrix with columns", "Plot of gain in % against time; the rest settles",
    "The editor shows `{{name}}` in a code span of the guide", "x" * 100_000,
]


def test_residue_and_what_only_speaks_of_it(spark):
    rows = [(t, r) for t, r in RESIDUE.items()] + [(t, None) for t in CLEAN]
    got = spark.createDataFrame(rows, "t string, want string").select("t", "want", residue(F.col("t")).reason.alias("got")).collect()
    assert [(r.t, r.want, r.got) for r in got if r.want != r.got and r.t != "x" * 100_000] == []


def test_invented_words_are_told_by_the_vocabulary_of_all(spark):
    rows = [(i, f"A view of the pump and the valve on panel {i}") for i in range(20)] + [(90, "Lonfel tispra cum arinir melqua ostdol"), (91, "Pump valve panel view pump"), (92, None), (93, ""), (94, "lonfel"), (90, "Lonfel tispra cum arinir melqua ostdol")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("reason", F.lit("clash"))
    assert [(r.key, r.reason) for r in reasons(df, "id", "t").collect()] == [(90, "filler")]
    assert reasons(df.limit(0), "id", "t").count() == 0


def test_tutorials_are_spared_by_density(spark):
    text = "This tutorial explains the syntax of a template engine. " + "Words follow here in a plain sentence. " * 20
    one = spark.createDataFrame([(text + "{{name}} renders a variable.",), (text[:60] + "{{a}} {{b}} {{c}} {{d}}",)], "t string")
    assert [r[0] for r in one.select(residue(F.col("t")).placeholder).collect()] == [False, True]


def brute(docs, items, run):
    grams = {}
    for i, t in items:
        w = words_of(t or "")
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    return sorted({(d, i) for d, t in docs for w in [words_of(t or "")] for k in range(len(w) - run + 1) for i in grams.get(tuple(w[k : k + run]), ())})


@pytest.mark.parametrize("run,per_index", [(15, 1_000_000), (5, 200)])
def test_leaks_equal_brute_force(spark, run, per_index):
    rng = random.Random(run)
    words = ["alpha", "beta", "gamma", "delta", "Ärger", "x1", "the", "of", "and"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(3, 40))) for i in range(30)] + [(99, None), (98, ""), (1, items_text := text(30))]
    items += [(100 + i, items[i][1]) for i in range(4)]
    docs = []
    for d in range(120):
        w = text(rng.randrange(0, 30)).split()
        if rng.random() < 0.7:
            src = words_of(rng.choice(items)[1] or "")
            n = rng.choice([run - 1, run, run + 3, 2 * run])
            a = rng.randrange(max(1, len(src) - n + 1))
            w += [x.upper() for x in src[a : a + n]] + text(3).split()
        docs.append((d, rng.choice([", ", " -- ", " "]).join(w)))
    docs += [(500, None), (501, ""), (502, (items_text + " ") * 3000), docs[0]]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = leaks(a, "doc_id", "text", b, "item_id", "text", run=run, postings_per_index=per_index)
    assert sorted((r.doc, r.item) for r in got.collect()) == brute(docs, items, run) != []


def test_no_items_and_no_texts(spark):
    a, b = spark.createDataFrame([(1, "x " * 40)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks(a, "doc_id", "text", b, "item_id", "text").count() == 0
    assert _probe(Index([]), [1], Words(["any words at all " * 10])) == []


def test_the_question_is_held_against_the_text(spark):
    body = " ".join(f"w{i}" for i in range(20))
    a = spark.createDataFrame([(1, body), (2, "Which duty? " + body.upper())], "doc_id long, text string")
    b = spark.createDataFrame([(7, body, "which duty"), (8, body, None)], "item_id long, text string, question string")
    got = leaks(a, "doc_id", "text", b, "item_id", "text", question="question").collect()
    assert {(r.doc, r.item): (r.passages, r.question) for r in got} == {(1, 7): (6, 0.0), (2, 7): (6, 1.0), (1, 8): (6, None), (2, 8): (6, None)}


def test_slices_lose_no_passage(monkeypatch):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(words) for _ in range(25)), None) for i in range(40)]
    long = " ".join([rng.choice(words) for _ in range(700)] + items[3][1].split() + [rng.choice(words) for _ in range(700)] + items[9][1].split()[2:19])
    texts = ["", "a\x00b", long, items[5][1], "é" * 30]
    index = Index(items)
    whole = _probe(index, list(range(5)), Words(texts))
    assert {(d, i) for d, i, *_ in whole} == {(2, 3), (2, 9), (3, 5)}
    for size in (7, 64, 1000):
        monkeypatch.setattr(leak, "SLICE", size)
        assert _probe(index, list(range(5)), Words(texts)) == whole
        assert [Words(texts).words(i, 3) for i in (0, 100, 1450)] == [words_of(" ".join(texts).replace("\x00", " "))[i : i + 3] for i in (0, 100, 1450)]


def test_many_items_and_a_text_of_a_million_words():
    rng = random.Random(6)
    words = [f"t{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(60)), None) for i in range(20_000)]
    index = Index(items)
    held = sum(x.nbytes for x in (index.maps, index.pair, index.weight, index.block_pair, index.block_weight))
    assert held < 100_000_000
    text = " ".join([rng.choice(words) for _ in range(1_000_000)] + items[77][1].split()[5:25])
    assert [(d, i, n) for d, i, n, _ in _probe(index, [1], Words([text]))] == [(1, 77, 6)]
