import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandline.operators.chunking import chunk_items
from strandline.plans import records
from strandline.runtime import salted_join, written
from strandline.sources import files, sinks
from strandline.streaming import tables


def test_discovery_and_manifest(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, text in (("a.md", "x"), ("sub/b.HTML", "y"), ("c.log", "z")):
        (tmp_path / "in" / name).write_text(text)
    found = files.discover(spark, [str(tmp_path / "in"), str(tmp_path / "in/c.log")])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.md", "b.HTML", "c.log"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    (tmp_path / "m.tsv").write_text(f"# one\n# two\nfilename\tsha256\na.md\t{sha('x')}\nb.HTML\t{sha('other')}\ngone.md\t{sha('q')}\n")
    t = files.verify_manifest(files.read_manifest(spark, str(tmp_path / "m.tsv")), files.digests(found))
    assert {r["filename"]: r["state"] for r in t.collect()} == {"a.md": "ok", "b.HTML": "changed", "gone.md": "missing", "c.log": "extra"}


def test_a_table_that_is_a_folder_is_one_source(spark, tmp_path):
    spark.range(9).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    (tmp_path / "one.parquet").write_bytes(next((tmp_path / "many.parquet").glob("*.parquet")).read_bytes())
    assert sorted(map(tuple, records.source_files(spark, f"{tmp_path}/").collect())) == [("many.parquet", 64), ("one.parquet", 64)]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "f.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert files.read_jsonl(spark, str(p), "a int, b string").count() == 2
    p.write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        files.read_jsonl(spark, str(p), "a int").collect()
    assert [(r["line_no"], r["line"]) for r in files.bad_lines(spark, str(p), "a int").collect()] == [(2, '{"a": ')]
    assert files.read_jsonl(spark, str(p), "a int", strict=False).where("_corrupt_record is not null").cache().count() == 1
    (tmp_path / "o.json").write_text(json.dumps({"x": {"y": 1}}, indent=2))
    assert files.read_object(spark, str(tmp_path / "o.json")).select("x.y").collect()[0][0] == 1


def test_returns_by_alias(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Item,"My Answer"\n1,"a, b"\n2,\n')
    got = files.read_returns(spark, str(tmp_path / "r.csv"), {"item": [], "answer": ["my answer", "my_answer"]})
    assert [tuple(r) for r in got.collect()] == [("1", "a, b"), ("2", None)]
    with pytest.raises(ValueError, match="no column verdict"):
        files.read_returns(spark, str(tmp_path / "r.csv"), {"verdict": ["judgement"]})


def test_items_of_markdown_and_html(spark):
    md = "# Top\n\npara one\n## 4.1 Sub\n| a | b |\n|---|---|\n| 1 | 2 |\na. item"
    html = "<title>T</title><h1>Top</h1><p>para <b>one</b></p><script>no()</script><h2>4.1 Sub</h2><table><tr><th>a</th></tr><tr><td>1</td></tr></table><p>end"
    df = spark.createDataFrame([("m", md, "md"), ("h", html, "html"), ("t", "a\n\nb", "txt"), ("n", None, "md"), ("e", "", "html")], "d string, t string, k string")
    got = {}
    for r in files.parse_items(df, "d", "t", F.col("k")).orderBy("doc", "pos").collect():
        got.setdefault(r["doc"], []).append((r["label"], r["level"], r["text"]))
    assert got["m"] == [("section_header", 1, "Top"), ("text", None, "para one"), ("section_header", 2, "4.1 Sub"), ("table", None, "| a | b |\n|---|---|\n| 1 | 2 |"), ("text", None, "a. item")]
    assert got["h"] == [("title", 1, "T"), ("section_header", 1, "Top"), ("text", None, "para one"), ("section_header", 2, "4.1 Sub"), ("table", None, "| a |\n| --- |\n| 1 |"), ("text", None, "end")]
    assert got["t"] == [("text", None, "a"), ("text", None, "b")] and set(got) == {"m", "h", "t"}
    chunks = chunk_items(files.parse_items(df.where("k = 'md'"), "d", "t", "md"))
    assert [(r["section"], r["clause"], r["etype"]) for r in chunks.orderBy("pos").collect()] == [("Top", "", "text"), ("Top > 4.1 Sub", "4.1", "table"), ("Top > 4.1 Sub", "4.1", "text")]


def test_layout_text_prefers_siblings(spark):
    f = spark.createDataFrame([("/p/a.pdf",), ("/p/b.pdf",), ("/p/c.pdf",)], "path string")
    s, p = (spark.createDataFrame(r, "path string, text string") for r in ([("/t/a.txt", "sib")], [("/p/a.pdf", "own"), ("/p/b.pdf", "own")]))
    assert {r["path"][3]: (r["text"], r["text_source"]) for r in files.layout_text(f, s, p).collect()} == {"a": ("sib", "sibling-layout-txt"), "b": ("own", "parser"), "c": ("", "unavailable")}


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"))
    df = lambda *rows: spark.createDataFrame(rows, "id int, v string")
    with pytest.raises(FileNotFoundError):
        t.read()
    t.upsert(df((1, "a"), (2, "b"), (2, "b")), "id")
    t.upsert(df((2, "B"), (3, "c")), "id")
    first = t.versions()[0].split("-", 1)[1]
    t.delete(df((1, None)), ["id"])
    assert {tuple(r) for r in t.read().collect()} == {(2, "B"), (3, "c")} and t.read(first).count() == 2 and len(t.versions()) == 3
    other = sinks.VersionedTable(spark, str(tmp_path / "u"))
    assert sinks.derive(t, other, lambda f: f.withColumn("w", F.upper("v"))) == 2
    for bad, err in ((lambda: sinks.derive(t, t, None), ValueError), (lambda: sinks.derive(t, other, None), FileExistsError), (lambda: sinks.derive(sinks.VersionedTable(spark, str(tmp_path / "no")), t, None), FileNotFoundError)):
        with pytest.raises(err):
            bad()
    sinks.write_results(t.read(), sinks.build_config(t.read(), "1", {}), str(tmp_path / "r"))
    sinks.append_metrics(t.read(), str(tmp_path / "metrics"))
    sinks.append_metrics(t.read(), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 4 and files.read_object(spark, str(tmp_path / "r/summary")).collect()[0]["rows"] == 2
    with pytest.raises(ValueError):
        sinks.build_config(t.read().limit(0), "1", {})


def test_streamed_upserts_are_idempotent(spark, tmp_path):
    src = tmp_path / "src"
    write = lambda rows: spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("append").parquet(str(src))
    t = sinks.VersionedTable(spark, str(tmp_path / "t"))
    go = lambda: tables.upsert_stream(tables.read_stream(spark, str(src), "id int, v string"), t, "id", str(tmp_path / "c"))
    write([(1, "a"), (2, "b")])
    go()
    write([(2, "B")])
    go()
    go()
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "B")}


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02}:00", k, float(m)) for h in range(3) for m in (0, 10, 50) for k in "ab"]
    df = spark.createDataFrame(rows, "ts string, k string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "e"))
    tables.run_to_table(tables.windowed_counts(tables.read_stream(spark, str(tmp_path / "e"), df.schema), "ts", ["k"], "1 hour"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect())) == sorted(map(tuple, tables.windowed_counts(df, "ts", ["k"], "1 hour").collect()))
    assert sorted((r["k"], r["n"]) for r in tables.sessions(df, "ts", "k", "15 minutes").collect()) == [(k, n) for k in "ab" for n in (1, 2, 3, 3)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    big = spark.createDataFrame([(k, i) for i in range(50) for k in ("hot", f"k{i}")] + [(None, 1), ("hot", 1)], "k string, v int")
    small = spark.createDataFrame([("hot", 1), ("k3", 2), ("k3", 3), (None, 4)], "k string, w int")
    assert sorted(map(str, salted_join(big, small, ["k"], how, 4).collect())) == sorted(map(str, big.join(small, "k", how).collect()))


def test_written_cuts_lineage(spark):
    t = written(spark.range(5).withColumn("x", F.lit(None).cast("string")), "test")
    assert t.count() == 5 and t.schema.simpleString() == "struct<id:bigint,x:string>" and "Range" not in t._jdf.queryExecution().toString()
