"""Readers of files and record formats, and their checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of files that are read.
SUFFIXES = (".pdf", ".docx", ".pptx", ".xlsx", ".html", ".htm", ".md")
ITEMS = "doc string, pos long, label string, level int, page int, text string"


def discover(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, length, modified, content: files below the folders with one of the suffixes; a path that names a file is taken whatever its suffix.

    Contents are read only where they are used.
    """
    out = None
    for p in paths:
        t = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p)
        asked = F.regexp_replace("path", "^file:/+", "/") == p.rstrip("/")
        t = t.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$") | asked)
        out = t if out is None else out.unionByName(t)
    return out.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def digests(files: DataFrame) -> DataFrame:
    """path, sha256 of whole files."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """filename, sha256 of a tab-separated manifest with a header and # comments."""
    return spark.read.schema("filename string, sha256 string").csv(path, sep="\t", header=True, comment="#")


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """filename, state: ok, changed, missing or extra, of files (path, sha256) against a manifest."""
    have = found.select(F.substring_index("path", "/", -1).alias("filename"), F.col("sha256").alias("now"))
    t = manifest.join(have, "filename", "full_outer")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.lower("sha256") == F.lower("now"), "ok").otherwise("changed")
    return t.select("filename", state.alias("state"))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """One JSON object a line; blank lines are passed over. Strict reading stops at a malformed line, otherwise it comes in the column ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    given = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*given.fields, T.StructField("_corrupt_record", T.StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line_no, line: the lines of JSONL files that do not parse, counted from 1."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n", -1)).alias("i", "line"))
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json("line").isNotNull() & parsed.isNotNull()
    return text.where((F.trim("line") != "") & ~valid).select("file", (F.col("i") + 1).alias("line_no"), "line")


def read_object(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a file, over any number of lines."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(path, multiLine=True)


def read_returns(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A CSV file with a header whose columns go by several names: ``aliases`` lists those of each wanted column. A column that is not there is an error."""
    t = spark.read.csv(path, header=True, multiLine=True, escape='"')
    have = {c.strip().lower(): c for c in t.columns}
    out = []
    for name, others in aliases.items():
        hit = next((have[a.lower()] for a in [name, *others] if a.lower() in have), None)
        if hit is None:
            raise ValueError(f"{path} has no column {name} (or {', '.join(others)}); it has {t.columns}")
        out.append(F.col(f"`{hit}`").alias(name))
    return t.select(out)


def layout_text(files: DataFrame, siblings: DataFrame, parsed: DataFrame) -> DataFrame:
    """path, text, text_source: the text of a sibling file of the same base name, else that of the parser, else ''.

    ``siblings`` and ``parsed`` have path, text.
    """
    base = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")
    s = siblings.select(base(F.col("path")).alias("base"), F.col("text").alias("sib")).dropDuplicates(["base"])
    p = parsed.select("path", F.col("text").alias("own"))
    t = files.select("path", base(F.col("path")).alias("base")).join(s, "base", "left").join(p, "path", "left")
    source = F.when(F.col("sib").isNotNull(), "sibling-layout-txt").when(F.col("own").isNotNull(), "parser").otherwise("unavailable")
    return t.select("path", F.coalesce("sib", "own", F.lit("")).alias("text"), source.alias("text_source"))


def _markdown(text: str) -> Iterator[tuple]:
    held: list[str] = []
    for line in [*text.split("\n"), ""]:
        table = line.lstrip().startswith("|")
        if held and not table:
            yield "table", None, "\n".join(held)
            held = []
        if table:
            held.append(line.strip())
        elif line.startswith("#"):
            yield "section_header", len(line) - len(line.lstrip("#")), line.lstrip("#").strip()
        elif line.strip():
            yield "text", None, line.strip()


def _html(text: str) -> Iterator[tuple]:
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.out: list[tuple] = []
            self.tag, self.parts, self.rows, self.cells, self.skip = "", [], None, [], 0

        def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN202
            if tag in ("script", "style"):
                self.skip += 1
            elif tag == "table":
                self.close_block()
                self.rows = []
            elif tag == "tr" and self.rows is not None:
                self.cells = []
            elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "title", "p", "li", "div", "td", "th"):
                if self.rows is None:
                    self.close_block()
                self.tag, self.parts = tag, []

        def handle_endtag(self, tag):  # noqa: ANN001, ANN202
            if tag in ("script", "style"):
                self.skip = max(0, self.skip - 1)
            elif tag in ("td", "th") and self.rows is not None:
                self.cells.append(" ".join("".join(self.parts).split()))
                self.parts = []
            elif tag == "tr" and self.rows is not None:
                self.rows.append("| " + " | ".join(self.cells) + " |")
            elif tag == "table" and self.rows is not None:
                rule = ["|" + " --- |" * self.rows[0].count(" |")] if self.rows else []
                if self.rows:
                    self.out.append(("table", None, "\n".join(self.rows[:1] + rule + self.rows[1:])))
                self.rows, self.parts = None, []
            elif self.rows is None and tag in ("h1", "h2", "h3", "h4", "h5", "h6", "title", "p", "li", "div"):
                self.close_block()

        def handle_data(self, data):  # noqa: ANN001, ANN202
            if not self.skip:
                self.parts.append(data)

        def close_block(self) -> None:
            text = " ".join("".join(self.parts).split())
            if text:
                level = int(self.tag[1]) if self.tag[:1] == "h" and self.tag[1:].isdigit() else None
                self.out.append(("section_header" if level else "title" if self.tag == "title" else "text", level or (1 if self.tag == "title" else None), text))
            self.parts = []

    r = Reader()
    r.feed(text)
    r.close()
    r.close_block()
    yield from r.out


def _plain(text: str) -> Iterator[tuple]:
    for part in text.split("\n\n"):
        if part.strip():
            yield "text", None, part.strip()


#: Parsers by format; others (PDF and office files need libraries that may not be there) can be added.
PARSERS: dict[str, Callable[[str], Iterator[tuple]]] = {"md": _markdown, "html": _html, "htm": _html, "txt": _plain}


def parse_items(texts: DataFrame, doc: str, text: str, kind: str | Column) -> DataFrame:
    """doc, pos, label, level, page, text: the items of Markdown, HTML and plain texts, by a pluggable parser for each format.

    A text of an unknown format is an error; null and empty texts have no items.
    """
    which = F.lit(kind) if isinstance(kind, str) else kind
    rows = texts.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text"), which.alias("kind")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, i, *x) for d, t, k in zip(*[c.to_pylist() for c in b.columns]) for i, x in enumerate(PARSERS[k](t))]
            cols = [[r[i] for r in out] for i in range(5)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, kinds)], pa.nulls(len(out), pa.int32()), pa.array(cols[4], pa.string())], ["doc", "pos", "label", "level", "page", "text"])

    return rows.mapInArrow(run, ITEMS)
