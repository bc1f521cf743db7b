"""Texts cut off by field limits or in transfer.

Two kinds of evidence are joined and kept apart. A text that is a strict prefix of a longer one
elsewhere is found by hashing prefixes of fixed lengths (each length below 16, then powers of two),
which leaves the few texts that share one, and by sorting those: in sorted order a prefix stands
right before a text that continues it. The same is done for the last sentence of a text against
the sentences of all others. Most cut texts have no longer copy, so the way a text ends is judged
as well: an open sentence or word, a trailing sign of the cut, or half a character. The lengths at
which a source's texts pile up are reported as its limits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import WHITE, trimmed
from strandline.runtime import salted_join, written

# What transfers and editors leave behind a cut.
SIGN = rf"({WHITE}|\x{{FFFD}}|\.{{3,}}|…|[\[(]{WHITE}*(\.{{3,}}|…|more|cut|truncated){WHITE}*[\])]|&(h(e(l(l(i(p;?)?)?)?)?)?)?)+$"
#: Ends of a complete sentence, with what may close after it.
CLOSED = r"[.!?。！？][\"'”’“»)\]}*_]*$|[;:][\"'”’»)\]]*$|[\"”’»]$"
#: Complete lines that need no full stop.
LIST_ENTRY = r"^\s*([-*•–·>]|[0-9]{1,3}[.)]|[a-z][.)])\s+\S"
CODE_LINE = r"^\s*[A-Z][A-Z0-9]*([-_./][A-Z0-9]+)+([,;:]? [\p{L}]{1,12}\.? [0-9]+)?$"
FIELD_LINE = r"^\s*[\p{L}][\p{L} _-]{0,24}:\s+\S[^.!?]*$"
SIGN_OFF = r"^\s*(--|—|–|==|\*\*|##|~~)|^\s*[(\[].*[)\]]\s*$"
#: Lengths of the prefixes that are hashed: powers of two from ``SHORT`` to ``LONGEST``; shorter texts are compared at their own length.
SHORT, LONGEST = 16, 1 << 20
#: Where a sentence ends, and from how many characters on an unfinished one tells enough to look for another that continues it.
SENTENCE, LEAST = r"(?<=[.!?])\s+|\n+", 16
#: A length is a limit of its source from so many texts on, if they are so large a share of its texts.
LIMIT_TEXTS, LIMIT_SHARE = 5, 0.02


#: Characters at the end of a text in which a sign of a cut is looked for first; a sign that may reach further is looked for in the whole text.
TAIL = 96


def _based(rows: DataFrame) -> DataFrame:
    """``rows`` (a column ``text``) with ``n``, the length of the trimmed text, and ``base``: the trimmed text without signs of a cut at its end.

    Every step is a column of its own, so that none is computed twice.
    """
    t = rows.withColumn("__t", trimmed(F.col("text"))).withColumn("n", F.length("__t")).withColumn("__tail", F.substring("__t", -TAIL, TAIL))
    t = t.withColumn("__rest", F.length(F.regexp_replace("__tail", SIGN, ""))).withColumn("__size", F.length("__tail"))
    base = F.when(F.col("__rest") == F.col("__size"), F.col("__t")).when(F.col("__rest") < TAIL // 4, F.regexp_replace("__t", SIGN, "")).otherwise(F.left("__t", F.col("n") - F.col("__size") + F.col("__rest")))
    return t.withColumn("base", base).drop("__t", "__tail", "__rest", "__size")


def _opened(based: DataFrame) -> DataFrame:
    """``based`` with ``m``, the length of the base, and ``open``: whether the text ends inside a word or sentence, by its own end alone; false for empty and null texts.

    Complete without a full stop are list entries, table rows with as many cells as the row
    before, codes, fields with a value, and lines that sign off. Anything before a sign of a cut
    is judged as prose unless it is a closed sentence.
    """
    t = based.withColumn("m", F.length("base")).withColumn("__last", F.substring_index("base", "\n", -1))
    last = F.col("__last")
    before = F.substring_index(F.substring_index("base", "\n", -2), "\n", 1)
    bars = lambda c: F.length(F.regexp_replace(c, r"[^|]+", ""))
    whole_row = last.rlike(r"\|\s*$") & (~before.startswith("|") | (bars(before) <= bars(last)))
    complete = F.when(last.startswith("|"), whole_row).otherwise(last.rlike(LIST_ENTRY) | last.rlike(CODE_LINE) | last.rlike(FIELD_LINE) | last.rlike(SIGN_OFF))
    # the closing marks of a sentence stand in the last line
    is_open = (F.col("m") > 0) & ~last.rlike(CLOSED) & ((F.col("n") > F.col("m")) | ~complete)
    return t.withColumn("open", F.coalesce(is_open, F.lit(False))).drop("__last")


#: The newline sorts behind every other character here, so that of several texts that continue one the next goes on inside the line if any does.
LAST = "\U0010ffff"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted distinct texts: those the next one continues, with the character that follows; and the first and last of the task."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, first = None, None
    for b in batches:
        out: list[tuple] = []
        for t in b.column(0).to_pylist():
            if last is None:
                first = t
                out.append((part, "first", t, None))
            elif t.startswith(last):
                out.append((part, "prefix", last, t[len(last)]))
            last = t
        yield _rows(out)
    if first is not None:
        yield _rows([(part, "last", last, None)])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.string()))], ["part", "kind", "text", "follows"])


def _marks(text: str, size: str) -> list[Column]:
    """whole: a digest of the text; head: its first characters; blocks: digests of its prefixes of 16, 32, 64 ... characters, as far as it reaches."""
    t, n = F.col(text), F.col(size)
    steps = [1 << k for k in range(SHORT.bit_length() - 1, LONGEST.bit_length())]
    blocks = F.array_compact(F.array(*[F.when(n >= k, F.xxhash64(F.left(t, F.lit(k)), F.lit(k))) for k in steps]))
    return [F.unhex(F.md5(t)).alias("whole"), F.left(t, F.lit(SHORT)).alias("head"), blocks.alias("blocks")]


def _one_each(marks: DataFrame) -> DataFrame:
    """One row for each distinct text: whole, key (the smallest that has it), m, head, blocks."""
    return marks.where("m > 0").groupBy("whole").agg(F.min("key").alias("key"), F.first("m").alias("m"), F.first("head").alias("head"), F.first("blocks").alias("blocks"))


def _prefixes(marks: DataFrame, asked: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """text, follows: the texts of ``asked`` that a longer one of ``marks`` begins with.

    Both are as ``_one_each`` gives them; ``fetch`` gives key, whole, text for a table of keys.
    """
    # the longest power of two a text reaches is where it would be a prefix; the others are where it would be continued
    keyed = marks.where(F.size("blocks") > 0).select("whole", F.explode("blocks").alias("block"))
    shared = keyed.groupBy("block").agg(F.min("whole").alias("a"), F.max("whole").alias("z")).where("a <> z").select("block")
    tops = asked.where(F.size("blocks") > 0).select(F.element_at("blocks", -1).alias("block")).distinct()
    near = written(salted_join(keyed, tops.join(shared, "block", "left_semi"), ["block"], "left_semi").select("whole").distinct(), "near")
    keys = written(marks.join(near, "whole", "left_semi").select("key", "whole"), "keys")
    close = fetch(keys.select("key").distinct()).join(keys.select("whole"), "whole", "left_semi").select(F.translate("text", "\n", LAST).alias("text")).distinct()
    found = written(close.repartitionByRange("text").sortWithinPartitions("text").mapInArrow(_neighbours, "part int, kind string, text string, follows string"), "prefixes")
    back = [F.translate("text", LAST, "\n").alias("text"), F.translate("follows", LAST, "\n").alias("follows")]
    out = found.where("kind = 'prefix'").select(back)
    # where the order passes from one task to the next
    parts = sorted(r[0] for r in found.where("kind = 'first'").select("part").collect())
    if len(parts) > 1:
        step = found.sparkSession.createDataFrame(list(zip(parts, parts[1:])), "part int, next_part int")
        first = found.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next"))
        ends = found.where("kind = 'last'").select("part", "text").join(step, "part").join(first, "next_part")
        at = ends.where("startswith(next, text)").select("text", F.expr("substring(next, length(text) + 1, 1)").alias("follows"))
        out = out.unionByName(at.select(back))
    # shorter texts are their own heads; they meet the heads of others cut to their length
    short = asked.where(f"m < {SHORT}").select(F.col("head").alias("text")).distinct()
    heads = marks.select("head").distinct().where("length(head) > 1").withColumn("k", F.explode(F.expr("sequence(1, length(head) - 1)")))
    cut = heads.select(F.expr("left(head, k)").alias("text"), F.expr("substring(head, k + 1, 1)").alias("follows")).join(short, "text", "left_semi")
    return out.unionByName(cut.groupBy("text").agg(F.max(F.translate("follows", "\n", "")).alias("f")).select("text", F.when(F.col("f") == "", "\n").otherwise(F.col("f")).alias("follows")))


def strict_prefixes(texts: DataFrame, text: str) -> DataFrame:
    """text, follows: the distinct texts that a longer one begins with, and the character it goes on with; of several such characters one that is no newline.

    Copies are collapsed first; only texts that share a prefix of half their length or more with
    another are sorted. Prefixes of up to ``LONGEST`` characters are hashed; a longer text is
    found by the first ``LONGEST`` of it. Null and empty texts give nothing.
    """
    base = texts.select(F.col(f"`{text}`").alias("text")).where("text is not null").withColumn("m", F.length("text")).withColumn("key", F.xxhash64("text"))
    marks = written(_one_each(base.select("key", "m", *_marks("text", "m"))), "marks")
    return _prefixes(marks, marks, lambda keys: base.join(keys, "key", "left_semi").select("key", F.unhex(F.md5("text")).alias("whole"), "text"))


def _facts(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    named = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    return _opened(_based(named)).withColumn("size", F.length("text"))


def truncated(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """key, source, size, open, continued, cut: the evidence on every row, and the verdict.

    ``open``: the text's own end is open. ``continued``: a longer text begins with this one (less
    the sign of the cut) and goes on inside the word or the line. ``cut`` is either. A text that
    longer ones continue only after a closed sentence or on a new line is not cut by that. Null
    and empty texts are not cut. Rows come out as often as they stand in ``rows``; one with a null
    key is judged, but other texts are not held against it.
    """
    facts = _facts(rows, key, text, source)
    facts = written(facts.select("key", "source", "size", "open", "m", *_marks("base", "m")), "facts")
    marks = written(_one_each(facts.where("key is not null")), "marks")

    def fetch(keys: DataFrame) -> DataFrame:
        few = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(keys, "key", "left_semi")
        return _based(few).select("key", F.unhex(F.md5("base")).alias("whole"), F.col("base").alias("text"))

    continued = _inside(_prefixes(marks, marks, fetch)).select(F.unhex(F.md5("text")).alias("whole"), F.lit(True).alias("continued")).distinct()
    out = salted_join(facts.select("key", "source", "size", "open", "whole"), continued, ["whole"], "left").drop("whole")
    return out.withColumn("continued", F.coalesce("continued", F.lit(False))).withColumn("cut", F.col("open") | F.col("continued"))


def _inside(longer: DataFrame) -> DataFrame:
    """The prefixes that go on inside the line and do not end a sentence, a number before a decimal point apart."""
    return longer.where((F.col("follows") != "\n") & (~F.col("text").rlike(CLOSED) | (F.col("text").rlike(r"[0-9]\.$") & F.col("follows").rlike("[0-9]"))))


def longer_sentences(rows: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """key: the texts whose own end is open and whose last sentence, of ``least`` characters or more, a longer sentence of some text begins with.

    The same join by prefix as for whole texts; sentences end before white space after a full
    stop, question or exclamation mark, and at line breaks.
    """
    facts = _facts(rows.where(F.col(f"`{key}`").isNotNull()), key, text, key)

    def units(t: DataFrame) -> DataFrame:
        each = t.select("key", "open", F.posexplode(F.split("base", SENTENCE)).alias("i", "u"), F.size(F.split("base", SENTENCE)).alias("of"))
        return each.select("key", (F.col("open") & (F.col("i") == F.col("of") - 1)).alias("tail"), trimmed(F.col("u")).alias("text")).withColumn("m", F.length("text")).where(F.col("m") >= least)

    marked = written(units(facts).select("key", "tail", "m", *_marks("text", "m")), "sentences")
    marks = written(_one_each(marked), "marks")
    asked = marks.join(marked.where("tail").select("whole").distinct(), "whole", "left_semi")

    def fetch(keys: DataFrame) -> DataFrame:
        few = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(keys, "key", "left_semi")
        return units(_opened(_based(few))).select("key", F.unhex(F.md5("text")).alias("whole"), "text")

    longer = _prefixes(marks, asked, fetch).select(F.unhex(F.md5("text")).alias("whole")).distinct()
    return salted_join(marked.where("tail").select("key", "whole"), longer, ["whole"], "left_semi").select("key").distinct()


def truncation_by_source(judged: DataFrame) -> DataFrame:
    """source, texts, cut, share, limits: how often each source truncates, and the lengths at which its cut texts pile up."""
    sized = judged.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("c"))
    of = sized.groupBy("source").agg(F.sum("n").alias("texts"), F.sum("c").alias("cut"))
    piles = sized.where(F.col("c") >= LIMIT_TEXTS).withColumnRenamed("source", "s").join(of, F.col("s").eqNullSafe(F.col("source"))).where(F.col("c") / F.col("texts") >= LIMIT_SHARE)
    limits = piles.groupBy("s").agg(F.array_sort(F.collect_set("size")).alias("limits"))
    out = of.join(limits, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return out.select("source", "texts", "cut", (F.col("cut") / F.col("texts")).alias("share"), F.coalesce("limits", F.array().cast("array<int>")).alias("limits"))
