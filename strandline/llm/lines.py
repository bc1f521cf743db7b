"""Lines repeated across one source's documents.

Equal documents of a source are collapsed first (a cluster keeps how many ids it stands for and
when it first appeared), then each line is counted over clusters, ids and days. Only digests of
lines travel, never texts, and a source holding a third of all documents is spread by salting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import folded
from strandline.runtime import salted_join

#: White space other than the newline.
INLINE = r"[\t\x0B\f\r \x85\p{Z}\x1C-\x1F]"


def line_digests(text: Column) -> Column:
    """A digest for each line (split at newlines), null for blank lines and SECTION lines.

    Lines that differ only in letter case, amount and kind of white space, or the digits of
    their numbers share a digest, of 128 bits.
    """
    same = F.regexp_replace(F.regexp_replace(folded(text), r"\p{Nd}+", "0"), rf"{INLINE}+", " ")
    return F.transform(F.split(same, "\n", -1), lambda x: _digest(F.trim(x)))


def _digest(line: Column) -> Column:
    return F.when((line != "") & ~line.startswith("section:"), F.unhex(F.md5(line)))


def documents_with_lines(rows: DataFrame, key: str, source: Column, text: str, day: Column) -> DataFrame:
    """key, src, doc, day, marks: one row for each key with a source; ``marks`` are the line digests."""
    t = F.col(f"`{text}`")
    packed = F.struct(source.alias("src"), F.unhex(F.md5(t)).alias("doc"), day.alias("day"), line_digests(t).alias("marks"))
    one = rows.select(F.col(f"`{key}`").alias("key"), packed.alias("p")).where("p.src is not null and p.marks is not null").groupBy("key").agg(F.first("p").alias("p"))
    return one.select("key", "p.*")


def repeated_lines(documents: DataFrame, least: int, share: float, least_clusters: int = 1, least_days: int = 1) -> DataFrame:
    """src, mark, ids, clusters, days, of: the lines found in at least ``least`` ids and ``share`` of the ids of their source.

    ``least_clusters`` and ``least_days`` ask in addition for so many different documents and
    first days, which spares articles that were merely republished. A line counts once a
    document however often it stands there.
    """
    clusters = documents.groupBy("src", "doc").agg(F.count(F.lit(1)).alias("ids"), F.min("day").alias("day"), F.first("marks").alias("marks"))
    each = clusters.select("src", "ids", "day", F.explode(F.array_distinct(F.array_compact("marks"))).alias("mark"))
    # by day first: the distinct days become rows to count, and hot lines are merged early
    daily = each.groupBy("src", "mark", "day").agg(F.sum("ids").alias("ids"), F.count(F.lit(1)).alias("clusters"))
    lines = daily.groupBy("src", "mark").agg(F.sum("ids").alias("ids"), F.sum("clusters").alias("clusters"), F.count("day").alias("days"))
    of = documents.groupBy("src").agg(F.count(F.lit(1)).alias("of"))
    enough = (F.col("ids") >= least) & (F.col("clusters") >= least_clusters) & ((F.col("days") >= least_days) if least_days > 1 else F.lit(True))
    return lines.where(enough).join(of.where(F.col("of") >= least), "src").where(F.col("ids") / F.col("of") >= share)


def by_source(repeated: DataFrame) -> DataFrame:
    """src and its repeated marks. A mark is in ``share`` of the ids of its source, so a source has at most its lines a document divided by ``share``."""
    return repeated.groupBy("src").agg(F.collect_list("mark").alias("bad"))


def repeated_positions(documents: DataFrame, repeated: DataFrame) -> DataFrame:
    """key, line_no: where repeated lines stand, counted from 0 over all lines of a document."""
    hit = salted_join(documents.select("key", "src", "marks"), by_source(repeated), ["src"])
    return hit.select("key", "bad", F.posexplode("marks").alias("line_no", "mark")).where("mark is not null and array_contains(bad, mark)").select("key", F.col("line_no").cast("long").alias("line_no"))


def without_lines(rows: DataFrame, source: Column, text: str, repeated: DataFrame) -> DataFrame:
    """``rows`` with a column ``cleaned``: the text without the repeated lines of its source. Rows without a source keep their text.

    A source with many rows is spread over tasks by the content of its rows.
    """
    t = F.col(f"`{text}`")
    bad = by_source(repeated).select(F.col("src").alias("__src"), F.col("bad").alias("__bad"))
    base = rows.withColumn("__src", source)
    pairs = F.arrays_zip(F.split(t, "\n", -1).alias("l"), line_digests(t).alias("m"))
    kept = F.array_join(F.transform(F.filter(pairs, lambda x: x["m"].isNull() | ~F.array_contains("__bad", x["m"])), lambda x: x["l"]), "\n")
    return salted_join(base, bad, ["__src"], "left").withColumn("cleaned", F.when(F.col("__bad").isNull(), t).otherwise(kept)).drop("__src", "__bad")
