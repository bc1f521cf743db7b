"""The graph of references between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import trimmed
from strandline.runtime import written


def edges(chunks: DataFrame, kind: str = "refers") -> DataFrame:
    """src, dst, type, n: distinct edges from documents to the codes their chunks name, with the number of chunks."""
    t = chunks.where("doc_code is not null").select(trimmed(F.col("doc_code")).alias("src"), F.explode(F.array_distinct("refs")).alias("dst")).where("src <> '' and src <> dst")
    return t.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).withColumn("type", F.lit(kind))


def closure(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """doc, step: everything reached from the seeds (a column ``doc``) along ``links`` (src, dst) to a fixed point, cycles included.

    Each step joins only the newest documents, writes what is new to the shared folder, and stops
    when nothing is, which comes at the latest after as many steps as there are documents.
    """
    out = links.select("src", "dst").distinct()
    known = written(seeds.where("doc is not null").select("doc").distinct().withColumn("step", F.lit(0)), "closure")
    newest, step = known, 0
    while True:
        step += 1
        found = newest.join(out, newest["doc"] == out["src"]).select(F.col("dst").alias("doc")).distinct()
        newest = written(found.join(known.select("doc"), "doc", "left_anti").withColumn("step", F.lit(step)), "closure")
        if newest.isEmpty():
            return known
        known = known.unionByName(newest)


def growth(reached: DataFrame) -> DataFrame:
    """step, new: how many documents each step adds."""
    return reached.groupBy("step").agg(F.count(F.lit(1)).alias("new"))


def dangling(links: DataFrame, held: DataFrame) -> DataFrame:
    """src, edges, dangling, rate, colour: references to documents not held (``held`` has doc). GREEN without any, AMBER up to a fifth, RED above."""
    have = held.select(F.col("doc").alias("dst")).distinct().withColumn("ok", F.lit(True))
    t = links.join(have, "dst", "left").groupBy("src").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("ok").isNull()).alias("dangling"))
    rate = F.col("dangling") / F.col("edges")
    return t.withColumn("rate", F.round(rate, 6)).withColumn("colour", F.when(F.col("dangling") == 0, "GREEN").when(rate <= 0.2, "AMBER").otherwise("RED"))


def acronym_collisions(acronyms: DataFrame) -> DataFrame:
    """short, documents, meanings, first, last: acronyms with two expansions that share no word. ``acronyms`` has doc, short, expansion.

    Pairs are counted, not made: of m expansions m (m - 1) / 2 pairs exist, and those that share a
    word are counted by inclusion and exclusion over the sets of words, as expansions that have a
    set in common are counted by grouping. ``first`` and ``last`` are the outermost expansions in
    alphabetical order. Empty and null expansions are left out.
    """
    each = acronyms.select("short", F.trim(F.lower("expansion")).alias("e"), "doc").where("e <> ''")
    distinct = each.groupBy("short", "e").agg(F.count_distinct("doc").alias("docs"))
    totals = distinct.groupBy("short").agg(F.sum("docs").alias("documents"), F.count(F.lit(1)).alias("meanings"), F.min("e").alias("first"), F.max("e").alias("last")).where("meanings > 1")
    words = distinct.join(totals.select("short"), "short", "left_semi").select("short", F.array_sort(F.array_distinct(F.split("e", r"\s+"))).alias("w"))
    bits = F.expr("sequence(1L, shiftleft(1L, size(w)) - 1)")
    sets = words.select("short", "w", F.explode(bits).alias("b")).select("short", F.expr("filter(w, (x, i) -> getbit(b, i) = 1)").alias("set"))
    shared = sets.groupBy("short", "set").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sign = F.when(F.size("set") % 2 == 1, 1).otherwise(-1)
    pairs = shared.groupBy("short").agg(F.sum(sign * F.expr("n * (n - 1) div 2")).alias("sharing"))
    t = totals.join(pairs, "short", "left").where(F.coalesce("sharing", F.lit(0)) < F.expr("meanings * (meanings - 1) div 2"))
    return t.select("short", "documents", "meanings", "first", "last")


def modal_fidelity(pairs: DataFrame) -> DataFrame:
    """Add lost, added, faithful: modals of ``source_modals`` the answer lacks, those it adds, and neither. Nulls count as no modals."""
    none = F.array().cast("array<string>")
    s, a = F.coalesce("source_modals", none), F.coalesce("answer_modals", none)
    t = pairs.withColumn("lost", F.array_sort(F.array_except(s, a))).withColumn("added", F.array_sort(F.array_except(a, s)))
    return t.withColumn("faithful", (F.size("lost") == 0) & (F.size("added") == 0))


def fabricated(citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """qid, doc: documents an answer cites that were not in its context. Both have qid, doc."""
    return citations.select("qid", "doc").distinct().join(contexts.select("qid", "doc"), ["qid", "doc"], "left_anti")
