"""Scores of answers: coverage, macro and weighted means, bootstrap intervals, judge validation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import ids
from strandline.functions.ids import draw
from strandline.runtime import written

# Floors and counts fixed before a run.
CLASS_FLOOR, CI_LEAST, REPLICATES, PAIRED_REPLICATES, SEED = 3, 20, 10_000, 1_000, 42
MIN_RECALL, MAX_FALSE_POSITIVE = 0.90, 0.05
LEAST_POSITIVE, LEAST_NEGATIVE, LEAST_CONSTRUCTED = 400, 10, 300
CONTROL_FLOOR = 0.60
HARD_REJECT, HARD_KEEP = 0.80, 0.95
#: Parts that the replicates of a bootstrap are made in, draws made at once, and the places values are rounded to, which bounds how many different ones a stratum has.
REPLICATE_BLOCKS, DRAWS, PLACES = 100, 1 << 20, 6


def item_coverage(verdicts: DataFrame) -> DataFrame:
    """item, class, n_required, coverage, all_required: share of required claims reached; null if any verdict is null. ``verdicts`` has item, class, tier, verdict."""
    v = verdicts.where("tier = 'required'")
    none = F.count_if(F.col("verdict").isNull()) > 0
    t = v.groupBy("item", "class").agg(F.count(F.lit(1)).alias("n_required"), F.when(~none, F.avg(F.col("verdict").cast("double"))).alias("coverage"))
    return t.withColumn("all_required", F.col("coverage") == 1.0).withColumn("coverage", F.round("coverage", 6))


def mean_of_known(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """by..., n, coverage: mean over the verdicts that are not null; null if there is none."""
    return verdicts.groupBy(*by).agg(F.count("verdict").alias("n"), F.round(F.avg(F.col("verdict").cast("double")), 6).alias("coverage"))


def class_means(items: DataFrame, scored: list[str] | None = None, floor: int = CLASS_FLOOR) -> DataFrame:
    """class, n, coverage, all_required, scored, why: means of items with a coverage; a class below the floor after drops is not scored, nor one that is not listed."""
    kept = items.where("coverage is not null")
    t = kept.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg("coverage").alias("coverage"), F.avg(F.col("all_required").cast("double")).alias("all_required"))
    listed = F.col("class").isin(scored) if scored is not None else F.lit(True)
    why = F.when(~listed, "not a scored class").when(F.col("n") < floor, F.concat(F.lit("n="), "n", F.lit(f" < {floor}")))
    return t.withColumn("why", why).withColumn("scored", F.col("why").isNull())


def macro(classes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row: classes, macro, weighted, macro_all_required over the scored classes; weights are renormalised over those present, and null if they add up to nothing."""
    t = classes.where("scored")
    t = t.withColumn("weight", F.lit(None).cast("double")) if weights is None else t.join(weights.select("class", F.col("weight").cast("double")), "class", "left")
    w = F.sum(F.coalesce("weight", F.lit(0.0)))
    return t.agg(
        F.count(F.lit(1)).alias("classes"), F.round(F.avg("coverage"), 6).alias("macro"),
        F.round(F.when(w > 0, F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("coverage")) / w), 6).alias("weighted"), F.round(F.avg("all_required"), 6).alias("macro_all_required"),
    )


def _replicate_means(values: DataFrame, replicates: int, seed: int) -> DataFrame:
    """c, r, m: the mean of each replicate in each stratum. ``values`` has c (the stratum) and v.

    Which item is drawn matters only by its value, so a stratum is its values in order with their
    numbers; a task has those of one stratum, makes all draws of its replicates from them as
    arrays, and gives one mean a replicate.
    """
    spark = values.sparkSession
    blocks = min(replicates, REPLICATE_BLOCKS)
    counted = values.select("c", F.round("v", PLACES).alias("v")).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    strata = counted.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("h")).select("c", F.col("h.v").alias("v"), F.col("h.n").alias("n"))
    parts = strata.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # a number of partitions of its own: these rows are few, the work they ask for is not
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c", "b")

    def draw_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, v, n, b in zip(*[x.to_pylist() for x in batch.columns]):
                value, upto = np.array(v), np.cumsum(n)
                total, small = int(upto[-1]), int(upto[-1]) <= 4 * DRAWS
                every = np.repeat(value, n) if small else None
                rs = range(b, replicates, blocks)
                means = []
                for r in rs:
                    base, added = ids.stream_of(seed, c, r), 0.0
                    for a in range(0, total, DRAWS):
                        u = ids.mixed_array(base, np.arange(a, min(total, a + DRAWS), dtype=np.uint64))
                        i = ((u * np.uint64(total)) >> np.uint64(32)).astype(np.int64)
                        added += float((every[i] if small else value[np.searchsorted(upto, i, side="right")]).sum())
                    means.append(added / total)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(means), pa.string()), pa.array(list(rs), pa.int32()), pa.array(means)], ["c", "r", "m"])

    return parts.select(F.col("c").cast("string").alias("c"), "v", "n", "b").mapInArrow(draw_all, "c string, r int, m double")


def bootstrap(items: DataFrame, stratum: str, value: str, replicates: int = REPLICATES, seed: int = SEED, weights: DataFrame | None = None) -> DataFrame:
    """One row: lo, hi, replicates: a percentile interval of the (weighted) macro mean, items drawn within their stratum.

    Draw s of replicate r in stratum c is the item number floor(n * u) in order of value, u the
    s-th number of a stream that begins at a digest of (seed, c, r): reproducible anywhere. The
    interval takes the ordered values at int(0.025 B) and int(0.975 B) - 1. Values count to six
    places. Nulls in value or stratum are left out, no values give no row.
    """
    kept = items.where(F.col(value).isNotNull() & F.col(stratum).isNotNull()).select(F.col(stratum).alias("c"), F.col(value).cast("double").alias("v"))
    means = _replicate_means(kept, replicates, seed)
    if weights is None:
        whole = means.groupBy("r").agg(F.round(F.avg("m"), 9).alias("m"))
    else:
        whole = means.join(weights.select(F.col("class").alias("c"), F.col("weight").cast("double").alias("w")), "c").groupBy("r").agg(F.round(F.sum(F.col("w") * F.col("m")) / F.sum("w"), 9).alias("m"))
    ordered = whole.agg(F.array_sort(F.collect_list("m")).alias("a"))  # as many as replicates
    lo, hi = int(0.025 * replicates), max(0, int(0.975 * replicates) - 1)
    return ordered.where(F.size("a") > 0).select(F.round(F.get("a", F.lit(lo)), 6).alias("lo"), F.round(F.get("a", F.lit(hi)), 6).alias("hi"), F.size("a").alias("replicates"))


def class_blocks(items: DataFrame, replicates: int = REPLICATES, least: int = CI_LEAST) -> DataFrame:
    """class, n, coverage, all_required, lo, hi, withheld: an interval only for classes of ``least`` items or more, the reason otherwise."""
    t = class_means(items, floor=0)
    big = t.where(F.col("n") >= least).select("class")
    per = items.join(big, "class", "left_semi").where("coverage is not null")
    # every class is its own stratum: the means by class and replicate are ranked within the class
    means = _replicate_means(per.select(F.col("class").alias("c"), F.col("coverage").alias("v")), replicates, SEED).withColumnRenamed("c", "class")
    a = means.groupBy("class").agg(F.array_sort(F.collect_list(F.round("m", 9))).alias("a"))
    ci = a.select("class", F.round(F.get("a", F.lit(int(0.025 * replicates))), 6).alias("lo"), F.round(F.get("a", F.lit(max(0, int(0.975 * replicates) - 1))), 6).alias("hi"))
    out = t.join(ci, "class", "left").withColumn("withheld", F.when(F.col("n") < least, F.concat(F.lit("n="), "n", F.lit(f" < {least}"))))
    return out.select("class", "n", F.round("coverage", 6).alias("coverage"), F.round("all_required", 6).alias("all_required"), "lo", "hi", "withheld")


def summary(rows: DataFrame, scored: list[str], weights: DataFrame | None = None) -> DataFrame:
    """One row: asked, kept, dropped_error, dropped_unparseable, refusals and the macro figures. ``rows`` has item, class, coverage, all_required, error, refused."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(F.col("error").isNotNull()).alias("dropped_error"), F.count_if(F.col("error").isNull() & F.col("coverage").isNull()).alias("dropped_unparseable"),
        F.count_if(F.col("error").isNull() & F.col("coverage").isNotNull()).alias("kept"), F.count_if(F.col("error").isNull() & F.col("coverage").isNotNull() & F.col("refused")).alias("refusals"),
    )
    figures = macro(class_means(rows.where("error is null"), scored), weights)
    return counts.withColumn("one", F.lit(1)).join(figures.withColumn("one", F.lit(1)), "one").drop("one")


def judge_validation(labels: DataFrame, limited: bool = False) -> DataFrame:
    """One row of rates and the verdict. ``labels`` has kind ('reviewer' or 'constructed'), label, judge (null: unparseable), matcher.

    SMOKE if the run was limited or a count is below its floor; else ACCEPTED if recall and false
    positives keep their limits and every reply could be read; else NOT ACCEPTED.
    """
    known = F.col("judge").isNotNull()
    pos, neg = (F.col("kind") == "reviewer") & known & F.col("label"), (F.col("kind") == "reviewer") & known & ~F.col("label")
    made = (F.col("kind") == "constructed") & known
    share = lambda hit, of: F.when(F.count_if(of) > 0, F.round(F.count_if(of & hit) / F.count_if(of), 6))
    judge, matcher = F.col("judge"), F.col("matcher")
    t = labels.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(~known).alias("unparseable"), F.count_if(pos).alias("positives"), F.count_if(neg).alias("negatives"), F.count_if(made).alias("constructed"),
        share(judge, pos).alias("recall"), share(matcher, pos).alias("matcher_recall"), share(judge, made).alias("false_positive"), share(matcher, made).alias("matcher_false_positive"), share(~judge, neg).alias("agreement"),
    )
    few = (F.col("positives") < LEAST_POSITIVE) | (F.col("negatives") < LEAST_NEGATIVE) | (F.col("constructed") < LEAST_CONSTRUCTED) | F.lit(limited)
    good = (F.coalesce("recall", F.lit(0.0)) >= MIN_RECALL) & (F.coalesce("false_positive", F.lit(0.0)) <= MAX_FALSE_POSITIVE) & (F.col("unparseable") == 0)
    return t.withColumn("verdict", F.when(few, "SMOKE").when(good, "ACCEPTED").otherwise("NOT ACCEPTED"))


def to_read(labels: DataFrame) -> DataFrame:
    """The constructed negatives the judge calls present, which somebody has to read."""
    return labels.where("kind = 'constructed' and judge")


def hard_negative_rates(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., rejected, kept, verdict: share of truncated claims the judge rejects and of controls it keeps, against their floors. ``labels`` has kind ('truncated' or 'control') and judge."""
    cut, control = F.col("kind") == "truncated", F.col("kind") == "control"
    rate = lambda hit, of: F.round(F.count_if(of & hit) / F.nullif(F.count_if(of), F.lit(0)), 6)
    known = labels.where("judge is not null")
    t = (known.groupBy(*by) if by else known.groupBy()).agg(rate(~F.col("judge"), cut).alias("rejected"), rate(F.col("judge"), control).alias("kept"))
    return t.withColumn("verdict", F.when((F.col("rejected") >= HARD_REJECT) & (F.col("kept") >= HARD_KEEP), "pass").otherwise("fail"))


def arm_verdict(results: DataFrame) -> DataFrame:
    """One row: means of the arms 'text_control' and 'figure_only' and what they say. ``results`` has arm, coverage."""
    mean = lambda arm: F.round(F.avg(F.when(F.col("arm") == arm, F.col("coverage"))), 4)
    t = results.agg(mean("text_control").alias("control"), mean("figure_only").alias("figure"))
    verdict = (
        F.when(F.col("control").isNull() | (F.col("control") < CONTROL_FLOOR), "inconclusive: controls failed").when(F.col("figure").isNull(), "inconclusive: no figure item judged")
        .when(F.col("figure") < F.col("control"), "gap confirmed").otherwise("prediction did not hold")
    )
    return t.withColumn("verdict", verdict)


#: Parts of equal size that claims are numbered in.
BUCKETS = 4_096


def constructed_negatives(answers: DataFrame, claims: DataFrame, per_item: int = 3, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """item, of, claim: for each answer ``per_item`` claims of other items, or all of them where there are fewer.

    No product of answers and claims is made: claims stand in a random order (by digest) and are
    numbered in it, part by part. An answer begins at a random one of the claims that are not its
    item's and takes those that follow, its own passed over, from the end on to the beginning.
    Repeated answers and claims count once; null items and claims are left out.
    """
    u = draw(seed, "c", F.col("of"), F.col("claim"))
    placed = claims.select(F.col("item").alias("of"), "claim").where("of is not null and claim is not null").distinct().withColumn("u", u).withColumn("bucket", F.floor(F.col("u") * buckets).cast("int"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("u", "of", "claim")) - 1
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)  # at most ``buckets`` rows
    numbered = written(placed.withColumn("k", within).join(sizes.select("bucket", "before"), "bucket").select("of", "claim", (F.col("before") + F.col("k")).alias("i")), "numbered")
    own = numbered.groupBy(F.col("of").alias("item")).agg(F.array_sort(F.collect_list("i")).alias("own"))
    total = numbered.agg(F.count(F.lit(1))).scalar()
    none = F.array().cast("array<bigint>")
    each = answers.select("item").where("item is not null").distinct().join(own, "item", "left").withColumn("own", F.coalesce("own", none)).withColumn("m", total - F.size("own")).where("m > 0")
    start = F.floor(draw(seed, "b", F.col("item")) * F.col("m")).cast("long")
    turns = each.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(per_item), F.col("m")).cast("int") - 1), lambda j: F.pmod(start + j, F.col("m")))))
    at = F.aggregate("own", F.col("p").cast("long"), lambda g, o: F.when(o <= g, g + 1).otherwise(g))
    return turns.select("item", at.alias("i")).join(numbered, "i").select("item", "of", "claim")


def matched_returns(returns: DataFrame, claims: DataFrame, answers: DataFrame) -> DataFrame:
    """The rows of ``returns`` (item, claim) with state: matched, or by name what they refer to in vain: no such item, no such claim, no answer.

    ``claims`` has item, claim, ``answers`` item. Nulls refer to nothing. Rows come out as often as they went in.
    """
    items = claims.select("item").distinct().withColumn("__i", F.lit(True))
    known = claims.select("item", "claim").distinct().withColumn("__c", F.lit(True))
    answered = answers.select("item").distinct().withColumn("__a", F.lit(True))
    t = returns.join(items, "item", "left").join(known, ["item", "claim"], "left").join(answered, "item", "left")
    state = F.when(F.col("__i").isNull(), "no such item").when(F.col("__c").isNull(), "no such claim").when(F.col("__a").isNull(), "no answer").otherwise("matched")
    return t.withColumn("state", state).drop("__i", "__c", "__a")


def compare_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """class, expected, found, problem: full outer comparison of counts; problem is null where they agree."""
    n = actual.groupBy("class").agg(F.count(F.lit(1)).alias("found"))
    t = expected.select("class", "expected").join(n, "class", "full_outer").fillna(0, ["expected", "found"])
    return t.withColumn("problem", F.when(F.col("expected") != F.col("found"), F.concat(F.lit("expected "), "expected", F.lit(", found "), "found")))


# --- statistics of differences -------------------------------------------------------------------


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a share; null for n = 0."""
    p = hits / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    ok = n > 0
    return F.when(ok, F.round(mid - half, 6)), F.when(ok, F.round(mid + half, 6))


def sign_test(gains: Column, losses: Column) -> Column:
    """Two-sided exact sign test of gains against losses; 1 where there is neither."""
    n, low = gains + losses, F.least(gains, losses)
    # sum of binomial(n, i) for i up to the smaller count, in logarithms against overflow
    term = lambda i: F.exp(_log_choose(n, i) - n * F.log(F.lit(2.0)))
    p = F.aggregate(F.sequence(F.lit(0).cast("long"), low.cast("long")), F.lit(0.0), lambda a, i: a + term(i))
    return F.round(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * p)), 6)


def _log_choose(n: Column, k: Column) -> Column:
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((n - k + i).cast("double")) - F.log(i.cast("double")))


def rule_of_three(n: Column) -> Column:
    """Upper 95% limit of a rate after n trials without a case."""
    return F.when(n > 0, F.round(F.lit(3.0) / n, 6))


def paired_bootstrap(pairs: DataFrame, a: str, b: str, stratum: str, replicates: int = PAIRED_REPLICATES, seed: int = SEED) -> DataFrame:
    """lo, hi, replicates of the difference b - a of means, pairs drawn within strata."""
    return bootstrap(pairs.withColumn("__d", F.col(b) - F.col(a)), stratum, "__d", replicates, seed)


def split_of(key: Column, shares: dict[str, float], seed: int = SEED) -> Column:
    """The split a key falls in, by digest; shares add up to 1."""
    u, out, top = draw(seed, key), F.lit(list(shares)[-1]), 1.0
    for name in reversed(list(shares)[:-1]):
        top = sum(v for k, v in shares.items() if list(shares).index(k) <= list(shares).index(name))
        out = F.when(u < round(top, 12), name).otherwise(out)
    return out
