"""Checks before a run, and figures that join what was reached with what was scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.ids import mixed


def frame_problems(frame: DataFrame, counts: dict[str, int], total: int | None = None) -> DataFrame:
    """subject, problem: every reason not to run on a frame, by name: items written twice, without class or required claim, classes and totals that are not as registered."""
    spark = frame.sparkSession
    required = F.size(F.filter(F.coalesce("claims", F.array().cast(dict(frame.dtypes)["claims"])), lambda c: c["tier"] == "required"))
    item = frame.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("class"), F.max(required).alias("required"))
    bad = lambda cond, text: F.when(cond, F.lit(text))
    named = item.select(F.coalesce("anchor_id", F.lit("(no id)")).alias("subject"), F.explode(F.array_compact(F.array(
        bad(F.col("anchor_id").isNull(), "no id"), bad(F.col("n") > 1, "written more than once"), bad(F.col("class").isNull(), "no class"), bad(F.col("required") == 0, "no required claim"),
    ))).alias("problem"))
    found = item.groupBy("class").agg(F.count(F.lit(1)).alias("found"))
    want = spark.createDataFrame(list(counts.items()) or [("", 0)], "class string, expected long")
    c = want.join(found, "class", "full_outer").fillna(0, ["expected", "found"]).where("expected <> found")
    wrong = c.select(F.concat(F.lit("class "), F.coalesce("class", F.lit("(none)"))).alias("subject"), F.concat(F.lit("expected "), "expected", F.lit(", found "), "found").alias("problem"))
    out = named.unionByName(wrong)
    if total is not None:
        t = item.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != total)
        out = out.unionByName(t.select(F.lit("total").alias("subject"), F.concat(F.lit(f"expected {total}, found "), "n").alias("problem")))
    return out


def weight_problems(weights: dict[str, int], denominator: int, scored: list[str], unscored: list[str]) -> list[str]:
    """What is wrong with weights: keys that are not the scored classes, a sum that is not the denominator, classes on both lists."""
    out = [f"no weight for {c}" for c in sorted(set(scored) - set(weights))] + [f"weight for {c}, which is not scored" for c in sorted(set(weights) - set(scored))]
    if sum(weights.values()) != denominator:
        out.append(f"weights add up to {sum(weights.values())}, not {denominator}")
    return out + [f"{c} is scored and unscored" for c in sorted(set(scored) & set(unscored))]


def malformed_probes(probes: DataFrame, arms: tuple[str, str] = ("figure_only", "text_control")) -> DataFrame:
    """id, problem of probes without question or claims or with an unknown arm."""
    checks = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("question"), F.lit("")) == "", F.lit("no question")), F.when(F.coalesce(F.size("claims"), F.lit(0)) <= 0, F.lit("no claims")),
        F.when(~F.coalesce(F.col("arm").isin(*arms), F.lit(False)), F.lit("unknown arm")),
    ))
    return probes.select("id", F.explode(checks).alias("problem"))


def require_accepted(validation: DataFrame) -> None:
    """Refuse to go on unless the one row of a judge validation says ACCEPTED."""
    rows = validation.select("verdict").take(2)
    if [r[0] for r in rows] != ["ACCEPTED"]:
        raise RuntimeError(f"the judge is not accepted: {[r[0] for r in rows] or 'no validation'}")


def by_reach(hits: DataFrame, items: DataFrame) -> DataFrame:
    """reach, items, coverage: mean coverage of items whose spans were all, partly or not at all in context. ``hits`` has anchor_id, hit; ``items`` item, coverage."""
    r = hits.groupBy("anchor_id").agg(F.count_if("hit").alias("got"), F.count(F.lit(1)).alias("need"))
    reach = F.when(F.col("got") == F.col("need"), "all").when(F.col("got") > 0, "some").otherwise("none")
    t = r.select(F.col("anchor_id").alias("item"), reach.alias("reach")).join(items.select("item", "coverage"), "item")
    return t.groupBy("reach").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("coverage"), 6).alias("coverage"))


def recall_by_role(hits: DataFrame, roles: DataFrame) -> DataFrame:
    """config, role, spans, reached, recall: ``roles`` has anchor_id, doc, clause, role; spans without one count as 'none'."""
    t = hits.join(roles.dropDuplicates(["anchor_id", "doc", "clause"]), ["anchor_id", "doc", "clause"], "left").withColumn("role", F.coalesce("role", F.lit("none")))
    return t.groupBy("config", "role").agg(F.count(F.lit(1)).alias("spans"), F.count_if("hit").alias("reached")).withColumn("recall", F.round(F.col("reached") / F.col("spans"), 6))


def item_statistics(scores: DataFrame) -> DataFrame:
    """item, runs, difficulty, discrimination, flips: over runs of the same items (run, item, score).

    Difficulty is the mean score; discrimination the correlation with the mean of the run; flips
    how often the score moves from 1 to less or back between consecutive runs.
    """
    run_mean = scores.groupBy("run").agg(F.avg("score").alias("m"))
    passed = F.col("score") == 1.0
    t = scores.join(run_mean, "run").withColumn("flip", (passed != F.lag(passed).over(Window.partitionBy("item").orderBy("run"))).cast("int"))
    corr = F.try_divide(F.covar_pop("score", "m"), F.stddev_pop("score") * F.stddev_pop("m"))
    return t.groupBy("item").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("score"), 6).alias("difficulty"), (F.round(corr, 4) + 0.0).alias("discrimination"), F.coalesce(F.sum("flip"), F.lit(0)).alias("flips")
    )


def answer_rates(answers: DataFrame) -> DataFrame:
    """One row of rates over answers: unsupported claims, answers with a critical one, false premises accepted. ``answers`` has claims, unsupported, critical, false_premise, accepted_premise."""
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return answers.agg(
        F.count(F.lit(1)).alias("answers"), share(F.sum("unsupported"), F.sum("claims")).alias("unsupported_claims"), share(F.count_if("critical"), F.count(F.lit(1))).alias("critical"),
        share(F.count_if(F.col("false_premise") & F.col("accepted_premise")), F.count_if("false_premise")).alias("false_premise_accepted"),
    )


def power(spark, n: int, base: float, gain: float, replicates: int = 1_000, z: float = 1.959963984540054, seed: int = 42) -> DataFrame:  # noqa: ANN001
    """n, base, gain, power: the share of simulated pairs of runs over n spans in which an improvement by ``gain`` is significant by the normal form of the sign test.

    Each span is reached at random before and after; both outcomes come from a stream of random numbers for each run.
    """
    t = spark.range(replicates * n).select((F.col("id") / n).cast("long").alias("r"), (F.col("id") % n).alias("i"))
    first = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("r"))), 1, 8), 16, 10).cast("long")
    starts = spark.range(replicates).select(F.col("id").alias("r")).withColumn("s", first)
    t = t.join(F.broadcast(starts), "r")  # one row a replicate
    u = lambda k: mixed(F.col("s"), 2 * F.col("i") + k) / F.lit(float(2**32))
    before, after = u(0) < base, u(1) < base + gain
    g = t.groupBy("r").agg(F.count_if(~before & after).alias("up"), F.count_if(before & ~after).alias("down"))
    hit = (F.col("up") - F.col("down")) / F.sqrt(F.greatest(F.col("up") + F.col("down"), F.lit(1))) > z
    return g.agg(F.lit(n).alias("n"), F.lit(base).alias("base"), F.lit(gain).alias("gain"), F.round(F.avg(hit.cast("double")), 6).alias("power"))


def passes(share: Column, threshold: float) -> Column:
    """PASS or FAIL at a threshold; a threshold of 0 only observes."""
    return F.lit("observed") if threshold == 0 else F.when(share >= threshold, "PASS").otherwise("FAIL")
