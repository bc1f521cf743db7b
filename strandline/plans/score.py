"""Queries that score answers. Verdicts come from a stand-in for a judge: a claim is reached if one of its evidence labels is in the index, and unread without evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import models
from strandline.functions.ids import draw
from strandline.functions.parse import anchor_parts, verdict
from strandline.functions.text import trimmed
from strandline.operators import contract, score
from strandline.operators.search import round_robin
from strandline.runtime import table, written

WEIGHTS = {"multihop": 22, "lookup": 14, "definition": 14, "trace": 10}
SCORED = ["definition", "lookup", "multihop", "trace", "negative"]
#: Replicates of the queries: those of production.
B, PAIRS = score.REPLICATES, score.PAIRED_REPLICATES


def _frame(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frame_items").dropDuplicates(["anchor_id"])


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """item, class, claim, tier, text, verdict."""
    claims = _frame(spark, d).select(F.col("anchor_id").alias("item"), "class", F.posexplode("claims").alias("claim", "c"))
    ev = claims.select("item", "claim", F.explode("c.evidence").alias("e"))
    doc, clause = anchor_parts(F.col("e.anchor"))
    ev = ev.select("item", "claim", doc.alias("doc"), clause.alias("clause")).where("doc <> ''")
    c = table(spark, d, "chunk_index").select(trimmed(F.coalesce("doc_code", F.lit(""))).alias("doc"), trimmed(F.coalesce("clause", F.lit(""))).alias("clause"))
    held = c.union(c.select("doc", F.lit(""))).distinct().withColumn("held", F.lit(True))
    reached = ev.join(held, ["doc", "clause"], "left").groupBy("item", "claim").agg(F.bool_or(F.coalesce("held", F.lit(False))).alias("verdict"))
    return claims.select("item", "class", "claim", F.col("c.tier").alias("tier"), F.col("c.text").alias("text")).join(reached, ["item", "claim"], "left")


def item_coverage(spark: SparkSession, d: str) -> DataFrame:
    return score.item_coverage(verdicts(spark, d))


def class_means(spark: SparkSession, d: str) -> DataFrame:
    t = score.class_means(item_coverage(spark, d), SCORED[:-1])
    return t.withColumn("coverage", F.round("coverage", 6)).withColumn("all_required", F.round("all_required", 6))


def _weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "class string, weight int")


def macro(spark: SparkSession, d: str) -> DataFrame:
    return score.macro(score.class_means(item_coverage(spark, d), SCORED), _weights(spark))


def tier_means(spark: SparkSession, d: str) -> DataFrame:
    return score.mean_of_known(verdicts(spark, d), ["class", "tier"])


def bootstrap(spark: SparkSession, d: str, replicates: int = B) -> DataFrame:
    return score.bootstrap(written(item_coverage(spark, d), "items"), "class", "coverage", replicates)


def bootstrap_weighted(spark: SparkSession, d: str, replicates: int = B) -> DataFrame:
    return score.bootstrap(written(item_coverage(spark, d), "items"), "class", "coverage", replicates, weights=_weights(spark))


def class_blocks(spark: SparkSession, d: str, replicates: int = B) -> DataFrame:
    return score.class_blocks(written(item_coverage(spark, d), "items"), replicates)


def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row: items asked, dropped and kept, refusals and macro figures; an item with an even draw errs, one in ten refuses."""
    u = draw("run", F.col("item"))
    rows = item_coverage(spark, d).withColumn("error", F.when(u < 0.05, "timeout")).withColumn("refused", u > 0.9)
    return score.summary(rows, SCORED, _weights(spark))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a judge that errs in one of ten and cannot be read in one of a hundred."""
    u, m = draw("judge", F.col("item"), F.col("claim")), draw("matcher", F.col("item"), F.col("claim"))
    t = verdicts(spark, d).where("verdict is not null").withColumn("kind", F.when(F.col("tier") == "required", "reviewer").otherwise("constructed")).withColumn("label", (F.col("kind") == "reviewer") & F.col("verdict"))
    reply = F.when(u < 0.01, "cannot say").when((u < 0.1) != F.col("label"), "Yes, it does.").otherwise("NO")
    return t.withColumn("judge", verdict(reply)).withColumn("matcher", (m < 0.4) != F.col("label"))


def judge_validation(spark: SparkSession, d: str) -> DataFrame:
    return score.judge_validation(_labels(spark, d))


def judge_by_class(spark: SparkSession, d: str) -> DataFrame:
    t = _labels(spark, d).withColumn("kind", F.when(F.col("label"), "control").otherwise("truncated"))
    return score.hard_negative_rates(t, ["class"])


def to_read(spark: SparkSession, d: str) -> DataFrame:
    return score.to_read(_labels(spark, d)).select("item", "claim")


def arms(spark: SparkSession, d: str) -> DataFrame:
    t = item_coverage(spark, d).withColumn("arm", F.when(F.col("class") == "negative", "figure_only").otherwise("text_control"))
    return score.arm_verdict(t)


def wilson(spark: SparkSession, d: str) -> DataFrame:
    t = verdicts(spark, d).where("verdict is not null").groupBy("class").agg(F.count_if("verdict").alias("hits"), F.count(F.lit(1)).alias("n"))
    lo, hi = score.wilson(F.col("hits"), F.col("n"))
    return t.withColumn("lo", lo).withColumn("hi", hi).withColumn("none_upper", score.rule_of_three(F.col("n")))


def splits(spark: SparkSession, d: str) -> DataFrame:
    s = score.split_of(F.col("anchor_id"), {"development": 0.5, "frozen": 0.3, "challenge": 0.2})
    return _frame(spark, d).select("anchor_id", s.alias("split"))


def negatives(spark: SparkSession, d: str) -> DataFrame:
    """item, of, claim: claims of other items for each item."""
    v = verdicts(spark, d).select("item", "claim")
    return score.constructed_negatives(v.select("item").distinct(), v)


def frame_problems(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.createDataFrame([("definition", 44), ("lookup", 40), ("multihop", 32), ("trace", 40), ("absent", 3)], "class string, expected long")
    return score.compare_counts(_frame(spark, d), expected)


def truncated_claims(spark: SparkSession, d: str) -> DataFrame:
    t = verdicts(spark, d).select("item", "claim", contract.truncate_claim(F.col("text")).alias("t"))
    return t.where("t is not null").select("item", "claim", "t.head", "t.tail")


def matched_returns(spark: SparkSession, d: str) -> DataFrame:
    """item, claim, state: what judgements that came back refer to; one in twenty names no item, another one no claim, and a tenth of the items have no answer."""
    v = verdicts(spark, d).select("item", "claim")
    u = draw("return", F.col("item"), F.col("claim"))
    back = v.select(F.when(u < 0.05, F.concat(F.lit("no-"), "item")).otherwise(F.col("item")).alias("item"), F.when((u >= 0.05) & (u < 0.1), F.col("claim") + 1000).otherwise(F.col("claim")).alias("claim"))
    return score.matched_returns(back, v, v.select("item").distinct().where(draw("answer", F.col("item")) >= 0.1))


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """class, rejected, kept, verdict: a judge that plugs in (here one that looks for every word) asked for whole claims in answers that are truncated claims, and in answers that are the claims."""
    t = verdicts(spark, d).select("class", F.col("text").alias("whole"), contract.truncate_claim(F.col("text")).alias("t")).where("t is not null")
    asked = t.select("class", "whole", F.explode(F.array(F.struct(F.lit("truncated").alias("kind"), F.col("t.head").alias("answer")), F.struct(F.lit("control").alias("kind"), F.col("whole").alias("answer")))).alias("a")).select("class", "whole", "a.*")
    return score.hard_negative_rates(asked.withColumn("judge", verdict(models.judge(models.containing_judge)(F.col("whole"), F.col("answer")))), ["class"])


def paired_bootstrap(spark: SparkSession, d: str, replicates: int = PAIRS) -> DataFrame:
    t = written(item_coverage(spark, d).where("coverage is not null"), "items").withColumn("other", F.when(draw("pair", F.col("item")) < 0.2, 0.0).otherwise(F.col("coverage")))
    return score.paired_bootstrap(t, "coverage", "other", "class", replicates)


def asked_in_turn(spark: SparkSession, d: str) -> DataFrame:
    """class, items: how the first 50 items taken in turn spread over the classes."""
    return round_robin(_frame(spark, d).select("anchor_id", "class"), "anchor_id", "class", 50).groupBy("class").agg(F.count(F.lit(1)).alias("items"))


_W = r"[\s\x0B\x{85}\p{Z}]"
_T = lambda c: f"regexp_replace(regexp_replace({c}, '^{_W}+', ''), '{_W}+$', '')"
_DRAW = lambda *p: "(('0x' || substring(md5(concat_ws('|', " + ", ".join(p) + ")), 1, 8))::bigint / 4294967296.0::double)"
_V = f"""with f as (select distinct on (anchor_id) * from frame_items), c as (select anchor_id item, class, unnest(range(len(claims))) claim, claims from f),
e as (select item, claim, regexp_split_to_array({_T("coalesce(x.anchor, '')")}, '{_W}+') a from (select item, claim, unnest(claims[claim+1].evidence) x from c)),
b as (select distinct coalesce({_T('doc_code')}, '') doc, coalesce({_T('clause')}, '') clause from chunk_index), held as (select doc, clause from b union select doc, '' from b),
r as (select item, claim, bool_or(held.doc is not null) verdict from e left join held on held.doc = a[1] and held.clause = coalesce(a[2], '') where coalesce(a[1], '') <> '' group by 1, 2),
v as (select c.item, c.class, c.claim::int claim, claims[c.claim+1].tier tier, claims[c.claim+1].text text, verdict from c left join r on r.item = c.item and r.claim = c.claim),
ic as (select item, class, count(*) n_required, round(case when count(*) = count(verdict) then avg(verdict::int) end, 6) coverage from v where tier = 'required' group by 1, 2),
it as (select *, coverage = 1.0 all_required from ic),
cm as (select class, count(*) n, avg(coverage) coverage, avg(all_required::int) all_required from it where coverage is not null group by 1)"""
def mixed_sql(x: str) -> str:
    """The columns of a 32-bit mixer, ``f5`` the last, for SQL that lets a column use those before it."""
    return f"({x})::ubigint f0, xor(f0, f0 >> 16) f1, (f1 * 2246822507) % 4294967296 f2, xor(f2, f2 >> 13) f3, (f3 * 3266489909) % 4294967296 f4, xor(f4, f4 >> 16) f5"


def _boot(values: str, replicates: int) -> str:
    """CTEs: the mean of each replicate in each stratum of a relation of c, v, drawn item by item."""
    return f""", nu as (select c, v, row_number() over (partition by c order by v) - 1 i, count(*) over (partition by c) n from {values}), st as (select c, r, n::ubigint n, ('0x' || substring(md5('42|' || c || '|' || r), 1, 8))::ubigint b from (select distinct c, n from nu), (select unnest(range({replicates})) r)),
sl as (select c, r, n, b, unnest(range(n::bigint))::ubigint s from st), dr as (select c, r, {mixed_sql('(b + s * 2654435769) % 4294967296')}, ((f5 * n) // 4294967296)::bigint i from sl), me as (select dr.c, r, avg(v) m from dr join nu using (c, i) group by 1, 2)"""


_BOOT = _boot("(select class c, coverage v from it where coverage is not null)", B)
_W8 = "(select unnest(['multihop', 'lookup', 'definition', 'trace']) c, unnest([22, 14, 14, 10]) w)"
_ENDS = lambda src, n=B: f"select round(list_sort(list(m))[{int(0.025 * n) + 1}], 6) lo, round(list_sort(list(m))[{int(0.975 * n)}], 6) hi, count(*)::int replicates from ({src})"
_MACRO = "count(*) classes, round(avg(coverage), 6) macro, round(case when sum(w) > 0 then sum(coalesce(w, 0) * coverage) / sum(w) end, 6) weighted, round(avg(all_required), 6) macro_all_required"
_L = _V + f""", j as (select *, {_DRAW("'judge'", 'item', 'claim')} u, {_DRAW("'matcher'", 'item', 'claim')} mu, case when tier = 'required' then 'reviewer' else 'constructed' end kind from v where verdict is not null),
la as (select *, (kind = 'reviewer' and verdict) label from j), lj as (select *, case when u < 0.01 then null else (u < 0.1) <> label end judge, (mu < 0.4) <> label matcher from la)"""
_PREP = "[" + ", ".join(f"'{w}'" for w in contract.PREPOSITIONS) + "]"
_VERBS = "[" + ", ".join(f"'{w}'" for w in contract.VERBS) + "]"
_DANGLING = "[" + ", ".join(f"'{w}'" for w in contract.DANGLING) + "]"
_SHARE = lambda hit, of: f"round(count(case when {of} and {hit} then 1 end) / nullif(count(case when {of} then 1 end), 0), 6)"

QUERIES = {
    "item_coverage": item_coverage, "class_means": class_means, "macro_coverage": macro, "tier_means": tier_means, "bootstrap_macro": bootstrap, "bootstrap_weighted": bootstrap_weighted, "class_blocks": class_blocks,
    "benchmark_summary": benchmark_summary, "judge_validation": judge_validation, "judge_by_class": judge_by_class, "to_read": to_read, "arm_verdict": arms, "wilson_intervals": wilson, "frame_splits": splits,
    "constructed_negatives": negatives, "frame_problems": frame_problems, "truncated_claims": truncated_claims, "matched_returns": matched_returns, "hard_negatives": hard_negatives, "paired_bootstrap": paired_bootstrap, "asked_in_turn": asked_in_turn,
}
SQL = {
    "item_coverage": _V + " select * from it",
    "class_means": _V + " select class, n, round(coverage, 6) coverage, round(all_required, 6) all_required, case when class not in ('definition', 'lookup', 'multihop', 'trace') then 'not a scored class' when n < 3 then 'n=' || n || ' < 3' end why, class in ('definition', 'lookup', 'multihop', 'trace') and n >= 3 scored from cm",
    "macro_coverage": _V + f" select {_MACRO} from cm left join {_W8} on c = class where n >= 3",
    "tier_means": _V + " select class, tier, count(verdict) n, round(avg(verdict::int), 6) coverage from v group by 1, 2",
    "bootstrap_macro": _V + _BOOT + _ENDS("select r, round(avg(m), 9) m from me group by 1"),
    "bootstrap_weighted": _V + _BOOT + _ENDS(f"select r, round(sum(w * m) / sum(w), 9) m from me join {_W8} using (c) group by 1"),
    "class_blocks": _V + _BOOT + f""", ci as (select c, round(list_sort(list(round(m, 9)))[{int(0.025 * B) + 1}], 6) lo, round(list_sort(list(round(m, 9)))[{int(0.975 * B)}], 6) hi from me group by 1)
      select class, n, round(coverage, 6) coverage, round(all_required, 6) all_required, case when n >= 20 then lo end lo, case when n >= 20 then hi end hi, case when n < 20 then 'n=' || n || ' < 20' end withheld from cm left join ci on c = class""",
    "benchmark_summary": _V + f""", x as (select *, {_DRAW("'run'", 'item')} u from it),
      k as (select class, count(*) n, avg(coverage) coverage, avg(all_required::int) all_required from x where u >= 0.05 and coverage is not null group by 1), m as (select {_MACRO} from k left join {_W8} on c = class where n >= 3)
      select (select count(*) from x) asked, (select count(*) from x where u < 0.05) dropped_error, (select count(*) from x where u >= 0.05 and coverage is null) dropped_unparseable, (select count(*) from x where u >= 0.05 and coverage is not null) kept,
      (select count(*) from x where u > 0.9 and coverage is not null) refusals, m.* from m""",
    "judge_validation": _L + f""", t as (select count(*) pairs, count(case when judge is null then 1 end) unparseable, count(case when kind = 'reviewer' and judge is not null and label then 1 end) positives, count(case when kind = 'reviewer' and judge is not null and not label then 1 end) negatives,
      count(case when kind = 'constructed' and judge is not null then 1 end) constructed, {_SHARE('judge', "kind = 'reviewer' and judge is not null and label")} recall, {_SHARE('matcher', "kind = 'reviewer' and judge is not null and label")} matcher_recall,
      {_SHARE('judge', "kind = 'constructed' and judge is not null")} false_positive, {_SHARE('matcher', "kind = 'constructed' and judge is not null")} matcher_false_positive, {_SHARE('not judge', "kind = 'reviewer' and judge is not null and not label")} agreement from lj)
      select *, case when positives < 400 or negatives < 10 or constructed < 300 then 'SMOKE' when coalesce(recall, 0) >= 0.9 and coalesce(false_positive, 0) <= 0.05 and unparseable = 0 then 'ACCEPTED' else 'NOT ACCEPTED' end verdict from t""",
    "judge_by_class": _L + f", t as (select class, {_SHARE('not judge', 'not label')} rejected, {_SHARE('judge', 'label')} kept from lj where judge is not null group by 1) select *, case when rejected >= 0.8 and kept >= 0.95 then 'pass' else 'fail' end verdict from t",
    "to_read": _L + " select item, claim from lj where kind = 'constructed' and judge",
    "arm_verdict": _V + """, a as (select round(avg(case when class <> 'negative' then coverage end), 4) control, round(avg(case when class = 'negative' then coverage end), 4) figure from it)
      select *, case when control is null or control < 0.6 then 'inconclusive: controls failed' when figure is null then 'inconclusive: no figure item judged' when figure < control then 'gap confirmed' else 'prediction did not hold' end verdict from a""",
    "wilson_intervals": _V + """, w as (select class, count(case when verdict then 1 end) hits, count(*) n from v where verdict is not null group by 1), z as (select *, 1.959963984540054 z, hits / n p from w)
      select class, hits, n, round((p + z*z/(2*n)) / (1 + z*z/n) - z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n)), 6) lo, round((p + z*z/(2*n)) / (1 + z*z/n) + z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n)), 6) hi, round(3.0 / n, 6) none_upper from z""",
    "frame_splits": f"select distinct anchor_id, case when {_DRAW('42', 'anchor_id')} < 0.5 then 'development' when {_DRAW('42', 'anchor_id')} < 0.8 then 'frozen' else 'challenge' end split from frame_items",
    "frame_problems": """with a as (select class, count(distinct anchor_id) found from frame_items group by 1), e as (select unnest(['definition', 'lookup', 'multihop', 'trace', 'absent']) class, unnest([44, 40, 32, 40, 3])::bigint expected)
      select class, coalesce(expected, 0) expected, coalesce(found, 0) found, case when coalesce(expected, 0) <> coalesce(found, 0) then 'expected ' || coalesce(expected, 0) || ', found ' || coalesce(found, 0) end problem from e full join a using (class)""",
    "constructed_negatives": _V + f""", nu as (select item "of", claim, row_number() over (order by {_DRAW('42', "'c'", 'item', 'claim')}, item, claim) - 1 i from v), an as (select distinct item from v),
      ow as (select an.item, coalesce(list_sort(list(i) filter (where i is not null)), []) own, (select count(*) from nu) - count(i) m from an left join nu on nu."of" = an.item group by 1),
      tu as (select item, own, (floor({_DRAW('42', "'b'", 'item')} * m)::bigint + j) % m p from (select *, unnest(range(least(3, m))) j from ow where m > 0)),
      ps as (select item, list_reduce(own, lambda g, o: case when o <= g then g + 1 else g end, p) i from tu) select item, "of", claim from ps join nu using (i)""",
    "paired_bootstrap": _V + f""", pa as (select class c, round(case when {_DRAW("'pair'", 'item')} < 0.2 then 0.0 else coverage end - coverage, 6) v from it where coverage is not null)""" + _boot("pa", PAIRS) + " " + _ENDS("select r, round(avg(m), 9) m from me group by 1", PAIRS),
    "truncated_claims": _V + f""", t as (select item, claim, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') t from v), w as (select *, list_transform(t, lambda x: lower(regexp_extract(x, '[A-Za-z][A-Za-z0-9''-]*'))) w from t),
      a as (select *, list_filter(range(len(t) - {contract.TAIL_TOKENS}, {contract.HEAD_TOKENS - 1}, -1), lambda i: list_contains({_PREP}, w[i + 1]) and list_has_any(w[1:i], {_VERBS}) and not list_contains({_DANGLING}, w[i])
        and len(string_split(rtrim(regexp_replace(array_to_string(t[1:i], ' '), '[,;: ]+$', '')), ' ')) >= {contract.HEAD_TOKENS})[1] k from w)
      select item, claim, rtrim(regexp_replace(array_to_string(t[1:k], ' '), '[,;: ]+$', '')) head, array_to_string(t[k + 1:], ' ') tail from a where k is not null""",
    "matched_returns": _V + f""", rr as (select item, claim, {_DRAW("'return'", 'item', 'claim')} u from v), x as (select case when u < 0.05 then 'no-' || item else item end item, case when u >= 0.05 and u < 0.1 then claim + 1000 else claim end claim, u from rr),
      i as (select distinct item, {_DRAW("'answer'", 'item')} >= 0.1 answered from v)
      select x.item, x.claim, case when i.item is null then 'no such item' when v.item is null then 'no such claim' when not answered then 'no answer' else 'matched' end state from x left join i on i.item = x.item left join v on v.item = x.item and v.claim = x.claim""",
    "hard_negatives": _V + f""", t as (select item, claim, class, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') t from v), w as (select *, list_transform(t, lambda x: lower(regexp_extract(x, '[A-Za-z][A-Za-z0-9''-]*'))) w from t),
      a as (select *, list_filter(range(len(t) - {contract.TAIL_TOKENS}, {contract.HEAD_TOKENS - 1}, -1), lambda i: list_contains({_PREP}, w[i + 1]) and list_has_any(w[1:i], {_VERBS}) and not list_contains({_DANGLING}, w[i])
        and len(string_split(rtrim(regexp_replace(array_to_string(t[1:i], ' '), '[,;: ]+$', '')), ' ')) >= {contract.HEAD_TOKENS})[1] k from w),
      h as (select class, list_transform(t, lambda x: lower(x)) c, list_transform(string_split(rtrim(regexp_replace(array_to_string(t[1:k], ' '), '[,;: ]+$', '')), ' '), lambda x: lower(x)) head from a where k is not null),
      rt as (select class, round(avg((not list_has_all(head, c))::int), 6) rejected, round(avg(list_has_all(c, c)::int), 6) kept from h group by 1) select *, case when rejected >= 0.8 and kept >= 0.95 then 'pass' else 'fail' end verdict from rt""",
    "asked_in_turn": """with t as (select distinct on (anchor_id) anchor_id, class from frame_items), r as (select *, row_number() over (partition by class order by anchor_id) turn from t), k as (select * from r order by turn, class, anchor_id limit 50) select class, count(*) items from k group by 1""",
}
