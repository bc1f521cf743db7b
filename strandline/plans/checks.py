"""Queries of checks and of figures that join reach and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import models
from strandline.functions.ids import draw
from strandline.functions.parse import verdict
from strandline.functions.text import trimmed
from strandline.operators import measure, search, validate
from strandline.plans import measure as pm
from strandline.plans import parse as pp
from strandline.plans import score as pc
from strandline.plans import search as ps
from strandline.runtime import table, written


def frame_check(spark: SparkSession, d: str) -> DataFrame:
    return validate.frame_problems(table(spark, d, "frame_items"), {"definition": 40, "lookup": 40, "multihop": 30, "trace": 40, "negative": 50}, 200)


def coverage_by_reach(spark: SparkSession, d: str) -> DataFrame:
    hits = measure.reached(*pm._contexts(spark, d)).where("config = 'A'")
    return validate.by_reach(hits, pc.item_coverage(spark, d))


def recall_by_role(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "frame_items").select("anchor_id", F.explode("_anchor.spans").alias("s"))
    roles = s.groupBy("anchor_id", trimmed(F.coalesce("s.doc_code", F.lit(""))).alias("doc"), trimmed(F.coalesce("s.clause", F.lit(""))).alias("clause")).agg(F.min("s.role").alias("role"))
    return validate.recall_by_role(measure.reached(*pm._contexts(spark, d)), roles)


def item_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of items over four stand-in runs that lose a random tenth of the items each."""
    items = pc.item_coverage(spark, d).where("coverage is not null")
    runs = items.withColumn("run", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    return validate.item_statistics(runs.select("run", "item", F.when(draw("loss", F.col("item"), F.col("run")) < 0.1, 0.0).otherwise(F.col("coverage")).alias("score")))


def answer_rates(spark: SparkSession, d: str) -> DataFrame:
    v = pc.verdicts(spark, d).groupBy("item", "class").agg(F.count(F.lit(1)).alias("claims"), F.count_if(~F.coalesce("verdict", F.lit(True))).alias("unsupported"))
    t = v.withColumn("critical", (F.col("unsupported") > 0) & (draw("crit", F.col("item")) < 0.2)).withColumn("false_premise", F.col("class") == "negative").withColumn("accepted_premise", draw("prem", F.col("item")) < 0.3)
    return validate.answer_rates(t)


def sample_power(spark: SparkSession, d: str, replicates: int = 1_000) -> DataFrame:
    """The power of a comparison with as many spans as the frame has to see a gain of five points over 80 percent."""
    n = measure.anchor_spans(table(spark, d, "frame_items")).count()
    return validate.power(spark, n, 0.80, 0.05, replicates)


def probe_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """probes, found, verdict: does every code, asked alone, give a chunk of its document first? Asked are all codes as they stand; one that is no code of the corpus's form is asked in vain."""
    docs = ps.search_keys(spark, d).where("doc_code is not null").select("key", "doc_code", "clause")
    q = docs.select(F.col("doc_code").alias("qid")).distinct().select("qid", search.route(F.col("qid")).alias("r")).select("qid", "r.kind", "r.a", "r.b")
    hit = search.filtered_or_wider(q.where("kind = 'identifier'"), docs).groupBy("qid").agg(F.min("key").alias("key")).join(docs.select("key", "doc_code"), "key")
    good = F.coalesce(F.col("qid") == F.col("doc_code"), F.lit(False))
    t = q.select("qid").join(hit, "qid", "left").agg(F.count(F.lit(1)).alias("probes"), F.count_if(good).alias("found"))
    return t.withColumn("verdict", validate.passes(F.col("found") / F.greatest("probes", F.lit(1)), 1.0))


def probe_sections(spark: SparkSession, d: str) -> DataFrame:
    """probes, dropped, top5, verdict: is a text found by its heading, where that heading is alone in the corpus? Asked are the texts whose number is divisible by 50; headings below 8 characters are named dropped."""
    c = pp.chunks(spark, d).where("element_type = 'text' and clause is not null and clause <> '' and length(body) > 400").select("id", "clause", "doc_code", F.substring_index("section", " > ", -1).alias("heading"))
    alone = c.groupBy(F.lower("heading").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    asked = written(c.join(alone.select("id"), "id", "left_semi").where(ps.every_one(F.col("id"))), "asked")
    lists = ps.ranked_lists(ps.chunk_index(spark, d), asked.where("length(heading) >= 8").select(F.col("id").alias("qid"), F.col("heading").alias("text")), 5)
    same = lists["dense"].join(ps.search_keys(spark, d).select("key", F.col("doc_code").alias("dk"), F.col("clause").alias("ck")), "key").join(asked.select(F.col("id").alias("qid"), "doc_code", "clause"), "qid")
    good = same.where(F.col("doc_code").eqNullSafe(F.col("dk")) & (F.col("clause") == F.col("ck"))).select("qid").distinct().agg(F.count(F.lit(1)).alias("top5"))
    n = asked.agg(F.count_if(F.length("heading") >= 8).alias("probes"), F.count_if(F.length("heading") < 8).alias("dropped"))
    return n.withColumn("one", F.lit(1)).join(good.withColumn("one", F.lit(1)), "one").drop("one").withColumn("verdict", validate.passes(F.lit(0.0), 0))


def encoded_topk(spark: SparkSession, d: str) -> DataFrame:
    """qid, id, rank: dense search with an encoder that plugs in (here the hashing stand-in) over all chunks."""
    encode = models.embedder(models.HashEncoder)
    docs = pp.chunks(spark, d).select(F.col("id").alias("key"), encode(F.col("body")).alias("vector"))
    q = ps.questions(spark, d).select("qid", encode(F.col("text")).alias("vector"))
    return search.dense_top_k(written(q, "encoded"), docs, ps.K).select("qid", F.col("key").alias("id"), "rank")


def model_rerank(spark: SparkSession, d: str) -> DataFrame:
    """qid, id, rank, first_rank: the encoded list ordered by a scorer that plugs in (here word overlap)."""
    t = encoded_topk(spark, d).withColumnRenamed("id", "key").join(pp.chunks(spark, d).select(F.col("id").alias("key"), "body"), "key").join(ps.questions(spark, d).select("qid", "text"), "qid")
    scored = written(t.withColumn("s", models.scorer(models.overlap_scorer)(F.col("text"), F.col("body"))), "scored")
    return search.rerank(scored, F.col("s")).select("qid", F.col("key").alias("id"), "rank", "first_rank")


def judged_claims(spark: SparkSession, d: str) -> DataFrame:
    """verdict, claims: claims judged by a judge that plugs in (here one that looks for every word) against the text of their first evidence span."""
    c = table(spark, d, "frame_items").dropDuplicates(["anchor_id"]).select(F.explode("claims").alias("c"))
    t = c.select(F.col("c.text").alias("claim"), F.get("c.evidence", F.lit(0))["span"].alias("answer"))
    reply = models.judge(models.containing_judge)(F.col("claim"), F.coalesce("answer", F.lit("")))
    return t.withColumn("reply", reply).groupBy(verdict(F.col("reply")).alias("verdict")).agg(F.count(F.lit(1)).alias("claims"))


#: The stand-in encoder in SQL: signed units at places picked by digests of the words, as single floats, and the cosine of all pairs.
_VECTOR = lambda c, k, src: f"""select {k}, list(v / nullif(sqrt(n), 0)) v from (select {k}, i, coalesce(s, 0)::double v, sum(coalesce(s, 0) * coalesce(s, 0)) over (partition by {k}) n from (select {k}, unnest(range(64)) i from {src})
  left join (select {k}, h % 64 i, sum(case when h >= 9223372036854775808 then 1 else -1 end) s from (select {k}, ('0x' || substring(md5(w), 1, 16))::ubigint h from (select {k}, unnest(regexp_extract_all(lower({c}), '\\S+')) w from {src})) group by 1, 2) using ({k}, i)) group by 1"""  # noqa: E731
_ENCODED = pp.CHUNKS + ", " + ps._Q + f""", dv0 as ({_VECTOR('body', 'id', 'ch').replace("list(v / nullif(sqrt(n), 0))", "list((v / sqrt(n))::float::double order by i)")}), qv0 as ({_VECTOR('text', 'qid', 'q').replace("list(v / nullif(sqrt(n), 0))", "list((v / sqrt(n))::float::double order by i)")}),
en as (select qid, id, row_number() over (partition by qid order by s desc, id) - 1 rank from (select qid, id, round(list_cosine_similarity(q.v, d.v), 9) s from qv0 q, dv0 d where not isnan(q.v[1]) and not isnan(d.v[1])))"""
_IT = "(select distinct on (anchor_id) * from frame_items)"
QUERIES = {
    "frame_check": frame_check, "coverage_by_reach": coverage_by_reach, "recall_by_role": recall_by_role, "item_statistics": item_statistics, "answer_rates": answer_rates, "sample_power": sample_power,
    "probe_identifiers": probe_identifiers, "probe_sections": probe_sections, "encoded_topk": encoded_topk, "model_rerank": model_rerank, "judged_claims": judged_claims,
}
SQL = {
    "frame_check": """with i as (select anchor_id, count(*) n, min(class) class, max(coalesce(len(list_filter(claims, lambda c: c.tier = 'required')), 0)) req from frame_items group by 1),
      p as (select coalesce(anchor_id, '(no id)') subject, unnest(list_filter([case when anchor_id is null then 'no id' end, case when n > 1 then 'written more than once' end, case when class is null then 'no class' end, case when req = 0 then 'no required claim' end], lambda x: x is not null)) problem from i),
      e as (select unnest(['definition', 'lookup', 'multihop', 'trace', 'negative']) class, unnest([40, 40, 30, 40, 50])::bigint expected), f as (select class, count(*) found from i group by 1),
      c as (select 'class ' || coalesce(class, '(none)') subject, 'expected ' || coalesce(expected, 0) || ', found ' || coalesce(found, 0) problem from e full join f using (class) where coalesce(expected, 0) <> coalesce(found, 0)),
      t as (select 'total' subject, 'expected 200, found ' || count(*) problem from i having count(*) <> 200) select * from p union all select * from c union all select * from t""",
    "recall_by_role": pm._SWEEP + f""", ro as (select anchor_id, coalesce({pp._trim('s.doc_code')}, '') doc, coalesce({pp._trim('s.clause')}, '') clause, min(s.role) role from (select anchor_id, unnest(_anchor.spans) s from frame_items) group by 1, 2, 3)
      select config, coalesce(role, 'none') role, count(*) spans, count(case when hit then 1 end) reached, round(count(case when hit then 1 end) / count(*), 6) recall from hit left join ro using (anchor_id, doc, clause) group by 1, 2""",
    "coverage_by_reach": pm._SWEEP + ", " + pc._V.removeprefix("with ") + """, rc as (select anchor_id, case when count(*) = count(case when hit then 1 end) then 'all' when bool_or(hit) then 'some' else 'none' end reach from hit where config = 'A' group by 1)
      select reach, count(*) items, round(avg(coverage), 6) coverage from rc join it on it.item = rc.anchor_id group by 1""",
    "item_statistics": pc._V + f""", s as (select item, run, case when {pc._DRAW("'loss'", 'item', 'run')} < 0.1 then 0.0 else coverage end score from it, (select unnest([0, 1, 2, 3]) run) where coverage is not null), m as (select run, avg(score) m from s group by 1),
      w as (select item, score, m, (score = 1.0) <> lag(score = 1.0) over (partition by item order by run) flip from s join m using (run))
      select item, count(*) runs, round(avg(score), 6) difficulty, round(covar_pop(score, m) / nullif(stddev_pop(score) * stddev_pop(m), 0), 4) + 0.0::double discrimination, coalesce(sum(flip::int), 0)::bigint flips from w group by 1""",
    "answer_rates": pc._V + f""", a as (select item, class, count(*) claims, count(case when not coalesce(verdict, true) then 1 end) unsupported from v group by 1, 2),
      br as (select *, unsupported > 0 and {pc._DRAW("'crit'", 'item')} < 0.2 critical, class = 'negative' fp, {pc._DRAW("'prem'", 'item')} < 0.3 ap from a)
      select count(*) answers, round(sum(unsupported) / nullif(sum(claims), 0), 6) unsupported_claims, round(count(case when critical then 1 end) / count(*), 6) critical, round(count(case when fp and ap then 1 end) / nullif(count(case when fp then 1 end), 0), 6) false_premise_accepted from br""",
    "judged_claims": """with c as (select unnest(claims) c from (select distinct on (anchor_id) claims from frame_items)), w as (select regexp_extract_all(lower(coalesce(c.text, '')), '\\S+') a, regexp_extract_all(lower(coalesce(c.evidence[1].span, '')), '\\S+') b from c)
      select list_has_all(b, a) verdict, count(*) claims from w group by 1""",
    "sample_power": f"""with {pm._SPANS}, n as (select count(*) n from aa), rs as (select r, ('0x' || substring(md5('42|' || r), 1, 8))::ubigint b from (select unnest(range(1000)) r)), t as (select r, b, n, unnest(range(n))::ubigint s from rs, n),
      m2 as (select r, n, {pc.mixed_sql('(b + (2 * s + 1) * 2654435769) % 4294967296')}, f5 v, s from t), w as (select r, s, n, {pc.mixed_sql('(b + 2 * s * 2654435769) % 4294967296')}, f5 u from t),
      g as (select w.r, w.n, count(case when not u / 4294967296 < 0.8 and v / 4294967296 < 0.85 then 1 end) up, count(case when u / 4294967296 < 0.8 and not v / 4294967296 < 0.85 then 1 end) down from w join m2 on m2.r = w.r and m2.s = w.s group by 1, 2)
      select max(n)::int n, 0.8::double base, 0.05::double gain, round(avg(((up - down) / sqrt(greatest(up + down, 1)) > 1.959963984540054)::int), 6) power from g""",
    "encoded_topk": _ENCODED + f"select qid, id, rank from en where rank < {ps.K}",
    "model_rerank": _ENCODED + f""", ov as (select en.qid, en.id, en.rank, len(list_intersect(q.s, d.s)) / nullif(len(q.s), 0) o from en join (select qid, list_distinct(regexp_extract_all(lower(text), '\\S+')) s from q) q on q.qid = en.qid join (select id, list_distinct(regexp_extract_all(lower(body), '\\S+')) s from ch) d on d.id = en.id where rank < {ps.K})
      select qid, id, row_number() over (partition by qid order by coalesce(o, 0) desc, rank, id) - 1 rank, rank first_rank from ov""",
    "probe_identifiers": pp.CHUNKS + f""", pq as (select distinct doc_code qid, doc_code as text from ch where doc_code is not null), pr as {ps.route_sql("pq", ", qid")},
      h as (select qid, arg_min(ch.doc_code, ch.id) got from pr join ch on ch.doc_code = pr.a where kind = 'identifier' and (b is null or clause = b or not exists (select 1 from ch c2 where c2.doc_code = pr.a and c2.clause = pr.b)) group by 1)
      select count(*) probes, count(case when got = qid then 1 end) found, case when count(case when got = qid then 1 end) / greatest(count(*), 1) >= 1.0 then 'PASS' else 'FAIL' end verdict from pq left join h using (qid)""",
    "probe_sections": ps._POSTS.replace(ps._Q, f"""hc as (select id, clause, doc_code, string_split(section, ' > ')[-1] heading from ch where element_type = 'text' and clause is not null and clause <> '' and length(body) > 400),
      al as (select min(id) id from hc group by lower(heading) having count(*) = 1), ak as (select * from hc where id in (select id from al) and ('0x' || substring(id, 1, 8))::bigint % {ps.EVERY} = 0), q as (select id qid, heading as text from ak where length(heading) >= 8)""") + """,
      g as (select distinct qid from cr join ch on ch.id = cr.id join ak on ak.id = cr.qid where rank < 5 and ch.doc_code is not distinct from ak.doc_code and ch.clause = ak.clause)
      select (select count(*) from q) probes, (select count(*) from ak where length(heading) < 8) dropped, (select count(*) from g) top5, 'observed' verdict""",
}
