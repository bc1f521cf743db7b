"""Queries that measure labels, retrieval and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import measure, score, search
from strandline.plans import parse as pp
from strandline.plans import search as ps
from strandline.runtime import stored, table, written

# The configurations of the sweep (what is asked, and how many passages), the baseline, and the passages of a context.
CONFIGS = {"A": ("prompt", 50), "B": ("prompt", 200), "C": ("text", 50), "D": ("text", 200)}
BASELINE, CONTEXT = "A", 10
#: Ids that stand in several rows of an index and are broadcast, at most.
REPEATED_IDS = 300_000


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return measure.label_counts(table(spark, d, "chunk_index").dropDuplicates(["id"]))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d)


def span_specificity(spark: SparkSession, d: str) -> DataFrame:
    t = measure.specificity(measure.anchor_spans(table(spark, d, "frame_items")), _labels(spark, d))
    return t.select("anchor_id", "doc", "clause", "n", "of", "fraction", "band", "cause")


def span_bands(spark: SparkSession, d: str) -> DataFrame:
    return measure.band_counts(measure.specificity(measure.anchor_spans(table(spark, d, "frame_items")), _labels(spark, d)))


def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = measure.label_coverage(table(spark, d, "chunk_index").dropDuplicates(["id"]))
    return t.withColumn("generic_breaches", F.array_join("generic_breaches", " ")).withColumn("corpus_breaches", F.array_join("corpus_breaches", " ")).orderBy("severity", "clause", "doc")


def _contexts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(spans needed by the questions, context of each configuration): routed retrieval without repeats of a label and crumb, cut. Each text is searched once, for its deepest configuration."""
    q = stored(spark, "questions", d, ["frame_items"], lambda: ps.questions(spark, d))
    spans = measure.anchor_spans(table(spark, d, "frame_items")).join(q.select(F.col("qid").alias("anchor_id")), "anchor_id", "left_semi")
    return spans, stored(spark, "contexts", d, ["frame_items", "chunk_index"], lambda: _swept(spark, d, q))


def _swept(spark: SparkSession, d: str, q: DataFrame) -> DataFrame:
    docs, ix = ps.search_keys(spark, d), ps.chunk_index(spark, d)
    keys = docs.select("key", F.coalesce("doc_code", F.lit("")).alias("doc"), F.coalesce("clause", F.lit("")).alias("clause"), F.coalesce("crumb", F.lit("")).alias("crumb"))
    found = None
    for column in sorted({c for c, _ in CONFIGS.values()}):
        asked = q.select("qid", F.col(column).alias("text"))
        deepest = 2 * max(k for c, k in CONFIGS.values() if c == column)
        made: dict[str, DataFrame] = {}

        def lists(search: DataFrame, n: int, made: dict = made, deepest: int = deepest) -> dict[str, DataFrame]:
            made.update({} if made else ps.ranked_lists(ix, search, deepest))
            return {name: t.where(F.col("rank") < n) for name, t in made.items()}

        for name, (_, k) in [x for x in CONFIGS.items() if x[1][0] == column]:
            ranked = ps.routed(ix, asked, docs, k, lists).select("qid", "key", "rank").join(keys, "key")
            c = search.dedup_cut(ranked, ["doc", "clause", "crumb"], CONTEXT).select(F.lit(name).alias("config"), F.col("qid").alias("anchor_id"), F.trim("doc").alias("doc"), F.trim("clause").alias("clause"))
            found = c if found is None else found.unionByName(c)
    return found


def recall_sweep(spark: SparkSession, d: str) -> DataFrame:
    return measure.recall(measure.reached(*_contexts(spark, d)))


def gains_losses(spark: SparkSession, d: str) -> DataFrame:
    return measure.gains_losses(measure.reached(*_contexts(spark, d)), BASELINE)


def change_tests(spark: SparkSession, d: str) -> DataFrame:
    """config, gains, losses, p: the sign test of each configuration against the baseline."""
    hits = written(measure.reached(*_contexts(spark, d)), "hits")
    t = measure.gains_losses(hits, BASELINE).groupBy("config").agg(F.count_if(F.col("change") == "gain").alias("gains"), F.count_if(F.col("change") == "loss").alias("losses"))
    every = hits.select("config").distinct().where(F.col("config") != BASELINE)
    return every.join(t, "config", "left").fillna(0).withColumn("p", score.sign_test(F.col("gains"), F.col("losses")))


def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    """qid, recall, precision, mrr, ndcg at 10 of the documents the questions are anchored in."""
    docs = pp.chunks(spark, d).select("id", F.coalesce("doc_code", F.lit("")).alias("doc"))
    ranked = ps.tfidf_topk(spark, d).join(docs, "id").groupBy("qid", "doc").agg(F.min("rank").alias("rank")).withColumnRenamed("doc", "key")
    need = measure.anchor_spans(table(spark, d, "frame_items")).select(F.col("anchor_id").alias("qid"), F.col("doc").alias("key")).join(ps.questions(spark, d).select("qid"), "qid", "left_semi")
    return measure.rank_metrics(ranked, need, 10)


def _repeats(t: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key stands once, and those whose key may repeat. Only digests of keys are shuffled (null is a key); where too many repeat to be broadcast, all rows are the latter."""
    t = t.withColumn("__key", F.xxhash64(key))
    twice = written(t.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key"), "repeated")
    if twice.count() > REPEATED_IDS:
        return t.where("false").drop("__key"), t.drop("__key")
    t = t.join(F.broadcast(twice.withColumn("__again", F.lit(True))), "__key", "left").drop("__key")
    return t.where("__again is null").drop("__again"), t.where("__again").drop("__again")


def _searchable(spark: SparkSession, d: str) -> DataFrame:
    """id, doc, clause, text, one row an id; of texts only those of repeated ids are shuffled."""
    t = table(spark, d, "chunk_index").select("id", F.coalesce("doc_code", F.lit("")).alias("doc"), F.coalesce("clause", F.lit("")).alias("clause"), "text")
    once, again = _repeats(t, "id")
    return once.unionByName(again.dropDuplicates(["id"]))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """The distinct references of the frame; those of an item that stands once are so by their places and are not shuffled."""
    once, again = _repeats(table(spark, d, "frame_items").select("anchor_id", "claims", "_anchor"), "anchor_id")
    return measure.frame_refs(once).unionByName(measure.frame_refs(again).distinct())


def anchor_decisions(spark: SparkSession, d: str) -> DataFrame:
    """anchor_id, field, claim, ref, state, new, n_chunks for every reference of the frame."""
    t = measure.decide(_refs(spark, d), _searchable(spark, d))
    return t.select("anchor_id", "field", "claim", "ref", "state", "new", "n_chunks")


def decision_tally(spark: SparkSession, d: str) -> DataFrame:
    return anchor_decisions(spark, d).groupBy("field", "state").agg(F.count(F.lit(1)).alias("refs"))


def alias_decisions(spark: SparkSession, d: str) -> DataFrame:
    """anchor_id, field, claim, ref, renamed_from, state, new: the decisions where every handbook has a new code in the searched index, found by its file."""
    new = _searchable(spark, d).withColumn("doc", _renamed("doc"))
    files = table(spark, d, "chunk_index").groupBy("source_file").agg(F.min(F.coalesce("doc_code", F.lit(""))).alias("doc_code"))
    aliases = measure.doc_aliases(files, files.withColumn("doc_code", _renamed("doc_code")))
    t = measure.decide(_refs(spark, d), new, aliases)
    return t.select("anchor_id", "field", "claim", "ref", "renamed_from", "state", "new")


def _renamed(code: str) -> Column:
    return F.regexp_replace(code, "-HB-", "-GD-")


def specificity_top(spark: SparkSession, d: str) -> DataFrame:
    """anchor_id, doc, clause, fraction: the 20 spans whose label says least, of documents whose code contains -ST-."""
    t = span_specificity(spark, d).where(F.col("doc").contains("-ST-") & F.col("fraction").isNotNull())
    return t.orderBy(F.desc("fraction"), "anchor_id", "doc", "clause").limit(20).select("anchor_id", "doc", "clause", "fraction")


def migrated_frame(spark: SparkSession, d: str) -> DataFrame:
    """anchor_id, anchors, labels: the frame after migration, its evidence anchors and span labels."""
    frame = table(spark, d, "frame_items").dropDuplicates(["anchor_id"])
    decisions = measure.decide(measure.frame_refs(frame), _searchable(spark, d)).where("state = 'RELABELLED'")
    moved = measure.migrate(frame, written(decisions.select("anchor_id", "field", "claim", "ref", "doc", "state", "new"), "decisions"))
    anchors = F.flatten(F.transform("claims", lambda c: F.transform(c["evidence"], lambda e: F.coalesce(e["anchor"], F.lit("")))))
    labels = F.transform("_anchor.spans", lambda s: F.concat_ws(" ", F.coalesce(s["doc_code"], F.lit("")), F.coalesce(s["clause"], F.lit(""))))
    return moved.select("anchor_id", F.array_join(anchors, "|").alias("anchors"), F.array_join(labels, "|").alias("labels"))


_W = r"[\s\x0B\x{85}\p{Z}]"
_T = pp._trim
_D = "d0 as (select distinct on (id) * from chunk_index)"
_COUNTS = f"""with {_D}, k as (select coalesce({_T('doc_code')}, '') doc, coalesce({_T('clause')}, '') clause, substring(coalesce(section, ''), 1, 60) s from d0),
lc as (select doc, clause, count(*) n, count(distinct s) sections from k group by 1, 2), lab as (select doc, clause, n, sum(n) over (partition by doc)::bigint "of", sections from lc)"""
_SPANS = f"""sp as (select anchor_id, unnest(_anchor.spans) s from frame_items), an as (select distinct anchor_id, coalesce({_T('s.doc_code')}, '') doc, coalesce({_T('s.clause')}, '') clause from sp),
aa as (select * from an where doc <> '' or clause <> '')"""
_SPEC = _COUNTS + f""", {_SPANS}, dd as (select distinct doc, "of" from lab),
j as (select aa.anchor_id, aa.doc, aa.clause, case when dd."of" is not null then coalesce(lab.n, 0) end n, dd."of", sections from aa left join dd using (doc) left join lab on lab.doc = aa.doc and lab.clause = aa.clause),
sc as (select *, round(n / "of", 6) fraction, case when n is null then null when n / "of" <= 0.05 then 'specific' when n / "of" <= 0.2 then 'loose' when n / "of" <= 0.5 then 'degenerate' else 'free' end band,
  case when "of" is null then null when sections is null then 'unknown' when sections >= 10 then 'sticky-label' else 'large-clause' end cause from j)"""
_FLOORS = measure.GENERIC | measure.CORPUS_BOUND
_POP = {f: f"({f} is not null and len({f}) > 0)" if f in ("modals", "refs", "req_ids") else f"({f} is not null)" if f == "page_number" else f"({f} is not null and {f} <> '')" for f in _FLOORS}
_PAGE = "coalesce(element_type not in ('definition', 'abbreviation'), true)"
_AVG = lambda f: f"avg(case when {_PAGE if f == 'page_number' else 'true'} then {_POP[f]}::int end)"
_BELOW = lambda names: "array_to_string(list_sort(list_filter([" + ", ".join(f"case when {f} < {v} then '{f}' end" for f, v in names.items()) + "], lambda x: x is not null)), ' ')"
_NORM = lambda c: f"trim(lower(regexp_replace(coalesce({c}, ''), '{_W}+', ' ', 'g')))"
_REFS = f"""f as (select distinct anchor_id, claims, _anchor from frame_items),
cl as (select anchor_id, unnest(range(len(claims))) k, claims from f), ev as (select anchor_id, k, unnest(range(len(claims[k+1].evidence))) r, claims[k+1].evidence e from cl),
er as (select anchor_id, 'evidence' field, k::int claim, r::int ref, regexp_split_to_array({_T("coalesce(e[r+1].anchor, '')")}, '{_W}+') a, e[r+1].span span from ev),
sr as (select anchor_id, unnest(range(len(_anchor.spans))) r, _anchor.spans s from f),
refs as (select anchor_id, field, claim, ref, coalesce(a[1], '') doc, coalesce(a[2], '') clause, span from er union all
  select anchor_id, 'spans', -1, r::int, coalesce(s[r+1].doc_code, ''), coalesce(s[r+1].clause, ''), s[r+1].text from sr),
rn as (select *, {_NORM('span')} sn from refs), bn as (select id, coalesce(doc_code, '') doc, coalesce(clause, '') label, {_NORM('text')} body from d0 where coalesce(doc_code, '') <> ''),
h as (select anchor_id, field, claim, ref, list_sort(list_distinct(list(label))) labels, count(*) n from rn join bn on rn.doc = bn.doc and contains(body, sn) where sn <> '' group by 1, 2, 3, 4),
de as (select rn.anchor_id, rn.field, rn.claim, rn.ref, case when labels is null then 'UNRESOLVED' when len(labels) > 1 then 'AMBIGUOUS' when labels[1] <> clause then 'RELABELLED' else 'unchanged' end state,
  case when len(labels) = 1 then labels[1] else clause end "new", coalesce(n, 0) n_chunks from rn left join h using (anchor_id, field, claim, ref))"""
#: The decisions under new codes of handbooks.
_ALIASED = (
    _REFS.replace("rn as (select *,", "al as (select distinct c old_doc, replace(c, '-HB-', '-GD-') new_doc from (select source_file, min(coalesce(doc_code, '')) c from chunk_index group by 1) where contains(c, '-HB-')), rn as (select anchor_id, field, claim, ref, coalesce(new_doc, doc) doc, clause, span, old_doc renamed_from,")
    .replace("sn from refs)", "sn from refs left join al on al.old_doc = refs.doc)").replace("coalesce(doc_code, '') doc, coalesce(clause, '') label", "replace(coalesce(doc_code, ''), '-HB-', '-GD-') doc, coalesce(clause, '') label")
    .replace("when labels[1] <> clause then", "when labels[1] <> clause or renamed_from is not null then").replace("coalesce(n, 0) n_chunks from rn", "renamed_from from rn")
)
_SWEEP = ps._POSTS.replace("min(coalesce(question, prompt_as_typed, '')) text", "min(coalesce(question, prompt_as_typed, '')) text, min(coalesce(prompt_as_typed, concat_ws(' ', context, question))) prompt") + f""",
qa as (select qid, prompt as text from q), qb as (select qid, text from q), {ps.retrieve_sql('qa', 'y', (50, 200))}, {ps.retrieve_sql('qb', 'z', (50, 200))},
cf as (select 'A' config, qid, id, rank from y50 union all select 'B', qid, id, rank from y200 union all select 'C', qid, id, rank from z50 union all select 'D', qid, id, rank from z200),
cx as (select config, qid, rank, id, coalesce(doc_code, '') doc, coalesce(clause, '') clause, coalesce(crumb, '') crumb from cf join ch using (id)), cy as (select *, row_number() over (partition by config, qid, doc, clause, crumb order by rank, id) n from cx),
cz as (select *, row_number() over (partition by config, qid order by rank, id) place from cy where n = 1), have as (select distinct config, qid, trim(doc, ' ') doc, trim(clause, ' ') clause from cz where place <= {CONTEXT}),
{_SPANS}, need as (select c.config, aa.* from aa join q on q.qid = aa.anchor_id cross join (select distinct config from have) c),
hit as (select need.*, have.qid is not null hit from need left join have on have.config = need.config and have.qid = need.anchor_id and have.doc = need.doc and have.clause = need.clause),
gl as (select a.config, case when a.hit then 'gain' else 'loss' end change, a.anchor_id, a.doc, a.clause from hit a join hit b on b.config = 'A' and a.config <> 'A' and a.anchor_id = b.anchor_id and a.doc = b.doc and a.clause = b.clause where a.hit <> b.hit)"""

QUERIES = {
    "label_counts": label_counts, "span_specificity": span_specificity, "span_bands": span_bands, "label_coverage": label_coverage, "recall_sweep": recall_sweep, "gains_losses": gains_losses,
    "change_tests": change_tests, "rank_metrics": rank_metrics, "anchor_decisions": anchor_decisions, "decision_tally": decision_tally, "alias_decisions": alias_decisions, "specificity_top": specificity_top, "migrated_frame": migrated_frame,
}
SQL = {
    "label_counts": _COUNTS + " select * from lab",
    "span_specificity": _SPEC + ' select anchor_id, doc, clause, n, "of", fraction, band, cause from sc',
    "span_bands": _SPEC + """, b as (select unnest(['specific', 'loose', 'degenerate', 'free', 'unmeasurable']) band),
      m as (select coalesce(band, 'unmeasurable') band, count(*) spans, count(case when band in ('degenerate', 'free') and cause = 'sticky-label' then 1 end) sticky, count(case when band in ('degenerate', 'free') and cause = 'large-clause' then 1 end) large,
        count(case when band in ('degenerate', 'free') and cause = 'unknown' then 1 end) "unknown" from sc group by 1)
      select b.band, coalesce(spans, 0) spans, coalesce(sticky, 0) sticky, coalesce(large, 0) large, coalesce("unknown", 0) "unknown" from b left join m using (band)""",
    "label_coverage": f"""with {_D}, a as (select coalesce(doc_code, '') doc, count(*) passages, {', '.join(f'{_AVG(f)} a_{f}' for f in _FLOORS)} from d0 group by 1),
      b as (select doc, passages, {', '.join(f'a_{f} {f}' for f in _FLOORS)} from a), c as (select *, {_BELOW(measure.GENERIC)} generic_breaches, {_BELOW(measure.CORPUS_BOUND)} corpus_breaches from b)
      select doc, passages, {', '.join(f'round({f}, 6) {f}' for f in _FLOORS)}, generic_breaches, corpus_breaches, case when generic_breaches <> '' then 0 when corpus_breaches <> '' then 1 else 2 end severity,
      case when generic_breaches <> '' then 'PARSE PROBLEM' when corpus_breaches <> '' then 'PROFILE MISMATCH' else 'ok' end verdict from c""",
    "recall_sweep": _SWEEP + """, it as (select config, anchor_id, count(case when hit then 1 end) got, count(*) need from hit group by 1, 2)
      select config, sum(got)::bigint spans_reached, sum(need)::bigint spans_total, count(case when got = need then 1 end) items_all_spans, count(case when got = 0 then 1 end) items_no_span, count(*) items_total from it group by 1""",
    "gains_losses": _SWEEP + " select * from gl",
    "change_tests": _SWEEP + """, k as (select c config, count(case when change = 'gain' then 1 end) gains, count(case when change = 'loss' then 1 end) losses from (select distinct config c from hit where config <> 'A') left join gl on gl.config = c group by 1)
      select config, gains, losses, round(case when gains + losses = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(gains + losses + 1) - lgamma(i + 1) - lgamma(gains + losses - i + 1) - (gains + losses) * ln(2))) from (select unnest(range(least(gains, losses) + 1)) i))) end, 6) p from k""",
    "rank_metrics": ps._POSTS + f""", {_SPANS}, rk as (select qid, coalesce(doc_code, '') doc, min(rank) rank from cr join ch using (id) where rank < 10 group by 1, 2), nd as (select distinct anchor_id qid, doc from aa where anchor_id in (select qid from q)),
      n as (select qid, count(*) n from nd group by 1), h as (select qid, count(*) hits, min(rank) fst, sum(1.0 / log2(rank + 2)) dcg from rk join nd using (qid, doc) group by 1)
      select qid, round(coalesce(hits, 0) / n, 6) recall, round(coalesce(hits, 0) / 10, 6) "precision", round(coalesce(1.0 / (fst + 1), 0), 6) mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0 / log2(i + 1))), 6) ndcg from n left join h using (qid)""",
    "anchor_decisions": f"with {_D}, {_REFS} select * from de",
    "alias_decisions": f"with {_D}, {_ALIASED} select anchor_id, field, claim, ref, renamed_from, state, \"new\" from de",
    "specificity_top": _SPEC + " select anchor_id, doc, clause, fraction from sc where contains(doc, '-ST-') and fraction is not null order by fraction desc, anchor_id, doc, clause limit 20",
    "migrated_frame": f"""with {_D}, {_REFS}, mv as (select de.*, refs.doc from de join refs using (anchor_id, field, claim, ref) where state = 'RELABELLED'), fx as (select distinct on (anchor_id) * from frame_items),
      ce as (select anchor_id, unnest(range(len(claims))) k, claims from fx), ee as (select anchor_id, k, unnest(range(len(claims[k+1].evidence))) r, claims[k+1].evidence ev from ce),
      ae as (select ee.anchor_id, string_agg(coalesce(trim(mv.doc || ' ' || mv."new"), ev[r+1].anchor, ''), '|' order by k, r) a from ee left join mv on mv.field = 'evidence' and mv.anchor_id = ee.anchor_id and mv.claim = k and mv.ref = r group by 1),
      se as (select anchor_id, unnest(range(len(_anchor.spans))) r, _anchor.spans sp from fx), al as (select se.anchor_id, string_agg(coalesce(mv.doc, sp[r+1].doc_code, '') || ' ' || coalesce(mv."new", sp[r+1].clause, ''), '|' order by r) l from se left join mv on mv.field = 'spans' and mv.anchor_id = se.anchor_id and mv.ref = r group by 1)
      select fx.anchor_id, case when claims is not null then coalesce(a, '') end anchors, case when _anchor.spans is not null then coalesce(l, '') end labels from fx left join ae using (anchor_id) left join al using (anchor_id)""",
    "decision_tally": f"with {_D}, {_REFS} select field, state, count(*) refs from de group by 1, 2",
}
