"""Queries on references between documents, on acronyms and modals, and streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import parse
from strandline.functions.profile import MODAL
from strandline.functions.text import filled, trimmed
from strandline.operators import contract, graph
from strandline.plans import parse as pp
from strandline.plans import search as ps
from strandline.runtime import shared_path, table, written
from strandline.sources import files, sinks
from strandline.streaming import tables

REFUSAL = "The sources do not"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(table(spark, d, "chunk_index").dropDuplicates(["id"]))


def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def reference_closure(spark: SparkSession, d: str) -> DataFrame:
    """doc, step: the documents the items of the frame are anchored in, what these refer to, and what that refers to, to the end."""
    seeds = table(spark, d, "frame_items").select(F.explode("_anchor.spans").alias("s")).select(filled(F.col("s.doc_code")).alias("doc"))
    return graph.closure(seeds, written(_edges(spark, d), "edges"))


def closure_growth(spark: SparkSession, d: str) -> DataFrame:
    return graph.growth(reference_closure(spark, d))


def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "chunk_index").where("deleted_at is null").select(trimmed(F.col("doc_code")).alias("doc"))
    return graph.dangling(_edges(spark, d), held)


def acronym_collisions(spark: SparkSession, d: str) -> DataFrame:
    return graph.acronym_collisions(pp.acronyms(spark, d))


def modal_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """id, lost, added, faithful: the modals noted for a chunk against those in its body."""
    t = pp.chunks(spark, d).select("id", F.col("modals").alias("source_modals"), parse.modals(F.col("body")).alias("answer_modals"))
    out = graph.modal_fidelity(t)
    return out.select("id", F.array_join("lost", " ").alias("lost"), F.array_join("added", " ").alias("added"), "faithful")


def fabricated_citations(spark: SparkSession, d: str) -> DataFrame:
    """qid, doc: anchored documents of a question that its context does not hold."""
    docs = pp.chunks(spark, d).select("id", F.coalesce("doc_code", F.lit("")).alias("doc"))
    held = ps.deduplicated(spark, d).join(docs, "id").select("qid", "doc")
    cited = table(spark, d, "frame_items").select(F.col("anchor_id").alias("qid"), F.explode("_anchor.spans").alias("s")).select("qid", F.coalesce("s.doc_code", F.lit("")).alias("doc"))
    return graph.fabricated(cited.join(ps.questions(spark, d).select("qid"), "qid", "left_semi"), held)


def responses(spark: SparkSession, d: str) -> DataFrame:
    """anchor_id, status, problems: stand-in responses made of the frame's items, held against the contract."""
    f = table(spark, d, "frame_items").dropDuplicates(["anchor_id"])
    src = F.transform("_anchor.spans", lambda s: F.struct(s["doc_code"].alias("doc"), s["clause"].alias("clause")))
    ranked = F.transform(F.filter("_anchor.spans", lambda s: s["doc_code"].isNotNull()), lambda s: F.struct(s["point_id"].alias("point_id")))
    answer = F.when(F.col("class") == "negative", F.lit(REFUSAL + " say.")).otherwise(F.get("claims", F.lit(0))["text"])
    error = F.when(F.col("status") == "retired", "retired")
    t = f.select("anchor_id", answer.alias("answer"), src.alias("sources"), ranked.alias("ranked"), error.alias("error"), (F.size("claims") / 4).alias("confidence"))
    t = contract.normalised(t.withColumn("status", contract.status_of(F.col("answer"), F.col("error"), REFUSAL)))
    return t.select("anchor_id", "status", F.array_join(contract.problems(t), "; ").alias("problems"))


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return sinks.stats(table(spark, d, "chunk_index"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """start, event_type, n, total by hour, from a stream over the events file."""
    schema = table(spark, d, "events").schema
    at = shared_path(spark, "events")
    source = tables.read_stream(spark, f"{d}/events.parquet", schema)
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    tables.run_to_table(tables.windowed_counts(source, "ts", ["event_type"], "1 hour"), f"{at}/out", f"{at}/check")
    t = spark.read.parquet(f"{at}/out")
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    """start, event_type, n by windows of two hours that begin every hour."""
    t = tables.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "2 hours", "1 hour")
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """user_id, sessions, longest: sessions of users that end after 30 minutes without events."""
    t = tables.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "30 minutes")
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def document_items(spark: SparkSession, d: str) -> DataFrame:
    """label, items, characters: the items of all documents read as Markdown."""
    t = files.parse_items(table(spark, d, "documents"), "doc_id", "text", "md")
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("text")).alias("characters"))


_E = f"""with d0 as (select distinct on (id) * from chunk_index), e0 as (select id, {pp._trim('doc_code')} src, unnest(list_distinct(refs)) dst from d0 where doc_code is not null),
ed as (select src, dst, count(*) n from e0 where src <> '' and src <> dst group by 1, 2)"""
_CL = _E.replace("with d0", "with recursive d0", 1) + f""", sd as (select distinct {pp._trim('s.doc_code')} doc from (select unnest(_anchor.spans) s from frame_items) where {pp._trim('s.doc_code')} <> ''),
cl(doc, step) using key (doc) as (select doc, 0 from sd union select dst, min(step) + 1 from cl join ed on ed.src = cl.doc where dst not in (select doc from recurring.cl) group by 1), cm as (select doc, step from cl)"""

QUERIES = {
    "reference_edges": reference_edges, "reference_closure": reference_closure, "closure_growth": closure_growth, "dangling_references": dangling_references, "acronym_collisions": acronym_collisions,
    "modal_fidelity": modal_fidelity, "fabricated_citations": fabricated_citations, "response_problems": responses, "collection_stats": collection_stats, "event_windows": event_windows, "event_sliding": event_sliding,
    "event_sessions": event_sessions, "document_items": document_items,
}
SQL = {
    "reference_edges": _E + " select src, dst, 'refers' as type, n from ed",
    "reference_closure": _CL + " select doc, step from cm",
    "closure_growth": _CL + " select step, count(*) as new from cm group by 1",
    "dangling_references": _E + f""", held as (select distinct {pp._trim('doc_code')} doc from chunk_index where deleted_at is null), g as (select src, count(*) edges, count(case when doc is null then 1 end) dangling from ed left join held on doc = dst group by 1)
      select *, round(dangling / edges, 6) rate, case when dangling = 0 then 'GREEN' when dangling / edges <= 0.2 then 'AMBER' else 'RED' end colour from g""",
    "acronym_collisions": pp.SQL["acronyms"].replace("select doc, short, arg_min", ", ac as (select doc, short, arg_min").rstrip() + """), x as (select short, lower(trim(expansion)) e, count(distinct doc) docs from ac group by 1, 2),
      s as (select short, sum(docs)::bigint documents, count(*) meanings, min(e) "first", max(e) "last" from x group by 1 having count(*) > 1),
      p as (select distinct a.short from x a join x b on a.short = b.short and a.e < b.e where not list_has_any(string_split(a.e, ' '), string_split(b.e, ' '))) select short, documents, meanings, "first", "last" from s join p using (short)""",
    "modal_fidelity": pp.CHUNKS + f""", m as (select id, coalesce(modals, []) s, list_distinct(regexp_extract_all(lower(body), '{MODAL}')) a from ch),
      k as (select id, array_to_string(list_sort(list_filter(list_distinct(s), lambda x: not list_contains(a, x))), ' ') lost, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(s, x))), ' ') added from m)
      select *, lost = '' and added = '' faithful from k""",
    "fabricated_citations": ps._DEDUP + """, he as (select distinct qid, coalesce(doc_code, '') doc from z join ch using (id) where place < 5), ci as (select distinct anchor_id qid, coalesce(s.doc_code, '') doc from (select anchor_id, unnest(_anchor.spans) s from frame_items) where anchor_id in (select qid from q))
      select ci.qid, ci.doc from ci anti join he on he.qid = ci.qid and he.doc = ci.doc""",
    "response_problems": f"""with f as (select distinct on (anchor_id) * from frame_items), r as (select anchor_id, case when class = 'negative' then '{REFUSAL} say.' else claims[1].text end answer, _anchor.spans s, list_filter(_anchor.spans, lambda x: x.doc_code is not null) k,
        case when status = 'retired' then 'retired' end error, len(claims) / 4 conf, claims from f),
      t as (select *, case when error is not null then null when starts_with(ltrim(coalesce(answer, '')), '{REFUSAL}') then 'insufficient_evidence' else 'supported_answer' end status from r)
      select anchor_id, status, case when error is not null then '' else array_to_string(list_filter([case when answer is null then 'missing required field: answer' end, case when s is null then 'missing required field: sources' end, case when k is null then 'missing required field: ranked' end,
        case when status is null then 'missing required field: status' end, case when len(list_filter(s, lambda x: x.doc_code is null)) > 0 then 'every source needs doc' end, case when len(list_filter(s, lambda x: x.clause is null)) > 0 then 'every source needs clause' end,
        case when len(list_filter(k, lambda x: x.point_id is null)) > 0 then 'every ranked entry needs point_id' end, case when len(k) < len(s) then 'ranked is shorter than sources' end, case when not (conf between 0 and 1) then 'confidence is not in 0..1' end], lambda x: x is not null), '; ') end problems from t""",
    "collection_stats": "select count(*) points, count(distinct doc_code) documents from chunk_index",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2",
    "event_sliding": "select strftime(date_trunc('hour', ts) - to_hours(k), '%Y-%m-%d %H:%M') as start, event_type, count(*) n from events, (select unnest([0, 1]) k) group by 1, 2",
    "document_items": f"""with l as (select doc_id, unnest(string_split(text, chr(10))) x, unnest(range(len(string_split(text, chr(10))))) n from documents),
      k as (select *, {pp._trim('x')} t, case when starts_with({pp._trim('x')}, '|') then 'table' when starts_with(x, '#') then 'section_header' when {pp._trim('x')} <> '' then 'text' end label from l),
      g as (select doc_id, n - row_number() over (partition by doc_id order by n) g, length(t) c from k where label = 'table'), tb as (select doc_id, g, sum(c) + count(*) - 1 c from g group by 1, 2),
      a as (select 'table' label, c from tb union all select label, length(case when label = 'text' then t else {pp._trim("ltrim(x, '#')")} end) from k where label in ('text', 'section_header'))
      select label, count(*) items, sum(c)::bigint characters from a group by 1""",
    "event_sessions": """with a as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end b from events), s as (select user_id, ts, sum(b) over (partition by user_id order by ts, b desc) k from a),
      g as (select user_id, k, count(*) n from s group by 1, 2) select user_id, count(*) sessions, max(n) longest from g group by 1""",
}
