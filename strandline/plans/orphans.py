"""References of the question frame against the searchable chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import WHITE, filled, trimmed
from strandline.operators.orphans import key_hash, orphan_references
from strandline.runtime import micros, table


def frame_references(frame: DataFrame) -> DataFrame:
    """One row a reference: anchor_id, field, claim_no, ref_no, doc, clause, drawn_at. References without a document are none."""
    base = frame.select("anchor_id", "drawn_at", F.col("_anchor.spans").alias("spans"), "claims")
    spans = base.select("anchor_id", "drawn_at", F.posexplode("spans").alias("ref_no", "s")).select(
        "anchor_id", F.lit("spans").alias("field"), F.lit(-1).cast("long").alias("claim_no"), F.col("ref_no").cast("long").alias("ref_no"),
        filled(F.col("s.doc_code")).alias("doc"), filled(F.col("s.clause")).alias("clause"), "drawn_at",
    )
    pieces = F.split(trimmed(F.col("e.anchor")), rf"{WHITE}+")
    evidence = base.select("anchor_id", "drawn_at", F.posexplode("claims").alias("claim_no", "c")).select(
        "anchor_id", "drawn_at", "claim_no", F.posexplode("c.evidence").alias("ref_no", "e")
    ).select(
        "anchor_id", F.lit("evidence").alias("field"), F.col("claim_no").cast("long").alias("claim_no"), F.col("ref_no").cast("long").alias("ref_no"),
        filled(F.get(pieces, F.lit(0))).alias("doc"), filled(F.get(pieces, F.lit(1))).alias("clause"), "drawn_at",
    )
    return spans.unionByName(evidence).where("doc is not null")


def judged_references(spark: SparkSession, d: str) -> DataFrame:
    refs = frame_references(table(spark, d, "frame_items"))
    refs = refs.select("anchor_id", "field", "claim_no", "ref_no", F.date_format("drawn_at", "yyyy-MM").alias("month"), key_hash(F.col("doc"), F.col("clause")).alias("key"), micros(refs, "drawn_at").alias("at")).distinct()
    chunks = table(spark, d, "chunk_index")
    rows = chunks.select(filled(F.col("doc_code")).alias("doc"), filled(F.col("clause")).alias("clause"), micros(chunks, "ingested_at").alias("born"), micros(chunks, "deleted_at").alias("gone")).where("doc is not null")
    keys = F.array(key_hash(F.col("doc"), F.lit(None)), F.when(F.col("clause").isNotNull(), key_hash(F.col("doc"), F.col("clause"))))
    parents = rows.select(F.explode(F.array_compact(keys)).alias("key"), "born", "gone")
    return orphan_references(refs, parents)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return judged_references(spark, d).where("kind is not null").select("anchor_id", "field", "claim_no", "ref_no", "kind").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Per field and month: references, and how many of each kind are orphans."""
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    return judged_references(spark, d).groupBy("field", "month").agg(F.count(F.lit(1)).alias("refs"), count("missing"), count("late"), count("deleted"))


#: White space of any kind, for RE2.
W = r"[\s\x0B\x{85}\p{Z}]"
_TRIM = lambda c: f"nullif(regexp_replace(regexp_replace({c}, '^{W}+', ''), '{W}+$', ''), '')"
_JUDGED = f"""
with f as (select distinct anchor_id, drawn_at, claims, _anchor from frame_items),
s as (select anchor_id, drawn_at, unnest(range(len(_anchor.spans))) r, _anchor.spans sp from f),
c as (select anchor_id, drawn_at, unnest(range(len(claims))) k, claims from f),
e as (select anchor_id, drawn_at, k, unnest(range(len(claims[k+1].evidence))) r, claims[k+1].evidence ev from c),
ea as (select anchor_id, drawn_at, k, r, regexp_split_to_array({_TRIM('ev[r+1].anchor')}, '{W}+') a from e),
refs as (
  select anchor_id, 'spans' field, -1::bigint claim_no, r::bigint ref_no, {_TRIM('sp[r+1].doc_code')} doc, {_TRIM('sp[r+1].clause')} clause, drawn_at from s
  union all select anchor_id, 'evidence', k::bigint, r::bigint, a[1], a[2], drawn_at from ea),
ch as (select {_TRIM('doc_code')} doc, {_TRIM('clause')} clause, ingested_at b, deleted_at g from chunk_index),
m as (select r.anchor_id, r.field, r.claim_no, r.ref_no, r.drawn_at, count(ch.doc) n,
    count(case when b <= drawn_at then 1 end) begun, count(case when b <= drawn_at and (g is null or g > drawn_at) then 1 end) alive
  from refs r left join ch on ch.doc = r.doc and (r.clause is null or ch.clause = r.clause) where r.doc is not null group by all),
j as (select *, case when n = 0 then 'missing' when begun = 0 then 'late' when alive = 0 then 'deleted' end kind from m)
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": _JUDGED + "select distinct anchor_id, field, claim_no, ref_no, kind from j where kind is not null",
    "p5_report": _JUDGED + "select field, strftime(drawn_at, '%Y-%m') as month, count(*) refs, count(case when kind='missing' then 1 end) missing, count(case when kind='late' then 1 end) late, count(case when kind='deleted' then 1 end) deleted from j group by 1, 2",
}
