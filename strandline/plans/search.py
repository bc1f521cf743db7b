"""Queries of the search side. Searched are all chunks, by every question whose number is divisible by 50."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.profile import DEFAULT, TOKEN
from strandline.operators import index, search
from strandline.plans import parse as pp
from strandline.runtime import stored, table, written

K = 10
EVERY = 50


def number(anchor: Column) -> Column:
    return F.regexp_extract(anchor, r"([0-9]+)$", 1).cast("long")


def every_one(uid: Column, every: int = EVERY) -> Column:
    """Whether the number that a chunk id is (its first 8 hexadecimal digits) is divisible."""
    return F.conv(F.substring(uid, 1, 8), 16, 10).cast("long") % every == 0


def questions(spark: SparkSession, d: str, every: int = EVERY) -> DataFrame:
    """qid, text, prompt: the questions that search."""
    t = table(spark, d, "frame_items").where(number(F.col("anchor_id")) % every == 0)
    prompt = F.coalesce("prompt_as_typed", F.concat_ws(" ", "context", "question"))
    return t.groupBy(F.col("anchor_id").alias("qid")).agg(F.min(F.coalesce("question", "prompt_as_typed", F.lit(""))).alias("text"), F.min(prompt).alias("prompt"))


INDEXED = ["chunk_index"]


@dataclass(frozen=True)
class SearchIndex:
    """What a search reads: idf (term, idf) and vectors (key, terms, tf, w) of all texts."""

    idf: DataFrame
    vectors: DataFrame

    @classmethod
    def of(cls, posts: DataFrame) -> SearchIndex:
        idf = index.idf(posts)
        return cls(idf, index.search_vectors(posts, idf))


def chunk_index(spark: SparkSession, d: str) -> SearchIndex:
    """The search index of all chunks, made once."""
    vectors = stored(spark, "terms", d, INDEXED, lambda: index.term_vectors(pp.chunks(spark, d), "id", "body"))
    idf = stored(spark, "idf", d, INDEXED, lambda: index.idf_of_vectors(vectors))
    return SearchIndex(idf, stored(spark, "vectors", d, INDEXED, lambda: index.unit_vectors(vectors, idf)))


def _asked(ix: SearchIndex, texts: DataFrame) -> DataFrame:
    """qid, term, tf, w of a table of qid, text; the weights are those of the terms that the index has."""
    posts = written(index.postings(texts.select("qid", "text"), "qid", "text").select("key", "term", "tf"), "asked")
    known = index.weighted(posts, ix.idf).select("key", "term", "w")
    return posts.join(known, ["key", "term"], "left").select(F.col("key").alias("qid"), "term", "tf", F.coalesce("w", F.lit(0.0)).alias("w"))


def ranked_lists(ix: SearchIndex, texts: DataFrame, k: int) -> dict[str, DataFrame]:
    """The ranked lists of a table of qid, text: TF-IDF cosine in the place of a dense encoder, and hashed-TF dot product; both from one pass over the index."""
    t = written(search.sparse_lists(_asked(ix, texts), ix.vectors, k, {"dense": ("w", "w"), "sparse": ("tf", "tf")}), "lists")
    return {n: t.where(F.col("list") == n).select("qid", "key", "score", "rank") for n in ("dense", "sparse")}


def _sparse(ix: SearchIndex, texts: DataFrame, k: int) -> DataFrame:
    return search.sparse_lists(index.postings(texts, "qid", "text").withColumnRenamed("key", "qid"), ix.vectors, k, {"sparse": ("tf", "tf")}).select("qid", "key", "score", "rank")


def _cosines(ix: SearchIndex, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """qid, key, score: the TF-IDF cosine of every given pair that shares a term."""
    q = _asked(ix, texts).select("qid", "term", F.col("w").alias("qw"))
    # the rows of the pairs are read from the index; each meets the terms of its own query only
    each = ix.vectors.join(pairs, "key").select("qid", "key", F.explode(F.arrays_zip("terms", "w")).alias("p")).select("qid", "key", F.col("p.terms").alias("term"), "p.w")
    return each.join(q, ["qid", "term"]).groupBy("qid", "key").agg(F.round(F.sum(F.col("w") * F.col("qw")), 9).alias("score"))


def routed(ix: SearchIndex, texts: DataFrame, docs: DataFrame, k: int, lists: Callable | None = None) -> DataFrame:
    """qid, key, rank, route, score: routed retrieval for a table of qid, text over an index."""
    return search.retrieve(texts, lists or (lambda q, n: ranked_lists(ix, q, n)), docs, k, exact=lambda q, pairs: _cosines(ix, q, pairs))


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(chunk_index(spark, d), questions(spark, d), K).select("qid", F.col("key").alias("id"), "score", "rank")


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    ix = chunk_index(spark, d)
    t = search.sparse_lists(_asked(ix, questions(spark, d)), ix.vectors, K, {"dense": ("w", "w")})
    return t.select("qid", F.col("key").alias("id"), F.round("score", 6).alias("score"), "rank")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """qid, vec_id, score, rank over the embeddings; the queries are the vectors whose id is divisible by 50."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    t = search.dense_top_k(e.where(F.col("key") % EVERY == 0).select(F.col("key").alias("qid"), "vector"), e, K)
    return t.select("qid", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def fused(spark: SparkSession, d: str) -> DataFrame:
    lists = ranked_lists(chunk_index(spark, d), questions(spark, d), 2 * K)
    t = search.fuse({"dense": (lists["dense"], search.W_DENSE), "sparse": (lists["sparse"], search.W_SPARSE)}, K)
    return t.select("qid", F.col("key").alias("id"), F.round("score", 9).alias("score"), "rank", "dense_rank", "sparse_rank")


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """qid, id, rank, place: the sparse list without repeats of (doc_code, clause), cut to 5."""
    keys = pp.chunks(spark, d).select(F.col("id").alias("key"), "doc_code", "clause")
    t = _sparse(chunk_index(spark, d), questions(spark, d), K).join(keys, "key")
    return search.dedup_cut(t, ["doc_code", "clause"], 5).select("qid", F.col("key").alias("id"), "rank", "place")


def probes(spark: SparkSession, d: str) -> DataFrame:
    """text: questions of every kind: as asked, every code alone and with a clause, and questions about terms."""
    c = table(spark, d, "chunk_index")
    asked = table(spark, d, "frame_items").select(F.col("question").alias("text")).unionByName(table(spark, d, "eval_items").select(F.col("question").alias("text")))
    code = c.select(F.lower("doc_code").alias("text")).unionByName(c.select(F.concat_ws(" clause ", "doc_code", "clause").alias("text")))
    code = code.unionByName(c.select(F.concat(F.lit("what does "), "doc_code", F.lit(" say")).alias("text")))
    short = pp.acronyms(spark, d).select(F.concat(F.lit("What does "), "short", F.lit(" stand for?")).alias("text"))
    head = F.lower(F.regexp_replace(F.substring_index("section", " > ", -1), r"^[0-9A-Z.]+ ", ""))
    term = c.select(F.concat(F.lit("what is the "), head, F.lit("?")).alias("text")).unionByName(c.select(F.concat(F.lit("define "), head).alias("text")))
    return asked.unionByName(code).unionByName(short).unionByName(term).where("text is not null").distinct()


def routes(spark: SparkSession, d: str) -> DataFrame:
    return probes(spark, d).select("text", search.route(F.col("text")).alias("r")).select("text", "r.*")


def identifier_hits(spark: SparkSession, d: str) -> DataFrame:
    """qid, id, route: chunks by exact code and clause, by the code alone where the clause is not there; asked are all codes, as they stand, with clauses 4.1 and 99.9."""
    codes = table(spark, d, "chunk_index").select("doc_code").where("doc_code is not null").distinct()
    q = codes.select("doc_code", F.explode(F.array(F.lit("4.1"), F.lit("99.9"))).alias("b")).select(F.concat_ws(" ", "doc_code", "b").alias("qid"), F.col("doc_code").alias("a"), "b")
    return search.filtered_or_wider(q, search_keys(spark, d).select("key", "doc_code", "clause")).select("qid", F.col("key").alias("id"), "route")


def search_keys(spark: SparkSession, d: str) -> DataFrame:
    """key, doc_code, clause, element_type, crumb of all chunks, made once."""
    return stored(spark, "keys", d, INDEXED, lambda: pp.chunks(spark, d).select(F.col("id").alias("key"), "doc_code", "clause", "element_type", "crumb"))


def retrieved(spark: SparkSession, d: str, every: int = EVERY) -> DataFrame:
    """qid, id, rank, route, score: routed retrieval for the questions."""
    t = routed(chunk_index(spark, d), questions(spark, d, every).select("qid", "text"), search_keys(spark, d), K)
    return t.select("qid", F.col("key").alias("id"), "rank", "route", F.round("score", 9).alias("score"))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """qid, id, rank, first_rank: the sparse list ordered by the share of the question's terms a chunk holds."""
    q = questions(spark, d)
    bodies = pp.chunks(spark, d).select(F.col("id").alias("key"), F.array_distinct(index.terms(F.col("body"))).alias("have"))
    asked = q.select("qid", F.array_distinct(index.terms(F.col("text"))).alias("want"))
    t = _sparse(chunk_index(spark, d), q, K).join(bodies, "key").join(asked, "qid")
    return search.rerank(t, F.size(F.array_intersect("have", "want")).cast("double")).select("qid", F.col("key").alias("id"), "rank", "first_rank", "rerank")


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """qid, context_sha1, passages: the labelled passages of each question as one text."""
    bodies = pp.chunks(spark, d).select(F.col("id").alias("key"), "crumb", "body")
    t = deduplicated(spark, d).withColumnRenamed("id", "key").join(bodies, "key")
    return search.context(t, F.col("crumb"), F.col("body")).select("qid", F.sha1("context").alias("context_sha1"), "passages")


def probe_definitions(spark: SparkSession, d: str) -> DataFrame:
    """One row: probes, top3, rank1, verdict: is a definition found by its own term? Asked is every definition whose number is divisible by 50 (one in so many)."""
    c = pp.chunks(spark, d).where("element_type = 'definition'").select("id", F.get(F.split("body", "\n"), F.lit(0)).alias("term"))
    q = c.where(every_one(F.col("id"))).select(F.col("id").alias("qid"), F.concat(F.lit("what is "), "term").alias("text"))
    q = written(q, "probes")
    lists = ranked_lists(chunk_index(spark, d), q, 2 * K)
    t = search.fuse({"dense": (lists["dense"], 1.0), "sparse": (lists["sparse"], 1.0)}, K).where("qid = key")
    out = q.select("qid").join(t.select("qid", "rank"), "qid", "left").agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.col("rank") < 3).alias("top3"), F.count_if(F.col("rank") == 0).alias("rank1"))
    return out.withColumn("verdict", F.when(F.col("top3") >= 0.9 * F.col("probes"), "PASS").otherwise("FAIL"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 items, one of each class in turn."""
    t = table(spark, d, "frame_items").groupBy("anchor_id").agg(F.min("class").alias("class"))
    return search.round_robin(t, "anchor_id", "class", 20).select("anchor_id", "class", "turn")


_T = TOKEN.format(code=DEFAULT.code)
_Q = f"""q as (select anchor_id qid, min(coalesce(question, prompt_as_typed, '')) text from frame_items where regexp_extract(anchor_id, '([0-9]+)$', 1)::bigint % {EVERY} = 0 group by 1)"""
_POSTS = pp.CHUNKS + f""", {_Q},
p as (select id, term, count(*) tf from (select id, lower(unnest(regexp_extract_all(body, '{_T}'))) term from ch) group by 1, 2),
qp as (select qid, term, count(*) tf from (select qid, lower(unnest(regexp_extract_all(text, '{_T}'))) term from q) group by 1, 2),
i as (select term, ln(1 + (select count(distinct id) from p)::double / count(*)) idf from p group by 1),
pw as (select id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by id)) w from p join i using (term)),
qw as (select qid, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by qid)) w from qp join i using (term)),
ds as (select qid, id, round(sum(qp.tf * p.tf)::double, 9) score from qp join p using (term) group by 1, 2),
cs as (select qid, id, round(sum(qw.w * pw.w), 9) score from qw join pw using (term) group by 1, 2),
dr as (select *, row_number() over (partition by qid order by score desc, id) - 1 rank from ds),
cr as (select *, row_number() over (partition by qid order by score desc, id) - 1 rank from cs)
"""
_DEDUP = _POSTS + f""", x as (select dr.qid, dr.id, rank, doc_code, clause from dr join ch using (id) where rank < {K}),
y as (select *, row_number() over (partition by qid, doc_code, clause order by rank, id) n from x), z as (select qid, id, rank, row_number() over (partition by qid order by rank, id) - 1 place from y where n = 1)
"""
_CODE_G = DEFAULT.code
_IDENT = rf"(?i)^\s*({_CODE_G})[a-z]?(\s+rev\.?\s*[0-9]+)?(\s+(clause\s+)?([0-9]+(\.[0-9]+)*))?\s*$"
def route_sql(of: str, keep: str = "") -> str:
    """A CTE body: the route of every text of a relation, beside the columns to keep."""
    return rf"""(select *, case when ident then 'identifier' when stands or expl or (sh <> '' and not regexp_matches(sh, '{search.QUALIFIER}')) then 'definitional' else 'general' end kind,
  case when ident then upper(regexp_extract(text, '{_IDENT}', 1)) when stands then regexp_extract(text, '(?i){search.STANDS}', 1) when expl then coalesce(nullif(ex, ''), trim(text)) when sh <> '' and not regexp_matches(sh, '{search.QUALIFIER}') then sht end a,
  case when ident then nullif(regexp_extract(text, '{_IDENT}', 7), '') end b from
  (select text{keep}, regexp_matches(text, '{_IDENT}') ident, regexp_matches(text, '(?i){search.STANDS}') stands, regexp_matches(lower(text), '{search.EXPLICIT}') expl,
  trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i){search.EXPLICIT}', ''), '^[ ?.\"'']+', ''), '[ ?.\"'']+$', '')) ex, trim(regexp_extract(lower(text), '{search.SHORT.replace("'", "''")}', 4)) sh,
  trim(regexp_extract(text, '(?i){search.SHORT.replace("'", "''")}', 4)) sht from {of} where text is not null))"""


_PROBES = pp.SQL["acronyms"].replace("select doc, short, arg_min", ", ac as (select doc, short, arg_min").rstrip() + rf"""),
  c as (select * from chunk_index), h as (select lower(regexp_replace(string_split(section, ' > ')[-1], '^[0-9A-Z.]+ ', '')) head from c),
  pr as (select question text from frame_items union select question from eval_items union select lower(doc_code) from c union select concat_ws(' clause ', doc_code, clause) from c
  union select 'what does ' || doc_code || ' say' from c union select 'What does ' || short || ' stand for?' from ac union select 'what is the ' || head || '?' from h union select 'define ' || head from h)
select text, kind, a, b from {route_sql("pr")}
"""


def lists_sql(asked: str, tag: str) -> str:
    """CTEs: both ranked lists of the texts of a relation (qid, text), over the postings of ``_POSTS``."""
    return f"""{tag}t as (select qid, term, count(*) tf from (select qid, lower(unnest(regexp_extract_all(text, '{_T}'))) term from {asked}) group by 1, 2),
{tag}w as (select qid, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by qid)) w from {tag}t join i using (term)),
{tag}c as (select qid, id, round(sum(x.w * pw.w), 9) score from {tag}w x join pw using (term) group by 1, 2), {tag}s as (select qid, id, round(sum(x.tf * p.tf)::double, 9) score from {tag}t x join p using (term) group by 1, 2),
{tag}cr as (select *, row_number() over (partition by qid order by score desc, id) - 1 rank from {tag}c), {tag}sr as (select *, row_number() over (partition by qid order by score desc, id) - 1 rank from {tag}s)"""


def retrieve_sql(asked: str, tag: str, ks: tuple[int, ...]) -> str:
    """CTEs: routed retrieval of the texts of a relation (qid, text); for each k a relation {tag}{k} of qid, id, rank, route, score."""
    out = f"""{tag}r as {route_sql(asked, ", qid")}, {tag}q as (select qid, case when kind = 'definitional' then coalesce(a, text) else text end text from {tag}r), {lists_sql(f"{tag}q", tag)},
{tag}h as (select qid, id, clause is not distinct from b or b is null ex, bool_or(clause is not distinct from b or b is null) over (partition by qid) any_ex from {tag}r join ch on ch.doc_code = a where kind = 'identifier'),
{tag}i as (select qid, h.id, case when any_ex then 'identifier' else 'identifier(document)' end route, coalesce(score, 0) score, row_number() over (partition by qid order by coalesce(score, 0) desc, h.id) - 1 rank from {tag}h h left join {tag}c using (qid, id) where ex or not any_ex)"""
    for k in ks:
        out += f""", {tag}u{k} as (select qid, id, rank, 'd' l from {tag}cr where rank < {2 * k} union all select qid, id, rank, 's' from {tag}sr where rank < {2 * k}),
{tag}m{k} as (select qid, id, round(sum(1.0::double / (60 + rank)), 12) score, min(case when l = 'd' then rank end) dr, min(case when l = 's' then rank end) sr from {tag}u{k} group by 1, 2),
{tag}b{k} as (select m.qid, m.id, kind route, round(score * case when kind = 'definitional' and element_type in ('definition', 'abbreviation') then 1.5 else 1.0 end, 12) score, dr, sr from {tag}m{k} m join {tag}r using (qid) join ch on ch.id = m.id where kind <> 'identifier'),
{tag}{k} as (select qid, id, rank, route, score from {tag}i where rank < {k} union all select qid, id, rank, route, score from (select *, row_number() over (partition by qid order by score desc, dr nulls last, sr nulls last, id) - 1 rank from {tag}b{k}) where rank < {k})"""
    return out


_DOUBLE = "list_transform(embedding, lambda x: x::double)"

QUERIES = {
    "sparse_topk": sparse_topk, "tfidf_topk": tfidf_topk, "dense_topk": dense_topk, "rrf": fused, "dedup_cut": deduplicated, "routes": routes, "identifier_hits": identifier_hits, "retrieve": retrieved,
    "rerank": reranked, "contexts": contexts, "probe_definitions": probe_definitions, "round_robin": turns,
}
SQL = {
    "sparse_topk": _POSTS + f"select qid, id, score, rank from dr where rank < {K}",
    "tfidf_topk": _POSTS + f"select qid, id, round(score, 6) score, rank from cr where rank < {K}",
    "dense_topk": f"""with e as (select vec_id, {_DOUBLE} v from embeddings), s as (select a.vec_id qid, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) score from e a join e b on a.vec_id % {EVERY} = 0),
      r as (select *, row_number() over (partition by qid order by score desc, vec_id) - 1 rank from s) select qid, vec_id, round(score, 6) score, rank from r where rank < {K}""",
    "rrf": _POSTS + f""", u as (select qid, id, rank, 'd' l from cr where rank < {2 * K} union all select qid, id, rank, 's' from dr where rank < {2 * K}),
      m as (select qid, id, round(sum(1.0::double / (60 + rank)), 12) score, min(case when l = 'd' then rank end) dense_rank, min(case when l = 's' then rank end) sparse_rank from u group by 1, 2),
      r as (select *, row_number() over (partition by qid order by score desc, dense_rank nulls last, sparse_rank nulls last, id) - 1 rank from m) select qid, id, round(score, 9) score, rank, dense_rank, sparse_rank from r where rank < {K}""",
    "retrieve": _POSTS + ", " + retrieve_sql("q", "z", (K,)) + f" select qid, id, rank, route, round(score, 9) score from z{K}",
    "probe_definitions": _POSTS.replace(_Q, f"""q as (select id qid, 'what is ' || string_split(body, chr(10))[1] text from ch where element_type = 'definition' and ('0x' || substring(id, 1, 8))::bigint % {EVERY} = 0)""") + f""",
      u as (select qid, id, rank, 'd' l from cr where rank < {2 * K} union all select qid, id, rank, 's' from dr where rank < {2 * K}),
      m as (select qid, id, round(sum(1.0::double / (60 + rank)), 12) score, min(case when l = 'd' then rank end) dense_rank, min(case when l = 's' then rank end) sparse_rank from u group by 1, 2),
      r as (select *, row_number() over (partition by qid order by score desc, dense_rank nulls last, sparse_rank nulls last, id) - 1 rank from m), o as (select q.qid, r.rank from q left join r on r.qid = q.qid and r.id = q.qid and r.rank < {K})
      select count(*) probes, count(case when rank < 3 then 1 end) top3, count(case when rank = 0 then 1 end) rank1, case when count(case when rank < 3 then 1 end) >= 0.9 * count(*) then 'PASS' else 'FAIL' end verdict from o""",
    "dedup_cut": _DEDUP + "select * from z where place < 5",
    "routes": _PROBES,
    "identifier_hits": pp.CHUNKS + """, q as (select distinct doc_code a, b from (select doc_code, unnest(['4.1', '99.9']) b from chunk_index where doc_code is not null)),
      h as (select a || ' ' || b qid, id, clause is not distinct from b ex, bool_or(clause is not distinct from b) over (partition by a, b) any_ex from q join ch on ch.doc_code = q.a)
      select qid, id, case when any_ex then 'identifier' else 'identifier(document)' end route from h where ex or not any_ex""",
    "rerank": _POSTS + f""", x as (select qid, id, rank, (select count(*) from qp where qp.qid = dr.qid and exists (select 1 from p where p.id = dr.id and p.term = qp.term)) s from dr where rank < {K})
      select qid, id, row_number() over (partition by qid order by s desc, rank, id) - 1 rank, rank first_rank, 'ok' rerank from x""",
    "contexts": _DEDUP + "select qid, sha1(string_agg('[' || crumb || ']' || chr(10) || body, chr(10) || '---' || chr(10) order by place)) context_sha1, count(*) passages from z join ch using (id) where place < 5 group by 1",
    "round_robin": "with t as (select anchor_id, min(class) class from frame_items group by 1), r as (select *, row_number() over (partition by class order by anchor_id) turn from t) select anchor_id, class, turn from r order by turn, class, anchor_id limit 20",
}
