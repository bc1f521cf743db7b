"""Queries of sources and sinks: what is written comes back as it was, and what is read is named."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import models, parse
from strandline.functions.ids import draw
from strandline.operators import index, validate
from strandline.plans import parse as pp
from strandline.plans import score as pc
from strandline.plans import search as ps
from strandline.runtime import file_system, shared_path, table
from strandline.sources import files, sinks

SPLIT = "2024-01-01"


def jsonl_frame(spark: SparkSession, d: str) -> DataFrame:
    """anchor_id, class, claims: the frame written as JSON lines with a summary beside it, and read again strictly."""
    at = shared_path(spark, "frame")
    rows = table(spark, d, "frame_items").dropDuplicates(["anchor_id"]).select("anchor_id", "class", F.size("claims").alias("claims"))
    sinks.write_results(rows, {"rows": rows.count()}, at)
    return files.read_jsonl(spark, f"{at}/rows", "anchor_id string, class string, claims int")


def config_record(spark: SparkSession, d: str) -> DataFrame:
    """version, rows, fields: the record of a build of the chunks, written as one object and read again."""
    at = shared_path(spark, "config")
    t = table(spark, d, "chunk_index")
    sinks.write_record(spark, sinks.build_config(t, "v4", {"target": 1600}), at)
    kinds = "version string, rows long, fields map<string, string>"
    return files.read_object(spark, at, kinds).select("version", "rows", F.size("fields").alias("fields"))


def returns_read(spark: SparkSession, d: str) -> DataFrame:
    """item, claim, answer: claims written as CSV under other column names, and read by their aliases."""
    at = shared_path(spark, "returns")
    v = pc.verdicts(spark, d).select(F.col("item").alias("Item ID"), F.col("claim").alias("claim_no"), F.col("text").alias("my_answer"))
    v.where("my_answer is not null and my_answer <> ''").write.option("escape", '"').csv(at, header=True)
    t = files.read_returns(spark, at, {"item": ["item id"], "claim": ["claim_no"], "answer": ["my_answer"]})
    return t.select("item", F.col("claim").cast("int").alias("claim"), "answer")


def manifest_states(spark: SparkSession, d: str) -> DataFrame:
    """state, files: the files of the first collection at the beginning of 2024 as a manifest against those of now."""
    t = table(spark, d, "ledger").where(F.col("collection") == pp.COLLECTION)
    name = F.substring_index("path", "/", -1).alias("filename")
    old = index.latest_ledger(t.where(f"recorded_at < timestamp'{SPLIT}'")).where("sha256 is not null").select(name, "sha256").groupBy("filename").agg(F.min("sha256").alias("sha256"))
    now = index.latest_ledger(t).where("sha256 is not null").groupBy(F.substring_index("path", "/", -1).alias("path")).agg(F.max("sha256").alias("sha256"))
    return files.verify_manifest(old, now).groupBy("state").agg(F.count(F.lit(1)).alias("files"))


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """filename, digits: the tables of the folder, with digests of their whole content; that of a table which is a folder is made of the names and digests of its files."""
    fs, at = file_system(spark, d)
    inside = F.substr("path", F.lit(len(fs.makeQualified(at).toString()) + 2))
    t = files.digests(files.discover(spark, [d], (".parquet",))).select(inside.alias("inside"), "sha256")
    parts = F.array_sort(F.collect_list(F.struct("inside", "sha256")))
    t = t.groupBy(F.substring_index("inside", "/", 1).alias("filename")).agg(parts.alias("parts"))
    whole = F.sha2(F.array_join(F.transform("parts", lambda p: F.concat_ws(" ", p["inside"], p["sha256"])), "\n"), 256)
    sha256 = F.when(F.get("parts.inside", F.lit(0)) == F.col("filename"), F.get("parts.sha256", F.lit(0))).otherwise(whole)
    return t.select("filename", F.length(sha256).alias("digits"))


def metrics_appended(spark: SparkSession, d: str) -> DataFrame:
    """doc_code, chunks, tables: the counters of a run appended in two parts and read as one."""
    at = shared_path(spark, "metrics")
    t = pp.quality(spark, d).select("doc_code", "chunks", "tables")
    for half in (F.col("tables") > 0, F.col("tables") == 0):
        sinks.append_metrics(t.where(half), at)
    return files.read_jsonl(spark, at, "doc_code string, chunks long, tables long")


def derived_collection(spark: SparkSession, d: str) -> DataFrame:
    """id, terms: a collection by class of source, and the one derived from it that holds the distinct terms of each chunk."""
    source = sinks.VersionedTable(spark, shared_path(spark, "source"), ["source_class"])
    source.write(pp.chunks(spark, d).select("id", "source_class", "body"))
    target = sinks.VersionedTable(spark, shared_path(spark, "derived"))
    sinks.derive(source, target, lambda t: t.select("id", F.size(F.array_distinct(index.terms(F.col("body")))).alias("terms")))
    return target.read()


def versions(spark: SparkSession, d: str) -> DataFrame:
    """version, rows: a ledger written whole, with the second collection put into it, and without the files of unknown digest; each version can still be read."""
    t = index.latest_ledger(table(spark, d, "ledger")).select("collection", "path", "sha256")
    at = sinks.VersionedTable(spark, shared_path(spark, "ledger"))
    made = [at.write(t.where(F.col("collection") == pp.COLLECTION).dropDuplicates(["path"])), at.upsert(t.where(F.col("collection") != pp.COLLECTION), "path"), at.delete(t.where("sha256 is null"), ["path"])]
    out = [at.read(v).agg(F.lit(i + 1).alias("version"), F.count(F.lit(1)).alias("rows")) for i, v in enumerate(made)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def malformed_probes(spark: SparkSession, d: str) -> DataFrame:
    """id, problem: the frame's items taken as probes, one in five under an arm that is none."""
    arm = F.when(draw("arm", F.col("anchor_id")) < 0.2, "other").otherwise("figure_only")
    t = table(spark, d, "frame_items").dropDuplicates(["anchor_id"]).select(F.col("anchor_id").alias("id"), "question", "claims", arm.alias("arm"))
    return validate.malformed_probes(t)


def dehyphenated(spark: SparkSession, d: str) -> DataFrame:
    """id, body_sha1: the bodies that name a code of two numbers, broken there after the hyphen and joined again."""
    code = r"(AXSS-[A-Z]-(ST|AS|HB|TM)-[0-9]{2})-([0-9]{2})"
    t = pp.chunks(spark, d).where(F.col("body").rlike(code))
    return t.select("id", F.sha1(parse.dehyphenate(F.regexp_replace("body", code, "$1- \n$3"))).alias("body_sha1"))


def judged_persistently(spark: SparkSession, d: str) -> DataFrame:
    """verdict, claims: claims judged by one that fails at first and needs room for its thoughts, against the text of their first evidence span."""
    c = table(spark, d, "frame_items").dropDuplicates(["anchor_id"]).select(F.explode("claims").alias("c"))
    t = c.select(F.col("c.text").alias("claim"), F.get("c.evidence", F.lit(0))["span"].alias("answer"))
    judge = models.judge(models.persistent(models.wordy_judge, budgets=(8, 100_000)))
    reply = parse.after_thinking(judge(F.col("claim"), F.coalesce("answer", F.lit(""))))
    return t.withColumn("reply", reply).groupBy(parse.verdict(F.col("reply")).alias("verdict")).agg(F.count(F.lit(1)).alias("claims"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """qid, answer_sha1: answers of a generator that plugs in (here one that quotes the first passage), without its thoughts."""
    bodies = pp.chunks(spark, d).select(F.col("id").alias("key"), "crumb", "body")
    t = ps.deduplicated(spark, d).withColumnRenamed("id", "key").join(bodies, "key")
    asked = ps.search.context(t, F.col("crumb"), F.col("body")).join(ps.questions(spark, d).select("qid", "text"), "qid")
    reply = parse.after_thinking(models.generator(models.quoting_generator)(F.col("text"), F.col("context")))
    return asked.select("qid", F.sha1(reply).alias("answer_sha1"))


_WORDS = "regexp_extract_all(lower({}), '\\S+')"
QUERIES = {
    "jsonl_frame": jsonl_frame, "config_record": config_record, "returns_read": returns_read, "manifest_states": manifest_states, "source_files": source_files, "metrics_appended": metrics_appended,
    "derived_collection": derived_collection, "versions": versions, "malformed_probes": malformed_probes, "dehyphenated": dehyphenated, "judged_persistently": judged_persistently, "answers": answers,
}
SQL = {
    "jsonl_frame": "select distinct anchor_id, class, len(claims)::int claims from frame_items",
    "config_record": "select 'v4' as version, count(*) as rows, (select count(*)::int from information_schema.columns where table_name = 'chunk_index') fields from chunk_index",
    "returns_read": pc._V + " select item, claim, text answer from v where text <> ''",
    "manifest_states": f"""with o as {pp._LATEST.format(f"(select * from ledger where recorded_at < timestamp '{SPLIT}')")}, n as {pp._LATEST.format('ledger')},
      a as (select regexp_extract(path, '[^/]*$') f, min(s) s from o where collection = '{pp.COLLECTION}' and s <> '' group by 1), b as (select regexp_extract(path, '[^/]*$') f, max(s) s from n where collection = '{pp.COLLECTION}' and s <> '' group by 1)
      select case when b.s is null then 'missing' when a.s is null then 'extra' when lower(a.s) = lower(b.s) then 'ok' else 'changed' end state, count(*) files from a full join b using (f) group by 1""",
    "source_files": "select table_name || '.parquet' filename, 64 digits from information_schema.tables",
    "metrics_appended": pp._QUALITY + "select doc_code, chunks, tables from q",
    "derived_collection": pp.CHUNKS + f" select id, len(list_distinct(list_transform(regexp_extract_all(body, '{ps._T}'), lambda x: lower(x))))::int terms from ch",
    "versions": f"""with t as {pp._LATEST.format('ledger')}, a as (select path from t where collection = '{pp.COLLECTION}'), b as (select path from t where collection <> '{pp.COLLECTION}'), u as (select path from a union select path from b)
      select 1 as version, count(distinct path) as rows from a union all select 2, count(*) from u union all select 3, count(*) from u where path not in (select path from t where s = '')""",
    "malformed_probes": f"""with f as (select distinct on (anchor_id) * from frame_items) select anchor_id id, unnest(list_filter([case when coalesce(trim(question), '') = '' then 'no question' end, case when coalesce(len(claims), 0) = 0 then 'no claims' end,
      case when {pc._DRAW("'arm'", 'anchor_id')} < 0.2 then 'unknown arm' end], lambda x: x is not null)) problem from f""",
    "dehyphenated": pp.CHUNKS + " select id, sha1(body) body_sha1 from ch where regexp_matches(body, 'AXSS-[A-Z]-(ST|AS|HB|TM)-[0-9]{2}-[0-9]{2}')",
    "judged_persistently": f"""with c as (select unnest(claims) c from (select distinct on (anchor_id) claims from frame_items)), w as (select {_WORDS.format("coalesce(c.text, '')")} a, {_WORDS.format("coalesce(c.evidence[1].span, '')")} b from c)
      select list_has_all(b, a) verdict, count(*) claims from w group by 1""",
    "answers": ps._DEDUP + "select qid, sha1(trim('[' || crumb || ']' || chr(10) || body)) answer_sha1 from z join ch using (id) where place = 0",
}
