"""Queries of the ingest side: names, lines, bodies, ids, captions, postings, ledger."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import ids, parse
from strandline.functions.profile import ANNEX_NUMBER, CLAUSE_DOTTED, DEFAULT, LETTERED, MODAL, NO_FIGURE, TOKEN
from strandline.functions.text import body as body_of
from strandline.functions.text import trimmed
from strandline.operators import index
from strandline.operators.chunking import chunk_items, expand_acronyms, harvest_acronyms, split_table
from strandline.operators.ordered import nearest
from strandline.runtime import salted_join, table
from strandline.sources.files import parse_items

COLLECTION = "standards_v3"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """chunk_index with one row an id and the body without its SECTION line."""
    return table(spark, d, "chunk_index").dropDuplicates(["id"]).withColumn("body", trimmed(body_of(F.col("text"))))


def ingest_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    code = parse.doc_code(path)
    authority, kind = parse.authority(code, F.lit("normative"), F.lit("standard"))
    return table(spark, d, "ledger").select("path").distinct().select(
        "path", code.alias("doc_code"), parse.revision(path).alias("revision"), authority.alias("authority"), kind.alias("source_class"), ids.position_id(path, F.lit(0)).alias("first_page_id")
    )


def clause_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each clause begin, and how many lines begin a requirement unit."""
    line = F.explode(F.split("body", "\n", -1)).alias("line")
    t = chunks(spark, d).select(line)
    return t.groupBy(F.coalesce(parse.clause_of(F.col("line")), F.lit("")).alias("clause")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(parse.is_boundary(F.col("line"))).alias("boundaries"))


def heading_clauses(spark: SparkSession, d: str) -> DataFrame:
    """The label the last heading of each section sets."""
    heading = F.substring_index("section", " > ", -1)
    return table(spark, d, "chunk_index").select(heading.alias("heading")).distinct().select("heading", F.coalesce(parse.clause_of_heading(F.col("heading")), F.lit("")).alias("clause"))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    t = index.enrich(chunks(spark, d).select("id", "body", trimmed(F.col("doc_code")).alias("doc_code"), "crumb"), "body", "doc_code")
    return t.select("id", F.array_join("refs", " ").alias("refs"), F.array_join("req_ids", " ").alias("req_ids"), F.array_join("modals", " ").alias("modals"), "n_chars", F.sha1(parse.display(F.col("crumb"), F.col("body"))).alias("display_sha1"))


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    t = chunks(spark, d).select("id", "source_file", "body")
    return index.content_ids(t, "source_file", "body", ["id"]).select("id", "content_id")


def duplicate_bodies(spark: SparkSession, d: str) -> DataFrame:
    """body_sha1, copies: bodies that stand under more than one id."""
    return chunks(spark, d).groupBy(F.sha1("body").alias("body_sha1")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def captions_kept(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "captions").select("caption_id", parse.usable_caption(F.col("caption")).alias("caption")).distinct()
    return t.where("caption is not null")


def captions_attached(spark: SparkSession, d: str) -> DataFrame:
    """caption_id, chunk_id, distance: every usable caption at the chunk of its file with the nearest page."""
    caps = table(spark, d, "captions").select("caption_id", "source_file", "page", parse.usable_caption(F.col("caption")).alias("caption")).where("caption is not null").select("caption_id", "source_file", "page").distinct()
    paged = table(spark, d, "chunk_index").where("page_number is not null").select("source_file", "page_number", F.col("id").alias("chunk_id")).distinct()
    near = nearest(caps, paged, ["source_file"], "page", "page_number", "chunk_id")
    return near.select("caption_id", "chunk_id", F.abs(F.col("page") - F.col("page_number")).cast("int").alias("distance"))


def _captions_placed(captions: DataFrame, chunks: DataFrame) -> DataFrame:
    """caption_id, source_file, page, caption, chunk_id, distance: every usable caption at the chunk of its file with the nearest page, else at the file's first.

    The first is that of the smallest page, without pages of the smallest id. Only a caption of a file without chunks has no chunk.
    """
    caps = captions.select("caption_id", "source_file", "page", parse.usable_caption(F.col("caption")).alias("caption")).where("caption is not null").distinct()
    own = chunks.select("source_file", "page_number", F.col("id").alias("chunk_id")).distinct()
    near = nearest(caps, own.where("page_number is not null"), ["source_file"], "page", "page_number", "chunk_id")
    first = own.groupBy("source_file").agg(F.min(F.struct(F.col("page_number").isNull(), "page_number", "chunk_id")).alias("f")).select("source_file", F.col("f.chunk_id").alias("first"))
    placed = salted_join(near, first, ["source_file"], "left")
    return placed.select("caption_id", "source_file", "page", "caption", F.coalesce("chunk_id", "first").alias("chunk_id"), F.abs(F.col("page") - F.col("page_number")).cast("int").alias("distance"))


def captions_placed(spark: SparkSession, d: str) -> DataFrame:
    """caption_id, chunk_id, distance: every usable caption at a chunk of its file; the distance is null where no page decided."""
    t = _captions_placed(table(spark, d, "captions"), table(spark, d, "chunk_index"))
    return t.select("caption_id", "source_file", "page", "chunk_id", "distance").distinct().select("caption_id", "chunk_id", "distance")


def _bodies_with_captions(captions: DataFrame, bodies: DataFrame) -> DataFrame:
    """id, body of the chunks that captions are put to, each on a line of its own at the end, in order of page and caption_id."""
    placed = _captions_placed(captions, bodies).where("chunk_id is not null")
    line = F.concat(F.lit("\n[FIGURES p"), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit("] "), "caption")
    each = F.struct(F.col("page").isNull().alias("n"), "page", "caption_id", line.alias("line"))
    added = placed.groupBy(F.col("chunk_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["line"]), "").alias("added"))
    return bodies.join(added, "id").select("id", F.concat(F.coalesce("body", F.lit("")), "added").alias("body"))


def captions_in_bodies(spark: SparkSession, d: str) -> DataFrame:
    """id, body_sha1, n_chars: the chunks that have captions, with the captions at the end of their bodies."""
    t = _bodies_with_captions(table(spark, d, "captions"), chunks(spark, d))
    return t.select("id", F.sha1("body").alias("body_sha1"), F.length("body").alias("n_chars"))


def postings_top(spark: SparkSession, d: str) -> DataFrame:
    """term, term_idx, chunks, tf: every term of the chunks with its hashed index."""
    p = index.postings(chunks(spark, d), "id", "body")
    return p.groupBy("term", "term_idx").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("tf"))


def quality(spark: SparkSession, d: str) -> DataFrame:
    t = chunks(spark, d).withColumn("doc_code", F.coalesce(trimmed(F.col("doc_code")), F.lit("")))
    return index.quality_counters(t, ["doc_code"])


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    """The totals of a run over its per-document counters."""
    per = quality(spark, d)
    return per.agg(F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in per.columns if c != "doc_code"])


def acronyms(spark: SparkSession, d: str) -> DataFrame:
    """doc, short, expansion: the abbreviation units of each document, the first by id of each acronym."""
    row = r"^([A-Z][A-Za-z0-9/\-]{1,9}) - ([^\n]{3,80})$"
    last = F.substring_index("body", "\n", -1)
    t = chunks(spark, d).where("element_type = 'abbreviation'").select(trimmed(F.col("doc_code")).alias("doc"), "id", F.regexp_extract(last, row, 1).alias("short"), F.regexp_extract(last, row, 2).alias("expansion"))
    return t.where("short <> '' and doc <> ''").groupBy("doc", "short").agg(F.min_by("expansion", "id").alias("expansion"))


def expanded(spark: SparkSession, d: str) -> DataFrame:
    """doc, chunks, expanded: how many chunks of each document name one of its acronyms."""
    maps = acronyms(spark, d).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("short", "expansion"))).alias("table"))
    t = salted_join(chunks(spark, d).where("element_type <> 'abbreviation'").select(trimmed(F.col("doc_code")).alias("doc"), "id", "body"), maps, ["doc"])
    return expand_acronyms(t, "body", "table").groupBy("doc").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("expanded") != F.col("body")).alias("expanded"))


def table_parts(spark: SparkSession, d: str) -> DataFrame:
    """id, parts, longest: the parts of every table chunk under a budget of 400 characters."""
    t = chunks(spark, d).where("element_type = 'table'").select("id", "body")

    @F.pandas_udf("struct<parts:int,longest:int>")
    def cut(bodies: pd.Series) -> pd.DataFrame:
        found = [split_table("\n".join(x for x in b.split("\n") if x.startswith("|")), 400) for b in bodies]
        return pd.DataFrame({"parts": [len(p) for p in found], "longest": [max(map(len, p)) for p in found]})

    return t.withColumn("c", cut("body")).select("id", "c.*")


def harvested(spark: SparkSession, d: str) -> DataFrame:
    """doc, short, expansion: the abbreviations found in the glossary text of each document, which is set from its abbreviation units, in order of id, between headings."""
    row = r"^([A-Z][A-Za-z0-9/\-]{1,9}) - ([^\n]{3,80})$"
    last = F.substring_index("body", "\n", -1)
    units = chunks(spark, d).where("element_type = 'abbreviation'").select(trimmed(F.col("doc_code")).alias("doc"), "id", F.regexp_replace(last, row, "$1  $2").alias("line")).where("doc <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n")
    texts = units.groupBy("doc").agg(F.concat(F.lit("1 Scope\nNO  not in the glossary\n3.3 Abbreviated terms\n"), text, F.lit("\n4 Requirements\nNO  not in it either")).alias("raw"))
    return harvest_acronyms(texts, "doc", "raw")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """doc, pos, part, body_sha1, cut, section, clause, etype: the chunks of all documents read as Markdown."""
    t = chunk_items(parse_items(table(spark, d, "documents"), "doc_id", "text", "md"))
    return t.select("doc", "pos", "part", F.sha1("body").alias("body_sha1"), "cut", "section", "clause", "etype")


def ledger_plan(spark: SparkSession, d: str) -> DataFrame:
    """collection, path, action: the newest state of every file against the state at the beginning of 2024."""
    t = table(spark, d, "ledger")
    now = index.latest_ledger(t)
    before = index.latest_ledger(t.where("recorded_at < timestamp'2024-01-01'"))
    return index.load_plan(now, before)


def ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    """path, sha256: the second collection's files put into the first's, less those whose digest is unknown."""
    t = index.latest_ledger(table(spark, d, "ledger"))
    first = t.where(F.col("collection") == COLLECTION).select("path", "sha256")
    second = t.where(F.col("collection") != COLLECTION).groupBy("path").agg(F.max("sha256").alias("sha256"))
    return index.delete_where(index.upsert(first, second, "path"), t.where("sha256 is null"), ["path"])


def projected(spark: SparkSession, d: str) -> DataFrame:
    """source_class, doc_codes, chunks: a scan of three columns."""
    return table(spark, d, "chunk_index").groupBy("source_class").agg(F.count_distinct("doc_code").alias("doc_codes"), F.count(F.lit(1)).alias("chunks"))


def filtered(spark: SparkSession, d: str) -> DataFrame:
    """id: chunks with exactly the code of the largest standard and clause 3.2, both pushed to the scan."""
    return table(spark, d, "chunk_index").where((F.col("doc_code") == "AXSS-E-ST-42-05") & (F.col("clause") == "3.2")).select("id").distinct()


W = r"[\s\x0B\x{85}\p{Z}]"


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{W}+', ''), '{W}+$', '')"


CHUNKS = f"""
with d0 as (select distinct on (id) *, string_split(text, chr(10)) l from chunk_index),
d1 as (select *, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^{W}*SECTION:')), true) pos from d0),
ch as (select * exclude (l, pos), {_trim("array_to_string(case when pos > 0 then l[:pos-1] || l[pos+1:] else l end, chr(10))")} body from d1)
"""
CODE, OLD, REQ = DEFAULT.code, DEFAULT.old_code, DEFAULT.requirement
_PLUS = lambda s: s.replace("(", "(?:")
_ANY = f"(?:{_PLUS(CODE)}|{_PLUS(OLD)})"
_BASE = "regexp_extract(path, '[^/]*$')"
_SPACE = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"
_USABLE = f"""
with c0 as (select caption_id, source_file, page, {_SPACE('caption')} t from captions),
cap as (select distinct caption_id, source_file, page, t caption from c0 where t <> '' and lower(regexp_replace(regexp_replace(t, '^[ .\\t\\n"'']+', ''), '[ .\\t\\n"'']+$', '')) not in ('none','no','n/a','nothing')
  and not regexp_matches(lower(t), '{NO_FIGURE}') and length(t) >= {DEFAULT.min_caption})
"""
_UUID = "substring(h,1,8)||'-'||substring(h,9,4)||'-5'||substring(h,14,3)||'-'||translate(substring(h,17,1),'0123456789abcdef','89ab89ab89ab89ab')||substring(h,18,3)||'-'||substring(h,21,12)"
_NS = "unhex('6ba7b8119dad11d180b400c04fd430c8')"
_LATEST = "(select collection, path, arg_max(coalesce(sha256, ''), (recorded_at, coalesce(sha256, ''))) s from {} group by 1, 2)"
_COUNT = lambda c, n: f"count(case when {c} then 1 end) {n}"
_QUALITY = CHUNKS + f""", q as (select coalesce({_trim('doc_code')}, '') doc_code, count(*) chunks, {', '.join(_COUNT(f"element_type='{k}'", n) for k, n in (('table', 'tables'), ('definition', 'definitions'), ('abbreviation', 'abbreviations')))},
  {', '.join(_COUNT(f"cut='{k}'", f'cut_{k}') for k in ('section', 'structural', 'paragraph', 'hard_max', 'definition'))}, {_COUNT('n_chars >= 3550', 'at_hard_max')} from ch group by 1) """

_PLACED = _USABLE + """, k as (select distinct caption_id, source_file, page from cap), p as (select distinct source_file, page_number, id from chunk_index),
j as (select caption_id, k.source_file, k.page, id, abs(k.page - page_number) dist, row_number() over (partition by caption_id, k.source_file, k.page order by abs(k.page - page_number), id) n from k join p on p.source_file = k.source_file and k.page is not null and page_number is not null),
fs as (select source_file, id, row_number() over (partition by source_file order by page_number is null, page_number, id) n from p),
pl as (select cap.caption_id, cap.source_file, cap.page, cap.caption, coalesce(j.id, fs.id) chunk_id, dist::int distance from cap left join j on j.n = 1 and j.caption_id = cap.caption_id and j.source_file = cap.source_file and j.page = cap.page left join fs on fs.n = 1 and fs.source_file = cap.source_file)
"""
_FIRST = CHUNKS + f""", a0 as (select {_trim('doc_code')} doc, id, string_split(body, chr(10))[-1] l from ch where element_type = 'abbreviation'),
b0 as (select doc, id, regexp_extract(l, '^([A-Z][A-Za-z0-9/\\-]{{1,9}}) - ([^\\n]{{3,80}})$', 1) short, regexp_extract(l, '^([A-Z][A-Za-z0-9/\\-]{{1,9}}) - ([^\\n]{{3,80}})$', 2) e from a0)"""
_ACRONYMS = _FIRST + ", ac as (select doc, short, arg_min(e, id) expansion from b0 where short <> '' and doc <> '' group by 1, 2)"
#: Chunks of Markdown documents as SQL: trails and fills as folds over the items of a document and of a stretch.
_CHUNKED = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) x, unnest(range(len(string_split(text, chr(10))))) n from documents where text is not null),
k as (select *, {_trim('x')} t, case when starts_with({_trim('x')}, '|') then 'table' when starts_with(x, '#') then 'section_header' when {_trim('x')} <> '' then 'text' end label from l),
g as (select *, n - row_number() over (partition by doc_id, label order by n) g from k), it as (select doc_id, min(n) n, label, case when label = 'section_header' then {_trim("ltrim(min(x), '#')")} else string_agg(t, chr(10) order by n) end t, length(min(x)) - length(ltrim(min(x), '#')) lvl
  from g where label is not null group by doc_id, label, case when label = 'table' then g end, case when label <> 'table' then n end),
p as (select *, row_number() over (partition by doc_id order by n) - 1 pos, sum((label <> 'text')::int) over (partition by doc_id order by n) run, label = 'section_header' h from it),
d as (select *, case when h then coalesce(nullif(regexp_extract(t, '{CLAUSE_DOTTED}', 1), ''), nullif(regexp_extract(t, '^[ \t]*([1-9]|1[0-9])[ \t]+[A-Z]', 1), ''), nullif(regexp_extract(t, '{ANNEX_NUMBER}', 1), ''), nullif(upper(regexp_extract(t, '(?i)^\\s*annex\\s+([a-z])\\b', 1)), ''))
  when label = 'text' then nullif(regexp_extract(t, '{CLAUSE_DOTTED}', 1), '') end dc, list(case when h then {{'l': lvl, 't': t}} end) over (partition by doc_id order by n) hs from p),
e as (select *, coalesce(last_value(dc ignore nulls) over (partition by doc_id order by n), '') clause, list_filter(list_reduce(list_filter(hs, lambda z: z is not null), lambda a, z: list_append(a[1:z.l - 1], z.t), []::varchar[]), lambda z: z <> '') tr,
  regexp_matches(t, '{CLAUSE_DOTTED}') or regexp_matches(t, '{LETTERED}') or regexp_matches(trim(t), '^{DEFAULT.requirement.removeprefix(chr(92) + 'b')}') b from d),
f as (select *, case when len(tr) > 0 then array_to_string(tr, ' > ') else '(document)' end section from e),
st as (select doc_id, run, list({{'s': length(t), 'b': b}} order by n) xs from f where label = 'text' group by 1, 2),
fo as (select doc_id, run, list_reduce(xs, lambda s, x: case when s.size >= 400 and ((s.size >= 1600 and x.b) or s.size >= 2500) then {{'size': x.s, 'ks': list_append(s.ks, s.ks[-1] + 1), 'cuts': list_append(s.cuts, case when s.size >= 1600 and x.b then 'structural' else 'paragraph' end)}}
  else {{'size': s.size + x.s, 'ks': list_append(s.ks, coalesce(s.ks[-1], 1)), 'cuts': s.cuts}} end, {{'size': 0::bigint, 'ks': []::bigint[], 'cuts': []::varchar[]}}) o from st),
tx as (select f.*, o.ks[row_number() over (partition by f.doc_id, f.run order by n)] c, o.cuts cuts from f join fo on fo.doc_id = f.doc_id and fo.run = f.run where label = 'text')
select doc_id::varchar doc, min(pos) pos, 0::bigint part, sha1(string_agg(t, chr(10) order by n)) body_sha1, coalesce(any_value(cuts)[c], 'section') cut, arg_max(section, n) section, arg_max(clause, n) clause, 'text' etype from tx group by doc_id, run, c
union all select doc_id::varchar, pos, 0, sha1(t), 'section', section, clause, 'table' from f where label = 'table' and length(t) <= 3600"""

QUERIES = {
    "ingest_names": ingest_names, "clause_lines": clause_lines, "heading_clauses": heading_clauses, "enriched": enriched, "content_ids": content_ids, "duplicate_bodies": duplicate_bodies,
    "captions_kept": captions_kept, "captions_attached": captions_attached, "captions_placed": captions_placed, "captions_in_bodies": captions_in_bodies, "postings_top": postings_top, "quality_counters": quality, "run_totals": run_totals, "acronyms": acronyms, "acronyms_expanded": expanded, "harvested": harvested, "document_chunks": document_chunks,
    "table_parts": table_parts, "ledger_plan": ledger_plan, "ledger_upsert": ledger_upsert, "projected_scan": projected, "filter_pushdown": filtered,
}
SQL = {
    "ingest_names": f"""with n as (select distinct path, {_BASE} b from ledger),
      m as (select *, coalesce(regexp_extract(b, '^{_ANY}'), '') c, regexp_extract(b, '{_ANY}([A-Z])', 1) r, regexp_extract(b, '{_ANY}[A-Z][-_ ]?Rev\\.?\\s?([0-9]+)', 1) k, sha1({_NS} || encode(path || '#v3#0')) h from n)
      select path, c doc_code, case when r = '' then '' when k <> '' then r || ' Rev.' || k else r end revision, case when regexp_matches(c, '-HB-|-TM-') then 'informative' else 'normative' end authority,
      case when regexp_matches(c, '-HB-|-TM-') then 'handbook' else 'standard' end source_class, {_UUID} first_page_id from m""",
    "clause_lines": CHUNKS + f""", l as (select unnest(string_split(body, chr(10))) x from ch)
      select regexp_extract(x, '{CLAUSE_DOTTED}', 1) clause, count(*) lines, count(case when regexp_matches(x, '{CLAUSE_DOTTED}') or regexp_matches(x, '{LETTERED}') or regexp_matches(trim(x), '^{REQ.removeprefix(chr(92) + 'b')}') then 1 end) boundaries from l group by 1""",
    "heading_clauses": f"""with h as (select distinct string_split(section, ' > ')[-1] heading from chunk_index)
      select heading, coalesce(nullif(regexp_extract(heading, '{CLAUSE_DOTTED}', 1), ''), nullif(regexp_extract(heading, '^[ \\t]*([1-9]|1[0-9])[ \\t]+[A-Z]', 1), ''), nullif(regexp_extract(heading, '{ANNEX_NUMBER}', 1), ''),
      nullif(upper(regexp_extract(heading, '(?i)^\\s*annex\\s+([a-z])\\b', 1)), ''), '') clause from h""",
    "enriched": CHUNKS + f""" select id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(body, '{CODE}'), lambda x: x is distinct from {_trim('doc_code')}))), ' ') refs,
      array_to_string(list_sort(list_distinct(regexp_extract_all(body, '{REQ}'))), ' ') req_ids, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(body), '{MODAL}'))), ' ') modals,
      length(body) n_chars, sha1('SECTION: ' || crumb || chr(10) || body) display_sha1 from ch""",
    "content_ids": CHUNKS + f""", n as (select id, source_file, sha1(body) s, row_number() over (partition by source_file, sha1(body) order by id) - 1 k from ch),
      u as (select id, sha1({_NS} || encode(source_file || '#v4#' || substring(s, 1, 20) || '#' || k)) h from n) select id, {_UUID} content_id from u""",
    "duplicate_bodies": CHUNKS + " select sha1(body) body_sha1, count(*) copies from ch group by 1 having count(*) > 1",
    "captions_kept": _USABLE + "select distinct caption_id, caption from cap",
    "captions_attached": _USABLE + """, k as (select distinct caption_id, source_file, page from cap), p as (select distinct source_file, page_number, id from chunk_index where page_number is not null),
      j as (select caption_id, k.page, id, abs(k.page - page_number) dist, row_number() over (partition by caption_id, k.source_file, k.page order by abs(k.page - page_number), id) n from k left join p on p.source_file = k.source_file and k.page is not null)
      select caption_id, id chunk_id, dist::int distance from j where n = 1""",
    "captions_placed": _PLACED + "select distinct caption_id, chunk_id, distance from pl",
    "captions_in_bodies": CHUNKS + ", " + _PLACED.strip().removeprefix("with ") + """, ad as (select chunk_id id, string_agg(chr(10) || '[FIGURES p' || coalesce(page::varchar, '') || '] ' || caption, '' order by page is null, page, caption_id, caption) a from (select distinct caption_id, page, caption, chunk_id from pl where chunk_id is not null) group by 1)
      select id, sha1(coalesce(body, '') || a) body_sha1, length(coalesce(body, '') || a) n_chars from ch join ad using (id)""",
    "table_parts": CHUNKS + """, t as (select id, list_filter(string_split(body, chr(10)), lambda x: starts_with(x, '|')) l from ch where element_type = 'table'), m as (select *, array_to_string(l, chr(10)) md, list_sum(list_transform(l[1:2], lambda x: length(x) + 1)) base from t),
      f as (select id, length(md) n, len(l) k, list_reduce(l[3:], lambda s, r: case when s.rows > 0 and s.size + length(r) + 1 > 400 then {'parts': s.parts + 1, 'longest': greatest(s.longest, s.size - 1), 'size': base + length(r) + 1, 'rows': 1} else {'parts': s.parts, 'longest': s.longest, 'size': s.size + length(r) + 1, 'rows': s.rows + 1} end,
        {'parts': 1::bigint, 'longest': 0::hugeint, 'size': base::hugeint, 'rows': 0}) s from m)
      select id, case when n <= 400 or k < 4 then 1 else s.parts end::int parts, case when n <= 400 or k < 4 then n else greatest(s.longest, s.size - 1) end::int longest from f""",
    "acronyms_expanded": _ACRONYMS + """, y as (select doc, list(short) shorts from ac group by 1), c as (select doc, regexp_extract_all(body, '\\b[A-Z][A-Za-z0-9/\\-]{1,9}\\b') w, shorts from (select *, """ + _trim("doc_code") + """ doc from ch where element_type <> 'abbreviation') join y using (doc))
      select doc, count(*) chunks, count(case when list_has_any(w, shorts) then 1 end) expanded from c group by 1""",
    "harvested": _ACRONYMS + " select doc, short, trim(regexp_replace(expansion, '\\s+', ' ', 'g')) expansion from ac where not starts_with(expansion, 'AXSS') and regexp_matches(short || '  ' || expansion, '^[A-Z][A-Za-z0-9/\\-]{1,9}  [A-Za-z][^\\n]{3,80}$')",
    "document_chunks": _CHUNKED,
    "postings_top": CHUNKS + f""", t as (select id, lower(unnest(regexp_extract_all(body, '{TOKEN.format(code=CODE)}'))) term from ch)
      select term, ('0x' || substring(md5(term), 1, 8))::bigint % 2147483648 term_idx, count(distinct id) chunks, count(*) tf from t group by 1, 2""",
    "quality_counters": _QUALITY + "select * from q",
    "run_totals": _QUALITY + "select count(*) documents, " + ", ".join(f"sum({c}) {c}" for c in "chunks tables definitions abbreviations cut_section cut_structural cut_paragraph cut_hard_max cut_definition at_hard_max".split()) + " from q",
    "acronyms": CHUNKS + f""", a as (select {_trim('doc_code')} doc, id, string_split(body, chr(10))[-1] l from ch where element_type = 'abbreviation'),
      b as (select doc, id, regexp_extract(l, '^([A-Z][A-Za-z0-9/\\-]{{1,9}}) - ([^\\n]{{3,80}})$', 1) short, regexp_extract(l, '^([A-Z][A-Za-z0-9/\\-]{{1,9}}) - ([^\\n]{{3,80}})$', 2) e from a)
      select doc, short, arg_min(e, id) expansion from b where short <> '' and doc <> '' group by 1, 2""",
    "ledger_plan": f"""with n as {_LATEST.format('ledger')}, o as {_LATEST.format("(select * from ledger where recorded_at < timestamp '2024-01-01')")}
      select coalesce(n.collection, o.collection) collection, coalesce(n.path, o.path) path, case when n.path is null then 'remove' when o.path is null then 'ingest' when n.s = o.s and n.s <> '' then 'skip' else 'update' end action
      from n full join o on n.collection = o.collection and n.path = o.path""",
    "ledger_upsert": f"""with t as {_LATEST.format('ledger')}, f as (select path, s from t where collection = '{COLLECTION}'), g as (select path, max(nullif(s, '')) s from t where collection <> '{COLLECTION}' group by 1)
      select path, nullif(s, '') sha256 from (select * from f where path not in (select path from g) union all select * from g) where path not in (select path from t where s = '')""",
    "projected_scan": "select source_class, count(distinct doc_code) doc_codes, count(*) chunks from chunk_index group by 1",
    "filter_pushdown": "select distinct id from chunk_index where doc_code = 'AXSS-E-ST-42-05' and clause = '3.2'",
}
