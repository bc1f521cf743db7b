"""Registered queries of the training-data operators, and SQL with the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import body, filled, trimmed
from strandline.llm import cutoff as cut
from strandline.llm import residue as res
from strandline.llm.cutoff import longer_sentences, truncated, truncation_by_source
from strandline.llm.dupes import copies, duplicate_groups
from strandline.llm.leak import RUN, leaks
from strandline.llm.lines import documents_with_lines, repeated_lines, repeated_positions, without_lines
from strandline.llm.mix import mixed, shares, token_counts
from strandline.llm.split import split_oversized
from strandline.llm.terms import term_counts, usefulness
from strandline.runtime import table, written

#: Production parameters of p1: a value of at most RARE_IDS ids is rare; shares above which one is common.
RARE_IDS, COMMON_CODE, COMMON_CLAUSE, COMMON_LABEL, LABEL_LEAST = 2, 0.05, 0.30, 0.20, 20
#: Production parameters of p2.
LINE_IDS, LINE_SHARE = 6, 0.10
#: Production parameters of p2_lines besides: different chunks that hold a line, and days on which they first came.
LINE_CLUSTERS, LINE_DAYS = 3, 2


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """field, value, chunks, documents, marks: every distinct doc_code, clause and label of chunk_index."""
    chunks = table(spark, d, "chunk_index").select("id", filled(F.col("doc_code")).alias("doc"), filled(F.col("clause")).alias("clause"))
    base = written(chunks.groupBy("id").agg(F.first("doc").alias("doc"), F.first("clause").alias("clause")).drop("id"), "labels")
    sequence = F.array(F.concat(F.lit("d"), "doc"), F.concat(F.lit("c"), "clause"))
    grams = written(term_counts(base.select(sequence.alias("t"), "doc"), "t", "doc", longest=2), "grams")
    kind = F.when(F.size("gram") == 2, "label").when(F.element_at("gram", 1).startswith("d"), "doc_code").otherwise("clause")
    value = F.array_join(F.transform("gram", lambda x: F.substring(x, 2, 2**31 - 1)), " ")
    # a clause that begins a sequence and a code that ends one are no labels: order in a label is fixed
    listed = grams.select(kind.alias("field"), value.alias("value"), F.substring(F.element_at("gram", 1), 2, 2**31 - 1).alias("doc"), F.col("occurrences").alias("chunks"), F.col("records").alias("documents"))
    ids = base.agg(F.count(F.lit(1))).scalar()
    codes = listed.where("field = 'doc_code'")
    of = codes.select("doc", F.col("chunks").alias("of"))
    n_codes = codes.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    rare = F.col("chunks") <= RARE_IDS
    code = codes.withColumn("marks", usefulness(F.col("value"), rare, F.col("chunks") / ids > COMMON_CODE))
    clause = listed.where("field = 'clause'").withColumn("marks", usefulness(F.col("value"), rare, F.col("documents") / n_codes > COMMON_CLAUSE))
    label = listed.where("field = 'label'").join(of, "doc").withColumn("marks", usefulness(F.col("value"), F.lit(False), (F.col("of") >= LABEL_LEAST) & (F.col("chunks") / F.col("of") > COMMON_LABEL)))
    names = ["field", "value", "chunks", "documents", "marks"]
    return code.select(names).unionByName(clause.select(names)).unionByName(label.select(names))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).select("field", "value", F.explode("marks").alias("mark"))


def _line_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "chunk_index").select("id", "doc_code", "text", "ingested_at")
    documents = written(documents_with_lines(rows, "id", filled(F.col("doc_code")), "text", F.to_date("ingested_at")), "lines")
    return documents, repeated_lines(documents, LINE_IDS, LINE_SHARE)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    documents, repeated = _line_documents(spark, d)
    return repeated_positions(documents, repeated).withColumnRenamed("key", "id")


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_code, mark, ids, clusters, days: the lines that repeat in different chunks and on different days, not only in republished ones."""
    documents, _ = _line_documents(spark, d)
    found = repeated_lines(documents, LINE_IDS, LINE_SHARE, LINE_CLUSTERS, LINE_DAYS)
    return found.select(F.col("src").alias("doc_code"), F.lower(F.hex("mark")).alias("mark"), "ids", "clusters", "days")


def p2_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """id, cleaned: every chunk without the repeated lines of its doc_code."""
    _, repeated = _line_documents(spark, d)
    rows = table(spark, d, "chunk_index").select("id", "doc_code", "text").dropDuplicates(["id"])
    return without_lines(rows, filled(F.col("doc_code")), "text", written(repeated, "repeated")).select("id", "cleaned")


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_index").select("id", trimmed(body(F.col("text"))).alias("body"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """id, piece_no, begins, ends, text, cut, record_cut: the pieces of every oversized body."""
    return split_oversized(_bodies(spark, d), "id", "body").withColumnRenamed("key", "id").dropDuplicates(["id", "piece_no"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_bodies(spark, d), "id", "body").select(F.col("key").alias("id"), F.col("record_cut").alias("cut")).distinct()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """keep_id, copies: one row for each record that stands under several ids, with their number."""
    return copies(duplicate_groups(table(spark, d, "chunk_index"), "id", "text", "crumb")).withColumnRenamed("keep", "keep_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = duplicate_groups(table(spark, d, "chunk_index"), "id", "text", "crumb")
    return groups.where("keep <> key").select(F.col("keep").alias("keep_id"), F.col("key").alias("copy_id"))


def _residue(spark: SparkSession, d: str) -> DataFrame:
    return res.reasons(table(spark, d, "captions").select("caption_id", "caption"), "caption_id", "caption")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).select(F.col("key").alias("caption_id")).distinct()


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    """reason, captions: how many captions are residue, and why."""
    return _residue(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("captions"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", question="question")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """item_id, documents, questions, passages: the items that leaked, into how many documents, how many of these hold every word of the question too, and the passages of the item in all of them."""
    found = _leaked(spark, d).groupBy(F.col("item").alias("item_id"))
    return found.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("question") == 1.0).alias("questions"), F.sum("passages").alias("passages"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return written(token_counts(table(spark, d, "documents"), "doc_id", "source", "text"), "tokens")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """key, source, tokens, copy, shard, place: the mixture, one row for each use of a document."""
    return mixed(_sizes(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source of mix_targets reaches, against its target."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    return shares(written(mixed(sizes, targets), "mix"), sizes, targets)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("cut").select(F.col("key").alias("doc_id")).distinct()


def p9_evidence(spark: SparkSession, d: str) -> DataFrame:
    """evidence, texts: how many texts are cut by a longer copy, by their open end, by a longer sentence elsewhere besides, and in all."""
    judged = written(_judged(spark, d), "judged").select("key", "open", "continued", "cut").distinct()
    sentences = longer_sentences(table(spark, d, "documents"), "doc_id", "text").withColumn("sentence", F.lit(True))
    t = judged.join(sentences, "key", "left").agg(
        F.count_if("continued").alias("longer text"), F.count_if("sentence").alias("longer sentence"), F.count_if("open").alias("open end"), F.count_if("cut").alias("cut"),
    )
    return t.unpivot([], ["longer text", "longer sentence", "open end", "cut"], "evidence", "texts")


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """source, texts, cut, share, limits: how often each source truncates."""
    return truncation_by_source(written(_judged(spark, d), "judged"))


#: White space of any kind, for RE2, and without the newline.
W, V = r"[\s\x0B\x{85}\p{Z}]", r"[\t\x0B\f\r \x{85}\p{Z}\x1C-\x1F]"


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{W}+', ''), '{W}+$', '')"


_LABELS = f"""
with b as (select distinct id, nullif({_trim('doc_code')}, '') doc, nullif({_trim('clause')}, '') clause from chunk_index),
c as (select doc, count(*) n from b where doc is not null group by 1),
k as (select clause, count(*) n, count(distinct doc) docs from b where clause is not null group by 1),
l as (select doc, clause, count(*) n from b where doc is not null and clause is not null group by 1, 2),
t as (select 'doc_code' as field, doc as value, n as chunks, 1 as documents, n <= {RARE_IDS} rare, n / (select count(*) from b) > {COMMON_CODE} common from c
  union all select 'clause', clause, n, docs, n <= {RARE_IDS}, docs / (select count(*) from c) > {COMMON_CLAUSE} from k
  union all select 'label', l.doc || ' ' || l.clause, l.n, 1, false, c.n >= {LABEL_LEAST} and l.n / c.n > {COMMON_LABEL} from l join c using (doc))
"""
_LINES = f"""
with b as (select distinct id, nullif({_trim('doc_code')}, '') doc, text from chunk_index),
u as (select id, doc, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) line_no from b where doc is not null),
n as (select id, doc, line_no, trim(regexp_replace(regexp_replace(lower(upper(line)), '\\p{{Nd}}+', '0', 'g'), '{V}+', ' ', 'g')) x from u),
o as (select doc, x, count(distinct id) ids from n where x <> '' and not starts_with(x, 'section:') group by 1, 2),
f as (select doc, count(*) n from b where doc is not null group by 1)
select id, line_no from n join o using (doc, x) join f using (doc) where ids >= {LINE_IDS} and ids / f.n >= {LINE_SHARE}
"""
_REPEATED = _LINES[: _LINES.index("select id, line_no from n")].replace("select distinct id, nullif", "select distinct id, ingested_at::date as day, nullif", 1) + f""", k as (select doc, text, min(day) as day from b where doc is not null group by 1, 2),
z as (select n.doc, n.x, count(distinct k.text) clusters, count(distinct k.day) as days from n join b using (id) join k on k.doc = n.doc and k.text = b.text where x <> '' and not starts_with(x, 'section:') group by 1, 2)
select doc doc_code, md5(x) mark, ids, clusters, days from z join o using (doc, x) join f using (doc) where ids >= {LINE_IDS} and ids / f.n >= {LINE_SHARE} and clusters >= {LINE_CLUSTERS} and days >= {LINE_DAYS}
"""
_CANON = "regexp_replace(lower(upper({})), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_COPIES = f"""
with b as (select id, string_split(text, chr(10)) l, crumb from chunk_index),
p as (select *, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^{W}*SECTION:')), true) pos from b),
t as (select id, crumb, array_to_string(case when pos > 0 then l[:pos-1] || l[pos+1:] else l end, chr(10)) body from p),
k as (select distinct id, {_CANON.format('body')} body, list_sort(list_filter(list_transform(string_split(crumb, '|'), lambda x: {_CANON.format('x')}), lambda x: x <> '')) parts from t),
g as (select body, parts, min(id) keep_id, count(*) copies from k group by 1, 2 having count(*) > 1)
"""
_UNIT = r"(?i)^[^\S\n]*((([1-9]|1[0-9])(\.[0-9]{1,3})+\.?(\s|$))|([a-z][.)]\s)|([a-z][a-z0-9]*([-‐‑–—.][a-z0-9]+)*_[0-9]{4,}\b))"
_SPLIT = f"""
with b as (select distinct id, string_split(text, chr(10)) l from chunk_index),
p as (select *, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^{W}*SECTION:')), true) pos from b),
t as (select id, {_trim("array_to_string(case when pos > 0 then l[:pos-1] || l[pos+1:] else l end, chr(10))")} body from p),
o as (select id, string_split(body, chr(10)) l from t where length(body) > 3600),
n as (select id, unnest(l) line, unnest(range(len(l))) no from o),
f as (select *, sum(regexp_matches(line, '{_UNIT}')::int) over (partition by id order by no) unit from n),
u as (select id, unit, length({_trim("string_agg(line, chr(10) order by no)")}) size from f group by 1, 2),
e as (select id, unnest(string_split(regexp_replace(line, '([.!?]){W}', '\\1' || chr(1), 'g'), chr(1))) piece from n),
m as (select id, (select max(size) from u where u.id = o.id) s, (select max(length({_trim('line')})) from n where n.id = o.id) p, (select max(length({_trim('piece')})) from e where e.id = o.id) e from o)
select id, case when s <= 3400 then 'structural' when p <= 3400 then 'paragraph' when e <= 3400 then 'sentence' else 'hard_max' end as cut from m
"""
_LEAKS = f"""
with w as (select doc_id, regexp_extract_all(lower(upper(text)), '[\\p{{L}}\\p{{N}}]+') w from documents),
i as (select item_id, regexp_extract_all(lower(upper(text)), '[\\p{{L}}\\p{{N}}]+') w from eval_items),
g as (select distinct doc_id, array_to_string(w[k:k+{RUN - 1}], ' ') run from (select doc_id, w, unnest(range(1, len(w) - {RUN - 2})) k from w where len(w) >= {RUN})),
h as (select distinct item_id, array_to_string(w[k:k+{RUN - 1}], ' ') run from (select item_id, w, unnest(range(1, len(w) - {RUN - 2})) k from i where len(w) >= {RUN}))
"""


#: How texts end, said anew for SQL: by characters instead of the operator's patterns.
_QUOTES = "'\"''”’»'"
_ENDS = rf"""
with a as (select doc_id, source, length(text) size, {_trim('text')} t from documents),
b as (select *, regexp_replace(t, '([\s\p{{Z}}\x{{FFFD}}…]|[.][.][.]+|[(\[]\s*([.][.][.]+|…|more|cut|truncated)\s*[)\]]|&h(e|el|ell|elli|ellip|ellip;)?|&)+$', '') base from a),
l as (select *, string_split(base, chr(10)) ls from b), m as (select *, ls[-1] last, coalesce(ls[-2], ls[-1]) before, ltrim(ls[-1]) flush from l),
c as (select *, right(rtrim(base, {_QUOTES} || '“)]}}*_'), 1) in ('.', '!', '?', '。', '！', '？') or right(rtrim(base, {_QUOTES} || ')]'), 1) in (';', ':') or right(base, 1) in ('"', '”', '’', '»') closed,
  case when starts_with(last, '|') then ends_with(last, '|') and (not starts_with(before, '|') or length(before) - length(replace(before, '|', '')) <= length(last) - length(replace(last, '|', '')))
    else (left(flush, 1) in ('-', '*', '•', '–', '·', '>') or regexp_matches(split_part(flush, ' ', 1), '^([0-9]{{1,3}}|[a-z])[.)]$')) and regexp_matches(flush, '^\S+\s+\S')
      or regexp_matches(flush, '^[A-Z][A-Z0-9]*([-_./][A-Z0-9]+)+([,;:]? [^\W\d_]{{1,12}}[.]? [0-9]+)?$')
      or (strpos(flush, ':') between 2 and 26 and regexp_matches(flush, '^\pL[\pL _-]*:\s+\S') and not regexp_matches(split_part(flush, ':', 2), '[.!?]'))
      or left(flush, 2) in ('--', '==', '**', '##', '~~') or left(flush, 1) in ('—', '–') or (left(flush, 1) in ('(', '[') and right(flush, 1) in (')', ']')) end whole from m),
o as (select *, base <> '' and not closed and (length(t) > length(base) or not whole) open from c),
f as (select distinct x.doc_id from o x join o y on x.base <> '' and length(y.base) > length(x.base) and starts_with(y.base, x.base)
  where substring(y.base, length(x.base) + 1, 1) <> chr(10) and (not x.closed or (regexp_matches(x.base, '[0-9][.]$') and regexp_matches(substring(y.base, length(x.base) + 1, 1), '[0-9]')))),
j as (select distinct doc_id, source, size, coalesce(open, false) open, doc_id in (select doc_id from f) continued from o)
"""
_EVIDENCE = _ENDS + rf""", sp as (select doc_id, open, regexp_split_to_array(regexp_replace(base, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|' || chr(10) || '+') us from o),
u as (select doc_id, {_trim('u')} u from (select doc_id, unnest(us) u from sp)), un as (select distinct u from u where length(u) >= {cut.LEAST}),
ta as (select distinct doc_id, {_trim('us[-1]')} u from sp where open), lo as (select distinct doc_id from ta where length(u) >= {cut.LEAST} and exists (select 1 from un where un.u <> ta.u and starts_with(un.u, ta.u)))
select 'longer text' evidence, count(case when continued then 1 end) texts from j union all select 'longer sentence', (select count(*) from lo) union all select 'open end', count(case when open then 1 end) from j union all select 'cut', count(case when open or continued then 1 end) from j
"""


#: Residue as it is seen in the captions, said anew for SQL: by how each kind begins, and by the syllables of the invented words.
_KINDS = rf"""
with a as (select distinct caption_id, lower(caption) t from captions where caption is not null),
c as (select *, {_trim(r"regexp_replace(t, '^[\s\p{Z}]*(\[[0-9]+\]|(figure|fig[.]?|page|pg[.]?|p[.]) *[0-9]+)[\s\p{Z}]*[:|.–—-]?', '')")} core from a),
m as (select *, case
  when not regexp_matches(core, '^(x+[^\pL]*){{3,}}$') and (regexp_matches(t, '\{{\{{[^{{}}]*\}}\}}|[$#]\{{|<%|@@[a-z_.]+@@|__[a-z_.]+__|\[\[|<<|%\(|\{{[0-9]\}}|\{{[a-z]{{4,}}\}}|<(insert|your|enter|add|type)\b')
    or regexp_matches(t, '\[[^\]]*(to be added|to be completed|tbd|describe the|insert |placeholder|einfügen|compléter|insertar|completar)[^\]]*\]') or regexp_matches(t, '(^|[^a-z])x{{3,}}([^a-z]|$)')) then 'placeholder'
  when regexp_matches(core, '^(sample description|dummy figure|text text|bla bla|this is a placeholder|type a description|asdf|caption text goes|blindtext|lorem ipsum|(x+[^\pL]*){{3,}}$)')
    or regexp_matches(core, '^((dol|cum|qua|mer|sun|nir|eba|pra|lon|tis|fel|ost|ari|vet)+[^\pL]*){{5,}}$') then 'filler'
  when regexp_matches(core, '^(traceback|\{{"error"|request timed out|connection reset|(http )?[45][0-9][0-9][: ]|fehler beim|your session|service temporarily|internal server|null pointer|error[: ]|access denied:|the requested image)') then 'message'
  when regexp_matches(core, '^(noscript|cookies must|this viewer needs|checking your browser|enable scripts|veuillez activer|bitte aktivieren|your browser does not|you need to turn|please enable)') then 'notice' end reason from c)
"""


QUERIES = {
    "p1_found": p1_found, "p1_terms": p1_terms, "p2_found": p2_found, "p2_lines": p2_lines, "p2_cleaned": p2_cleaned, "p3_found": p3_found, "p3_pieces": p3_pieces,
    "p4_found": p4_found, "p4_groups": p4_groups, "p6_found": p6_found, "p6_reasons": p6_reasons, "p7_found": p7_found, "p7_items": p7_items,
    "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_evidence": p9_evidence, "p9_sources": p9_sources,
}
SQL = {
    "p1_found": _LABELS + "select field, value, 'rare' as mark from t where rare union all select field, value, 'common' from t where common",
    "p1_terms": _LABELS + "select field, value, chunks, documents, list_concat(case when rare then ['rare'] else [] end, case when common then ['common'] else [] end) marks from t",
    "p2_found": _LINES,
    "p2_lines": _REPEATED,
    "p2_cleaned": _LINES.replace("select id, line_no from n", ", bad as (select id, line_no, true hit from n").rstrip() + """), k as (select u.id, string_agg(line, chr(10) order by u.line_no) filter (where hit is null) t from u left join bad on bad.id = u.id and bad.line_no = u.line_no group by 1)
      select b.id, case when b.doc is null then b.text else coalesce(k.t, '') end cleaned from b left join k using (id)""",
    "p3_found": _SPLIT,
    "p4_found": _COPIES + "select keep_id, id as copy_id from k join g using (body, parts) where id <> keep_id",
    "p4_groups": _COPIES + "select keep_id, copies from g",
    "p6_found": _KINDS + "select distinct caption_id from m where reason is not null",
    "p6_reasons": _KINDS + "select reason, count(distinct caption_id) captions from m where reason is not null group by 1",
    "p7_found": _LEAKS + "select distinct doc_id, item_id from g join h using (run)",
    "p7_items": _LEAKS + """, m as (select doc_id, item_id, count(*) n from g join h using (run) group by 1, 2), qw as (select item_id, regexp_extract_all(lower(upper(question)), '[\\p{L}\\p{N}]+') q from eval_items)
      select item_id, count(*) documents, count(case when list_has_all(w.w, qw.q) then 1 end) questions, sum(n)::bigint passages from m join w using (doc_id) join qw using (item_id) group by 1""",
    "p9_found": _ENDS + "select distinct doc_id from j where open or continued",
    "p9_evidence": _EVIDENCE,
    "p9_sources": _ENDS + f""", k as (select source, size, coalesce(open, false) or doc_id in (select doc_id from f) cut from o), s as (select source, count(*) texts, count(case when cut then 1 end) cut from k group by 1),
      p as (select source, size, count(case when cut then 1 end) c from k group by 1, 2), pm as (select p.source, list_sort(list(size)) limits from p join s on p.source is not distinct from s.source where c >= {cut.LIMIT_TEXTS} and c / texts >= {cut.LIMIT_SHARE} group by 1)
      select s.source, texts, cut, cut / texts share, coalesce(limits, []) limits from s left join pm on pm.source is not distinct from s.source""",
}
