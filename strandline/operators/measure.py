"""How well an index labels and a search reaches: specificity, coverage, recall, migration."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.parse import anchor_parts, collapsed, populated
from strandline.functions.text import trimmed
from strandline.runtime import hot_keys, written

# Upper ends of the bands (a boundary belongs to the tighter band), the cheap ones, sections from which a label is sticky.
BANDS = (("specific", 0.05), ("loose", 0.20), ("degenerate", 0.50), ("free", None))
CHEAP = ("degenerate", "free")
STICKY_SECTIONS, SECTION_CHARS = 10, 60
# Fields by what recovers them, their floors, and the units that have no page by design.
GENERIC = {"crumb": 0.95, "clause": 0.50, "page_number": 0.50, "modals": 0.0, "element_type": 0.95}
CORPUS_BOUND = {"doc_code": 0.95, "document_revision": 0.95, "refs": 0.0, "req_ids": 0.0}
PAGELESS = ("definition", "abbreviation")


def label_counts(chunks: DataFrame) -> DataFrame:
    """doc, clause, n, of, sections: chunks with each label, chunks of its document, and distinct sections (their first 60 characters) under it.

    Labels are trimmed; nulls count as ''.
    """
    t = chunks.select(*[trimmed(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in (("doc_code", "doc"), ("clause", "clause"))], F.substring(F.coalesce("section", F.lit("")), 1, SECTION_CHARS).alias("section"))
    labels = t.groupBy("doc", "clause", "section").agg(F.count(F.lit(1)).alias("n")).groupBy("doc", "clause").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sections"))
    return labels.join(labels.groupBy("doc").agg(F.sum("n").alias("of")), "doc").select("doc", "clause", "n", "of", "sections")


def band(fraction: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, top in reversed(BANDS):
        out = F.lit(name) if top is None else F.when(fraction <= top, name).otherwise(out)
    return F.when(fraction.isNotNull(), out)


def cause(sections: Column) -> Column:
    return F.when(sections.isNull(), "unknown").when(sections >= STICKY_SECTIONS, "sticky-label").otherwise("large-clause")


def anchor_spans(frame: DataFrame) -> DataFrame:
    """anchor_id, doc, clause: the distinct labels an answer must draw on, trimmed; the empty pair is left out."""
    s = frame.select("anchor_id", F.explode("_anchor.spans").alias("s"))
    pair = s.select("anchor_id", trimmed(F.coalesce(F.col("s.doc_code"), F.lit(""))).alias("doc"), trimmed(F.coalesce(F.col("s.clause"), F.lit(""))).alias("clause"))
    return pair.where("doc <> '' or clause <> ''").distinct()


def specificity(spans: DataFrame, labels: DataFrame) -> DataFrame:
    """The spans with n, of, fraction, band, sections, cause. Spans of a document the index does not hold have nulls; a label it does not hold has n = 0."""
    docs = labels.select("doc", "of").distinct()
    joined = spans.join(docs, "doc", "left").join(labels.drop("of"), ["doc", "clause"], "left")
    n = F.when(F.col("of").isNotNull(), F.coalesce("n", F.lit(0)))
    t = joined.withColumn("n", n).withColumn("fraction", F.round(F.col("n") / F.col("of"), 6))
    return t.withColumn("band", band(F.col("n") / F.col("of"))).withColumn("cause", F.when(F.col("of").isNotNull(), cause(F.col("sections"))))


def band_counts(judged: DataFrame) -> DataFrame:
    """band, spans, sticky, large, unknown: every band, those without spans too; the causes count for cheap bands only; 'unmeasurable' has its row."""
    spark = judged.sparkSession
    domain = spark.createDataFrame([(n,) for n, _ in BANDS] + [("unmeasurable",)], "band string")
    cheap = F.col("band").isin(*CHEAP)
    n = judged.withColumn("band", F.coalesce("band", F.lit("unmeasurable"))).groupBy("band").agg(
        F.count(F.lit(1)).alias("spans"), *[F.count_if(cheap & (F.col("cause") == c)).alias(a) for c, a in (("sticky-label", "sticky"), ("large-clause", "large"), ("unknown", "unknown"))]
    )
    return domain.join(n, "band", "left").fillna(0, ["spans", "sticky", "large", "unknown"])


def label_coverage(chunks: DataFrame) -> DataFrame:
    """doc, passages, one fraction a field, breaches, verdict, severity: how many passages of each document carry each label.

    Pages are asked only of units that can have one; a field with nothing to ask has null and no
    breach. A parse problem (generic field below its floor) outranks a profile mismatch.
    """
    kinds = dict(chunks.dtypes)
    floors = GENERIC | CORPUS_BOUND
    asked = {f: ~F.coalesce(F.col("element_type").isin(*PAGELESS), F.lit(False)) if f == "page_number" else F.lit(True) for f in floors}
    fractions = [F.avg(F.when(asked[f], populated(F.col(f), kinds[f]).cast("double"))).alias(f) for f in floors]
    t = chunks.groupBy(F.coalesce("doc_code", F.lit("")).alias("doc")).agg(F.count(F.lit(1)).alias("passages"), *fractions) if "doc_code" in kinds else chunks
    below = lambda names: F.array_sort(F.array_compact(F.array(*[F.when(F.col(f) < v, F.lit(f)) for f, v in names.items()])))
    t = t.withColumn("generic_breaches", below(GENERIC)).withColumn("corpus_breaches", below(CORPUS_BOUND))
    severity = F.when(F.size("generic_breaches") > 0, 0).when(F.size("corpus_breaches") > 0, 1).otherwise(2)
    names = F.array(*[F.lit(x) for x in ("PARSE PROBLEM", "PROFILE MISMATCH", "ok")])
    return t.withColumn("severity", severity).withColumn("verdict", F.get(names, F.col("severity"))).withColumns({f: F.round(f, 6) for f in floors})


def reached(need: DataFrame, context: DataFrame) -> DataFrame:
    """config, anchor_id, doc, clause, hit: for every configuration in ``context`` (config, anchor_id, doc, clause), whether each needed span is in its context."""
    configs = context.select("config").distinct()
    wanted = need.withColumn("config", F.explode(F.array(*[F.lit(r[0]) for r in configs.collect()]).cast("array<string>")))
    have = context.select("config", "anchor_id", "doc", "clause", F.lit(True).alias("hit")).distinct()
    return wanted.join(have, ["config", "anchor_id", "doc", "clause"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def recall(hits: DataFrame) -> DataFrame:
    """config, spans_reached, spans_total, items_all_spans, items_no_span, items_total."""
    item = hits.groupBy("config", "anchor_id").agg(F.count_if("hit").alias("got"), F.count(F.lit(1)).alias("need"))
    return item.groupBy("config").agg(
        F.sum("got").alias("spans_reached"), F.sum("need").alias("spans_total"), F.count_if(F.col("got") == F.col("need")).alias("items_all_spans"),
        F.count_if(F.col("got") == 0).alias("items_no_span"), F.count(F.lit(1)).alias("items_total"),
    )


def gains_losses(hits: DataFrame, baseline: str) -> DataFrame:
    """config, change, anchor_id, doc, clause: spans a configuration gains over the baseline and those it loses, never netted."""
    got = hits.where("hit").select("config", "anchor_id", "doc", "clause")
    keys = ["anchor_id", "doc", "clause"]
    base = got.where(F.col("config") == baseline).select(keys)
    others = got.where(F.col("config") != baseline)
    gains = others.join(base, keys, "left_anti").withColumn("change", F.lit("gain"))
    configs = hits.where(F.col("config") != baseline).select("config").distinct()
    held = base.withColumn("config", F.explode(F.array(*[F.lit(r[0]) for r in configs.collect()]).cast("array<string>")))
    losses = held.join(others, ["config", *keys], "left_anti").withColumn("change", F.lit("loss"))
    return gains.unionByName(losses).select("config", "change", *keys)


def rank_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """qid, recall, precision, mrr, ndcg at k: ``ranked`` has qid, key, rank from 0, ``relevant`` qid, key. Queries without a hit count with 0."""
    rel = relevant.select("qid", "key").distinct()
    n = rel.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    hit = ranked.where(F.col("rank") < k).join(rel, ["qid", "key"], "left_semi").groupBy("qid").agg(
        F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(F.lit(1.0) / F.log2(F.col("rank") + 2)).alias("dcg")
    )
    t = n.join(hit, "qid", "left").fillna(0, ["hits", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1))
    return t.select("qid", F.round(F.col("hits") / F.col("n"), 6).alias("recall"), F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.coalesce(F.lit(1.0) / (F.col("first") + 1), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


# --- migration of anchors ------------------------------------------------------------------------


def doc_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_doc, new_doc: codes that changed between two indexes, by source_file; both have source_file and doc_code."""
    a = old.select("source_file", F.col("doc_code").alias("old_doc")).distinct()
    b = new.select("source_file", F.col("doc_code").alias("new_doc")).distinct()
    return a.join(b, "source_file").where("old_doc <> new_doc and old_doc <> ''").select("old_doc", "new_doc").distinct()


def frame_refs(frame: DataFrame) -> DataFrame:
    """anchor_id, field, claim, ref, doc, clause, span: the evidence of claims and the anchor spans of every item; claim is -1 for the latter."""
    ev = frame.select("anchor_id", F.posexplode("claims").alias("claim", "c")).select("anchor_id", "claim", F.posexplode("c.evidence").alias("ref", "e"))
    doc, clause = anchor_parts(F.col("e.anchor"))
    ev = ev.select("anchor_id", F.lit("evidence").alias("field"), "claim", "ref", doc.alias("doc"), clause.alias("clause"), F.col("e.span").alias("span"))
    sp = frame.select("anchor_id", F.posexplode("_anchor.spans").alias("ref", "s"))
    sp = sp.select("anchor_id", F.lit("spans").alias("field"), F.lit(-1).alias("claim"), "ref", F.coalesce("s.doc_code", F.lit("")).alias("doc"), F.coalesce("s.clause", F.lit("")).alias("clause"), F.col("s.text").alias("span"))
    return ev.unionByName(sp)


#: Pieces in a row by which spans and chunks meet: as many as fit, of these. Spans without a whole piece inside are tested on every chunk of their document.
GRAMS = (6, 3, 2, 1)
#: Documents that are broadcast at most, to leave out chunks nobody asks for and to rename; groups of documents a shuffle partition; letters of chunks that a search takes at once.
ASKED_DOCS, GROUPS, LETTERS = 100_000, 4, 8_000_000


def resolve(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The references with labels (distinct clauses of the chunks of their document whose text contains the span) and n_chunks.

    Texts are compared with white space collapsed and letter case ignored. Chunks and the distinct
    spans of a document are brought together once (those of a hot document in several parts, to
    each of which its spans are copied) and only labels and counts come out. Instead of testing
    every span on every chunk, they meet on a run of whole pieces inside the span (its first and
    last piece may be cut in the middle of a word): six, else three, two or one; what meets is
    compared in full. A span of one or two pieces meets every chunk of its document. An empty span
    resolves to nothing. ``chunks`` has id, doc, clause, text, one row an id.
    """
    spark = refs.sparkSession
    asked = refs.select("doc", collapsed(F.col("span")).alias("span_norm")).where("span_norm <> '' and doc <> ''")
    body = chunks.where("doc <> ''")
    docs = written(asked.select("doc").distinct(), "docs")
    if docs.count() <= ASKED_DOCS:
        body = body.join(F.broadcast(docs), "doc", "left_semi")
    # at most HOT_KEYS rows
    hot = F.broadcast(written(hot_keys(body, ["doc"]), "hot"))
    groups = GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = lambda t: t.withColumn("__key", F.xxhash64("doc")).join(hot, "__key", "left").withColumn("part", F.when(F.col("__salts").isNull(), F.pmod("__key", F.lit(groups))).otherwise(F.col("__key")))
    texts = placed(body).select("part", F.pmod(F.xxhash64("id"), F.coalesce("__salts", F.lit(1))).cast("int").alias("salt"), "doc", F.col("clause").alias("label"), collapsed(F.col("text")).alias("body"))
    spans = placed(asked.distinct()).select("part", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)).alias("salt"), "doc", "span_norm")
    hits = texts.groupBy("part", "salt").cogroup(spans.groupBy("part", "salt")).applyInArrow(_hits, "doc string, span_norm string, labels array<string>, n long")
    # from here 128 bits stand for the document and the span
    key = lambda span: F.substring(F.unhex(F.sha2(F.concat(F.sha2("doc", 256), span), 256)), 1, 16).alias("__key")
    found = hits.select(key(F.col("span_norm")), "labels", "n").groupBy("__key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), F.sum("n").alias("n_chunks"))
    out = refs.select("*", key(collapsed(F.col("span")))).join(found, "__key", "left").drop("__key")
    return out.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def _hits(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """doc, span_norm, labels, n: the spans that stand in texts of their document (doc, label, body), the labels of these, and how many they are."""
    found: dict[int, tuple[set, int]] = {}
    if texts.num_rows and spans.num_rows:
        search = _Spans(spans["doc"].to_pylist(), spans["span_norm"].to_pylist())
        ends = np.cumsum(pc.binary_length(texts["body"]).to_numpy())
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + LETTERS, "right")))
            part = texts.slice(start, stop - start)
            labels = part["label"].to_pylist()
            for span, row in search.found(part["doc"], part["body"]):
                have, n = found.get(span, (set(), 0))
                have.add(labels[row])
                found[span] = have, n + 1
            start = stop
    at = pa.array(list(found), pa.int64())
    kinds = {"doc": pa.string(), "span_norm": pa.string(), "labels": pa.list_(pa.string()), "n": pa.int64()}
    columns = [spans["doc"].take(at).cast(pa.string()), spans["span_norm"].take(at).cast(pa.string()), pa.array([sorted(x) for x, _ in found.values()], kinds["labels"]), pa.array([n for _, n in found.values()], pa.int64())]
    return pa.table(columns, schema=pa.schema(kinds))


class _Spans:
    """Spans of documents, found in texts by the digests of their runs of pieces; a digest only proposes, the text decides."""

    def __init__(self, docs: list[str], spans: list[str]) -> None:
        self.spans, self.docs = spans, {d: i for i, d in enumerate(dict.fromkeys(docs))}
        self.short: dict[int, list[int]] = {}
        runs: dict[int, list[tuple[int, int, list[str]]]] = {}
        for i, (d, s) in enumerate(zip(docs, spans)):
            inner = s.split(" ")[1:-1]
            g = next((g for g in GRAMS if g <= len(inner)), 0)
            if g:
                runs.setdefault(g, []).append((i, self.docs[d], inner[:g]))
            else:
                self.short.setdefault(self.docs[d], []).append(i)
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for r in runs.values() for *_, run in r for w in run))}
        self.runs = {}
        for g, rows in sorted(runs.items()):
            words = np.array([[self.words[w] for w in run] for *_, run in rows], np.uint64)
            digest = self.digest(np.array([d for _, d, _ in rows], np.uint64), words.T)
            order = np.argsort(digest, kind="stable")
            self.runs[g] = digest[order], np.array([i for i, *_ in rows])[order], self.map_of(digest)

    @staticmethod
    def digest(doc: np.ndarray, words: Iterable[np.ndarray]) -> np.ndarray:
        h = doc + np.uint64(1)
        for w in words:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    @staticmethod
    def map_of(digest: np.ndarray) -> tuple[np.ndarray, np.uint64]:
        """A map of the leading bits of digests, by which most others are passed over, and by how much to shift."""
        bits = max(10, int(len(digest)).bit_length() + 4)
        shift = np.uint64(64 - bits)
        held = np.zeros(1 << bits, bool)
        held[digest >> shift] = True
        return held, shift

    def found(self, docs: pa.ChunkedArray, bodies: pa.ChunkedArray) -> Iterator[tuple[int, int]]:
        """(number of the span, number of the text) for each span that stands in a text of its document, once."""
        doc = pc.index_in(docs, pa.array(list(self.docs), docs.type)).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        read = bodies.combine_chunks()
        for d, spans in self.short.items():
            for row in np.flatnonzero(doc == d).tolist():
                text = read[row].as_py()
                yield from ((i, row) for i in spans if self.spans[i] in text)
        if not self.runs:
            return
        split = pc.split_pattern(read, " ")
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        word = pc.index_in(split.flatten(), pa.array(list(self.words), docs.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        # a text of a document without spans has no known words
        word = np.where(doc[row] < 0, -1, word)
        unknown = np.concatenate([[0], np.cumsum(word < 0)])
        last = np.repeat(np.cumsum(sizes), sizes)
        at, word = np.flatnonzero(word >= 0), word.astype(np.uint64)
        for g, (digests, owners, (held, shift)) in self.runs.items():
            at = at[at + g <= last[at]]
            at = at[unknown[at + g] == unknown[at]]
            h = self.digest(doc[row[at]].astype(np.uint64), (word[at + i] for i in range(g)))
            near = held[h >> shift]
            h, where = h[near], row[at[near]]
            first, behind = np.searchsorted(digests, h, "left"), np.searchsorted(digests, h, "right")
            met = behind > first
            pairs = np.unique(np.stack([where[met], first[met], behind[met]], 1), axis=0)
            known, text = -1, ""
            for r, a, b in pairs.tolist():
                if r != known:
                    known, text = r, read[r].as_py()
                yield from ((i, r) for i in owners[a:b].tolist() if self.spans[i] in text)


def decide(refs: DataFrame, chunks: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The references with renamed_from, state and new clause: UNRESOLVED, AMBIGUOUS, unchanged or RELABELLED.

    A document whose code changed is looked up under its new one, and such a reference counts as
    relabelled even where its clause stays.
    """
    r = refs
    if aliases is not None:
        aliases = written(aliases, "aliases")
        if aliases.count() <= ASKED_DOCS:
            aliases = F.broadcast(aliases)
        r = r.join(aliases, F.col("doc") == F.col("old_doc"), "left").withColumn("renamed_from", F.col("old_doc")).withColumn("doc", F.coalesce("new_doc", "doc")).drop("old_doc", "new_doc")
    else:
        r = r.withColumn("renamed_from", F.lit(None).cast("string"))
    t = resolve(r, chunks)
    only = F.element_at("labels", 1)
    moved = (only != F.col("clause")) | F.col("renamed_from").isNotNull()
    state = F.when(F.size("labels") == 0, "UNRESOLVED").when(F.size("labels") > 1, "AMBIGUOUS").when(moved, "RELABELLED").otherwise("unchanged")
    return t.withColumn("state", state).withColumn("new", F.when(F.size("labels") == 1, only).otherwise(F.col("clause")))


def migrate(frame: DataFrame, decisions: DataFrame) -> DataFrame:
    """The frame with relabelled references rewritten: evidence keeps its earlier anchor in ``anchor_before``, spans get the new label and lose the point id that no longer resolves."""
    moved = decisions.where("state = 'RELABELLED'").withColumn("anchor", F.trim(F.concat_ws(" ", "doc", "new")))
    at = F.concat_ws("/", "field", "claim", "ref")
    table = moved.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct(at, F.struct("anchor", "doc", F.col("new").alias("clause"))))).alias("__m"))
    look = lambda *p: F.try_element_at("__m", F.concat_ws("/", *p))
    new_ev = lambda ci: lambda e, ei: F.struct(
        F.coalesce(look(F.lit("evidence"), ci, ei)["anchor"], e["anchor"]).alias("anchor"), e["span"].alias("span"), F.when(look(F.lit("evidence"), ci, ei).isNotNull(), e["anchor"]).alias("anchor_before")
    )
    claims = F.transform("claims", lambda c, ci: F.struct(c["id"].alias("id"), c["tier"].alias("tier"), c["text"].alias("text"), F.transform(c["evidence"], new_ev(ci)).alias("evidence")))
    spans = F.transform(
        "_anchor.spans",
        lambda s, si: F.struct(
            F.coalesce(look(F.lit("spans"), F.lit(-1), si)["doc"], s["doc_code"]).alias("doc_code"), F.coalesce(look(F.lit("spans"), F.lit(-1), si)["clause"], s["clause"]).alias("clause"),
            s["text"].alias("text"), s["role"].alias("role"), s["point_id"].alias("point_id_stale"), F.when(look(F.lit("spans"), F.lit(-1), si).isNotNull(), s["clause"]).alias("clause_before"),
        ),
    )
    return frame.join(table, "anchor_id", "left").withColumn("claims", claims).withColumn("_anchor", F.struct(spans.alias("spans"))).drop("__m")
