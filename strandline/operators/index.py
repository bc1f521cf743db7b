"""The chunk table: enrichment, ids, postings, incremental loads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import ids, parse
from strandline.functions import profile as pf
from strandline.functions.profile import DEFAULT, CorpusProfile
from strandline.runtime import salted_join, written


def enrich(chunks: DataFrame, body: str, own_code: str, profile: CorpusProfile = DEFAULT) -> DataFrame:
    """Add refs, req_ids, modals and n_chars of a body."""
    b = F.col(body)
    return chunks.withColumns({"refs": parse.refs(b, F.col(own_code), profile), "req_ids": parse.requirement_ids(b, profile), "modals": parse.modals(b), "n_chars": F.length(b)})


def occurrences(chunks: DataFrame, source: str, body: str, order: list[str], name: str = "occurrence") -> DataFrame:
    """Add the ordinal, from 0, of a verbatim repeat of a body within its source, by the given order.

    Bodies are compared by digest. A body repeated without end is spread by the order of its rows.
    """
    return ordinals(chunks.withColumn("__digest", F.sha1(F.col(body))), [source, "__digest"], order, name).drop("__digest")


def ordinals(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Add the place, from 0, of each row in its group by the given order, in two levels.

    Rows are cut into ranges of (group, order); a window numbers the rows of a group in a range,
    and what earlier ranges hold of the group is added. A hot group is many ranges.
    """
    ranged = written(rows.repartitionByRange(*[F.col(f"`{c}`") for c in [*by, *order]]).withColumn("__range", F.spark_partition_id()), "ranged")
    own = ranged.withColumn("__own", F.row_number().over(Window.partitionBy("__range", *by).orderBy(*order)) - 1)
    held = ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    # only groups that reach over an edge have rows here
    offset = held.withColumn("__before", earlier).where("__before > 0").select(*by, "__range", "__before")
    match = [own[c].eqNullSafe(offset[c]) for c in by] + [own["__range"] == offset["__range"]]
    joined = own.join(offset, match, "left").select(*[own[c] for c in rows.columns], (own["__own"] + F.coalesce("__before", F.lit(0))).cast("int").alias(name))
    return joined


def content_ids(chunks: DataFrame, source: str, body: str, order: list[str], name: str = "content_id") -> DataFrame:
    """Add the content id: equal for equal body, source and ordinal, whatever else moved."""
    t = ordinals(chunks.withColumn("__digest", F.sha1(F.col(body))), [source, "__digest"], order, "__n")
    return t.withColumn(name, ids.digest_id(F.col(source), F.col("__digest"), F.col("__n"))).drop("__n", "__digest")


def terms(text: Column, profile: CorpusProfile = DEFAULT) -> Column:
    """The terms of a text: whole document codes or words of two or more characters, in lower case. Null gives none."""
    pattern = pf.TOKEN.format(code=profile.code)
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower), F.array().cast("array<string>"))


def postings(rows: DataFrame, key: str, text: str, profile: CorpusProfile = DEFAULT) -> DataFrame:
    """key, term, tf, term_idx: term frequencies with hashed indices; a text without terms gives no row."""
    each = rows.select(F.col(key).alias("key"), F.explode(terms(F.col(text), profile)).alias("term"))
    return each.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf")).withColumn("term_idx", ids.term_index(F.col("term")))


def sparse_vectors(posts: DataFrame, weight: str = "tf") -> DataFrame:
    """key, indices, values: each text's vector, by index; colliding terms add up."""
    merged = posts.groupBy("key", "term_idx").agg(F.sum(weight).cast("double").alias("w"))
    rows = F.array_sort(F.collect_list(F.struct("term_idx", "w")))
    return merged.groupBy("key").agg(rows.alias("v")).select("key", F.col("v.term_idx").alias("indices"), F.col("v.w").alias("values"))


def idf(posts: DataFrame) -> DataFrame:
    """term, df, idf over all texts that have terms: ln(1 + n / df)."""
    n = posts.select("key").distinct().agg(F.count(F.lit(1)).alias("n"))
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log1p(n.scalar() / F.col("df")))


def weighted(posts: DataFrame, table: DataFrame) -> DataFrame:
    """key, term, tf, w: TF-IDF weights scaled to unit length. Terms without an idf are left out. ``posts`` should be a table."""
    return _unit(_raised(posts, table)).select("key", F.explode(F.arrays_zip("terms", "tf", "w")).alias("p")).select("key", F.col("p.terms").alias("term"), "p.tf", "p.w")


def _raised(posts: DataFrame, table: DataFrame) -> DataFrame:
    return salted_join(posts.select("key", "term", "tf"), table.select("term", "idf"), ["term"]).withColumn("w", F.col("tf") * F.col("idf"))


def _unit(raised: DataFrame) -> DataFrame:
    """key, terms, tf, w: one row a text, its weights scaled to unit length."""
    rows = raised.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "tf", "w")).alias("p"))
    return rows.select("key", F.col("p.term").alias("terms"), F.col("p.tf").alias("tf"), F.transform("p.w", lambda x: x / F.col("norm")).alias("w"))


def search_vectors(posts: DataFrame, table: DataFrame) -> DataFrame:
    """key, terms, tf, w: the sparse vectors of every text, one row each, with counts and with TF-IDF weights of unit length; to be stored once and searched often."""
    return _unit(_raised(posts, table))


def term_vectors(rows: DataFrame, key: str, text: str, profile: CorpusProfile = DEFAULT) -> DataFrame:
    """key, terms, tf: the distinct terms of every text with their counts, one row each, without a shuffle; a text without terms gives no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(1).flatten().dictionary_encode()
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            v = max(1, len(words.dictionary))
            pair, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * v + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            ends = np.searchsorted(pair // v, np.arange(len(sizes) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (words.dictionary.take(pa.array(pair % v)), pa.array(n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["key", "terms", "tf"])

    each = rows.select(F.col(key).alias("key"), terms(F.col(text), profile).alias("t")).where(F.size("t") > 0)
    return each.mapInArrow(count, f"key {dict(each.dtypes)['key']}, terms array<string>, tf array<long>")


def idf_of_vectors(vectors: DataFrame) -> DataFrame:
    """``idf`` from term vectors: only terms are shuffled, merged before."""
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    return vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log1p(n.scalar() / F.col("df")))


#: Terms whose idf is sent to the tasks at most (about 100 bytes each); more are joined.
VOCABULARY = 1_000_000


def unit_vectors(vectors: DataFrame, table: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """key, terms, tf, w: term vectors with TF-IDF weights of unit length. A vocabulary that is small is sent to the vectors, a larger one meets them by a join."""
    spark = vectors.sparkSession
    if table.limit(vocabulary + 1).count() > vocabulary:
        posts = vectors.select("key", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("key", F.col("p.terms").alias("term"), "p.tf")
        return search_vectors(posts, table)
    known = table.select("term", "idf").toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast((pa.array(known.column(0).to_pylist(), pa.string()), known.column(1).to_numpy()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, idf = sent.value
        for b in batches:
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            at = pc.index_in(b.column(1).flatten(), value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
            w = b.column(2).flatten().to_numpy() * idf[at]
            norm = np.sqrt(np.add.reduceat(w * w, ends[:-1])) if len(sizes) else np.zeros(0)
            unit = pa.ListArray.from_arrays(pa.array(ends), pa.array(w / np.repeat(norm, sizes)))
            yield pa.RecordBatch.from_arrays([*b.columns, unit], ["key", "terms", "tf", "w"])

    kinds = dict(vectors.dtypes)
    return vectors.select("key", "terms", "tf").mapInArrow(weigh, f"key {kinds['key']}, terms array<string>, tf array<long>, w array<double>")


# --- incremental loads -------------------------------------------------------------------------


def latest_ledger(ledger: DataFrame) -> DataFrame:
    """collection, path, sha256: the newest record of each file; of equal times the largest digest."""
    return ledger.groupBy("collection", "path").agg(F.max_by("sha256", F.struct("recorded_at", F.coalesce("sha256", F.lit("")))).alias("sha256"))


def load_plan(files: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """collection, path, action: skip, update, ingest or remove, of the files now there against the ledger.

    A file whose digest is unknown on either side is loaded again.
    """
    old = ledger.select("collection", "path", F.col("sha256").alias("old"), F.lit(True).alias("had"))
    new = files.select("collection", "path", F.col("sha256").alias("new"), F.lit(True).alias("has"))
    same = F.coalesce(F.col("old") == F.col("new"), F.lit(False)) & F.lit(not force)
    action = F.when(F.col("has").isNull(), "remove").when(F.col("had").isNull(), "ingest").when(same, "skip").otherwise("update")
    return new.join(old, ["collection", "path"], "full_outer").select("collection", "path", action.alias("action"))


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows of ``incoming`` in place of those with the same key. Of repeated keys in ``incoming`` one row is kept."""
    fresh = incoming.dropDuplicates([key])
    return current.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete_where(current: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``current`` without the rows whose values of ``on`` are in ``keys``."""
    return current.join(keys.select(*on).distinct(), on, "left_anti")


def quality_counters(chunks: DataFrame, by: list[str], profile: CorpusProfile = DEFAULT) -> DataFrame:
    """Per group: chunks, tables, definitions, abbreviations, cuts by kind, and chunks at the size ceiling."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    kinds = [n(F.col("element_type") == k, name) for k, name in (("table", "tables"), ("definition", "definitions"), ("abbreviation", "abbreviations"))]
    cuts = [n(F.col("cut") == k, f"cut_{k}") for k in ("section", "structural", "paragraph", "hard_max", "definition")]
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), *kinds, *cuts, n(F.col("n_chars") >= profile.hard_max - profile.near_max, "at_hard_max"))
