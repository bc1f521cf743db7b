"""Routed hybrid search over tables of queries.

Every operator is set-based over a column ``qid``: queries are a table, never a loop. Ranks are
made by windows per query with a limit, which the planner turns into a group limit before the
shuffle; the id is always the last sorting key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandline.functions.profile import DEFAULT, CorpusProfile
from strandline.runtime import salted_join, written

# Fixed values of the ranking.
RRF_C, W_DENSE, W_SPARSE, DEFINITION_BOOST = 60, 1.0, 1.0, 1.5
#: Words that make a short "what is" question one about application.
QUALIFIER = r"\b(for|when|under|during|if|applicable|applies|required|tested|at|in case)\b"
EXPLICIT = r"^\s*(define\b|definition\s+of\b|meaning\s+of\b|what\s+(is|are|does)\b.*\bmean\b|what\s+does\b.*\bstand\s+for)"
SHORT = r"^\s*what\s+(is|are)\s+((a|an|the)\s+)?([a-z0-9/' -]{2,40})\s*\??\s*$"
STANDS = r"\bwhat\s+does\s+([A-Za-z][A-Za-z0-9/-]{1,9})\s+stand\s+for"
#: Queries that are compared with all rows in one pass, terms they have together at most, and scores a task holds at once.
QUERIES_PER_PASS, TERMS_PER_PASS, SCORES = 1_000, 200_000, 4_000_000
#: A term of more than one in so many queries of a pass is multiplied as a matrix, the others one by one.
COMMON = 20


def route(text: Column, profile: CorpusProfile = DEFAULT) -> Column:
    """struct(kind, a, b): ('identifier', code, clause), ('definitional', term, null) or ('general', null, null).

    A query that is only a code, with revision or clause, is an identifier (the code comes out in
    upper case, as it is stored); one that says more is not. Null and empty queries are general.
    """
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    ident = rf"(?i)^\s*({profile.code})[a-z]?(\s+rev\.?\s*[0-9]+)?(\s+(clause\s+)?([0-9]+(\.[0-9]+)*))?\s*$"
    clause = F.regexp_extract(t, ident, 7)
    tidy = lambda c: F.regexp_replace(c, r"^[ ?.\"']+|[ ?.\"']+$", "")
    explicit = tidy(F.regexp_replace(t, f"(?i){EXPLICIT}", ""))
    short = F.trim(F.regexp_extract(low, SHORT, 4))
    short_as_typed = F.trim(F.regexp_extract(t, f"(?i){SHORT}", 4))
    pack = lambda k, a, b=None: F.struct(F.lit(k).alias("kind"), a.cast("string").alias("a"), (F.lit(None) if b is None else b).cast("string").alias("b"))
    return (
        F.when(t.rlike(ident), pack("identifier", F.upper(F.regexp_extract(t, ident, 1)), F.nullif(clause, F.lit(""))))
        .when(t.rlike(f"(?i){STANDS}"), pack("definitional", F.regexp_extract(t, f"(?i){STANDS}", 1)))
        .when(low.rlike(EXPLICIT), pack("definitional", F.when(explicit != "", explicit).otherwise(F.trim(t))))
        .when((short != "") & ~short.rlike(QUALIFIER), pack("definitional", short_as_typed))
        .otherwise(pack("general", F.lit(None)))
    )


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "key", by: str = "qid", name: str = "rank") -> DataFrame:
    """The k best rows of each query, ranked from 0; ties go to the smaller key."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn(name, F.row_number().over(w) - 1).where(F.col(name) < k)


class _Best:
    """The k best rows of each query so far, in a task: by score, then by the smaller key."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, score: np.ndarray, keys: np.ndarray) -> None:
        """Scores of all queries (rows) for some keys; -inf for a pair that does not count."""
        n = score.shape[1]
        if n > self.k:
            np.maximum(self.least, np.partition(score, n - self.k, axis=1)[:, n - self.k], out=self.least)
        q, row = np.nonzero((score >= self.least[:, None]) & (score > -np.inf))
        self.held.append((q, score[q, row], keys[row]))
        self.size += len(q)
        if self.size > SCORES:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, key) of the k best."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        q, score, keys = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        order = np.lexsort((np.unique(keys, return_inverse=True)[1], -score, q))
        q, score, keys = q[order], score[order], keys[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = place == self.k - 1
        self.least[q[full]] = score[full]
        first = place < self.k
        self.held, self.size = [(q[first], score[first], keys[first])], int(first.sum())
        return self.held[0]


def _blocks(rows: Iterator, size: int, terms: int | None = None) -> Iterator[list]:
    """Rows (first item: the query) in blocks of up to ``size`` queries and ``terms`` rows or one query; the rows of a query come together."""
    block, seen = [], 0
    last = object()
    for r in rows:
        if r[0] != last:
            if seen == size or (terms and len(block) >= terms):
                yield block
                block, seen = [], 0
            seen, last = seen + 1, r[0]
        block.append(r)
    if block:
        yield block


def sparse_scores(queries: DataFrame, docs: DataFrame, weight: str = "tf") -> DataFrame:
    """qid, key, score: the sum of products of weights over shared terms, for every pair of ``queries`` and ``docs`` that shares one.

    ``queries`` has qid, term and the weight, ``docs`` is a table of key, term and the weight, for
    pairs that are few; ``sparse_lists`` ranks all rows without making pairs. Products are summed
    before they are shuffled by query where they meet. A query without terms has no rows.
    """
    q = queries.select("qid", "term", F.col(weight).alias("qw"))
    hits = docs.select("key", "term", F.col(weight).alias("dw"))
    return salted_join(hits, q, ["term"]).groupBy("qid", "key").agg(F.round(F.sum(F.col("qw") * F.col("dw")), 9).alias("score"))


def sparse_lists(queries: DataFrame, docs: DataFrame, k: int, lists: dict[str, tuple[str, str]], per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """list, qid, key, score, rank: for each named list the k best by the sum of products of weights over shared terms.

    ``queries`` has qid, term and a weight a list, ``docs`` one row a key with terms and an array
    of weights a list, in the order of the terms; ``lists`` names both weights. Queries go out in
    blocks of bounded size and all lists come from one pass over ``docs``: a task multiplies its
    rows with a block and keeps its own k best, so nothing else is shuffled, whatever terms are
    in every text. Queries and rows that share no term do not meet; null keys match nothing.
    """
    spark = queries.sparkSession
    names, kinds = list(lists), (dict(queries.dtypes), dict(docs.dtypes))
    columns = list(dict.fromkeys(d for _, d in lists.values()))
    schema = f"list string, qid {kinds[0]['qid']}, key {kinds[1]['key']}, score double"
    qid_type, key_type = to_arrow_type(queries.schema["qid"].dataType), to_arrow_type(docs.schema["key"].dataType)

    def one_pass(block: list) -> DataFrame:
        qids = list(dict.fromkeys(r[0] for r in block))
        vocabulary = list(dict.fromkeys(r[1] for r in block))
        of_q, of_t = {q: i for i, q in enumerate(qids)}, {t: i for i, t in enumerate(vocabulary)}
        q, t = np.array([of_q[r[0]] for r in block]), np.array([of_t[r[1]] for r in block])
        weights = {n: np.array([r[2 + i] for r in block], np.float64) for i, n in enumerate(names)}
        sent = spark.sparkContext.broadcast((pa.array(qids, qid_type), pa.array(vocabulary, pa.string()), _Side(q, t, len(qids), len(vocabulary)), weights))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, words, side, w = sent.value
            kept = {n: _Best(len(ids), k) for n in names}
            step = max(256, SCORES // len(ids))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    b = batch.slice(a, step)
                    keys = b.column(0).to_numpy(zero_copy_only=False)
                    term = pc.index_in(b.column(1).flatten(), value_set=words)
                    sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
                    known = term.is_valid().to_numpy(zero_copy_only=False)
                    term, row = pc.fill_null(term, 0).to_numpy(zero_copy_only=False)[known], np.repeat(np.arange(len(keys)), sizes)[known]
                    value = {c: b.column(2 + i).flatten().to_numpy(zero_copy_only=False)[known].astype(np.float64) for i, c in enumerate(columns)}
                    for n in names:
                        score = np.round(side.times(w[n], term, row, value[lists[n][1]], len(keys)), 9)
                        kept[n].add(np.where(score > 0, score, -np.inf), keys)
            for n in names:
                which, score, keys = kept[n].cut()
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(which), pa.string()), ids.take(pa.array(which, pa.int64())), pa.array(keys, key_type), pa.array(score)], ["list", "qid", "key", "score"])

        return docs.where("key is not null").select("key", "terms", *columns).mapInArrow(best, schema)

    out = None
    rows = queries.where("qid is not null and term is not null").select("qid", "term", *[F.col(q) for q, _ in lists.values()]).orderBy("qid").toLocalIterator()
    for block in _blocks(rows, per_pass, TERMS_PER_PASS):
        out = _also(out, one_pass(block))
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("list", "qid").orderBy(F.col("score").desc(), "key")
    return out.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


class _Side:
    """The terms of a block of queries, common ones as rows of a matrix and the others by term."""

    def __init__(self, q: np.ndarray, t: np.ndarray, queries: int, terms: int) -> None:
        self.queries = queries
        often = np.bincount(t, minlength=terms) * COMMON > queries
        self.common = np.where(often, np.cumsum(often) - 1, -1)
        self.dense, self.sparse = np.flatnonzero(often[t]), np.flatnonzero(~often[t])
        self.sparse = self.sparse[np.argsort(t[self.sparse], kind="stable")]
        self.q, self.t = q, t
        self.starts = np.searchsorted(t[self.sparse], np.arange(terms + 1))

    def times(self, weight: np.ndarray, term: np.ndarray, row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Scores of all queries for so many rows whose terms and values are given."""
        at = self.common[term]
        left = np.zeros((self.queries, int(self.common.max(initial=-1)) + 1))
        np.add.at(left, (self.q[self.dense], self.common[self.t[self.dense]]), weight[self.dense])
        right = np.zeros((left.shape[1], rows))
        right[at[at >= 0], row[at >= 0]] = value[at >= 0]
        score = left @ right
        term, row, value = term[at < 0], row[at < 0], value[at < 0]
        many = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(many)
        pick = self.sparse[np.repeat(self.starts[term] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]
        cell = self.q[pick] * rows + np.repeat(row, many)
        return score + np.bincount(cell, weight[pick] * np.repeat(value, many), self.queries * rows).reshape(self.queries, rows)


def dense_top_k(queries: DataFrame, docs: DataFrame, k: int, vector: str = "vector", per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """qid, key, score, rank: by cosine, exactly.

    ``queries`` has qid and a vector, ``docs`` key and a vector. Query vectors go out in blocks
    of bounded size; a task multiplies its rows with a block, a bounded number of scores at once,
    and keeps its own k best per query, so little is shuffled. Null, empty and zero vectors, and
    those of another length, match nothing.
    """
    spark = queries.sparkSession
    kinds = dict(queries.dtypes), dict(docs.dtypes)
    schema = f"qid {kinds[0]['qid']}, key {kinds[1]['key']}, score double"
    qid_type, key_type = to_arrow_type(queries.schema["qid"].dataType), to_arrow_type(docs.schema["key"].dataType)

    def one_pass(chunk: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((pa.array([r[0] for r in chunk], qid_type), _unit(np.array([r[1] for r in chunk], np.float64))))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = sent.value
            kept, step = _Best(len(qids), k), max(256, SCORES // len(qids))
            for batch in batches:
                sizes = pc.fill_null(pc.list_value_length(batch.column(1)), -1).to_numpy(zero_copy_only=False)
                rows = batch.take(pa.array(np.flatnonzero(sizes == q.shape[1])))
                for a in range(0, rows.num_rows, step):
                    b = rows.slice(a, step)
                    m = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1]))
                    score = np.round(q @ m.T, 9)
                    kept.add(np.where(np.isnan(score), -np.inf, score), b.column(0).to_numpy(zero_copy_only=False))
            which, score, keys = kept.cut()
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(which, pa.int64())), pa.array(keys, key_type), pa.array(score)], ["qid", "key", "score"])

        return docs.select("key", F.col(vector).alias("v")).where("v is not null and key is not null").mapInArrow(best, schema)

    out = None
    groups: dict[int, list] = {}
    for r in queries.select("qid", vector).where(F.col("qid").isNotNull() & (F.size(vector) > 0)).toLocalIterator():
        block = groups.setdefault(len(r[1]), [])
        block.append(r)
        if len(block) == per_pass:
            out, groups[len(r[1])] = _also(out, one_pass(block)), []
    for block in groups.values():
        if block:
            out = _also(out, one_pass(block))
    return top_k(spark.createDataFrame([], schema) if out is None else out, k)


def _also(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0)


def fuse(lists: dict[str, tuple[DataFrame, float]], k: int, boost: Callable[[DataFrame], DataFrame] | None = None, c: int = RRF_C) -> DataFrame:
    """qid, key, score, rank and the rank in each list: reciprocal rank fusion of ranked lists.

    Each list adds weight / (c + rank), ranks from 0. ``boost`` may multiply the score. Ties keep
    the order of the first list, then of the next; rows only in later lists come after.
    """
    tagged = None
    for name, (ranked, weight) in lists.items():
        tagged = _also(tagged, ranked.select("qid", "key", F.lit(name).alias("list"), "rank", (F.lit(float(weight)) / (F.col("rank") + c)).alias("part")))
    ranks = [F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists]
    merged = tagged.groupBy("qid", "key").agg(F.round(F.sum("part"), 12).alias("score"), *ranks)
    if boost:
        merged = boost(merged)
    order = [F.col("score").desc(), *[F.col(f"{n}_rank").asc_nulls_last() for n in lists], F.col("key")]
    w = Window.partitionBy("qid").orderBy(*order)
    return merged.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def dedup_cut(ranked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first row of each query and key combination (nulls equal nulls), in order of rank, cut to k; ``place`` counts from 0."""
    first = ranked.withColumn("__n", F.row_number().over(Window.partitionBy("qid", *keys).orderBy("rank", "key"))).where("__n = 1").drop("__n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "key")) - 1).where(F.col("place") < k)


def filtered_or_wider(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """qid, key, route: rows with the code and clause of the query; without any, rows with its code alone, under another route.

    ``queries`` has qid, a (code), b (clause or null); ``docs`` has key, doc_code, clause. Codes
    and clauses are compared exactly.
    """
    hit = salted_join(docs.select("key", F.col("doc_code").alias("a"), "clause"), queries.where("a is not null").select("qid", "a", "b"), ["a"])
    hit = hit.withColumn("exact", F.coalesce(F.col("clause") == F.col("b"), F.col("b").isNull()))
    any_exact = hit.groupBy("qid").agg(F.bool_or("exact").alias("any"))
    kept = salted_join(hit, any_exact, ["qid"]).where(F.col("exact") | ~F.col("any"))
    return kept.select("qid", "key", F.when(F.col("any"), "identifier").otherwise("identifier(document)").alias("route"))


def rerank(ranked: DataFrame, score: Column) -> DataFrame:
    """Order each query's pool by a scorer's column; if any score of a query is null (a failed batch), its order stays, with a note."""
    failed = F.bool_or(F.col("__s").isNull()).over(Window.partitionBy("qid"))
    t = ranked.withColumn("__s", score).withColumn("rerank", F.when(failed, "failed: original order").otherwise("ok"))
    w = Window.partitionBy("qid").orderBy(F.when(F.col("rerank") == "ok", -F.col("__s")), "rank", "key")
    return t.withColumn("first_rank", F.col("rank")).withColumn("rank", F.row_number().over(w) - 1).withColumnRenamed("__s", "rerank_score")


def retrieve(queries: DataFrame, lists: Callable[[DataFrame, int], dict[str, DataFrame]], docs: DataFrame, k: int, profile: CorpusProfile = DEFAULT, exact: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """qid, key, rank, route, score: routed retrieval for a table of queries.

    ``queries`` has qid, text; ``docs`` key, doc_code, clause, element_type. ``lists(table, n)``
    gives the ranked lists 'dense' and 'sparse' of the n best for a table of qid, text. Identifier
    queries are filtered and keep dense order; definitional queries search for the term alone and
    favour definitions; the others search for the text. ``exact(table, pairs)`` gives the dense
    scores qid, key, score of the pairs of qid and key that the filter leaves; pairs it leaves out
    score 0. Without it only rows that are also in the dense list of the whole corpus have a score.
    """
    routed = written(queries.withColumn("r", route(F.col("text"), profile)).select("qid", "text", "r.*"), "routed")
    search = routed.select("qid", F.when(F.col("kind") == "definitional", F.coalesce("a", "text")).otherwise(F.col("text")).alias("text"))
    found = lists(search, 2 * k)
    coded = routed.where("kind = 'identifier'")
    chosen = filtered_or_wider(coded, docs)
    if exact:
        chosen = written(chosen, "chosen")
        dense = exact(coded.select("qid", "text"), chosen.select("qid", "key"))
    else:
        dense = found["dense"]
    scores = dense.select("qid", "key", F.col("score").alias("dense"))
    ident = top_k(chosen.join(scores, ["qid", "key"], "left").withColumn("score", F.coalesce("dense", F.lit(0.0))), k).select("qid", "key", "rank", "route", "score")
    rest = routed.where("kind <> 'identifier'").select("qid", F.col("kind").alias("route"))
    kinds = docs.select("key", "element_type")

    def boost(merged: DataFrame) -> DataFrame:
        t = merged.join(rest, "qid").join(kinds, "key")
        up = (F.col("route") == "definitional") & F.col("element_type").isin("definition", "abbreviation")
        return t.withColumn("score", F.round(F.col("score") * F.when(up, DEFINITION_BOOST).otherwise(1.0), 12))

    fused = fuse({"dense": (found["dense"], W_DENSE), "sparse": (found["sparse"], W_SPARSE)}, k, boost)
    return ident.unionByName(fused.select("qid", "key", "rank", "route", "score"))


def context(ranked: DataFrame, label: Column, text: Column, separator: str = "\n---\n") -> DataFrame:
    """qid, context, passages: the passages of each query as one labelled text, in order of ``place`` (cut before, so bounded)."""
    each = F.struct("place", F.concat(F.lit("["), label, F.lit("]\n"), text).alias("p"))
    return ranked.groupBy("qid").agg(F.array_sort(F.collect_list(each)).alias("c")).select("qid", F.array_join("c.p", separator).alias("context"), F.size("c").alias("passages"))


def round_robin(items: DataFrame, key: str, by: str, n: int | None) -> DataFrame:
    """One item of each class in turn, in order of key, until ``n`` (all, without one); ``turn`` counts from 1."""
    turned = items.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(key)))
    return turned if n is None else turned.orderBy("turn", by, key).limit(n)
