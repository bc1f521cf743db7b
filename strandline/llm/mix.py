"""Mixing sources to target weights, with exact quotas for every output shard.

Each source is cut into a fixed number of blocks by the hash of its documents (a permutation that
needs no sort). A source's quota of tokens is its share of the total; what whole repeats do not
fill is filled by its first blocks, in the block at the edge by its first sub-blocks, and in the
sub-block at the edge by its first documents. The blocks chosen are then dealt to the output shards
by a tree: at each node the number of blocks of each source is split between the two halves by a
multivariate hypergeometric draw, so that every shard gets a random but exact block quota, and
disjoint runs of permuted blocks meet the quotas. Within a shard, documents are ordered by hash.
The driver holds a few numbers a target; blocks, schedule and documents are tables.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.runtime import written

#: Blocks of a source and sub-blocks of a block, whatever the number of documents, and output shards.
BLOCKS, SUB_BLOCKS, SHARDS = 1_024, 1_024, 16
TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary lies on this machine; pass another path for another place."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(rows: DataFrame, key: str, group: str, text: str, path: str | None = None) -> DataFrame:
    """key, source, tokens of every row; null texts have none."""
    where = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(where).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["key", "source", "tokens"])

    base = rows.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{group}`").alias("source"), F.col(f"`{text}`").alias("text"))
    return base.mapInArrow(count, "key long, source string, tokens long")


def quotas(size: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens each source is to give.

    Sources without tokens give none and the others share the whole in proportion. Without a
    ``total`` it is the largest at which every source reaches its share within its repeats. With
    a larger one, sources at their cap give all they may and the others make up for it in
    proportion to their shares, as far as they can.
    """
    live = {s for s in share if size.get(s, 0) > 0 and share[s] > 0 and repeats[s] > 0}
    if not live:
        return {}
    weight = sum(share[s] for s in live)
    cap = {s: size[s] * repeats[s] for s in live}
    if total is None:
        total = min(cap[s] * weight / share[s] for s in live)
    out: dict[str, float] = {}
    left = float(total)
    while live:
        weight = sum(share[s] for s in live)
        full = {s for s in live if left * share[s] / weight >= cap[s]}
        if not full:
            return out | {s: left * share[s] / weight for s in live}
        out |= {s: float(cap[s]) for s in full}
        left -= sum(cap[s] for s in full)
        live -= full
    return out


def deal(counts: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows): exact in both margins, by a hypergeometric splitting tree.

    The total is spread over the shards as evenly as it divides.
    """
    out = np.zeros((shards, len(counts)), np.int64)
    total = int(sum(counts))
    sizes = [total // shards + (i < total % shards) for i in range(shards)]

    def split(colors: np.ndarray, a: int, b: int) -> None:
        if b - a == 1:
            out[a] = colors
            return
        m = (a + b) // 2
        left = rng.multivariate_hypergeometric(colors, sum(sizes[a:m]), method="marginals") if colors.sum() else colors
        split(left, a, m)
        split(colors - left, m, b)

    split(np.asarray(counts, np.int64), 0, shards)
    return out


def _filled(cells: DataFrame, of: list[str], order: str) -> DataFrame:
    """The cells (tokens ``t``, in order within ``of``) that ``want`` tokens reach, with ``upto``: what each gives, all of it or up to the edge."""
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*of).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("upto", F.least("t", F.col("want") - before)).where("upto > 0")


def mixed(sizes: DataFrame, targets: DataFrame, total: float | None = None, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 42) -> DataFrame:
    """key, source, tokens, copy, shard, place: one row for each time a document is used.

    ``sizes`` has key, source, tokens; ``targets`` has source, target_share, max_repeats (of a
    repeated source the first by share counts). Sources with null names, without target or without
    tokens give nothing. A source's last document is the one that brings it to its quota or just
    below; ``place`` orders a shard at random. The same seed and rows give the same result. A
    window runs over the blocks of a source or the documents of one sub-block, never over a source.
    """
    spark = sizes.sparkSession
    want: dict[str, tuple[float, int]] = {}
    for r in targets.select("source", "target_share", "max_repeats").where("source is not null").toLocalIterator():
        if r[0] not in want or (r[1] or 0, r[2] or 0) > want[r[0]]:
            want[r[0]] = (r[1] or 0.0, r[2] or 0)
    names = spark.createDataFrame([(s,) for s in want] or [("",)], "source string")
    h = F.xxhash64(F.lit(seed), "key")
    listed = sizes.where("source is not null and tokens > 0").select("key", "source", "tokens").join(names, "source", "left_semi")
    # the number of a block and of a sub-block, and the order within it, are independent parts of one hash
    listed = written(listed.select("key", "source", "tokens", F.pmod(h, F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64(h), F.lit(SUB_BLOCKS)).cast("int").alias("sub"), F.xxhash64(h, F.lit(1)).alias("order")), "sizes")
    cells = written(listed.groupBy("source", "block").agg(F.sum("tokens").alias("t")), "blocks")
    size = {r[0]: r[1] for r in cells.groupBy("source").agg(F.sum("t")).toLocalIterator()}
    quota = quotas(size, {s: v[0] for s, v in want.items()}, {s: v[1] for s, v in want.items()}, total)
    # how much each copy of a source gives: whole copies, then what is left
    copies = [(s, c, min(size[s], int(q + 1e-6) - c * size[s])) for s, q in quota.items() for c in range(min(want[s][1], -(-int(q + 1e-6) // size[s])))]
    plan = spark.createDataFrame(copies, "source string, copy int, want long") if copies else spark.createDataFrame([], "source string, copy int, want long")
    taken = written(_filled(cells.join(plan, "source"), ["source", "copy"], "block").select("source", "copy", "block", "t", "upto"), "taken")
    # the tree deals as many blocks of each source as were taken; each source's blocks, permuted, are handed out in runs
    counts = sorted((r[0], r[1]) for r in taken.groupBy("source").count().toLocalIterator())
    dealt = deal([n for _, n in counts], shards, np.random.default_rng(seed)).cumsum(axis=0)
    ends = [(s, dealt[:, i].tolist()) for i, (s, _) in enumerate(counts)]
    runs = spark.createDataFrame(ends, "source string, ends array<long>") if ends else spark.createDataFrame([], "source string, ends array<long>")
    turn = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "copy", "block"), "copy", "block"))
    schedule = written(taken.withColumn("turn", turn).join(runs, "source").select("source", "copy", "block", "t", "upto", F.size(F.filter("ends", lambda e: e < F.col("turn"))).alias("shard")), "schedule")
    out = ["key", "source", "tokens", "copy", "shard", F.xxhash64(F.lit(seed + 1), "key", "copy").alias("place")]
    hit = listed.join(schedule.where("upto = t").drop("t", "upto"), ["source", "block"])
    # the blocks at the edge, one for each copy at most: their first sub-blocks, and of the next one the first documents
    edge = listed.join(schedule.where("upto < t").select("source", "copy", "block", "shard", F.col("upto").alias("want")), ["source", "block"])
    parts = edge.groupBy("source", "copy", "want", "sub").agg(F.sum("tokens").alias("t"))
    reached = _filled(parts, ["source", "copy"], "sub").select("source", "copy", "sub", "t", "upto")
    near = edge.join(reached, ["source", "copy", "sub"])
    run = F.sum("tokens").over(Window.partitionBy("source", "copy", "sub").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, 0))
    last = near.where("upto < t").withColumn("run", run).where("run <= upto")
    return hit.select(out).unionByName(near.where("upto = t").select(out)).unionByName(last.select(out))


def shares(mix: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, available, tokens, repeats, share: what each listed source gives, against its target."""
    given = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("copy") + 1).alias("repeats"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    out = targets.select("source", "target_share", "max_repeats").join(have, "source", "left").join(given, "source", "left").fillna(0, ["available", "tokens", "repeats"])
    return out.withColumn("share", F.col("tokens") / mix.agg(F.sum("tokens")).scalar())
