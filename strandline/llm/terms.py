"""Frequency of every distinct value or term, by a suffix array with common-prefix intervals.

Every position of every token sequence starts a suffix, cut at ``longest`` tokens. The suffixes
are range-partitioned and sorted by (suffix, record); in the sorted array the occurrences of an
n-gram are an interval of neighbours whose common prefix has n tokens or more, so its length is
the occurrence count. The record count is that length less the duplicates within a record, which
are neighbours once the interval is ordered by record. Equal suffixes of a record are one entry of the
array with a weight, so that a record repeated without end is no longer than one. Intervals cut by
the edge of a block of the array are merged afterwards, record by record; all others are final
where they are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes handled at once in a task.
BLOCK = 250_000
_OUT = "gram array<string>, occurrences long, records long, cut boolean, record string"


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= block:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _intervals(longest: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, block):
            suffix, record = (pc.dictionary_encode(t.column("record")) if c == "record" else t.column(c) for c in ("suffix", "record"))
            suffix = suffix.combine_chunks() if isinstance(suffix, pa.ChunkedArray) else suffix
            record = record.combine_chunks() if isinstance(record, pa.ChunkedArray) else record
            n = len(suffix)
            at = suffix.offsets.to_numpy()
            tokens = suffix.values.slice(at[0], at[-1] - at[0])
            codes = pc.dictionary_encode(tokens)
            words, codes = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
            at = at - at[0]
            size = np.diff(at)
            grid = np.full((n, longest), -1, np.int64)
            for k in range(longest):
                has = size > k
                grid[has, k] = codes[at[:-1][has] + k]
            # common prefix of neighbours, in tokens
            same = np.cumprod((grid[1:] == grid[:-1]) & (grid[1:] >= 0), axis=1) if n > 1 else np.zeros((0, longest), int)
            prefix = same.sum(axis=1)
            rec = pc.fill_null(record.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            weight = t.column("times").to_numpy()
            for k in range(1, longest + 1):
                fits = size >= k
                if not fits.any():
                    continue
                start = np.r_[True, prefix < k]
                group = np.cumsum(start) - 1
                first = np.flatnonzero(start)
                total = np.add.reduceat(weight, first)
                # duplicates within a record: equal neighbours once each interval is ordered by record
                order = np.lexsort((rec, group))
                g, r = group[order], rec[order]
                new = np.r_[True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])]
                records = np.bincount(g[new & (r >= 0)], minlength=len(total))
                valid = fits[first]
                edge = np.zeros(len(total), bool)
                edge[[0, -1]] = True
                whole = np.flatnonzero(valid & ~edge)
                # intervals at an edge of the block: one row a record
                heads = np.flatnonzero(new)
                runs = np.add.reduceat(weight[order], heads)
                part = edge[g[heads]] & valid[g[heads]]
                rows = np.r_[first[whole], first[g[heads][part]]]
                name = pc.take(words, pa.array(grid[rows, :k].reshape(-1)))
                grams = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), name)
                labels = pc.take(record.dictionary, pa.array(np.r_[np.zeros(len(whole), np.int64), r[heads][part]], pa.int64(), mask=np.r_[np.ones(len(whole), bool), r[heads][part] < 0])) if len(record.dictionary) else pa.nulls(len(rows), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        grams, pa.array(np.r_[total[whole], runs[part]], pa.int64()), pa.array(np.r_[records[whole], np.zeros(part.sum(), np.int64)], pa.int64()),
                        pa.array(np.r_[np.zeros(len(whole), bool), np.ones(part.sum(), bool)]), labels.cast(pa.string()),
                    ],
                    ["gram", "occurrences", "records", "cut", "record"],
                )

    return run


def term_counts(sequences: DataFrame, tokens: str, record: str, longest: int, block: int = BLOCK) -> DataFrame:
    """gram (array of 1 to ``longest`` tokens), occurrences, records: for every distinct n-gram of the collection.

    ``tokens`` is an array column, a row each a sequence no n-gram crosses; ``record`` says which
    record a row belongs to (rows may share one). Occurrences in rows without a record count,
    but add no record. Null tokens are left out; null and empty arrays give nothing. Repeated
    rows count as often as they stand there.
    """
    clean = sequences.select(F.array_compact(F.col(f"`{tokens}`")).alias("t"), F.col(f"`{record}`").cast("string").alias("record"))
    at = F.explode(F.sequence(F.lit(1), F.size("t")))
    suffixes = clean.where(F.size("t") > 0).select("t", "record", at.alias("i")).select(F.slice("t", F.col("i"), longest).alias("suffix"), "record")
    # merged before they are shuffled and before ranges are cut, which could not part equal rows
    entries = suffixes.groupBy("suffix", "record").agg(F.count(F.lit(1)).alias("times"))
    array = entries.repartitionByRange("suffix", "record").sortWithinPartitions("suffix", "record")
    parts = array.mapInArrow(_intervals(longest, block), _OUT)
    merged = parts.groupBy("gram", "cut", "record").agg(F.sum("occurrences").alias("o"), F.sum("records").alias("r"))
    seen = F.when(F.col("cut"), F.col("record").isNotNull().cast("long")).otherwise(F.col("r"))
    return merged.groupBy("gram").agg(F.sum("o").alias("occurrences"), F.sum(seen).alias("records"))


def usefulness(value: Column, rare: Column, common: Column) -> Column:
    """The marks of a value: an array holding 'rare', 'common', both or none."""
    return F.when(value.isNotNull(), F.array_compact(F.array(F.when(rare, F.lit("rare")), F.when(common, F.lit("common")))))
