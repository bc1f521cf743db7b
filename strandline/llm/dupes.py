"""Duplicates hidden by formatting: Merkle-style digests of normalised records.

Leaves (the body, each part of the unordered crumb) are normalised and hashed, the digests of the
unordered parts are sorted, and the root digest hashes body and node. Records are grouped by root;
only the texts of groups of two or more are read again and compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import body, letters_digits
from strandline.runtime import salted_join, written


def parts_of(c: Column) -> Column:
    """The normalised parts of a field separated by "|", sorted; null and empty parts are left out."""
    found = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|", -1), letters_digits), lambda x: x != "")
    return F.array_sort(found)


def root_digest(leaf: Column, unordered: Column) -> Column:
    """128 bits of the record; ``unordered`` is an array whose child digests are sorted."""
    node = F.md5(F.array_join(F.array_sort(F.transform(unordered, F.md5)), ""))
    return F.unhex(F.md5(F.concat(F.md5(leaf), node)))


def duplicate_groups(rows: DataFrame, key: str, text: str, parts: str) -> DataFrame:
    """keep, key, root: the membership of every group of two or more keys that hold the same record.

    ``keep`` is the smallest key of the group (it is a member, too). Null texts count as empty.
    Rows with a null key are left out; a key with several equal rows counts once, one with
    different rows is a member of each group. Only keys and digests are shuffled until a root is
    known to repeat; then the texts of its members are read again.
    """
    named = rows.where(F.col(f"`{key}`").isNotNull())
    leaf = letters_digits(body(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    roots = written(named.select(F.col(f"`{key}`").alias("key"), root_digest(leaf, parts_of(F.col(f"`{parts}`"))).alias("root")), "roots")
    several = roots.groupBy("root").agg(F.min("key").alias("keep"), F.max("key").alias("z")).where("keep < z").select("root", "keep")
    members = written(salted_join(roots, several, ["root"]).select("keep", "key", "root").distinct(), "members")
    # the full comparison: all members of a root must be one record, whatever their digest; few keys are broadcast, many are not
    again = named.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{parts}`").alias("parts")).join(members.select("key").distinct(), "key", "left_semi")
    leaf = letters_digits(body(F.coalesce(F.col("text"), F.lit(""))))
    full = again.select("key", leaf.alias("leaf"), parts_of(F.col("parts")).alias("parts")).withColumn("root", root_digest(F.col("leaf"), F.col("parts")))
    full = full.select("key", "root", F.concat_ws("\x1f", "leaf", F.array_join("parts", "\x1f")).alias("record"))
    variants = full.select("root", "record").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    odd = written(variants.select("root"), "odd")
    if odd.isEmpty():
        return members
    # roots that stand for more than one record: their members are grouped by the record itself
    told = written(full.join(odd, "root", "left_semi").distinct(), "told")
    groups = told.groupBy("root", "record").agg(F.min("key").alias("keep"), F.max("key").alias("z")).where("keep < z").drop("z")
    apart = salted_join(told, groups, ["root", "record"]).select("keep", "key", "root")
    return members.join(odd, "root", "left_anti").select("keep", "key", "root").unionByName(apart)


def copies(groups: DataFrame) -> DataFrame:
    """One row a group: keep and how many keys hold the record."""
    return groups.groupBy("keep").agg(F.count(F.lit(1)).alias("copies"))
