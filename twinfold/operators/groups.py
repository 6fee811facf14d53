"""Groups of several detectors: merged by their set of files, measured and ranked.

Working form: members (group_key, pos, file_id) and reasons (group_key, method, similarity, signature).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinfold.operators.positions import numbered_within
from twinfold.options import METHODS

ORDER = {m: k for k, m in enumerate(METHODS)}


def method_order(c):
    return F.coalesce(*(F.when(c == m, F.lit(k)) for m, k in ORDER.items()), F.lit(len(ORDER)))


def method_bit(c):
    return F.coalesce(*(F.when(c == m, F.lit(b)) for m, b in METHODS.items()), F.lit(0))


def file_sets(members: DataFrame) -> DataFrame:
    """(group_key, set_key): a digest of each group's sorted files.

    A set is told by its number of files, its least and its greatest, and two sums of hashes: all
    partial aggregates, so no set is collected.
    """
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "file_id").cast("decimal(20,0)"))
    g = members.groupBy("group_key").agg(F.count("*").alias("n"), F.min("file_id").alias("lo"), F.max("file_id").alias("hi"), h(1).alias("h1"), h(2).alias("h2"))
    return g.select("group_key", F.sha2(F.concat_ws(",", "n", "lo", "hi", "h1", "h2"), 256).alias("set_key"))


def merge(members: DataFrame, reasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups with the same files become one: the first detector's order stays, and of each method its best reason."""
    keys = file_sets(members).join(reasons.groupBy("group_key").agg(F.min(method_order(F.col("method"))).alias("o")), "group_key")
    first = keys.groupBy("set_key").agg(F.min(F.struct("o", "group_key"))["group_key"].alias("kept"))
    named = keys.join(first, "set_key").select("group_key", "kept")
    out = members.join(named.filter("group_key = kept").select("group_key"), "group_key", "left_semi")
    best = reasons.join(named, "group_key").groupBy(F.col("kept").alias("group_key"), "method").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("group_key").alias("g"), "signature")).alias("b"))
    return out, best.select("group_key", "method", (-F.col("b.s")).alias("similarity"), F.col("b.signature").alias("signature"))


def measured(members: DataFrame, reasons: DataFrame, files: DataFrame) -> DataFrame:
    """(group_key, group_id, method, methods, similarity, signature, n_files, reclaimable_bytes, total_bytes), by partial aggregates."""
    sized = members.join(files.select("file_id", "length"), "file_id")
    g = sized.groupBy("group_key").agg(F.min("file_id").alias("group_id"), F.count("*").alias("n_files"), F.sum(F.when(F.col("pos") > 0, F.col("length")).otherwise(0)).alias("reclaimable_bytes"), F.sum("length").alias("total_bytes"))
    first = F.min(F.struct(method_order(F.col("method")).alias("o"), "method", "signature"))
    r = reasons.groupBy("group_key").agg(first.alias("f"), F.bit_or(method_bit(F.col("method"))).alias("methods"), F.max("similarity").alias("similarity"))
    return g.join(r.select("group_key", F.col("f.method").alias("method"), "methods", "similarity", F.col("f.signature").alias("signature")), "group_key")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with their ordinal in an order that has no ties.

    Ordinals come from range partitions and their counts, not from one task that holds all rows.
    """
    return numbered_within(rows.withColumn("__all", F.lit(0)), ["__all"], [*order], "ordinal").withColumn("ordinal", F.col("ordinal") + 1).drop("__all")


def ranked(groups: DataFrame) -> DataFrame:
    """Groups with their ordinal: most reclaimable first, then most files, then the least file."""
    return numbered(groups, F.desc("reclaimable_bytes"), F.desc("n_files"), F.asc("group_id"))


def sorted_by(rows: DataFrame, column: str, descending: bool = False, key: str = "group_id") -> DataFrame:
    """Rows with their ordinal when a list is sorted by one of its columns; ties by key."""
    return numbered(rows, F.desc(column) if descending else F.asc(column), F.asc(key))


def reasons_shown(reasons: DataFrame) -> DataFrame:
    """Reasons with their place within the group as it is shown: greatest similarity first, then by method."""
    return numbered_within(reasons, ["group_key"], [F.desc("similarity"), method_order(F.col("method")), F.asc("signature")], "place").withColumn("place", F.col("place").cast("int"))


def visible(groups: DataFrame, condition: Column | None = None) -> DataFrame:
    """One row: how many groups there are, and how many a filter leaves; without one, all."""
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(condition if condition is not None else F.lit(True)).alias("n_visible"))


def nested(members: DataFrame, reasons: DataFrame, files: DataFrame) -> DataFrame:
    """One row per group with its files and reasons as ordered arrays, for sinks."""
    f = members.join(files, "file_id").groupBy("group_key").agg(F.sort_array(F.collect_list(F.struct("pos", *[c for c in files.columns if c != "content"]))).alias("files"))
    r = reasons.groupBy("group_key").agg(F.sort_array(F.collect_list(F.struct(method_order(F.col("method")).alias("o"), "method", "similarity", "signature"))).alias("r"))
    return f.join(r, "group_key").select("group_key", "files", F.transform("r", lambda x: F.struct(x["method"].alias("method"), x["similarity"].alias("similarity"), x["signature"].alias("signature"))).alias("reasons"))
