"""Filters of groups, as predicates on members and reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def min_count(groups: DataFrame, least: int = 2) -> DataFrame:
    return groups.filter(F.col("n_files") >= max(2, least))


def with_text(groups: DataFrame, members: DataFrame, files: DataFrame, text: str) -> DataFrame:
    """Groups of which any file's name or directory contains the text, in any case; blank text filters nothing."""
    if not text or not text.strip():
        return groups
    low = F.lit(text.lower())
    found = files.filter(F.contains(F.lower("file_name"), low) | F.contains(F.lower("directory_name"), low)).select("file_id")
    return groups.join(members.join(found, "file_id", "left_semi").select("group_key"), "group_key", "left_semi")


def with_reasons(groups: DataFrame, reasons: DataFrame, wanted: dict[str, float], every: bool = False, floor: float = 0.0) -> DataFrame:
    """Groups with any, or every, wanted method at its least similarity; without methods, of a best similarity of ``floor``."""
    if not wanted:
        return groups.filter(F.col("similarity") >= floor)
    flags = [F.max(((F.col("method") == m) & (F.col("similarity") >= s)).cast("int")) == 1 for m, s in wanted.items()]
    test = reduce(lambda a, b: a & b if every else a | b, flags)
    return groups.join(reasons.groupBy("group_key").agg(test.alias("_ok")).filter("_ok").select("group_key"), "group_key", "left_semi")
