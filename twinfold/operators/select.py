"""Keep rules: of every group, which file stays. Ties go to the first in group order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinfold.functions.names import copy_marker_score



def order_of(rule: str) -> list[Column]:
    """What the kept file is least in."""
    time, length = F.col("last_write_utc"), F.col("length")
    rules = {
        "newest": [-F.unix_micros(time)],
        "oldest": [F.unix_micros(time)],
        "largest": [-length],
        "smallest": [length],
        "shortest_path": [F.length("full_path")],
        "cleanest_name": [copy_marker_score(F.col("file_name")), F.length("file_name")],
        "first": [],
    }
    return rules[rule]


def keepers(members: DataFrame, files: DataFrame, rule: str) -> DataFrame:
    """(group_key, file_id): the least by rule and place, a partial aggregate and no window."""
    rows = members.join(files, "file_id")
    by = [c.alias(f"o{k}") for k, c in enumerate(order_of(rule))]
    return rows.groupBy("group_key").agg(F.min(F.struct(*by, "pos", "file_id"))["file_id"].alias("file_id"))


def redundant(members: DataFrame, files: DataFrame, rule: str) -> DataFrame:
    """Members that the rule does not keep."""
    kept = keepers(members, files, rule)
    return members.join(kept, ["group_key", "file_id"], "left_anti")
