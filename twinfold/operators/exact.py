"""Exact duplicates: a funnel of size, sampled key and full hash.

Each stage keeps keys that more than one file has, counted by partial aggregates, and a semi-join
passes their files on; no stage collects a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinfold.common import written
from twinfold.operators.positions import placed

#: Length of either sample; the tail is sampled where a file is longer than two samples.
SAMPLE_BYTES = 65_536


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key more than one row has."""
    return rows.join(rows.groupBy(*keys).count().filter("count > 1").select(*keys), keys, "left_semi")


def quick_key(content: Column, length: Column, sample: int = SAMPLE_BYTES) -> Column:
    """Hash of the first ``sample`` units, and of the last ones where there are more than two samples."""
    tail = F.when(length > 2 * sample, F.substring(content, -sample, sample)).otherwise(F.lit(""))
    return F.sha2(F.concat(F.substring(content, 1, sample), tail), 256)


def signature(length: Column, full_hash: Column) -> Column:
    return F.concat_ws(":", length.cast("string"), full_hash)


def hashed(files: DataFrame, content: str = "content", quick: bool = False) -> DataFrame:
    """Files that share a size, and the sampled key if wanted, with their signature.

    The sampled stage pays where content lies in files; where it is a column it would be read anyway.
    """
    rows = repeated(files, ["length"])
    if quick:
        rows = repeated(rows.withColumn("quick", quick_key(F.col(content), F.col("length"))), ["length", "quick"])
    return rows.withColumn("content_hash", F.sha2(F.col(content), 256)).withColumn("group_key", signature(F.col("length"), F.col("content_hash")))


def groups(signed: DataFrame) -> DataFrame:
    """(group_id, signature, n_files, total_bytes, reclaimable_bytes).

    Members of a group have one length, so whichever stays, the others free the same: counts and a
    minimum are enough, which hash aggregation keeps in place.
    """
    g = signed.groupBy("group_key", "length").agg(F.min("file_id").alias("group_id"), F.count("*").alias("n_files")).filter("n_files > 1")
    return g.select("group_id", F.col("group_key").alias("signature"), "n_files", (F.col("length") * F.col("n_files")).alias("total_bytes"), (F.col("length") * (F.col("n_files") - 1)).alias("reclaimable_bytes"))


def detect(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (group_key, pos, file_id), oldest first, and reasons (group_key, method, similarity, signature)."""
    # Written, since it is read several times and content would be hashed anew each time.
    rows, _, _ = written(repeated(signed.select("group_key", "last_write_utc", "file_id"), ["group_key"]))
    members = placed(rows, F.asc("last_write_utc"), F.asc("file_id"))
    reasons = rows.select("group_key").distinct().select("group_key", F.lit("ExactContent").alias("method"), F.lit(1.0).alias("similarity"), F.col("group_key").alias("signature"))
    return members, reasons
