"""Summaries of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinfold.functions.media import media_class
from twinfold.operators.exact import quick_key, repeated

CLASSES = ["Images", "Videos", "Other"]


def _largest(c: str) -> Column:
    """Maximum over all rows, of which there are a few."""
    return F.greatest(F.lit(1), F.max(c).over(Window.partitionBy(F.lit(0))))


def scan_summary(files: DataFrame, groups: DataFrame) -> DataFrame:
    """One row. Groups that overlap count their files twice."""
    f = files.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_scanned"))
    g = groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("duplicate_files"), F.coalesce(F.sum(F.col("n_files") - 1), F.lit(0)).alias("redundant_files"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"))
    return f.join(F.broadcast(g))  # one row each


def file_types(files: DataFrame) -> DataFrame:
    """Always the three classes, with zeros."""
    spark = files.sparkSession
    found = files.groupBy(media_class(F.col("extension")).alias("category")).agg(F.count("*").alias("n"), F.sum("length").alias("b"))
    return spark.createDataFrame([(c,) for c in CLASSES], "category string").join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n_files"), F.coalesce("b", F.lit(0)).alias("bytes"))


def file_type_bars(files: DataFrame) -> DataFrame:
    return file_types(files).filter("n_files > 0").withColumn("fraction", F.col("bytes") / _largest("bytes"))


def by_method(groups: DataFrame) -> DataFrame:
    """Groups and reclaimable bytes of each first method, with the fraction of the largest."""
    g = groups.groupBy("method").agg(F.count("*").alias("n_groups"), F.sum("reclaimable_bytes").alias("reclaimable_bytes"))
    return g.withColumn("fraction", F.col("reclaimable_bytes") / _largest("reclaimable_bytes"))


def flag_histogram(photos: DataFrame) -> DataFrame:
    """Photos of each flag, and those without any as Good."""
    flags = photos.select(F.explode(F.when(F.size("flags") > 0, F.col("flags")).otherwise(F.array(F.lit("Good")))).alias("flag"))
    g = flags.groupBy("flag").agg(F.count("*").alias("n"))
    return g.withColumn("fraction", F.col("n") / _largest("n"))


def top(groups: DataFrame, n: int = 5) -> DataFrame:
    return groups.orderBy(F.desc("reclaimable_bytes"), F.asc("group_id")).limit(n)


def import_totals(groups: DataFrame) -> DataFrame:
    """Totals of reloaded groups: all their files count as scanned."""
    return groups.agg(F.sum("n_files").alias("files_scanned"), F.sum(F.col("n_files") - 1).alias("redundant_files"), F.sum("reclaimable_bytes").alias("reclaimable_bytes"))


def photo_counts(photos: DataFrame) -> DataFrame:
    """One row: photos, and those with any flag."""
    return photos.agg(F.count(F.lit(1)).alias("n_photos"), F.count_if(F.size("flags") > 0).alias("n_flagged"))


def selection(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: how many files are chosen (file_id), each once, and their bytes."""
    some = files.join(chosen.select("file_id").distinct(), "file_id", "left_semi")
    return some.agg(F.count(F.lit(1)).alias("n_selected"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_selected"))


def candidates(files: DataFrame) -> DataFrame:
    """One row: files and bytes that share a size, so are sampled, and that share the sample too, so are read in full."""
    quick = repeated(files, ["length"]).withColumn("quick", quick_key(F.col("content"), F.col("length")))
    sizes = quick.groupBy("length", "quick").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"))
    zero = F.lit(0).cast("long")
    return sizes.agg(F.coalesce(F.sum("n"), zero).alias("n_quick"), F.coalesce(F.sum("b"), zero).alias("bytes_quick"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), zero).alias("n_full"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("b"))), zero).alias("bytes_full"))
