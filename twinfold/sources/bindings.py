"""Tables bound to the canonical files schema.

file_id, full_path, file_name, directory_name, extension, length, last_write_utc, and content,
perceptual_hash or frame_hashes where the table has something to make them of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinfold.common import table
from twinfold.functions.bits import dhash_ring
from twinfold.functions.names import directory_name, extension, file_name

#: Endings that stand in for copies, other types and media.
ENDINGS = [".txt", " (1).txt", " - Copy.txt", " final.PDF", ".jpg"]


def from_paths(rows: DataFrame, path: str = "full_path") -> DataFrame:
    """Adds name, directory and extension."""
    p = F.col(path)
    return rows.withColumns({"file_name": file_name(p), "directory_name": directory_name(p), "extension": extension(p)})


def _time(key: Column) -> Column:
    """A day of 2024, with ties."""
    return F.timestamp_micros((F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + key % 97 * 86_400) * 1_000_000)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    ending = F.when(key % 35 == 34, F.lit(".mp4")).otherwise(F.get(F.array(*map(F.lit, ENDINGS)), (key % 5).cast("int")))
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/item "), F.floor(key / 5).cast("string"), ending)
    rows = d.select(key.alias("file_id"), path.alias("full_path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"), _time(key).alias("last_write_utc"), F.coalesce("text", F.lit("")).alias("content"))
    return from_paths(rows)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files named after them."""
    p = table(spark, sf_dir, "part").filter("p_name is not null")
    rows = p.select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("/parts/"), F.col("p_name")).alias("full_path"), (F.col("p_size").cast("long") * 1024).alias("length"), _time(F.col("p_partkey")).alias("last_write_utc"))
    return from_paths(rows)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images: their hash is taken around the ring of components, their grid is 8 x 8 luma."""
    v = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    key = F.col("vec_id")
    ext = F.when(key % 11 == 0, F.lit(".png")).otherwise(F.lit(".jpg"))
    name = F.concat(F.when(key % 13 == 0, F.lit("Screenshot ")).otherwise(F.lit("IMG_")), key.cast("string"), ext)
    grid = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.5) * 255))).cast("int"))
    rows = v.select(key.alias("file_id"), F.concat(F.lit("/photos/"), name).alias("full_path"), (F.col("label").cast("long") * 1000 + key % 7).alias("length"), _time(key).alias("last_write_utc"), dhash_ring(F.col("embedding")).alias("perceptual_hash"), grid.alias("grid"), (F.lit(400) + key % 5 * 400).cast("int").alias("width"), (F.lit(300) + key % 3 * 390).cast("int").alias("height"))
    return from_paths(rows)


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as videos of two to four frames, sixteen bits each."""
    v = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    key = F.col("vec_id")
    frames = F.slice(F.array(*(dhash_ring(F.col("embedding"), 16 * k, 16) for k in range(4))), F.lit(1), (key % 3 + 2).cast("int"))
    rows = v.select(key.alias("file_id"), F.concat(F.lit("/videos/"), key.cast("string"), F.lit(".mp4")).alias("full_path"), (key % 50 * 1000).alias("length"), _time(key).alias("last_write_utc"), frames.alias("frame_hashes"))
    return from_paths(rows)


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, images (of 24-bit hashes) and videos as one set of files; the keys of the latter two are negative."""
    common = ["file_id", "full_path", "length", "last_write_utc"]
    pictures = images(spark, sf_dir).select(*common, F.col("perceptual_hash").bitwiseAND((1 << 24) - 1).alias("perceptual_hash")).withColumn("file_id", -(F.col("file_id") * 2 + 1))
    clips = videos(spark, sf_dir).select(*common, "frame_hashes").withColumn("file_id", -(F.col("file_id") * 2 + 2))
    rows = documents(spark, sf_dir).select(*common, "content")
    return from_paths(rows.unionByName(pictures, allowMissingColumns=True).unionByName(clips, allowMissingColumns=True))
