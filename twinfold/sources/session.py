"""Sinks and their way back: CSV and JSON reports, and sessions."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinfold.common import joined_file, scratch
from twinfold.functions.text import csv_escape, humanize, similarity_number
from twinfold.operators.groups import nested
from twinfold.operators.positions import numbered_within
from twinfold.sources import jsonsplit

COLUMNS = ["GroupId", "Method", "Similarity", "FilePath", "SizeBytes", "SizeHuman", "LastModifiedUtc", "ReclaimableBytes"]
SESSION = """Version INT, SavedAtUtc STRING, Groups ARRAY<STRUCT<Reasons: ARRAY<STRUCT<Method: STRING, Similarity: DOUBLE, Signature: STRING>>,
 Files: ARRAY<STRUCT<Path: STRING, Length: BIGINT, LastWriteUtc: STRING, ContentHash: STRING>>>>"""


def iso(time_: Column) -> Column:
    return F.date_format(time_, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")


def csv_rows(ranked: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file of a group, ordered by ordinal and place."""
    rows = ranked.select("group_key", "ordinal", "method", "similarity", "reclaimable_bytes").join(members, "group_key").join(files, "file_id")
    return rows.select(
        F.col("ordinal").alias("GroupId"), F.col("method").alias("Method"), similarity_number(F.col("similarity")).alias("Similarity"), F.col("full_path").alias("FilePath"),
        F.col("length").alias("SizeBytes"), humanize(F.col("length")).alias("SizeHuman"), iso(F.col("last_write_utc")).alias("LastModifiedUtc"), F.col("reclaimable_bytes").alias("ReclaimableBytes"), F.col("pos").alias("_pos"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """One file, UTF-8 with a byte-order mark."""
    line = F.concat_ws(",", *(csv_escape(F.col(c).cast("string")) for c in COLUMNS))
    _one_file(rows.select("GroupId", "_pos", line.alias("line")), ["GroupId", "_pos"], path, "\ufeff" + ",".join(COLUMNS) + "\n", "\n", last=True)


def _one_file(lines: DataFrame, order: list[str], path: str, head: str, between: str, tail: str = "", last: bool = False) -> None:
    """One file of lines in order: parts that the executors write, put together as bytes. ``last`` tells whether ``between`` follows the last line too."""
    spark = lines.sparkSession
    parts = scratch(spark, "parts")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").option("lineSep", between).text(parts)
    joined_file(spark, parts, path, head.encode(), 0 if last else len(between.encode()), tail.encode())


def write_csv_parts(rows: DataFrame, path: str) -> None:
    """The same lines in a folder of files, written by the executors; each begins with the columns' names, and they are in order."""
    rows.repartitionByRange("GroupId", "_pos").sortWithinPartitions("GroupId", "_pos").select(*COLUMNS).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_json_parts(path: str, groups: DataFrame) -> None:
    """A line of JSON for each group, of a report or a session, in a folder of files written by the executors, in order."""
    groups.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("json").write.mode("overwrite").text(path)


def load_parts(spark: SparkSession, path: str) -> DataFrame:
    """(group_key, reasons, files) of a session written in parts."""
    one = SESSION[SESSION.index("STRUCT<") : -1]
    lines = spark.read.text(path).select(F.from_json("value", one).alias("g"))
    found = imported(lines.select(F.array("g").alias("Groups")))
    return found.withColumn("group_key", F.monotonically_increasing_id())


def json_groups(ranked: DataFrame, members: DataFrame, files: DataFrame, reasons: DataFrame) -> DataFrame:
    """(ordinal, json) of each group."""
    rows = ranked.join(nested(members, reasons, files).select("group_key", "files"), "group_key")
    has = "content_hash" in files.columns
    listed = F.transform("files", lambda f: F.struct(f["full_path"].alias("path"), f["length"].alias("sizeBytes"), iso(f["last_write_utc"]).alias("lastModifiedUtc"), (f["content_hash"] if has else F.lit(None).cast("string")).alias("contentHash")))
    body = F.struct(F.col("ordinal").alias("id"), "method", "similarity", "signature", F.col("reclaimable_bytes").alias("reclaimableBytes"), listed.alias("files"))
    return rows.select("ordinal", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def write_json(path: str, summary: dict, warnings: list[str], groups: DataFrame) -> None:
    head = '{"summary":' + json.dumps(summary, ensure_ascii=False) + ',"warnings":' + json.dumps(warnings, ensure_ascii=False) + ',"groups":['
    _one_file(groups.select("ordinal", F.col("json").alias("line")), ["ordinal"], path, head, ",", "]}")


def session_groups(ranked: DataFrame, members: DataFrame, files: DataFrame, reasons: DataFrame) -> DataFrame:
    """(ordinal, json) of each group as a session holds it."""
    rows = ranked.select("group_key", "ordinal").join(nested(members, reasons, files), "group_key")
    has = "content_hash" in files.columns
    body = F.struct(
        F.transform("reasons", lambda r: F.struct(r["method"].alias("Method"), r["similarity"].alias("Similarity"), r["signature"].alias("Signature"))).alias("Reasons"),
        F.transform("files", lambda f: F.struct(f["full_path"].alias("Path"), f["length"].alias("Length"), iso(f["last_write_utc"]).alias("LastWriteUtc"), (f["content_hash"] if has else F.lit(None).cast("string")).alias("ContentHash"))).alias("Files"),
    )
    return rows.select("ordinal", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def save(path: str, groups: DataFrame) -> None:
    """One file with a line for each group."""
    head = '{"Version":1,"SavedAtUtc":"' + time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()) + '","Groups":['
    line = F.concat(F.when(F.col("ordinal") == 1, F.lit("\n")).otherwise(F.lit("")), "json")
    _one_file(groups.select("ordinal", line.alias("line")), ["ordinal"], path, head, ",\n", "]}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """(group_key, reasons, files) of a saved session, in its order."""
    one = SESSION[SESSION.index("STRUCT<") : -1]
    groups = jsonsplit.elements(spark, path, "Groups").select("at", F.from_json("json", one).alias("g"))
    placed = numbered_within(groups.withColumn("all", F.lit(0)), ["all"], [F.asc("at")], "group_key")
    return imported(placed.select("group_key", F.array("g").alias("Groups")), "group_key")


def imported(sessions: DataFrame, key: str | None = None) -> DataFrame:
    """Groups of two files or more; one without reasons is taken for exact content. They are named by ``key``, or by their place in the session."""
    g = sessions.select(F.posexplode("Groups").alias("group_key", "g")) if key is None else sessions.select(F.col(key).alias("group_key"), F.explode("Groups").alias("g"))
    g = g.select("group_key", F.col("g.Reasons").alias("reasons"), F.col("g.Files").alias("files")).filter(F.size("files") >= 2)
    none = F.array(F.struct(F.lit("ExactContent").alias("Method"), F.lit(1.0).alias("Similarity"), F.lit("").alias("Signature")))
    return g.withColumn("reasons", F.when(F.coalesce(F.size("reasons"), F.lit(0)) <= 0, none).otherwise(F.col("reasons")))


def unnest(groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, reasons and files of imported groups."""
    f = groups.select("group_key", F.posexplode("files").alias("pos", "f"))
    files = f.select(F.xxhash64("f.Path").alias("file_id"), F.col("f.Path").alias("full_path"), F.col("f.Length").alias("length"), F.to_timestamp("f.LastWriteUtc").alias("last_write_utc"), F.col("f.ContentHash").alias("content_hash")).dropDuplicates(["file_id"])
    members = f.select("group_key", "pos", F.xxhash64("f.Path").alias("file_id"))
    r = groups.select("group_key", F.explode("reasons").alias("r"))
    return members, r.select("group_key", F.col("r.Method").alias("method"), F.col("r.Similarity").alias("similarity"), F.col("r.Signature").alias("signature")), files
