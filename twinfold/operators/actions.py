"""Plans of what to do with redundant files, carrying them out, and what is left after."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from twinfold.common import exists, ship, spread
from twinfold.functions.names import stem
from twinfold.operators.positions import numbered_within


def plan_delete(files: DataFrame) -> DataFrame:
    return files.select(F.lit("delete").alias("action"), F.col("full_path").alias("path"), F.col("length").alias("bytes"))


def plan_move(files: DataFrame, target: str, existing: DataFrame | None = None) -> DataFrame:
    """Destinations in one folder, no two the same, any case, and none that ``existing`` (file_name) has there.

    The first file of a name, by path, keeps it. Each further one gets the next number that no file's own name and
    no existing one has: its own place among them, and one more for each taken number on the way.
    """
    ending = r"(\.[^.]*)$"
    rows = files.select("full_path", "length", "file_name", F.lower("file_name").alias("_own"), F.lower(F.concat(stem(F.col("file_name")), F.lit("/"), F.regexp_extract("file_name", ending, 1))).alias("_base"))
    there = existing.select(F.lower("file_name").alias("_own")).distinct() if existing is not None else None
    names = rows.select("_own").unionByName(there) if there is not None else rows.select("_own")
    # "stem (7).end" takes the number 7 of "stem.end".
    parts = names.distinct().select(F.regexp_extract("_own", r"^(.*) \(([1-9]\d{0,8})\)((?:\.[^.]*)?)$", 1).alias("s"), F.regexp_extract("_own", r"^(.*) \(([1-9]\d{0,8})\)((?:\.[^.]*)?)$", 2).alias("k"), F.regexp_extract("_own", r"^(.*) \(([1-9]\d{0,8})\)((?:\.[^.]*)?)$", 3).alias("e")).filter("k <> ''")
    taken = parts.select(F.concat_ws("/", "s", "e").alias("_base"), F.col("k").cast("long").alias("k"))
    free = numbered_within(taken, ["_base"], [F.asc("k")]).select("_base", (F.col("k") - F.col("pos") - 1).alias("_at"), F.lit(1).cast("long").alias("_taken"))
    numbered = numbered_within(rows, ["_base"], [F.asc("full_path")], "_at")
    if there is not None:
        numbered = numbered.join(there.withColumn("_there", F.lit(1)), "_own", "left").withColumn("_at", F.col("_at") + F.when(F.col("_there").isNull(), 0).otherwise(1))
    # A taken number counts for those whose place comes after the free numbers before it.
    both = numbered.select("full_path", "length", "file_name", "_base", "_at", F.lit(0).cast("long").alias("_taken")).unionByName(free, allowMissingColumns=True)
    summed = numbered_within(both, ["_base"], [F.asc("_at"), F.asc("_taken"), F.asc("full_path")], "_nth", ("_taken", "_over"))
    told = summed.withColumn("_k", F.col("_at") + F.col("_over")).filter("_taken = 0")
    name = F.when(F.col("_at") == 0, F.col("file_name")).otherwise(F.concat(stem(F.col("file_name")), F.lit(" ("), F.col("_k").cast("string"), F.lit(")"), F.regexp_extract("file_name", ending, 1)))
    return told.select(F.lit("move").alias("action"), F.col("full_path").alias("path"), F.col("length").alias("bytes"), F.concat(F.lit(target.rstrip("/") + "/"), name).alias("destination"))


def _carried_out(action: str, path: str, destination: str | None, was: str, target: str) -> str | None:
    """What went wrong with one action, or None. What an earlier attempt has done already counts as done."""
    from twinfold.sources import store

    try:
        if was == "none":
            return "No such file or directory"
        gone = store.kind(path) == "none"
        if action == "delete":
            if not gone:
                store.deleted(path)
        elif action == "move":
            if not gone:
                store.moved(path, destination)
            elif target != "none" or store.kind(destination) == "none":
                return "No such file or directory"
        else:
            return f"no such action: {action}"
    except OSError as x:
        return store.reason(x)
    return None


def apply(plan: DataFrame, at: str) -> DataFrame:
    """Carries out a plan on the executors; (action, path, bytes, destination, error) of each item, error null where it was done.

    ``at`` is a folder of the caller's that keeps the journal: what was there before anything was done, written first, and the outcomes. So an
    item that was done by a task whose executor was lost is not taken for one that failed, and a plan applied again into the same folder does
    nothing more and gives the same outcomes, as does one that goes on after the driver died. One item that fails harms no other.
    """
    from twinfold.sources import store

    spark = ship(plan.sparkSession)
    rows = plan if "destination" in plan.columns else plan.withColumn("destination", F.lit(None).cast("string"))
    names = ["action", "path", "bytes", "destination"]
    rows = rows.select(*names)

    def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            was = [pa.array([None if p is None else store.kind(p) for p in b.column(c).to_pylist()], pa.string()) for c in ("path", "destination")]
            yield pa.RecordBatch.from_arrays([*b.columns, *was], names=[*b.schema.names, "was", "target"])

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            why = [_carried_out(r["action"], r["path"], r["destination"], r["was"], r["target"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(why, pa.string())], names=[*names, "error"])

    if not exists(spark, f"{at}/before/_SUCCESS"):
        spread(rows).mapInArrow(surveyed, T.StructType([*rows.schema.fields, T.StructField("was", T.StringType()), T.StructField("target", T.StringType())])).write.mode("overwrite").parquet(f"{at}/before")
    if not exists(spark, f"{at}/outcomes/_SUCCESS"):
        before = spark.read.parquet(f"{at}/before")
        spread(before).mapInArrow(done, T.StructType([*before.select(*names).schema.fields, T.StructField("error", T.StringType())])).write.mode("overwrite").parquet(f"{at}/outcomes")
    return spark.read.parquet(f"{at}/outcomes")


def report(outcomes: DataFrame) -> DataFrame:
    """(succeeded, bytes_freed, n_errors) of (path, bytes, error) rows."""
    ok = F.col("error").isNull()
    return outcomes.agg(F.count_if(ok).alias("succeeded"), F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes_freed"), F.count_if(~ok).cast("int").alias("n_errors"))


def errors(outcomes: DataFrame) -> DataFrame:
    """(path, message) of what failed, a row each."""
    return outcomes.filter("error is not null").select("path", F.concat_ws(": ", "path", "error").alias("message"))


def after(members: DataFrame, files: DataFrame, gone: DataFrame) -> DataFrame:
    """Members left when the paths of ``gone`` are no more, any case; groups of fewer than two go too."""
    lost = gone.select(F.lower("path").alias("_p"))
    dead = files.select("file_id", F.lower("full_path").alias("_p")).join(lost, "_p", "left_semi").select("file_id")
    left = members.join(dead, "file_id", "left_anti")
    return left.join(left.groupBy("group_key").count().filter("count > 1").select("group_key"), "group_key", "left_semi")
