"""Places and running sums within groups, against plain Python, however groups lie over partitions."""

import random

import pytest
from pyspark.sql import functions as F

from twinfold.operators import exact
from twinfold.operators.positions import numbered_within


def expected(rows):
    out, at = [], {}
    for g, o, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        n, total = at.get(g, (0, 0))
        at[g] = (n + 1, total + (w or 0))
        out.append((g, o, n, total + (w or 0)))
    return sorted(out, key=str)


def numbered(df):
    found = numbered_within(df, ["g"], [F.asc("o")], "place", ("w", "total"))
    return sorted(((r.g, r.o, r.place, r.total) for r in found.collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_places_and_sums(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice(["hot", "hot", "a", "b", "", None, f"own {k}"]), k, rng.choice([None, 0, 5, -3])) for k in range(900)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, o long, w long").withColumn("__nothing", F.lit(1))
        assert numbered(df) == expected(rows)
        assert numbered(df.filter("g = 'hot'")) == expected([r for r in rows if r[0] == "hot"])
        assert numbered(df.filter("false")) == []
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_hot_group_spreads_over_tasks(spark):
    """Empty files are 30 % of all rows: the places of their group are made in several partitions, and are those of a window."""
    from twinfold.common import written
    from twinfold.operators import positions

    n = 20_000
    files = spark.range(n).select(F.col("id").alias("file_id"), F.when(F.col("id") % 10 < 3, F.lit("empty")).otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("group_key"), F.timestamp_seconds(F.col("id") * 7919 % 1000).alias("last_write_utc"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = {}
    try:
        before, positions.written = positions.written, lambda df: seen.setdefault("t", written(df))
        members, _ = exact.detect(files)
    finally:
        positions.written = before
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spread = {r[0]: r["count"] for r in seen["t"][0].filter("group_key = 'empty'").groupBy(positions.PART).count().collect()}
    assert len(spread) > 1 and max(spread.values()) < 0.3 * n
    got = sorted((r.pos, r.file_id) for r in members.filter("group_key = 'empty'").collect())
    assert got == list(enumerate(k for _, k in sorted((k * 7919 % 1000, k) for k in range(n) if k % 10 < 3)))
