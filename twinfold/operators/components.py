"""Connected components of an edge list by alternating star contractions (Kiveris et al., 2014).

Each round hangs every node on the smallest neighbour it knows, until all hang on the smallest of
their component. A hub's neighbours are never collected: its minimum is a partial aggregate. Where
the minima are few enough to be sent to all executors, edges stay where they are; beyond that they
are written first, so the join back on them is of two plain inputs, whose hot keys Spark splits. Each
round's edges are a written table, so a lost executor costs no more than the round; the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinfold.common import remove, written

#: More rounds than any graph of 2^60 nodes needs.
ROUNDS = 120
#: Minima, of 16 bytes each, that are sent to all executors.
BROADCAST = 500_000


def _hung(rows: DataFrame, least: DataFrame, few: bool, spent: list[str]) -> DataFrame:
    """Rows (u, v) with the least node m known to u."""
    if few:
        return rows.join(F.broadcast(least), "u")
    kept, path, _ = written(least)
    spent.append(path)
    return rows.join(kept, "u")


def _large(edges: DataFrame, few: bool, spent: list[str]) -> DataFrame:
    """Hangs larger neighbours of each node on the least of its neighbours and itself."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _hung(both.filter("v > u"), least, few, spent).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, few: bool, spent: list[str]) -> DataFrame:
    """Hangs smaller neighbours of each node, and itself, on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = _hung(down, least, few, spent).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
    return hung.select("e.u", "e.v").filter("u <> v").distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """Edges written, their path, and their number with a sum of hashes that tells whether a round changed them."""
    rows, path, seen = written(edges, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"))
    return rows, path, (seen["n"], seen["h"])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node on an edge; component is the least node reachable.

    Loops and repeated edges count for nothing; an edge with a null end is dropped; a node whose only
    edge is a loop is returned as its own component. An empty edge list gives no rows.
    """
    spark = edges.sparkSession
    given, _, _ = written(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).dropna())
    loops = given.filter("u = v").select("u").distinct()
    now, path, mark = _kept(given.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        few, spent = 2 * mark[0] <= BROADCAST, [path]
        before = mark
        now, path, mark = _kept(_small(_large(now, few, spent), few, spent))
        for old in spent:
            remove(spark, old)
        if mark == before:
            break
    hung = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(hung.union(roots).select("node"), "node", "left_anti")
    return hung.union(roots).union(alone)
