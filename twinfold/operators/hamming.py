"""Pairs of 64-bit hashes within a number of bits, whatever bits they fill and however they are skewed.

Hashes within t bits differ in at most t // m bits of one of m slices, so an equality join on (slice, bits near it) finds every pair.
Slices are made of the bits that vary among the hashes given, dealt out so that each tells about as much; how many there are follows from
how often two hashes agree in them. Bits of one slice that many hashes have are met again by a further slicing of the bits
that are left, and so on, so a constant, narrow or common part of the hashes does not bring all of them together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from twinfold.common import written
from twinfold.functions.bits import ball, signed, sliced

#: Hashes that may share the bits of a slice before further bits are asked of them, and how often that is done.
HEAVY, LEVELS = 512, 3
#: Heavy values that are sent to all executors; more are joined by a shuffle.
BROADCAST = 500_000


@dataclass(frozen=True)
class Cell:
    """Bits that have been asked, and at each level the slices, the radius and which slice was taken."""

    used: int = 0
    steps: tuple[tuple[tuple[int, ...], int, int], ...] = ()


def _bits_set(rows: DataFrame, value: str) -> dict[int, tuple[int, list[int]]]:
    """By path, how many rows there are and in how many each bit is set."""
    ones = [F.sum(F.shiftrightunsigned(value, i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]
    return {r.path: (r.n, [r[f"b{i}"] for i in range(64)]) for r in rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), *ones).collect()}


def candidates(points: DataFrame, most: int, key: str = "id", value: str = "h") -> DataFrame:
    """(ka, va, kb, vb, chain): pairs with ka < kb that meet in some slice; a pair may meet in several. ``points`` is read several times: cut its lineage first."""
    spark = points.sparkSession
    start = points.select(F.col(key).alias("k"), F.col(value).alias("v"), F.lit(0).alias("path"), F.lit(0).cast("long").alias("bits")).filter("v is not null")
    a = b = start
    cells, fullest, met, last = {0: Cell()}, {}, [], 0
    for level in range(LEVELS):
        probes, below = [], {}
        for path, (n, ones) in sorted(_bits_set(b, "v").items()):
            cell, fullest[path] = cells[path], fullest.get(path, n)
            agree = {i: (x / n) ** 2 + (1 - x / n) ** 2 for i, x in enumerate(ones) if 0 < x < n and not cell.used >> i & 1}
            masks, radius = sliced(agree, fullest[path], most)
            for at, mask in enumerate(masks):
                last += 1
                below[last] = Cell(cell.used | mask, (*cell.steps, (tuple(masks), radius, at)))
                probes += [(path, last, signed(mask), signed(x)) for x in ball(mask, radius)]
        if not below:
            break
        cells = below
        plan = F.broadcast(spark.createDataFrame(probes, "path int, below int, mask long, flip long"))
        part = F.col("v").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip"))
        dealt = lambda rows, by: rows.join(by, "path").select("k", "v", F.col("below").alias("path"), F.col("bits").bitwiseOR(part).alias("bits"))
        asks, homes = dealt(a, plan), dealt(b, plan.filter("flip = 0"))
        heavy = None
        if level < LEVELS - 1 and max(fullest.values()) > HEAVY:
            heavy, _, seen = written(homes.groupBy("path", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HEAVY), F.count(F.lit(1)).alias("n"))
        if heavy is None or not seen["n"]:
            met.append((asks, homes))
            break
        fullest = {r.path: r.n for r in heavy.groupBy("path").agg(F.max("n").alias("n")).collect()}
        told = heavy.select("path", "bits")
        few = F.broadcast(told) if seen["n"] <= BROADCAST else told
        met.append((asks.join(few, ["path", "bits"], "left_anti"), homes.join(few, ["path", "bits"], "left_anti")))
        # The ways of the cells stay: a pair that met in a light slice is asked how it came there.
        met[-1] += (cells,)
        a, b = (written(x.join(few, ["path", "bits"], "left_semi"))[0] for x in (asks, homes))
    out = None
    for asks, homes, *more in met:
        ways = [(p, [{"masks": [signed(m) for m in masks], "radius": r, "at": at} for masks, r, at in c.steps]) for p, c in (more[0] if more else cells).items()]
        ways = F.broadcast(spark.createDataFrame(ways, "path int, chain array<struct<masks: array<bigint>, radius: int, at: int>>"))
        left = asks.select(F.col("k").alias("ka"), F.col("v").alias("va"), "path", "bits")
        right = homes.select(F.col("k").alias("kb"), F.col("v").alias("vb"), "path", "bits")
        found = left.join(right, ["path", "bits"]).filter("ka < kb").join(ways, "path").select("ka", "va", "kb", "vb", "chain")
        out = found if out is None else out.unionByName(found)
    if out is None:
        none = F.array().cast("array<struct<masks: array<bigint>, radius: int, at: int>>")
        return start.limit(0).select(F.col("k").alias("ka"), F.col("v").alias("va"), F.col("k").alias("kb"), F.col("v").alias("vb"), none.alias("chain"))
    return out


def _first(x: Column) -> Column:
    """Whether the pair took the first slice it is near in, at each level: true of one of the ways in which it met."""
    return F.forall("chain", lambda c: F.array_position(F.transform(c["masks"], lambda m: F.bit_count(x.bitwiseAND(m)) <= c["radius"]), True) == c["at"] + 1)


def hash_pairs(points: DataFrame, most: int, key: str = "id", value: str = "h") -> DataFrame:
    """(a, b, bits): pairs of keys with a < b whose hashes differ in at most ``most`` bits, each once; no cross join and no distinct.

    Null hashes pair with nothing. ``points`` is read several times: cut its lineage first.
    """
    x = F.col("va").bitwiseXOR(F.col("vb"))
    near = candidates(points, most, key, value).withColumn("n", F.bit_count(x)).filter(F.col("n") <= most)
    return near.filter(_first(x)).select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.col("n").alias("bits"))
