"""SimHash fingerprints, and all links between them by vantage-point trees.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of the upper or of the
lower half. For either half a vantage-point tree, grown on a bounded sample, cuts the space into
leaves by Hamming distance. Every fingerprint lives in one leaf of a tree; by the triangle bound it
also visits those later leaves that its ball of 1 bit may reach across a boundary, and no others. So
any two that are close in a half meet in a leaf, where all 64 bits are compared. A leaf of
more than TILE members is cut into tiles by hash that cover all its pairs. Leaves emit a spanning
forest of their links, never all pairs of a group; components of the forests are those of all links.

Defined cases: a null or empty text, or one of white space, has fingerprint 0 and is linked like any
other; texts of fewer words than a shingle have one shingle. Equal fingerprints are one
point. An empty table gives no rows. Rows with a null key are linked like any other; a component is
named by the least key in it, null where it has none. Repeated rows get the same component. Extra columns are not carried: join the result on the key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from twinfold.common import cut, ship, written
from twinfold.llm.bpe import slices
from twinfold.llm.memory import tidy
from twinfold.operators.components import components

#: Words of a shingle, seed of its hash, bits of a fingerprint that may differ.
SHINGLE, SEED, BITS = 3, 42, 3
#: Fingerprints that the trees are grown on, members of a leaf aimed at, deepest tree, members of a tile.
SAMPLE, LEAF, DEPTH, TILE = 65_536, 1_024, 12, 16_384
#: Rows of key and hash that are sent to all executors; more are joined by a shuffle.
BROADCAST = 500_000
#: Shingle hashes summed at once, rows compared at once.
BLOCK, ROWS = 32_768, 256
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text: bits set in over half of its shingles' hashes."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = ((ends - sizes)[: -size + 1].tolist(), ends[size - 1 :].tolist()) if len(words) > size else ([0], [len(joined)])
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, seed: int = SEED, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, fp) and the other columns named: the fingerprint of each row as the bit pattern of a long."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = np.array([fingerprint(t, size, seed) for t in part.column(text).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (key, *more)), pa.array(found.view(np.int64), pa.int64())], names=[key, *more, "fp"])

    kept = [T.StructField(c, df.schema[c].dataType) for c in (key, *more)]
    return df.select(key, text, *more).mapInArrow(tidy(run), T.StructType([*kept, T.StructField("fp", T.LongType())]))


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class Tree:
    """A vantage-point tree over values compared by Hamming distance; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 0):
        self.nodes: list[tuple] = []
        self.leaves = 0
        self._grow(np.unique(sample), depth, np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        best = None
        if depth and len(points) > 1:
            for p in rng.choice(points, min(6, len(points)), replace=False):
                d = np.bitwise_count(points ^ p)
                for mu in {int(np.median(d)), int(np.median(d)) - 1}:
                    # Few near the boundary, and halves of like size.
                    crossing, left = np.mean((d > mu - 1) & (d <= mu + 1)), np.mean(d <= mu)
                    cost = crossing + abs(left - 0.5)
                    if 0 < left < 1 and (best is None or cost < best[0]):
                        best = (cost, p, mu, d <= mu)
        if best is None:
            self.nodes[at] = (self.leaves,)
            self.leaves += 1
            return at
        _, p, mu, left = best
        a = self._grow(points[left], depth - 1, rng)
        b = self._grow(points[~left], depth - 1, rng)
        self.nodes[at] = (p, mu, a, b)
        return at

    def route(self, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each leaf reached: its number, the values' positions, and whether each lives there.

        A value visits leaves after its own only: of two close values the one whose leaf comes first
        finds the other.
        """
        stack = [(0, np.arange(len(values)), np.ones(len(values), bool))]
        while stack:
            at, who, home = stack.pop()
            if not len(who):
                continue
            node = self.nodes[at]
            if len(node) == 1:
                yield node[0], who, home
                continue
            p, mu, a, b = node
            d = np.bitwise_count(values[who] ^ p).astype(np.int64)
            left, right = np.where(home, d <= mu, d - radius <= mu), d + radius > mu
            stack.append((a, who[left], home[left]))
            stack.append((b, who[right], home[right] & (d[right] > mu)))


def halves(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [u >> np.uint64(32), u & np.uint64(0xFFFFFFFF)]


def forest(fp: np.ndarray, home: np.ndarray, most: int = BITS) -> tuple[list[int], list[int]]:
    """Positions of a spanning forest of the links between members that live here and any others."""
    parent = np.arange(len(fp))

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            parent[x] = parent[up]
            x = up

    us, vs = [], []
    own = np.flatnonzero(home)
    for at in range(0, len(own), ROWS):
        block = own[at : at + ROWS]
        near = np.bitwise_count(fp[block][:, None] ^ fp[None, :]) <= most
        for r in np.flatnonzero(near.sum(1) > 1).tolist():
            found = np.unique(roots(np.flatnonzero(near[r])))
            if len(found) > 1:
                us += [int(found[0])] * (len(found) - 1)
                vs += found[1:].tolist()
                parent[found[1:]] = found[0]
    return us, vs


def links(points: DataFrame, most: int = BITS) -> DataFrame:
    """(u, v): links that connect what all links connect, for ``points`` of distinct ``fp`` and their ``rep``.

    ``points`` is read several times: cut its lineage first.
    """
    spark = ship(points.sparkSession)
    n = points.count()
    share = min(1.0, SAMPLE / max(1, n))
    few = points if share == 1 else points.filter(F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = np.array([r.fp for r in few.select("fp").collect()], np.int64)
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, n) / LEAF))))
    shared = spark.sparkContext.broadcast([Tree(h, depth, k) for k, h in enumerate(halves(sample))])
    radius = most // 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, (tree, values) in enumerate(zip(shared.value, halves(batch.column("fp").to_numpy()), strict=True)):
                got = [(leaf, len(who)) for leaf, who, _ in tree.route(values, radius)]
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | leaf for leaf, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())], names=["leaf", "n"])

    sizes = points.select("fp").mapInArrow(place, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).filter(F.col("n") > TILE).collect()
    cuts = spark.sparkContext.broadcast({r.leaf: -(-r.n // TILE) * 2 for r in sizes})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, reps = batch.column("fp").to_numpy(), batch.column("rep").to_numpy()
            for part, (tree, values) in enumerate(zip(shared.value, halves(fps), strict=True)):
                for leaf, who, home in tree.route(values, radius):
                    k = cuts.value.get(part << 32 | leaf, 1)
                    own = ((fps[who].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % k
                    for j in range(k):
                        low, high = np.minimum(own, j), np.maximum(own, j)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), part << 32 | leaf), pa.int64()), pa.array(low << 32 | high, pa.int64()), pa.array(fps[who], pa.int64()), pa.array(reps[who], pa.int64()), pa.array(home, pa.bool_())], names=["leaf", "tile", "fp", "rep", "home"])

    def join(rows: pa.Table) -> pa.Table:
        fps, reps = rows.column("fp").to_numpy().view(np.uint64), rows.column("rep").to_numpy()
        us, vs = forest(fps, rows.column("home").to_numpy(), most)
        return pa.table({"u": pa.array(reps[us] if us else [], pa.int64()), "v": pa.array(reps[vs] if vs else [], pa.int64())})

    dealt = points.select("fp", "rep").mapInArrow(deal, "leaf long, tile long, fp long, rep long, home boolean")
    return dealt.groupBy("leaf", "tile").applyInArrow(join, "u long, v long")


def _components(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(fp, component, least): of each fingerprint among the rows, the least one reachable over links, and the least key there."""
    # A fingerprint is its own number: keys may repeat or be null.
    points = cut(rows.groupBy("fp").agg(F.min(F.col(key).cast("long")).alias("least")).withColumn("rep", F.col("fp")))
    found = components(links(points, most))
    rooted = cut(points.join(found, points.rep == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "least"))
    # Cut, so the join is of two plain inputs and Spark can split a component that holds much.
    return rooted.drop("least").join(cut(rooted.groupBy("component").agg(F.min("least").alias("least"))), "component")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, seed: int = SEED, most: int = BITS) -> DataFrame:
    """(key, fp, component_id) of each row; the component is the least key reachable over links."""
    rows = cut(fingerprints(df, text, key, size, seed))
    named = cut(_components(rows, key, most).select("fp", F.col("least").alias("component_id")))  # so that Spark can split a hot fingerprint
    return rows.join(named, "fp").select(key, "fp", "component_id")


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with one row of each group of near-duplicates, of those with the least key one; a null key is more than any other.

    What goes is told by key and a hash of the text, and sent to the texts while it is at most BROADCAST rows.
    """
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    prints = fingerprints(df.select(F.col(key), F.col(text), mark.alias("__mark")), text, key, more=("__mark",))
    rows = written(prints.groupBy(key, "__mark").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")))[0]
    named = rows.join(_components(rows, key, BITS).select("fp", "component"), "fp")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__mark"))
    best = cut(named.groupBy("component").agg(F.min(order).alias("best")))
    told = named.join(best, "component").select(key, "__mark", "n", (order == F.col("best")).alias("stays"))
    told, path, seen = written(told.filter("not stays or n > 1"), F.count(F.when(~F.col("stays"), 1)).alias("go"), F.count(F.when(F.col("stays"), 1)).alias("again"))

    def joined(left: DataFrame, right: DataFrame, n: int, how: str) -> DataFrame:
        few = right.select(F.col(key).alias("__key"), F.col("__mark").alias("__mark"))
        return left.join(F.broadcast(few) if n <= BROADCAST else few, F.col(key).eqNullSafe(F.col("__key")) & (mark == F.col("__mark")), how)

    kept = joined(df, told.filter("not stays"), seen["go"], "left_anti")
    if seen["again"]:
        again = told.filter("stays")
        one = joined(kept, again, seen["again"], "left_semi").withColumn("__mark", mark).dropDuplicates([key, "__mark"]).drop("__mark")
        kept = joined(kept, again, seen["again"], "left_anti").unionByName(one)
    return kept.select(*df.columns)
