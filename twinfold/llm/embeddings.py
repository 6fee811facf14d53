"""Embedding near-dedup on robust-pruned flat graphs.

Centres fitted on a bounded sample cut the vectors into shards; each vector lives in the shard of its
nearest centre and is a member of the next OVERLAP - 1 as well. In each shard a flat graph is built:
every member searches it greedily from the medoid and takes robust-pruned edges to what it met. The
adjacency lists that a vector has in its shards are united. From the shard's
medoid, a greedy search for every vector that lives there first narrows to the best BEAM members and
then expands for as long as it meets members in range. What it found is verified in double
precision. An audit compares sampled vectors with all vectors, block by block, every vector weighing
the same and those of hot groups apart from others; below the recall asked for, everything is repeated
with twice the overlap, and where the most overlap falls short, all pairs are compared in tiles. A shard of more than TILE members is
dealt in tiles, pairs of hashed parts, so that none grows with a hot group.

Equal vectors are one class, with their number. A shard counts links and emits a spanning forest of
them, never all pairs.

Defined cases: null, empty and zero vectors, and those with null or non-finite components, link
with nothing, not even with equal ones, and are components of their own; vectors link with those of
their own length only, which have centres of their own; floats are compared as doubles; an
empty table gives no rows; equal vectors link; rows that repeat a key, or have none, are vectors of their
own, and a component is named by the least key in it, null where it has none; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from twinfold.common import cut, ship
from twinfold.operators.components import components

#: Cosine of a link; vectors that centres are fitted on; members of a shard aimed at; most centres.
COSINE, SAMPLE, SHARD, CENTRES = 0.95, 16_384, 2_048, 4_096
#: Shards that a vector is a member of at first, and at most; members of a tile.
OVERLAP, OVERLAP_MOST, TILE = 4, 32, 6_144
#: Edges of a node; near and random members pruned from; pruning factor; width of the search.
DEGREE, POOL, RANDOM, ALPHA, BEAM = 32, 64, 32, 1.2, 48
#: Vectors audited, recall asked for, queries searched together.
AUDIT, RECALL, TOGETHER = 512, 0.95, 256


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def centres(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 0) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(sample[a : a + 2048] @ c.T).argmax(1) for a in range(0, len(sample), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], c)
    return c


def prune(x: np.ndarray, order: np.ndarray, sims: np.ndarray, most: int, chosen: np.ndarray) -> np.ndarray:
    """Robust pruning of every node's candidates, nearest first: one stays unless a kept one is nearer to it by ALPHA."""
    n, width = order.shape
    alive = sims > -2
    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
    rows = np.arange(n)
    for _ in range(most):
        pick = alive.argmax(1)
        ok = alive[rows, pick]
        if not ok.any():
            break
        best = np.where(ok, order[rows, pick], 0)
        chosen = np.concatenate([chosen, np.where(ok, best, -1)[:, None]], 1)
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nwd->nw", x[best], x[order])))
        alive &= ALPHA * between > far
        alive[rows, pick] = False
    return chosen


def choose(x: np.ndarray, who: np.ndarray, met: np.ndarray, sims: np.ndarray, cosine: float) -> np.ndarray:
    """Out-edges of each node of ``who`` among its candidates (``met``, of similarity -2 or less where there is none).

    Half of the edges may go to candidates in range, the nearest; the others are robust-pruned from those out of
    range, so that a group of near-copies stays connected with the rest.
    """
    sims = np.where(met == who[:, None], -3, sims)
    half = DEGREE // 2
    parts = []
    for inside in (True, False):
        value = np.where((sims >= cosine) == inside, sims, -3)
        k = min(half if inside else POOL, value.shape[1])
        top = np.argpartition(-value, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(value, top, 1)
        by = np.argsort(-value, axis=1, kind="stable")
        order, value = np.take_along_axis(np.take_along_axis(met, top, 1), by, 1), np.take_along_axis(value, by, 1)
        parts.append(np.where(value > -2, order, -1) if inside else prune(x, order, value, half, np.full((len(who), 0), -1)))
    both = np.concatenate(parts, 1)
    return np.pad(both, ((0, 0), (0, DEGREE - both.shape[1])), constant_values=-1) if both.shape[1] < DEGREE else both


def walk(x: np.ndarray, table: np.ndarray, entry: int, q: np.ndarray, cosine: float = 2.0) -> np.ndarray:
    """Greedy search of each query from ``entry`` over a table of edges: similarities of what it meets, -2 elsewhere.

    It narrows to the best BEAM members and then expands for as long as it meets members in range.
    """
    n, rows = len(x), np.arange(len(q))
    sim = np.full((len(q), n), -2.0)
    sim[:, entry] = q @ x[entry]
    todo = np.full((len(q), n), -2.0)  # similarity of what is met and not expanded
    todo[:, entry] = sim[:, entry]
    live, k = rows, min(BEAM, n)
    while len(live):
        floor = np.minimum(np.partition(sim[live], n - k, axis=1)[:, n - k], cosine)
        open_ = todo[live] >= np.maximum(floor, -1.5)[:, None]
        waiting = open_.sum(1)
        live, open_ = live[waiting > 0], open_[waiting > 0]
        if not len(live):
            break
        e = int(min(64, n, max(4, waiting.max() // 4)))
        value = np.where(open_, todo[live], -3)
        top = np.argpartition(-value, e - 1, axis=1)[:, :e] if e < n else np.tile(np.arange(n), (len(live), 1))
        fine = np.take_along_axis(value, top, 1) > -2
        who, node = np.repeat(live, e).reshape(len(live), e)[fine], top[fine]
        todo[who, node] = -2
        got = table[node]
        b, m = np.repeat(who, got.shape[1]), got.ravel()
        keys = np.unique(b[m >= 0] * n + m[m >= 0])
        b, m = keys // n, keys % n
        new = sim[b, m] <= -2
        b, m = b[new], m[new]
        s = np.einsum("ij,ij->i", q[b], x[m])
        sim[b, m] = s
        todo[b, m] = s
    return sim


def _nearest(value: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of each row, -1 for those that were not met."""
    k = min(k, value.shape[1])
    top = np.argpartition(-value, k - 1, axis=1)[:, :k]
    return np.where(np.take_along_axis(value, top, 1) > -2, top, -1)


def _medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build(x: np.ndarray, cosine: float = COSINE, seed: int = 0) -> list[np.ndarray]:
    """Adjacency of a flat graph, built by greedy search and robust pruning.

    Members come in random order, in batches at most as large as what is there. Each searches the graph
    for itself from the medoid; its edges are chosen from what it met and from some members at random, and
    go both ways; a node much pointed at chooses anew.
    """
    n, rng = len(x), np.random.default_rng(seed)
    most = 3 * DEGREE
    table, degree = np.full((n, most), -1), np.zeros(n, np.int64)
    medoid = _medoid(x) if n else 0
    order = rng.permutation(n)
    at = int(np.flatnonzero(order == medoid)[0]) if n else 0
    order[[0, at]] = order[[at, 0]] if n else order[[0, at]]

    def keep(who: np.ndarray, lists: np.ndarray) -> None:
        by = np.argsort(lists < 0, axis=1, kind="stable")
        table[who] = -1
        table[who, : lists.shape[1]] = np.take_along_axis(lists, by, 1)
        degree[who] = (lists >= 0).sum(1)

    def point_back(who: np.ndarray, lists: np.ndarray) -> None:
        u, v = np.repeat(who, lists.shape[1]), lists.ravel()
        u, v = u[v >= 0], v[v >= 0]
        new = ~(table[v] == u[:, None]).any(1)
        u, v = u[new], v[new]
        by = np.argsort(v, kind="stable")
        u, v = u[by], v[by]
        to, first, count = np.unique(v, return_index=True, return_counts=True)
        place = degree[v] + np.arange(len(v)) - np.repeat(first, count)
        fits = place < most
        table[v[fits], place[fits]] = u[fits]
        full = to[degree[to] + count > most]
        degree[to] = np.minimum(degree[to] + count, most)
        for node in full.tolist():
            met = np.union1d(table[node][: degree[node]], u[v == node])[None]
            keep(np.array([node]), choose(x, np.array([node]), met, (x[met[0]] @ x[node])[None], cosine))

    at = 1
    while at < n:
        who = order[at : at + min(at, TOGETHER)]
        sim = walk(x, table, medoid, x[who])
        # What is out of range is pruned from the nearest of it, however many are in range.
        near, far = (_nearest(v, k) for v, k in ((sim, POOL), (np.where(sim >= cosine, -3, sim), POOL)))
        some = order[rng.integers(0, at, (len(who), RANDOM))]
        met = np.sort(np.concatenate([near, far, some, table[who]], 1), axis=1)
        met[:, 1:][met[:, 1:] == met[:, :-1]] = -1
        sims = np.where(met >= 0, np.einsum("nd,nwd->nw", x[who], x[met]), -3)
        lists = choose(x, who, met, sims, cosine)
        keep(who, lists)
        point_back(who, lists)
        at += len(who)
    return [table[i, : degree[i]] for i in range(n)]


def search(x: np.ndarray, edges: list[np.ndarray], queries: np.ndarray, cosine: float = COSINE) -> Iterator[tuple[int, np.ndarray]]:
    """Of each query (a position), the members in range that a range-expanding greedy search from the medoid meets."""
    table = np.full((len(x), max(1, max(map(len, edges), default=0))), -1)
    for i, e in enumerate(edges):
        table[i, : len(e)] = e
    medoid = _medoid(x)
    for at in range(0, len(queries), TOGETHER):
        qs = queries[at : at + TOGETHER]
        for q, row in zip(qs, walk(x, table, medoid, x[qs], cosine), strict=True):
            yield int(q), np.flatnonzero(row >= cosine)


def compared(x: np.ndarray, queries: np.ndarray, cosine: float = COSINE) -> Iterator[tuple[int, np.ndarray]]:
    """What ``search`` gives, from comparing each query with every member."""
    for at in range(0, len(queries), TOGETHER):
        qs = queries[at : at + TOGETHER]
        for q, row in zip(qs, x[qs] @ x.T >= cosine, strict=True):
            yield int(q), np.flatnonzero(row)


def valid(df: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return df.filter(F.coalesce(fine, F.lit(False)))


def _by_length(rows: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """At most 2,048 rows together whose vectors have one length."""
    for at in range(0, rows.num_rows, 2048):
        part = rows.slice(at, 2048)
        sizes = pc.list_value_length(part.column("vector")).to_numpy()
        for n in np.unique(sizes).tolist():
            yield n, part.take(pa.array(np.flatnonzero(sizes == n))) if (sizes != n).any() else part


def _route(points: DataFrame, shared, overlap: int, cuts) -> DataFrame:
    """(tile, shard, rep, n, vector, home, part): every membership; in hot shards, each part in its tiles.

    ``shared``: of each length, the number of its first shard and its centres. A length without centres is a shard of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows in _by_length(batch):
                if length in shared.value:
                    first, c = shared.value[length]
                    top = first + np.argsort(-(unit(matrix(rows.column("vector"))) @ c.T), axis=1, kind="stable")[:, :overlap]
                else:
                    top = np.full((rows.num_rows, 1), -length)
                reps = rows.column("rep").to_numpy()
                for rank in range(top.shape[1]):
                    parts = np.array([cuts.value.get(x, 1) for x in top[:, rank].tolist()])
                    own = ((reps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
                    for other in range(int(parts.max())):
                        keep = np.flatnonzero(other < parts)
                        i, j = np.minimum(own, other)[keep], np.maximum(own, other)[keep]
                        some = rows.take(pa.array(keep))
                        yield pa.RecordBatch.from_arrays([pa.array(top[keep, rank], pa.int64()), pa.array(i << 32 | j, pa.int64()), some.column("rep"), some.column("n"), some.column("vector"), pa.array(np.full(len(keep), rank == 0)), pa.array(own[keep], pa.int64())], names=["shard", "tile", "rep", "n", "vector", "home", "part"])

    return points.mapInArrow(run, f"shard long, tile long, rep long, n long, vector {points.schema['vector'].dataType.simpleString()}, home boolean, part long")


def _linked(points: DataFrame, shared, overlap: int, cosine: float, exact: bool = False) -> DataFrame:
    """(u, v, n): with v null, n links of u's class to other classes; else an edge of a forest. Exact compares
    all members of a tile; without centres these are all pairs of vectors of a length."""
    spark = points.sparkSession
    none = spark.sparkContext.broadcast({})
    sizes = _route(points, shared, overlap, none).groupBy("shard").count().filter(F.col("count") > TILE).collect()
    cuts = spark.sparkContext.broadcast({r.shard: -(-2 * r["count"] // TILE) for r in sizes})
    members = cut(_route(points, shared, overlap, cuts))

    def graph(rows: pa.Table) -> pa.Table:
        x, reps = unit(matrix(rows.column("vector"))), rows.column("rep").to_numpy()
        edges = build(x, cosine)
        return pa.table({"rep": pa.array(reps, pa.int64()), "near": pa.array([reps[e] for e in edges], pa.list_(pa.int64()))})

    def find(rows: pa.Table) -> pa.Table:
        x, reps, n = unit(matrix(rows.column("vector"))), rows.column("rep").to_numpy(), rows.column("n").to_numpy()
        part, tile = rows.column("part").to_numpy(), int(rows.column("tile")[0].as_py())
        across = (tile >> 32) != (tile & 0xFFFFFFFF)
        parent = np.arange(len(x))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        home = np.flatnonzero(rows.column("home").to_numpy())
        if exact:
            met = compared(x, home, cosine)
        else:
            place = {r: k for k, r in enumerate(reps.tolist())}
            met = search(x, [np.array([place[r] for r in near if r in place], np.int64) for near in rows.column("near").to_pylist()], home, cosine)
        u, v, links = [], [], []
        for q, hits in met:
            hits = hits[(hits != q) & ((part[hits] != part[q]) if across else True)]
            u.append(reps[q])
            v.append(None)
            links.append(int(n[hits].sum()))
            for h in np.unique(parent[hits]).tolist():
                a, b = root(q), root(h)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    u.append(reps[a])
                    v.append(reps[b])
                    links.append(0)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(links, pa.int64())})

    if exact:
        return members.groupBy("shard", "tile").applyInArrow(find, "u long, v long, n long")
    lists = members.groupBy("shard", "tile").applyInArrow(graph, "rep long, near array<long>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return members.join(united, "rep").select("shard", "tile", "rep", "n", "vector", "home", "part", "near").groupBy("shard", "tile").applyInArrow(find, "u long, v long, n long")


def _audit(points: DataFrame, counts: DataFrame, total: int, cosine: float) -> float:
    """Share of its links found, averaged over the sampled classes with links: over those with more links than a
    node has edges or over the others, whichever is less."""
    spark = points.sparkSession
    share = min(1.0, AUDIT / max(1, total))
    asked = points.filter(F.pmod(F.xxhash64(F.lit("audit"), "rep"), F.lit(1 << 40)) < int(share * (1 << 40))).collect()
    if not asked:
        return 1.0
    of: dict[int, list] = {}
    for r in asked:
        of.setdefault(len(r.vector), []).append(r)
    shared = spark.sparkContext.broadcast({n: (np.array([r.rep for r in rs]), unit(np.array([r.vector for r in rs], np.float64))) for n, rs in of.items()})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: np.zeros(len(reps), np.int64) for n, (reps, _) in shared.value.items()}
        for batch in batches:
            for length, rows in _by_length(batch):
                if length in found:
                    reps, q = shared.value[length]
                    hit = (unit(matrix(rows.column("vector"))) @ q.T >= cosine) & (rows.column("rep").to_numpy()[:, None] != reps)
                    found[length] += (hit * rows.column("n").to_numpy()[:, None]).sum(0)
        for n, links in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[n][0], pa.int64()), pa.array(links, pa.int64())], names=["u", "truth"])

    truth = points.mapInArrow(compare, "u long, truth long").groupBy("u").agg(F.sum("truth").alias("truth"))
    part = F.least("truth", F.coalesce("n_links", F.lit(0))) / F.col("truth")
    r = truth.filter("truth > 0").join(counts, "u", "left").groupBy((F.col("truth") > DEGREE).alias("hot")).agg(F.avg(part).alias("found")).collect()
    return min((x.found for x in r), default=1.0)


def _searched(points: DataFrame, cosine: float) -> tuple[DataFrame, float]:
    """What ``_linked`` gives, found with enough overlap or from all pairs, and its recall as audited."""
    spark = points.sparkSession
    total = points.count()
    share = min(1.0, SAMPLE / max(1, total))
    sample: dict[int, list] = {}
    for r in points.filter(F.pmod(F.xxhash64(F.lit("fit"), "rep"), F.lit(1 << 40)) < int(share * (1 << 40))).select("vector").collect():
        sample.setdefault(len(r.vector), []).append(r.vector)
    overlap = OVERLAP
    while True:
        fitted, first = {}, 0
        for length, rows in sorted(sample.items()):
            k = min(max(1, CENTRES * len(rows) // SAMPLE), max(1, round(len(rows) / share * overlap / SHARD)))
            fitted[length] = (first, centres(unit(np.array(rows, np.float64)), k))
            first += len(fitted[length][1])
        linked = cut(_linked(points, spark.sparkContext.broadcast(fitted), overlap, cosine))
        recall = _audit(points, _counts(linked), total, cosine)
        if recall >= RECALL:
            return linked, recall
        overlap *= 2
        if overlap > min(OVERLAP_MOST, 2 * first):
            return cut(_linked(points, spark.sparkContext.broadcast({}), 1, cosine, exact=True)), 1.0


def _counts(linked: DataFrame) -> DataFrame:
    return linked.filter("v is null").groupBy("u").agg(F.sum("n").alias("n_links"))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept, audited_recall) of each row. Vectors of unlike length link with nothing."""
    spark = ship(df.sparkSession)
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector"))
    classes = valid(rows, "vector").groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    # The numbers hold since what is cut is written.
    points = cut(classes.select(F.monotonically_increasing_id().alias("rep"), "least", "n", "vector"))
    linked, recall = _searched(points.select("rep", "n", "vector"), cosine)
    found, counts = components(linked.filter("v is not null").select("u", "v")), _counts(linked)
    rooted = cut(points.join(counts, points.rep == counts.u).join(found, points.rep == found.node, "left").select("vector", "least", (F.col("n_links") + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("root")))
    named = rooted.join(cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select("vector", "links", "component_id")
    # Rows that link with nothing must not meet a class: their vectors are none of its.
    out = rows.join(named, "vector", "left").select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))).withColumn("audited_recall", F.lit(float(recall)))
