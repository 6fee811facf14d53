"""Conversation prefix trie with rolled-up counts.

A node is a distinct sequence of turns with which conversations begin, told by a digest of them. Digests of prefixes are made in
blocks of turns and joined up by doubling; so are subtree sums: in round k each node hands what it has of its next 2^k levels
to its ancestor 2^k above, and jumps to that one's ancestor. Rounds are as many as the logarithm of the depth, however
long a conversation is, and no conversation, node or set of members is gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from twinfold.common import remove, ship, written
from twinfold.llm.memory import tidy
from twinfold.operators.positions import numbered_within

#: Turns whose digests are gathered in one row, and members whose keys are.
BLOCK, MEMBERS = 64, 1024
#: Rows that are sent to all executors, of under 100 bytes each; more are joined by a shuffle that Spark may split.
BROADCAST = 200_000
#: Turns that a conversation may take over from another.
SHARED = 8


def digest(x: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(x, 256)), 1, 16)


def root() -> Column:
    """What the textless root is told by."""
    return digest(F.lit(""))


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, leaf, bytes): turns by their place, a digest of role and text, and the text's UTF-8 bytes.

    Turns stand by ``turn``, null first, then by role, then by the digest of role and text. Null roles and texts are empty; rows of a null conversation are left out.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    leaf = digest(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"))
    rows = df.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), r.alias("role"), leaf.alias("leaf"), F.octet_length(t).cast("long").alias("bytes"))
    return numbered_within(rows, ["conv"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("leaf")]).select("conv", "pos", "leaf", "bytes")


def spliced(rows: DataFrame, donor: Column, shared: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``shared`` (at most SHARED) turns of another, ``donor``, instead of their own first ones.

    Both are expressions of ``conv``. Returns (conv, pos, leaf, bytes) and (conv, n), the number of turns, of every conversation.
    ``rows`` is read several times.
    """
    sizes, _, seen = written(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("own")), F.count(F.lit(1)).alias("n"))
    told = sizes.select("conv", "own", donor.alias("donor"), shared.alias("shared"))
    given = sizes.select(F.col("conv").alias("donor"), F.col("own").alias("theirs"))
    head = F.least(F.col("shared"), F.coalesce("theirs", F.lit(0)))
    plan, _, _ = written(told.join(given, "donor", "left").select("conv", "donor", "shared", head.alias("head"), (head + F.greatest(F.lit(0), F.col("own") - F.col("shared"))).alias("n")))
    first = rows.filter(F.col("pos") < SHARED).select(F.col("conv").alias("donor"), "pos", "leaf", "bytes")
    taken = first.join(_few(plan.select("conv", "donor", "head"), seen["n"]), "donor").filter("pos < head").select("conv", "pos", "leaf", "bytes")
    own = rows.join(_few(plan.select("conv", "shared", "head"), seen["n"]), "conv").filter("pos >= shared").select("conv", (F.col("pos") - F.col("shared") + F.col("head")).alias("pos"), "leaf", "bytes")
    return taken.unionByName(own), plan.select("conv", "n")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, bytes): of each turn, digests of all turns up to it, and up to the one before."""
    spark = rows.sparkSession
    block = (F.col("pos") / BLOCK).cast("long")
    own = rows.groupBy("conv", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "leaf", "bytes"))).alias("t"))
    empty = F.array().cast("array<binary>")
    chained = F.aggregate("t", empty, lambda acc, x: F.concat(acc, F.array(digest(F.concat(F.coalesce(F.get(acc, F.size(acc) - 1), root()), x["leaf"])))))
    blocks, path, seen = written(own.withColumn("chain", chained), F.coalesce(F.max("block"), F.lit(0)).alias("deepest"))
    # After round k a block's digest covers the 2^k blocks that end with it, or all where there are fewer.
    ends, spent = blocks.select("conv", "block", F.element_at("chain", -1).alias("all")), []
    step = 1
    while step <= seen["deepest"]:
        before = ends.select("conv", (F.col("block") + step).alias("block"), F.col("all").alias("left"))
        ends, at, _ = written(ends.join(before, ["conv", "block"], "left").select("conv", "block", F.when(F.col("left").isNull(), F.col("all")).otherwise(digest(F.concat("left", "all"))).alias("all")))
        spent.append(at)
        step *= 2
    before = ends.select("conv", (F.col("block") + 1).alias("block"), F.col("all").alias("before"))
    whole = blocks if not seen["deepest"] else blocks.join(before, ["conv", "block"], "left")
    until = F.lit(None).cast("binary") if not seen["deepest"] else F.col("before")
    named = whole.select("conv", "block", "t", until.alias("before"), "chain").withColumn("nodes", F.transform("chain", lambda x: F.when(F.col("before").isNull(), x).otherwise(digest(F.concat("before", x)))))
    # The turn before the first of a block is the last of the block before, whose digest is digest(before of that block, its chain's last).
    last = F.when(F.size("nodes") > 0, F.element_at("nodes", -1))
    out, made, _ = written(named.select("conv", "block", "t", "nodes", last.alias("last")))
    if seen["deepest"]:
        prior = out.select("conv", (F.col("block") + 1).alias("block"), F.col("last").alias("prior"))
        linked = out.drop("last").join(prior, ["conv", "block"], "left")
    else:
        linked = out.drop("last").withColumn("prior", F.lit(None).cast("binary"))
    parents = F.concat(F.array(F.coalesce("prior", root())), F.slice("nodes", F.lit(1), F.size("nodes") - 1))
    flat = linked.select("conv", F.explode(F.arrays_zip("t", F.col("nodes").alias("node"), parents.alias("parent"))).alias("x")).select("conv", (F.col("x.t.pos") + 1).alias("depth"), "x.node", "x.parent", F.col("x.t.bytes").alias("bytes"))
    kept, _, _ = written(flat)
    for old in [path, made, *spent]:
        remove(spark, old)
    return kept


def rolled_up(nodes: DataFrame, sums: list[str], most: int) -> DataFrame:
    """``nodes`` (node, parent, and columns of numbers) with each of ``sums`` summed over the node and all nodes below it.

    ``parent`` is null at a root; no path is longer than ``most`` edges, which takes log2(most) + 1 rounds.
    """
    spark = nodes.sparkSession
    now, path, seen = written(nodes.select("node", F.col("parent").alias("up"), *sums), F.count(F.lit(1)).alias("n"))
    reach = 1
    while reach <= most:
        more = now.filter("up is not null").groupBy(F.col("up").alias("node")).agg(*(F.sum(c).alias(f"__{c}") for c in sums))
        # A pointer that reaches a root ends there: its next jump leads nowhere, and is not looked up.
        jump = now.filter("up is not null").select(F.col("node").alias("up"), F.col("up").alias("next"))
        added = now.join(more, "node", "left").select("node", "up", *((F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums))
        half, at, _ = written(added)
        done = half.filter("up is null").select("node", "up", *sums)
        on = half.filter("up is not null").join(_few(jump, seen["n"]), "up", "left").select("node", F.col("next").alias("up"), *sums)
        now, last, _ = written(done.unionByName(on))
        for x in (path, at):
            remove(spark, x)
        path, reach = last, 2 * reach
    return nodes.drop(*sums).join(now.drop("up"), "node")


def _ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the sorted keys of each node's members, joined by commas.

    Keys are numbered within their node and joined in pieces of MEMBERS; a node of several pieces is hashed as they stream by,
    so a task holds no more than a piece.
    """
    placed = numbered_within(members.select("node", "conv"), ["node"], [F.asc("conv")])
    piece = placed.groupBy("node", F.floor(F.col("pos") / MEMBERS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text"))
    pieces, _, _ = written(piece)
    several = pieces.filter("piece > 0").select("node").distinct()
    one = pieces.join(several, "node", "left_anti").select("node", F.sha2("text", 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for n, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if n != node:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    long = pieces.join(several, "node", "left_semi").repartition("node").sortWithinPartitions("node", "piece").select("node", "text")
    return one.unionByName(long.mapInArrow(tidy(run), T.StructType([T.StructField("node", T.BinaryType()), T.StructField("ends_sha256", T.StringType())])))


def prefix_trie(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each node of the trie of conversations (conv, pos, leaf, bytes) with their numbers of turns (conv, n).

    node, depth, conv_id (least member), parent_conv_id (the parent's; null at the root), n_convs (members), n_children, n_leaves (childless nodes
    in its subtree), saved_tokens (over its subtree, (n_convs - 1) times bytes of its last turn), ends_sha256 (of its members that end there).
    A conversation without turns is a member of the root only. Without conversations there is no node.
    """
    spark = ship(rows.sparkSession)
    sizes, _, all_ = written(sizes, F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"))
    paths = prefixes(rows)
    grouped = paths.groupBy("node", "parent").agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"))
    top = spark.range(1 if all_["n"] else 0).select(root().alias("node"), F.lit(all_["least"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(all_["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("bytes"))
    nodes, _, seen = written(grouped.unionByName(top), F.count(F.lit(1)).alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    counted, _, _ = written(
        nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    )
    rolled = rolled_up(counted, ["n_leaves", "saved_tokens"], seen["deepest"])
    last = paths.join(_few(sizes.select("conv", F.col("n").alias("depth")), all_["n"]), ["conv", "depth"], "left_semi").select("node", "conv")
    ends = _ends(last.unionByName(sizes.filter("n = 0").select(root().alias("node"), "conv")))
    ended, _, _ = written(rolled.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return ended.join(_few(above, seen["n"]), "parent", "left").select("node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
