"""Perceptual duplicates: images whose hashes, and videos most of whose frames, are within a number of bits.

Equal hashes, and equal sets of frames, are one node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from twinfold.common import cut, written
from twinfold.functions.bits import hamming, hex16
from twinfold.functions.video import frame_match
from twinfold.operators.components import components
from twinfold.operators.hamming import hash_pairs
from twinfold.operators.positions import placed
from twinfold.options import FRAME_MATCH

#: Meetings of sets of frames that a task compares, about.
MEETINGS = 2_000_000
#: Sets that each meets in the first step of finding components, on average.
FIRST = 500


def image_clusters(files: DataFrame, most: int) -> DataFrame:
    """(group_id, file_id, length, perceptual_hash) of files in clusters of two or more."""
    rows = cut(files.filter("perceptual_hash is not null").select("file_id", "length", "perceptual_hash"))
    points = cut(rows.groupBy("perceptual_hash").agg(F.min("file_id").alias("id")))
    found = components(hash_pairs(points.select("id", F.col("perceptual_hash").alias("h")), most), "a", "b")
    rooted = points.join(found, points.id == found.node, "left").select("perceptual_hash", F.coalesce("component", "id").alias("root"))
    joined = rows.join(rooted, "perceptual_hash")
    sizes = joined.groupBy("root").agg(F.count("*").alias("n"), F.min("file_id").alias("group_id")).filter("n > 1")
    return joined.join(sizes.select("root", "group_id"), "root").select("group_id", "file_id", "length", "perceptual_hash")


def detect_images(files: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Members, largest first; similarity is 1 - mean distance to the first / 64."""
    rows = cut(image_clusters(files, most))
    key = F.concat(F.lit("image:"), F.col("group_id").cast("string"))
    first = rows.groupBy("group_id").agg(F.min(F.struct((-F.col("length")).alias("o"), "file_id", "perceptual_hash")).alias("f")).select("group_id", F.col("f.file_id").alias("rep"), F.col("f.perceptual_hash").alias("rep_hash"))
    members = placed(rows.select(key.alias("group_key"), "length", "file_id"), F.desc("length"), F.asc("file_id"))
    mean = F.avg(F.when(F.col("file_id") != F.col("rep"), hamming(F.col("perceptual_hash"), F.col("rep_hash"))))
    compared = rows.join(first, "group_id").groupBy("group_id", "rep_hash").agg(mean.alias("m"))
    similarity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("m") / 64))
    return members, compared.select(key.alias("group_key"), F.lit("PerceptualImage").alias("method"), similarity.alias("similarity"), hex16(F.col("rep_hash")).alias("signature"))


def needed(size: int, least: float) -> int:
    """How many frames must match for their share of ``size`` to be ``least`` or more: one in any case."""
    m = max(1, int(least * size) - 1)
    while m / size < least:
        m += 1
    return m


@dataclass(frozen=True)
class _Frames:
    """What sets of frames (id, high, frames) are joined by, as written tables."""

    #: (h, other): frames that are near each other, each to itself too.
    near: DataFrame
    #: (id, h, upto, cost, frames): what each set asks for, of sets of up to so many frames, and how many sets hold something near.
    asked: DataFrame
    #: (id, high, n, h, frames): every frame of every set.
    homes: DataFrame
    #: Sets, the frames of the longest, and how many meet in all.
    n: int
    longest: int
    meets: int
    most: int

    def _compared(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """(a, b, share) of those that meet in a frame, as often as they meet."""
        met = a.join(b, "h").filter("a <> b and a < high and n <= upto")
        return met.select("a", "b", frame_match(F.col("fa"), F.col("fb"), self.most, self.longest).alias("share"))

    def _all_near(self, rows: DataFrame, part: float = 1.0) -> DataFrame:
        """Rows once for every frame near theirs, dealt to tasks by how many meet: what is dealt is small, what comes of it is not."""
        tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(self.meets * part) // MEETINGS))
        return rows.repartition(tasks, "h").join(self.near, "h").drop("h").withColumnRenamed("other", "h")

    def links(self, some: DataFrame | None = None) -> DataFrame:
        """(a, b, share): of sets, or those where one is among ``some`` (id), that meet; some of them several times."""
        a = self.asked.select(F.col("id").alias("a"), "h", "upto", F.col("frames").alias("fa"))
        b = self.homes.select(F.col("id").alias("b"), "high", "n", "h", F.col("frames").alias("fb"))
        if some is None:
            return self._compared(self._all_near(a), b)
        part = some.count() / max(1, self.n)
        mine, theirs = a.join(some, a.a == some.id, "left_semi"), a.join(some, a.a == some.id, "left_anti")
        held = b.join(some, b.b == some.id, "left_semi")
        return self._compared(self._all_near(mine, part), b).unionByName(self._compared(theirs, self._all_near(held, part)))


def _frames(sets: DataFrame, most: int, least: float) -> _Frames:
    """Of sets (id, high, frames), what tells which of them may have ``least`` of a's frames near b's, where some file of a is before one of b's.

    Distinct frames are joined first, so what follows goes by their keys. Of the frames of a set at least ``needed`` must match, so only
    so many of them are asked for that one at least is among them: those that fewest sets hold something near of. A frame that
    all sets share, such as a black one, brings none together. How many are needed grows with the other's size, so a frame is asked of sets up to a size.
    """
    own = sets.select("id", "high", F.size("frames").alias("n"), F.size(F.filter("frames", lambda h: h.isNotNull())).alias("real"), "frames")
    told = own.withColumn("h", F.explode(F.array_distinct(F.filter("frames", lambda h: h.isNotNull())))).withColumn("times", F.size(F.filter("frames", lambda x: x == F.col("h"))))
    frames, _, _ = written(told)
    held, _, _ = written(frames.groupBy("h").agg(F.count(F.lit(1)).alias("sets")))
    pairs, _, _ = written(hash_pairs(held.select(F.col("h").alias("id"), "h"), most).select("a", "b"))
    near = pairs.select(F.col("a").alias("h"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("h"), F.col("a").alias("other"))).unionByName(held.select("h", F.col("h").alias("other")))
    near, _, _ = written(near)
    cost = near.join(held.select(F.col("h").alias("other"), "sets"), "other").groupBy("h").agg(F.sum("sets").alias("cost"))
    sizes = sorted(r.n for r in frames.select("n").distinct().collect())
    needs = F.create_map(*(F.lit(x) for s in sizes or [1] for x in (s, needed(s, least))))
    # Frames of one set, at most as many as its row holds.
    rarest = Window.partitionBy("id").orderBy("cost", "h").rowsBetween(Window.unboundedPreceding, -1)
    ranked = frames.join(cost, "h").withColumn("before", F.coalesce(F.sum("times").over(rarest), F.lit(0)))
    fits = F.filter(F.array(*map(F.lit, sizes or [1])), lambda s: F.element_at(needs, F.least(F.col("n"), s)) <= F.col("real") - F.col("before"))
    asked, _, seen = written(ranked.select("id", "h", F.array_max(fits).alias("upto"), "cost", "frames").filter("upto is not null"), F.coalesce(F.sum("cost"), F.lit(0)).alias("meets"))
    return _Frames(near, asked, frames.select("id", "high", "n", "h", "frames"), sets.count(), max(sizes, default=1), seen["meets"], most)


def frame_candidates(files: DataFrame, most: int, least: float = FRAME_MATCH) -> DataFrame:
    """(a, b, share) of the pairs of videos that are compared, whether or not enough frames match."""
    return _file_frames(files, most, least).links().distinct()


def _file_frames(files: DataFrame, most: int, least: float) -> _Frames:
    return _frames(files.filter(F.size("frame_hashes") > 0).select(F.col("file_id").alias("id"), F.col("file_id").alias("high"), F.col("frame_hashes").alias("frames")), most, least)


def frame_pairs(files: DataFrame, most: int, least: float = FRAME_MATCH) -> DataFrame:
    """(a, b, share): videos whose share of matching frames is ``least`` or more; a is the smaller id, whose frames are counted.

    Videos without a frame in common are never paired, whatever ``least`` is. Null frames match nothing; videos without frames are left out.
    """
    return _file_frames(files, most, least).links().filter(F.col("share") >= least).distinct()


def _linked(frames: _Frames, least: float) -> DataFrame:
    """(a, b): links enough to tell what is reachable from what.

    Where sets meet many others, all are compared with some of them first. That brings most together if there are many links. A link within the
    largest component so found tells nothing more, and every other has an end outside it: so the sets outside are compared with all
    (Sutton, Ben-Nun and Barak, 2018). Whatever the first step finds, nothing is lost.
    """
    found = lambda some=None: frames.links(some).filter(F.col("share") >= least).select("a", "b").distinct()
    one_of = -(-frames.meets // max(1, frames.n * FIRST))
    if one_of <= 2:
        return found()
    ids, _, _ = written(frames.homes.select("id").distinct())
    first, _, seen = written(components(found(ids.filter(F.pmod(F.xxhash64("id"), F.lit(one_of)) == 0)), "a", "b"), F.count(F.lit(1)).alias("n"))
    if not seen["n"]:
        return found()
    largest = first.groupBy("component").count().orderBy(F.desc("count"), "component").first().component
    rest, _, _ = written(ids.join(first.filter(F.col("component") == largest), ids.id == first.node, "left_anti"))
    return found(rest).unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b")))


def video_clusters(files: DataFrame, most: int, least: float = FRAME_MATCH) -> DataFrame:
    """(node, component) of the videos that are linked with another, directly or through others.

    Videos of the same frames, in any order, are one node, so copies are not paired with each other.
    """
    rows = files.filter(F.size("frame_hashes") > 0).select("file_id", F.array_sort("frame_hashes").alias("frames"))
    # Copies are linked unless too many of their frames are null.
    alike = F.when(F.size(F.filter("frames", lambda h: h.isNotNull())) / F.size("frames") >= least, F.lit(None)).otherwise(F.col("file_id"))
    kept, _, _ = written(rows.withColumn("apart", alike))
    sets, _, _ = written(kept.groupBy("frames", "apart").agg(F.min("file_id").alias("id"), F.max("file_id").alias("high"), F.count(F.lit(1)).alias("n")))
    links = _linked(_frames(sets.select("id", "high", "frames"), most, least), least)
    found = components(links.unionByName(sets.filter("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))), "a", "b")
    named, _, _ = written(sets.join(found, sets.id == found.node).select("frames", "apart", "component"))
    same = kept["frames"].eqNullSafe(named["frames"]) & kept["apart"].eqNullSafe(named["apart"])
    return kept.join(named, same).select(F.col("file_id").alias("node"), "component")


def detect_videos(files: DataFrame, most: int, least: float = FRAME_MATCH) -> tuple[DataFrame, DataFrame]:
    """Members, largest first; similarity is the share asked for, the signature names the number of members."""
    rows = files.filter(F.size("frame_hashes") > 0).select("file_id", "length")
    found = cut(video_clusters(files, most, least))
    key = F.concat(F.lit("video:"), F.col("component").cast("string"))
    joined = rows.join(found, rows.file_id == found.node)
    members = placed(joined.select(key.alias("group_key"), "length", "file_id"), F.desc("length"), F.asc("file_id"))
    reasons = found.groupBy("component").count().select(key.alias("group_key"), F.lit("PerceptualVideo").alias("method"), F.lit(least).alias("similarity"), F.concat(F.lit("video:"), F.col("count").cast("string")).alias("signature"))
    return members, reasons
