"""Name duplicates: distinct normalised names, joined by a block and what is left of short ones without some letters, or by lengths that can match and a piece in common, then closed."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from twinfold.common import cut, spread
from twinfold.functions.names import normalize, ratio, stem
from twinfold.operators.components import components
from twinfold.operators.positions import placed

#: Keeps rounding from losing a pair at the bound.
SLACK = 1e-9
#: Letters that a piece of a name has at least.
PIECE = 3
#: Strings that are left of a short name, at most, when as many letters go as it may differ by.
REST = 256


def normalized(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Files with their normalised name; those of which nothing is left go."""
    return files.withColumn("normalized_name", normalize(stem(F.col(name)))).filter("normalized_name <> ''")


def distinct_names(rows: DataFrame) -> DataFrame:
    """(name_id, name): equal names are one node, known by its least file."""
    return rows.groupBy(F.col("normalized_name").alias("name")).agg(F.min("file_id").alias("name_id"))


def _edits(n: Column, threshold: float) -> Column:
    """Edits that a pair whose longer name has ``n`` letters may differ by."""
    return F.floor(n * (1 - threshold) + SLACK).cast("int")


def _pieces(least: Column, edits: Column) -> Column:
    """Into how many pieces a name of ``least`` letters is cut: one more than edits, or one empty piece where they would be too short to tell much."""
    return F.when(least >= PIECE * (edits + 1), edits + 1).otherwise(1)


def _short(threshold: float) -> tuple[int, int]:
    """Letters of the longest name that leaves no more than ``REST`` strings, and of no shorter one more; and its edits."""
    edits = lambda n: int(n * (1 - threshold) + SLACK)
    n = 0
    while n < REST and sum(comb(n + 1, k) for k in range(edits(n + 1) + 1)) <= REST:
        n += 1
    return n, edits(n)


def _left(name: Column, edits: Column, most: int) -> Column:
    """What is left of a name without any ``edits`` letters or fewer, each string once; ``most`` is the greatest number of edits."""
    fewer = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))).otherwise(F.array().cast("array<string>"))
    last = out = F.array(name)
    for k in range(1, most + 1):
        last = F.when(edits >= k, F.array_distinct(F.flatten(F.transform(last, fewer)))).otherwise(F.array().cast("array<string>"))
        out = F.concat(out, last)
    return out


def _short_met(given: DataFrame, threshold: float, most: int) -> DataFrame:
    """(ia, ib, na, nb): names of at most ``most`` letters that have the same left without some letters.

    Two names of d edits are alike once each loses those of its letters that are changed or dropped. The longer loses d at most, the shorter fewer by
    the difference of their lengths, which is no more than what its own length allows; so each is dealt by its own edits. However many names begin or end
    alike, only those that are near in all their letters meet.
    """
    rows = spread(given.filter(F.col("n") <= most)).withColumn("left", F.explode(_left(F.col("name"), _edits(F.col("n"), threshold), _short(threshold)[1])))
    a, b = (rows.select(F.col("name_id").alias(f"i{x}"), F.col("name").alias(f"n{x}"), "block", "left") for x in "ab")
    return a.join(b, ["block", "left"]).filter("ia < ib").select("ia", "ib", "na", "nb")


def candidates(names: DataFrame, threshold: float) -> DataFrame:
    """(ia, ib, na, nb): names with one first character that may have a ratio of the threshold or more; a pair may meet in several ways.

    Pairs of short names meet in what is left of them without some letters. Where the longer is not short: if two names differ by at most d
    edits and the shorter is cut into d + 1 pieces, one of them stands in the longer as
    it is, k places at most from its own where it is the k-th, and so many from the end likewise (Li, Deng, Wang and
    Feng, 2011). So block, length, d, piece and its letters are an equality that both sides are dealt by, and it loses no pair.
    """
    n, d, m, k = F.length("name"), F.col("d"), F.col("len"), F.col("k")
    block = F.substring("name", 1, 1)
    start = lambda j: F.floor(j * m / (d + 1)).cast("int")
    size = F.when(m >= PIECE * (d + 1), start(k + 1) - start(k)).otherwise(0)
    given = names.select("name_id", "name", block.alias("block"), n.alias("n"))
    most = _short(threshold)[0]
    short = given.select("name_id", "name", "block", F.col("n").alias("len"), F.explode(F.sequence(_edits(F.col("n"), threshold), _edits(F.floor(F.col("n") / threshold + SLACK), threshold))).alias("d"))
    short = short.withColumn("k", F.explode(F.sequence(F.lit(0), _pieces(m, d) - 1)))
    b = short.withColumns({"s": start(k), "z": size}).select(F.col("name_id").alias("ib"), F.col("name").alias("nb"), "block", "len", "d", "k", F.expr("substring(name, s + 1, z)").alias("piece"))
    long = given.filter(F.col("n") > most).withColumn("d", _edits(F.col("n"), threshold)).withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - d), F.col("n")))).withColumn("k", F.explode(F.sequence(F.lit(0), _pieces(m, d) - 1)))
    long = long.withColumns({"s": start(k), "z": size})
    more = F.col("n") - m
    low, high = F.greatest(-k, more - (d - k), -F.col("s")), F.least(k, more + (d - k), F.col("n") - F.col("z") - F.col("s"))
    shifts = F.when(F.col("z") == 0, F.array(F.lit(0))).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    a = long.withColumn("t", F.explode(shifts)).select(F.col("name_id").alias("ia"), F.col("name").alias("na"), "block", "len", "d", "k", F.expr("substring(name, s + t + 1, z)").alias("piece"))
    met = a.join(b, ["block", "len", "d", "k", "piece"]).filter((F.length("na") > F.length("nb")) | (F.col("ia") < F.col("ib"))).select("ia", "ib", "na", "nb")
    return met.unionByName(_short_met(given, threshold, most))


def pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ratio) of names with one first character and a ratio of the threshold or more."""
    scored = candidates(names, threshold).withColumn("ratio", ratio(F.col("na"), F.col("nb"))).filter(F.col("ratio") >= threshold)
    return scored.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "ratio").distinct()


def clusters(files: DataFrame, threshold: float, name: str = "file_name") -> DataFrame:
    """(group_id, file_id, file_name, normalized_name) of files in clusters of two or more."""
    rows = cut(normalized(files, name).select("file_id", F.col(name).alias("file_name"), "normalized_name"))
    names = cut(distinct_names(rows))
    found = components(pairs(names, threshold), "a", "b")
    rooted = names.join(found, names.name_id == found.node, "left").select(F.col("name").alias("normalized_name"), F.coalesce("component", "name_id").alias("root"))
    joined = rows.join(rooted, "normalized_name")
    sizes = joined.groupBy("root").agg(F.count("*").alias("n"), F.min("file_id").alias("group_id")).filter("n > 1")
    return joined.join(sizes.select("root", "group_id"), "root").select("group_id", "file_id", "file_name", "normalized_name")


def detect(files: DataFrame, threshold: float, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Members by file name, binary order by default; similarity is the mean ratio of the others to the first."""
    rows = cut(clusters(files, threshold))
    by = order if order is not None else F.col("file_name")
    first = rows.groupBy("group_id").agg(F.min(F.struct(by.alias("o"), "file_id", "normalized_name")).alias("f")).select("group_id", F.col("f.file_id").alias("rep"), F.col("f.normalized_name").alias("rep_name"))
    key = F.concat(F.lit("name:"), F.col("group_id").cast("string"))
    members = placed(rows.select(key.alias("group_key"), by.alias("by"), "file_id"), F.asc("by"), F.asc("file_id"))
    compared = rows.join(first, "group_id").groupBy("group_id", "rep_name").agg(F.avg(F.when(F.col("file_id") != F.col("rep"), ratio(F.col("normalized_name"), F.col("rep_name")))).alias("similarity"))
    reasons = compared.select(key.alias("group_key"), F.lit("NameSimilarity").alias("method"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "similarity")).alias("similarity"), F.col("rep_name").alias("signature"))
    return members, reasons
