"""Line dedup over levelled sorted runs of line hashes.

A store keeps runs: tables of line hashes, bucketed and sorted by hash, no hash in two of them. Each new batch is summed by
hash and merge-anti-joined with every run; what none knows is the batch's own run, what one knows goes to a log of repeats.
When a level has as many runs as the fan-out, they are merged into one of the next level, so there are few runs
whatever the number of batches. Tables of equal buckets are merged without being shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from twinfold.common import remove, scratch, ship, written
from twinfold.llm.bpe import slices
from twinfold.llm.memory import tidy

#: A line counts from this many code points on, and is dropped when this many documents hold it.
LEAST, OFTEN = 40, 5
#: Batches that a whole table is dealt to, and runs of a level that are merged into one of the next.
BATCHES, FANOUT = 4, 3
#: Hashes that are sent to all executors, of 24 bytes each; more are joined by a shuffle.
BROADCAST = 500_000
SPACE = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def lines_of(texts: pa.Array) -> pa.ListArray:
    """Lines of each text; a null or empty text is one empty line."""
    return pc.split_pattern(pc.fill_null(texts, ""), "\n")


def line_keys(lines: pa.Array) -> pa.Array:
    """Lines without white space at both ends, A-Z lower-cased."""
    return pc.ascii_lower(pc.ascii_trim(lines, SPACE))


def _digests(lines: pa.Array, least: int) -> list[bytes | None]:
    """128 bits of hash of each line's key; None where it is shorter than ``least`` code points."""
    keys = line_keys(lines)
    long = pc.greater_equal(pc.utf8_length(keys), least)
    return [xxhash.xxh3_128_digest(k.as_buffer()) if x else None for k, x in zip(keys, long.to_pylist(), strict=True)]


def _halves(digests: list[bytes]) -> list[pa.Array]:
    return [pa.array([int.from_bytes(d[a : a + 8], "big", signed=True) for d in digests], pa.int64()) for a in (0, 8)]


def line_hashes(df: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """(key, mark, h1, h2): the distinct line hashes of each row; ``mark`` is a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                lines = lines_of(part.column(text))
                found, ends = _digests(lines.flatten(), least), lines.offsets.to_pylist()
                rows = [(r, d) for r, (a, b) in enumerate(zip(ends, ends[1:])) for d in dict.fromkeys(found[a - ends[0] : b - ends[0]]) if d]
                at = pa.array([r for r, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(key).take(at), part.column("mark").take(at), *_halves([d for _, d in rows])], names=[key, "mark", *HASH])

    schema = T.StructType([df.schema[key], *(T.StructField(c, T.LongType()) for c in ("mark", *HASH))])
    return df.select(key, text, _mark(text).alias("mark")).mapInArrow(tidy(run), schema)


def _mark(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class Runs:
    """Levelled sorted runs of (h1, h2, n, last): of each line hash, rows that hold it and the greatest key among them.

    Batches whose keys descend leave in ``last`` the greatest key of all, since a hash stands in the run of the first batch
    that holds it; repeats add to ``n`` only. Batches must not share a row.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, max(2, fanout)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = [[]]
        self.repeats: list[DataFrame] = []

    def _saved(self, df: DataFrame) -> tuple[str, str]:
        """A table sorted within buckets of hashes: its name and path."""
        name, path = f"line_run_{uuid4().hex}", f"{scratch(self.spark, 'run')}/rows"
        df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        return name, path

    def _gone(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, path)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, lines: DataFrame, key: str) -> DataFrame:
        """Takes in the (key, h1, h2) of a batch; returns (h1, h2, n, last) of those hashes that no batch before held."""
        summed = self._saved(lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("last")))
        new = batch = self.spark.table(summed[0])
        for run in self.runs():
            new = new.join(run.hint("merge"), HASH, "left_anti")
        own = self._saved(new)
        fresh = self.spark.table(own[0])
        if any(self.levels):
            self.repeats.append(written(batch.join(fresh.hint("merge"), HASH, "left_anti").select(*HASH, "n"))[0])
        self._gone(*summed)
        self.levels[0].append(own)
        self._compact()
        return fresh

    def _compact(self) -> None:
        """Merges the runs of each full level into one of the next; they share no hash, so nothing is added up."""
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            merged = self.spark.table(level[0][0])
            for name, _ in level[1:]:
                merged = merged.unionByName(self.spark.table(name))
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._saved(merged.repartition(self.buckets, *HASH)))
            for run in level:
                self._gone(*run)
            self.levels[k] = []

    def held_often(self, often: int) -> DataFrame:
        """(h1, h2, last) of hashes that ``often`` rows or more hold."""
        repeats, runs = self.repeats, self.runs()
        if not runs:
            raise ValueError("no batch was added")
        known = runs[0]
        for run in runs[1:]:
            known = known.unionByName(run)
        if not repeats:
            return known.filter(F.col("n") >= often).select(*HASH, "last")
        more = repeats[0]
        for rows in repeats[1:]:
            more = more.unionByName(rows)
        more = more.groupBy(*HASH).agg(F.sum("n").alias("more"))
        return known.join(more, HASH, "left").filter(F.col("n") + F.coalesce("more", F.lit(0)) >= often).select(*HASH, "last")

    def close(self) -> None:
        """Deletes every run."""
        for level in self.levels:
            for run in level:
                self._gone(*run)
        self.levels = [[]]


def _descending(lines: DataFrame, key: str, batches: int) -> list[DataFrame]:
    """The rows in batches of descending keys, of about one size; null keys are in the last."""
    cuts = lines.select(F.percentile_approx(key, [k / batches for k in range(1, batches)], F.lit(10_000))).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    c, out, above = F.col(key), [], F.lit(True)
    for x in cuts:
        out.append(lines.filter(above & (c > x)))
        above = c <= x
    return [*out, lines.filter(c.isNull() | above)]


def drop_repeated(df: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, often: int = OFTEN, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(key, n_lines, n_dropped, kept) of every row of ``df``; keys are integers.

    A line whose key (stripped of ASCII white space, A-Z lower-cased) has ``least`` code points or more and stands in ``often`` rows or
    more is dropped, all its places, from every row but those of the greatest key that holds it. The others stay, joined
    by line feeds. A null or empty text is one empty line. Rows of a repeated key count one by one, and keep their
    lines together; a null key is less than any other. An empty table gives no rows; other columns do not matter.
    """
    spark = ship(df.sparkSession)
    lines, path, _ = written(line_hashes(df, text, key, least))
    store = Runs(spark, fanout)
    for batch in _descending(lines, key, batches):
        store.add(batch, key)
    marks, _, seen = written(store.held_often(often), F.count(F.lit(1)).alias("n"))
    store.close()
    few = F.broadcast(marks) if seen["n"] <= BROADCAST else marks
    told = lines.join(few, HASH).filter(~F.col(key).eqNullSafe(F.col("last")))
    # Of a row, no more hashes than it has lines.
    told = told.groupBy(key, "mark").agg(F.collect_set(F.struct(*HASH)).alias("__gone"))
    gone, _, seen = written(told.select(F.col(key).alias("__key"), F.col("mark").alias("__mark"), "__gone"), F.coalesce(F.sum(F.size("__gone") + 2), F.lit(0)).alias("n"))
    remove(spark, path)
    docs = df.select(F.col(key), F.col(text), _mark(text).alias("mark"))
    few = F.broadcast(gone) if seen["n"] <= BROADCAST else gone
    joined = docs.join(few, F.col(key).eqNullSafe(F.col("__key")) & (F.col("mark") == F.col("__mark")), "left").select(key, text, "__gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                counts, dropped, kept = [], [], []
                for t, drops in zip(lines_of(part.column(text)), part.column("__gone").to_pylist(), strict=True):
                    rows = t.values
                    counts.append(len(rows))
                    if not drops:
                        dropped.append(0)
                        kept.append(None)
                        continue
                    out = {d["h1"].to_bytes(8, "big", signed=True) + d["h2"].to_bytes(8, "big", signed=True) for d in drops}
                    stay = [x for x, d in zip(rows.to_pylist(), _digests(rows, least), strict=True) if d not in out]
                    dropped.append(len(rows) - len(stay))
                    kept.append("\n".join(stay))
                whole = pc.fill_null(part.column(text), "")
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pc.coalesce(pa.array(kept, pa.string()), whole)], names=[key, "n_lines", "n_dropped", "kept"])

    schema = T.StructType([df.schema[key], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(tidy(run), schema)
