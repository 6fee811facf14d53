"""Places of rows within their groups, and running sums there, without a task that holds a group.

Rows are dealt to range partitions by group and order, so a large group spreads over many of them. Each
partition numbers its rows as it passes them on; what a group has in the partitions before is added
from one row a partition, which is all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from twinfold.common import ship, written

#: Helper columns: the group as text; partition, number of the group in it, place in the group's stretch there, and sum of weights up to here.
GROUP, PART, NTH, AT, SUM = "__group", "__part", "__nth", "__at", "__sum"
OWN = T.StructType([T.StructField(PART, T.IntegerType()), *(T.StructField(c, T.LongType()) for c in (NTH, AT, SUM))])
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _stretches(weight: str | None) -> Run:
    """Numbers rows, sorted by group, within the stretch of their group that lies in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, rows, total = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group = batch.column(GROUP)
            new = np.ones(n, bool)
            new[0] = not seen or group[0].as_py() != last
            if n > 1:
                new[1:] = pc.not_equal(group.slice(1), group.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            index = np.arange(n)
            first = np.maximum.accumulate(np.where(new, index, -1))
            at = np.where(first < 0, index + rows, index - first)
            weights = np.ones(n, np.int64) if weight is None else pc.fill_null(batch.column(weight), 0).to_numpy()
            before = np.concatenate([[0], np.cumsum(weights)])
            sums = before[1:] - np.where(first < 0, -total, before[np.maximum(first, 0)])
            nth = seen + np.cumsum(new)
            last, seen, rows, total = group[n - 1].as_py(), int(nth[-1]), int(at[-1]) + 1, int(sums[-1])
            kept = [k for k, name in enumerate(batch.schema.names) if name != GROUP]
            made = [pa.array(np.full(n, part), pa.int32()), *(pa.array(x, pa.int64()) for x in (nth, at, sums))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *made], names=[*(batch.schema.names[k] for k in kept), *OWN.names])

    return run


def _carried(parts: list) -> list[tuple[int, int, int]]:
    """Of each partition, how many rows its first group has in the partitions before, and their sum; those without any are left out."""
    out, group, rows, total = [], None, 0, 0
    for p in sorted(parts, key=lambda r: r[PART]):
        same = group == (p.first_a, p.first_b)
        if same:
            out.append((p[PART], rows, total))
        # The last group goes on from before only where it is also the first.
        on = same and p.groups == 1
        rows, total = p.last_rows + (rows if on else 0), p.last_sum + (total if on else 0)
        group = (p.last_a, p.last_b)
    return out


def numbered_within(rows: DataFrame, by: list[str], order: list[Column], name: str = "pos", running: tuple[str, str] | None = None) -> DataFrame:
    """``rows`` with their place, from 0, among those of equal ``by`` in an order without ties.

    ``running`` names a column of longs and a new one for its sum up to and with the row, nulls as 0. Nulls of ``by`` are a group of
    their own. Rows that tie in the whole order stand in any order, and all together in one partition. The result is a
    written table with a broadcast of one row a partition; an empty table stays empty.
    """
    spark = ship(rows.sparkSession)
    weight, sum_ = running or (None, None)
    given = rows.withColumn(GROUP, F.to_json(F.struct(*by)))
    sort = [F.asc(c) for c in by] + order
    dealt = given.repartitionByRange(*sort).sortWithinPartitions(*sort)
    table, _, _ = written(dealt.mapInArrow(_stretches(weight), T.StructType([*rows.schema.fields, *OWN.fields])))
    h = [F.xxhash64(F.lit(seed), *by) for seed in (1, 2)]
    place = F.shiftleft(NTH, 32) + F.col(AT)
    ends = [f(x, place).alias(f"{n}_{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c, x in zip("ab", h, strict=True)]
    parts = table.groupBy(PART).agg(*ends, F.max(NTH).alias("groups"), (F.max(place).bitwiseAND((1 << 32) - 1) + 1).alias("last_rows"), F.max_by(SUM, place).alias("last_sum")).collect()
    carried = spark.createDataFrame(_carried(parts) or [(-1, 0, 0)], f"{PART} int, __rows long, __total long")
    more = lambda c: F.when(F.col(NTH) == 1, F.coalesce(c, F.lit(0))).otherwise(0)
    out = table.join(F.broadcast(carried), PART, "left").withColumn(name, F.col(AT) + more("__rows"))
    if sum_:
        out = out.withColumn(sum_, F.col(SUM) + more("__total"))
    return out.drop(*OWN.names, "__rows", "__total")


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """(group_key, pos, file_id): members of groups by their place."""
    return numbered_within(rows, ["group_key"], [*order]).select("group_key", F.col("pos").cast("int").alias("pos"), "file_id")
