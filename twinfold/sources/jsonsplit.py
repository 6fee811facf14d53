"""The elements of one array in one large JSON document, cut out by many tasks.

The document is looked at in ranges of bytes. What a range means depends on whether it begins inside a string, and how deep: so each task
first says, for either beginning, whether its range ends inside a string, by how much it goes deeper, and where arrays stand that
may be the one asked for. From these few numbers the driver knows how every range begins, and each task then cuts
out the elements that begin in its own range, reading on to the end of the last. No task holds more than a range and an element.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinfold.common import files_below, ship
from twinfold.sources import store

#: Bytes of a range.
RANGE = 16 << 20
#: Bytes before an array in which its name stands.
NAME = 1024
QUOTE, SLASH = ord('"'), ord("\\")


def _read(path: str, at: int, n: int) -> bytes:
    with store.opened(path) as f:
        f.seek(at)
        return f.read(n)


def _escaped(b: np.ndarray, first: bool) -> np.ndarray:
    """Which bytes follow an odd run of backslashes; ``first`` says it of the first byte."""
    slash = b == SLASH
    if first and len(b):
        slash[0] = False
    index = np.arange(len(b))
    # Of each byte, the last place before it that is no backslash.
    plain = np.maximum.accumulate(np.where(slash, -1, index))
    run = np.where(slash, index - plain, 0)
    out = np.zeros(len(b), bool)
    out[1:] = run[:-1] % 2 == 1
    if len(b):
        out[0] = first
    return out


def _depths(b: np.ndarray, escaped: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte, whether it lies in a string, its sign (1 opens, -1 closes), and the depth after it."""
    quotes = (b == QUOTE) & ~escaped
    string = ((np.cumsum(quotes) + inside) % 2 == 1) | quotes
    opens, closes = (b == ord("{")) | (b == ord("[")), (b == ord("}")) | (b == ord("]"))
    sign = np.where(string, 0, opens.astype(np.int8) - closes.astype(np.int8))
    return string, sign, depth + np.cumsum(sign)


def _told(data: bytes, first: bool) -> list[tuple[bool, int, list[int], list[int]]]:
    """For a beginning outside and inside a string: whether the range ends inside one, the change of depth, and where arrays open and close, with the relative depth after it."""
    b = np.frombuffer(data, np.uint8)
    escaped, out = _escaped(b, first), []
    for inside in (False, True):
        quotes = int(((b == QUOTE) & ~escaped).sum())
        _, sign, depth = _depths(b, escaped, inside, 0)
        # Arrays right below the root open and close where the depth is as low as it gets in this range, or one more.
        array = ((sign > 0) & (b == ord("["))) | ((sign < 0) & (b == ord("]")))
        arrays = np.flatnonzero(array & (depth - (sign > 0) <= depth.min(initial=0) + 1))
        out.append(((quotes + inside) % 2 == 1, int(depth[-1]) if len(b) else 0, arrays.tolist(), depth[arrays].tolist() if len(b) else []))
    return out


def _slashes_before(path: str, at: int) -> bool:
    """Whether the byte at a place follows an odd run of backslashes."""
    n, step = 0, 64
    while at - n > 0:
        got = _read(path, max(0, at - n - step), min(step, at - n))
        kept = len(got) - len(got.rstrip(b"\\"))
        n += kept
        if kept < len(got):
            break
    return n % 2 == 1


def _elements(path: str, at: int, end: int, first: bool, inside: bool, depth: int, start: int, size: int) -> Iterator[tuple[int, str]]:
    """Objects right below the array that opens at ``start``, which begin between ``at`` and ``end``, with their places."""
    here, opened, held = at, None, []
    while here < size:
        data = _read(path, here, min(RANGE, (end - here) if here < end else RANGE, size - here))
        b = np.frombuffer(data, np.uint8)
        _, sign, after = _depths(b, _escaped(b, first), inside, depth)
        for k in np.flatnonzero(sign).tolist():
            place = here + k
            if sign[k] > 0 and after[k] == 3 and place > start and b[k] == ord("{") and opened is None:
                if place >= end:
                    return
                opened = place
            elif sign[k] < 0 and after[k] == 2 and opened is not None:
                yield opened, (b"".join(held) + data[max(0, opened - here) : k + 1]).decode()
                opened, held = None, []
            elif sign[k] < 0 and after[k] < 2 and place > start:
                return
        if opened is not None:
            held.append(data[max(0, opened - here) :])
        elif here + len(data) >= end:
            return
        quotes = int(((b == QUOTE) & ~_escaped(b, first)).sum())
        inside, depth = (quotes + inside) % 2 == 1, int(after[-1])
        here += len(data)
        first = _slashes_before(path, here)


def elements(spark: SparkSession, path: str, name: str, size: int = 0) -> DataFrame:
    """(at, json): the objects of the array that the root object of the document at ``path`` has under ``name``, with their places in bytes.

    None where there is no such array; text after the root object does not matter. ``size`` bytes make a range.
    """
    ship(spark)
    size, range_ = sum(n for _, n, _ in files_below(spark, path if store.URI.match(path) else f"file:{path}")), size or RANGE
    ranges = spark.range(0, max(1, -(-size // range_)), 1, max(1, -(-size // range_)))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                told = _told(_read(path, k * range_, range_), _slashes_before(path, k * range_))
                yield pa.RecordBatch.from_arrays([pa.array([k] * 2, pa.int64()), *(pa.array([t[c] for t in told], kind) for c, kind in enumerate((pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))))], names=["k", "inside", "depth", "places", "depths"])

    told: dict[int, list] = {}
    for r in ranges.mapInArrow(tell, "k long, inside boolean, depth long, places array<long>, depths array<long>").collect():
        told.setdefault(r.k, []).append(r)
    begins, inside, depth, start, stop = [], False, 0, None, None
    for k in sorted(told):
        begins.append((k, inside, depth))
        r = told[k][int(inside)]
        start, stop = _bounds(path, [(k * range_ + p, depth + d) for p, d in zip(r.places, r.depths, strict=True)], name, start, stop)
        inside, depth = r.inside, depth + r.depth
    known = spark.createDataFrame([(k, i, d, start) for k, i, d in begins if start is not None and start < (k + 1) * range_ and (stop is None or k * range_ < stop)], "k long, inside boolean, depth long, start long")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = r["k"] * range_
                for place, text in _elements(path, at, min(size, at + range_), _slashes_before(path, at), r["inside"], r["depth"], r["start"], size):
                    yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([text], pa.string())], names=["at", "json"])

    return known.repartition(max(1, len(begins)), F.col("k")).mapInArrow(cut_out, "at long, json string")


def _bounds(path: str, places: list[tuple[int, int]], name: str, start: int | None, stop: int | None) -> tuple[int | None, int | None]:
    """Where the array opens and closes, as far as it is known, after some more places with the depth after them."""
    for place, depth in places:
        if start is None and depth == 2 and _named(path, place, name):
            start = place
        elif start is not None and stop is None and depth == 1:
            stop = place
    return start, stop


def _named(path: str, at: int, name: str) -> bool:
    """Whether the array that opens at a place is the value of that name."""
    before = _read(path, max(0, at - NAME), min(NAME, at))
    found = re.search(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', before, re.S)
    return bool(found) and json.loads(found[1]) == name
