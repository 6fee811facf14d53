"""Lengths of videos from their containers' headers: ISO media (MP4, MOV, M4V, 3GP), Matroska (MKV, WebM) and AVI.

Only headers are read: a box or element that isn't looked into is stepped over, whatever its size, so a video of many
gigabytes costs some short reads, by path or by URI. A length that can't be told (another format, a broken or a live
stream's header, an empty file, none at all) is 0.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from twinfold.common import ship
from twinfold.functions.media import is_video
from twinfold.sources.store import opened

#: Matroska's element identifiers, and nanoseconds a tick where a file gives none.
EBML, SEGMENT, INFO, SCALE, LENGTH, TICK = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 1_000_000
#: Boxes or elements stepped over on one level, at most: a header that has more before it isn't one a writer makes.
STEPS = 100_000


def _at(f: BinaryIO, place: int, n: int) -> bytes:
    f.seek(place)
    return f.read(n)


def _boxes(f: BinaryIO, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of what it holds) of the ISO boxes between two places."""
    for _ in range(STEPS):
        head = _at(f, start, 16)
        if start + 8 > end or len(head) < 8:
            return
        size, kind, body = int.from_bytes(head[:4], "big"), head[4:8], start + 8
        if size == 1 and len(head) == 16:
            size, body = int.from_bytes(head[8:], "big"), start + 16
        stop = end if size == 0 else start + size
        if stop < body:
            return
        yield kind, body, min(stop, end)
        start = stop


def _counted(data: bytes) -> tuple[int, int] | None:
    """(ticks a second, ticks) of a header whose version says how wide its numbers are; none where ticks aren't known."""
    form, at = ("I", 12) if data[:1] == b"\0" else ("Q", 20)
    scale, ticks = struct.unpack_from(f">I{form}", data, at)
    return (scale, ticks) if scale and ticks != (1 << 8 * struct.calcsize(form)) - 1 else None


def _iso(f: BinaryIO, end: int) -> float:
    for kind, a, b in _boxes(f, 0, end):
        if kind == b"moov":
            inner = {k: (x, y) for k, x, y in _boxes(f, a, b)}
            scale, ticks = _counted(_at(f, inner[b"mvhd"][0], 32)) or (0, 0)
            if scale and not ticks and b"mvex" in inner:  # the fragments' length stands apart
                for k, x, _ in _boxes(f, *inner[b"mvex"]):
                    if k == b"mehd":
                        data = _at(f, x, 12)
                        ticks = int.from_bytes(data[4 : 8 if data[0] == 0 else 12], "big")
            return ticks / scale if scale else 0.0
    return 0.0


def _number(f: BinaryIO, place: int, marked: bool) -> tuple[int, int, bool]:
    """A Matroska number of varying width, with its mark or without; the place behind it; whether all its bits are set."""
    data = _at(f, place, 8)
    n = 9 - data[0].bit_length()
    value = int.from_bytes(data[:n], "big")
    bare = value & ((1 << 7 * n) - 1)
    return (value if marked else bare), place + n, bare == (1 << 7 * n) - 1


def _elements(f: BinaryIO, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(identifier, start and end of what it holds); one of unknown size ends where its parent does."""
    for _ in range(STEPS):
        if start >= end:
            return
        name, at, _ = _number(f, start, True)
        size, body, unknown = _number(f, at, False)
        stop = end if unknown else body + size
        yield name, body, min(stop, end)
        start = stop


def _matroska(f: BinaryIO, end: int) -> float:
    for name, a, b in _elements(f, 0, end):
        if name == SEGMENT:
            for part, x, y in _elements(f, a, b):
                if part == INFO:
                    held = {k: _at(f, p, q - p) for k, p, q in _elements(f, x, y) if k in (SCALE, LENGTH) and q - p <= 8}
                    if len(raw := held.get(LENGTH, b"")) in (4, 8):
                        return struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0] * (int.from_bytes(held[SCALE], "big") if SCALE in held else TICK) / 1e9
                    return 0.0
    return 0.0


def _avi(f: BinaryIO) -> float:
    head = _at(f, 12, 64)
    if head[:4] != b"LIST" or head[8:16] != b"hdrlavih":
        return 0.0
    micros, frames = struct.unpack_from("<I", head, 20)[0], struct.unpack_from("<I", head, 36)[0]
    return micros * frames / 1e6


def duration(path: str) -> float:
    """Seconds that a video's header gives; 0 where it can't be told."""
    try:
        with opened(path) as f:
            end = f.seek(0, os.SEEK_END)
            head = _at(f, 0, 12)
            if head[:4] == EBML.to_bytes(4, "big"):
                found = _matroska(f, end)
            elif head[:4] == b"RIFF" and head[8:] == b"AVI ":
                found = _avi(f)
            else:
                found = _iso(f, end)
        return found if math.isfinite(found) and found > 0 else 0.0
    except (OSError, struct.error, KeyError, IndexError, OverflowError, ValueError):
        return 0.0


def durations(files: DataFrame, path: Column | None = None) -> DataFrame:
    """Video files with ``duration``, the seconds that their headers give; null where it can't be told. One task reads only its own files."""
    ship(files.sparkSession)
    seconds = F.pandas_udf(lambda paths: paths.map(duration), DoubleType())
    videos = files.filter(is_video(F.col("extension")))
    return videos.withColumn("duration", F.nullif(seconds(F.col("full_path") if path is None else path), F.lit(0.0)))
