"""Frames of videos through an extractor that can be replaced; the default one calls ffmpeg where it is installed."""

from __future__ import annotations

import hashlib
import shutil
import subprocess
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from twinfold.common import ship
from twinfold.functions.media import is_video
from twinfold.options import ScanOptions
from twinfold.sources import containers
from twinfold.sources.images import LUMA, shrink

PNG = b"\x89PNG\r\n\x1a\n"


class FrameExtractor(Protocol):
    def duration(self, path: str) -> float: ...

    def frame(self, path: str, second: float) -> bytes | None: ...


def split_png(stream: bytes) -> list[bytes]:
    """Images of a stream in which each begins with its signature; what stands before the first is dropped."""
    return [PNG + part for part in stream.split(PNG)[1:]]


def find_tool(name: str, explicit: str = "") -> str | None:
    """The path of a tool that answers a version request."""
    path = explicit or shutil.which(name)
    if not path:
        return None
    try:
        ok = subprocess.run([path, "-version"], capture_output=True, timeout=3).returncode == 0
    except (OSError, subprocess.TimeoutExpired):
        return None
    return path if ok else None


class Ffmpeg:
    """One thread per call; any failure is no frame."""

    def __init__(self, ffmpeg: str = "", ffprobe: str = ""):
        self.ffmpeg, self.ffprobe = find_tool("ffmpeg", ffmpeg), find_tool("ffprobe", ffprobe)

    def _out(self, args: list[str]) -> bytes:
        try:
            return subprocess.run(args, capture_output=True, timeout=120).stdout
        except (OSError, subprocess.TimeoutExpired):
            return b""

    def duration(self, path: str) -> float:
        """As the probe says; without it, or where it can't tell, as the file's own header says."""
        out = self._out([self.ffprobe, "-v", "error", "-show_entries", "format=duration", "-of", "csv=p=0", path]) if self.ffprobe else b""
        try:
            return max(0.0, float(out)) or containers.duration(path)
        except ValueError:
            return containers.duration(path)

    def frame(self, path: str, second: float) -> bytes | None:
        if not self.ffmpeg:
            return None
        return next(iter(split_png(self._out([self.ffmpeg, "-v", "error", "-threads", "1", "-ss", f"{second:.3f}", "-i", path, "-frames:v", "1", "-vf", "scale=160:-2", "-f", "image2pipe", "-c:v", "png", "-"]))), None)

    def every(self, path: str, seconds: int, most: int) -> list[bytes]:
        """Frames at even steps, for a video whose length can't be told."""
        return split_png(self._out([self.ffmpeg, "-v", "error", "-threads", "1", "-i", path, "-vf", f"fps=1/{seconds},scale=160:-2", "-frames:v", str(most), "-f", "image2pipe", "-c:v", "png", "-"])) if self.ffmpeg else []


def decode_png(data: bytes) -> np.ndarray | None:
    """Luma levels of an 8-bit, non-interlaced PNG; null for anything else."""
    try:
        if not data.startswith(PNG):
            return None
        at, head, packed = len(PNG), None, []
        while at + 8 <= len(data):
            size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), *body[8:13])
            elif kind == b"IDAT":
                packed.append(body)
            elif kind == b"IEND":
                break
            at += 12 + size
        width, height, depth, colour, _, _, interlaced = head
        channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
        if depth != 8 or interlaced or channels is None:
            return None
        rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
        out = np.zeros((height, width, channels), np.int64)
        above = np.zeros((width, channels), np.int64)
        for y in range(height):
            above = out[y] = _unfilter(int(rows[y, 0]), rows[y, 1:].astype(np.int64).reshape(width, channels), above)
        a = out.astype(np.float64)
        return a[..., 0] if channels < 3 else np.rint(a[..., 0] * LUMA[0] + a[..., 1] * LUMA[1] + a[..., 2] * LUMA[2])
    except (ValueError, TypeError, zlib.error, IndexError):
        return None


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A scan line as it was before its filter; ``row`` and ``above`` have a line for each pixel."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, axis=0) % 256
    if kind == 2:
        return (row + above) % 256
    out, left, corner = np.empty_like(row), np.zeros(row.shape[1], np.int64), np.zeros(row.shape[1], np.int64)
    for x in range(len(row)):
        if kind == 3:
            guess = (left + above[x]) // 2
        else:
            p = left + above[x] - corner
            far = np.abs(np.stack([p - left, p - above[x], p - corner]))
            guess = np.choose(far.argmin(0), [left, above[x], corner])
        left = out[x] = (row[x] + guess) % 256
        corner = above[x]
    return out


def frame_hash(a: np.ndarray) -> int:
    """Difference hash of an image as a signed 64-bit pattern."""
    grid = shrink(a, 9, 8)
    bits = (grid[:, :-1] < grid[:, 1:]).ravel()
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def positions(duration: float, options: ScanOptions, key: str) -> list[float]:
    """Like the Column function of that name, for a worker that has just learned the duration."""
    n = max(2, min(60, options.video_samples))
    intro, outro = (max(0.0, min(0.4, x)) for x in (options.intro_skip, options.outro_skip))
    part = max(duration * (1 - intro - outro), 0.5) / n
    place = lambda i: int.from_bytes(hashlib.sha256(f"{options.video_seed}:{key}:{i}".encode()).digest()[:8], "big") / 2**64
    return [duration * intro + part * (i + (place(i) if options.video_seed else 0.5)) for i in range(n)]


def signature(path: str, options: ScanOptions, extractor: FrameExtractor) -> list[int]:
    """Frame hashes of a video; frames that can't be had or decoded are left out. Without a length, a frame each ten seconds."""
    duration = extractor.duration(path)
    if duration > 0:
        frames = [extractor.frame(path, s) for s in positions(duration, options, path)]
    else:
        frames = getattr(extractor, "every", lambda *_: [])(path, 10, max(2, min(60, options.video_samples)))
    return [frame_hash(a) for f in frames if f and (a := decode_png(f)) is not None]


def hashed(files: DataFrame, options: ScanOptions, extractor: FrameExtractor | None = None, jobs: int = 0) -> DataFrame:
    """Video files with their frame hashes; those without any go. ``jobs``: partitions, which bound how many decode at once."""
    ship(files.sparkSession)
    rows = files.filter(is_video(F.col("extension")))
    rows = rows.repartition(jobs, "file_id") if jobs else rows
    kept = [f for f in rows.schema if f.name != "frame_hashes"]
    tool = extractor or Ffmpeg()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                found = signature(one.column("full_path")[0].as_py(), options, tool)
                if found:
                    yield pa.RecordBatch.from_arrays([*(one.column(f.name) for f in kept), pa.array([found], pa.list_(pa.int64()))], names=[*(f.name for f in kept), "frame_hashes"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("frame_hashes", T.ArrayType(T.LongType()))]))
