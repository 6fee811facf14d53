"""Images read by Spark's own decoder, brought to small luma grids on the executors."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinfold.common import ship
from twinfold.functions import photo
from twinfold.functions.bits import dhash

#: Weights of red, green and blue in luma (BT.709), and the longer side of the copy that quality is measured on.
LUMA, MEASURED = (0.2126, 0.7152, 0.0722), 320
FIELDS = "origin string, width int, height int, grid array<int>, sharpness double, brightness double"


def luma(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Levels 0..255; the decoder's order is blue, green, red."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return np.rint(a[..., 0]) if channels == 1 else np.rint(a[..., 2] * LUMA[0] + a[..., 1] * LUMA[1] + a[..., 0] * LUMA[2])


def shrink(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean of the cells that each smaller cell covers, nearest cell where there is none to average."""
    ys, xs = (np.minimum(np.arange(n + 1) * m // n, m) for n, m in ((height, a.shape[0]), (width, a.shape[1])))
    sums = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    y0, y1 = np.minimum(ys[:-1], a.shape[0] - 1), np.maximum(ys[1:], np.minimum(ys[:-1], a.shape[0] - 1) + 1)
    x0, x1 = np.minimum(xs[:-1], a.shape[1] - 1), np.maximum(xs[1:], np.minimum(xs[:-1], a.shape[1] - 1) + 1)
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    return np.rint(total / np.outer(y1 - y0, x1 - x0))


def measure(a: np.ndarray) -> tuple[float, float]:
    """Laplacian variance and mean level of the copy that fits MEASURED."""
    h, w = a.shape
    if max(h, w) > MEASURED:
        a = shrink(a, max(1, w * MEASURED // max(h, w)), max(1, h * MEASURED // max(h, w)))
    inner = 4 * a[1:-1, 1:-1] - a[1:-1, :-2] - a[1:-1, 2:] - a[:-2, 1:-1] - a[2:, 1:-1]
    return (max(0.0, float((inner**2).mean() - inner.mean() ** 2)) if inner.size else 0.0), float(a.mean())


def grids(images: DataFrame) -> DataFrame:
    """9 x 8 grid, sharpness and brightness of decoded images; those that can't be decoded have nulls."""
    ship(images.sparkSession)
    flat = images.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One decoded image at a time is in Python's memory.
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                if row["width"] is None or row["width"] <= 0:
                    one = (row["origin"], None, None, None, None, None)
                else:
                    a = luma(row["data"], row["width"], row["height"], row["nChannels"])
                    one = (row["origin"], row["width"], row["height"], shrink(a, 9, 8).astype(int).ravel().tolist(), *measure(a))
                yield _row(one)

    return flat.mapInArrow(run, FIELDS)


def levels(pixels: np.ndarray) -> np.ndarray:
    """Luma of rows of pixels with one channel, or with red, green and blue first."""
    a = pixels.astype(np.float64)
    return np.rint(a[..., 0] if a.shape[-1] < 3 else a[..., 0] * LUMA[0] + a[..., 1] * LUMA[1] + a[..., 2] * LUMA[2])


def portable_map(data: bytes) -> np.ndarray:
    """Luma of a PBM, PGM or PPM image, as text or binary. Comments may stand before the pixels."""
    head = re.match(rb"P([1-6])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 2, data)
    kind = int(head[1])
    width, height, at, most = int(head[2]), int(head[3]), head.end(), 1
    if kind not in (1, 4):
        more = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)").match(data, at)
        most, at = int(more[1]), more.end()
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind == 1:
        flat = np.array([c - 48 for c in re.sub(rb"#[^\n]*|[^01]", b"", data[at:])][:n])
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], np.int64)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        flat = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if kind in (1, 4):  # a set bit is black
        flat = 1 - flat
    return levels(flat.reshape(height, width, channels) * 255.0 / most)


def targa(data: bytes) -> np.ndarray:
    """Luma of a TGA image with or without a colour map or run lengths, of 8, 15, 16, 24 or 32 bits a pixel."""
    skip, mapped, kind, first, entries, bits, _, _, width, height, depth, flags = struct.unpack("<BBBHHBHHHHBB", data[:18])
    if kind & 7 not in (1, 2, 3) or depth not in (8, 15, 16, 24, 32):
        raise ValueError("not a TGA image of a known kind")
    at, size, n = 18 + skip, (depth + 7) // 8, width * height
    palette = data[at : at + entries * ((bits + 7) // 8)] if mapped else b""
    at += len(palette)
    if kind < 8:
        raw = data[at : at + n * size]
    else:
        out = bytearray()
        while len(out) < n * size:
            run = (data[at] & 127) + 1
            if data[at] & 128:
                out += data[at + 1 : at + 1 + size] * run
                at += 1 + size
            else:
                out += data[at + 1 : at + 1 + size * run]
                at += 1 + size * run
        raw = bytes(out[: n * size])

    def colours(b: bytes, width_: int) -> np.ndarray:
        if width_ == 1:
            return np.frombuffer(b, np.uint8)[:, None]
        if width_ == 2:
            v = np.frombuffer(b, "<u2").astype(np.int64)
            return np.stack([(v >> s & 31) * 255 // 31 for s in (10, 5, 0)], 1)
        return np.frombuffer(b, np.uint8).reshape(-1, width_)[:, 2::-1]

    pixels = colours(palette, (bits + 7) // 8)[np.frombuffer(raw, np.uint8).astype(int) - first] if mapped and kind & 7 == 1 else colours(raw, size)
    a = levels(pixels.reshape(height, width, -1))
    a = a if flags & 32 else a[::-1]
    return a[:, ::-1] if flags & 16 else a


#: Endings of the images that are decoded here, since the ``image`` reader doesn't.
DECODED = {".pbm": portable_map, ".pgm": portable_map, ".ppm": portable_map, ".pnm": portable_map, ".tga": targa}


def decoded(files: DataFrame) -> DataFrame:
    """Like ``grids``, of (path, content) rows whose ending is one of DECODED."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    a = DECODED[os.path.splitext(path)[1].lower()](data.as_py())
                    one = (path, a.shape[1], a.shape[0], shrink(a, 9, 8).astype(int).ravel().tolist(), *measure(a))
                except (ValueError, IndexError, TypeError, struct.error):  # not such an image, or cut off
                    one = (path, None, None, None, None, None)
                yield _row(one)

    return files.select("path", "content").mapInArrow(run, FIELDS)


def _row(one: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64()), strict=True)], names=[f.split(" ")[0] for f in FIELDS.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(full_path, width, height, perceptual_hash, sharpness, brightness) of the images below a path."""
    own = F.lower(F.regexp_extract("origin", r"(\.[^./]+)$", 1)).isin(list(DECODED))
    rows = grids(spark.read.format("image").option("recursiveFileLookup", "true").load(path)).filter(~own)
    more = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(x for e in DECODED for x in (e[1:], e[1:].upper())) + "}").load(path)
    rows = rows.unionByName(decoded(more))
    return rows.select(F.regexp_replace("origin", "^file:/+", "/").alias("full_path"), "width", "height", F.when(F.col("grid").isNotNull(), dhash(F.col("grid"))).alias("perceptual_hash"), "sharpness", "brightness")


def quality(rows: DataFrame, blur: float = photo.BLUR, dark: float = photo.DARK, low: int = photo.LOW_RESOLUTION) -> DataFrame:
    """Flags and score of rows with sizes, measures, name and extension; rows without measures go."""
    w, h, s, b = (F.col(c) for c in ("width", "height", "sharpness", "brightness"))
    found = photo.flags(s, b, w, h, F.col("file_name"), F.col("extension"), blur, dark, low)
    return rows.filter("sharpness is not null").withColumn("flags", found).withColumn("score", photo.score(s, b, w, h, F.col("flags")))
