"""Sampled and full content hashes of files, read in ranges on the executors wherever the files are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from twinfold.common import cut, ship, spread
from twinfold.operators.exact import SAMPLE_BYTES, repeated, signature
from twinfold.sources import store

BUFFER = 1 << 20


def quick_hash(path: str, length: int) -> str:
    """SHA-256 of the first sample, and of the last where the file is longer than two."""
    with store.opened(path) as f:
        h = hashlib.sha256(f.read(SAMPLE_BYTES))
        if length > 2 * SAMPLE_BYTES:
            f.seek(length - SAMPLE_BYTES)
            h.update(f.read(SAMPLE_BYTES))
    return h.hexdigest()


def full_hash(path: str, length: int = 0) -> str:
    h = hashlib.sha256()
    with store.opened(path) as f:
        while data := f.read(BUFFER):
            h.update(data)
    return h.hexdigest()


def write_files(rows: DataFrame, root: str) -> None:
    """Writes a file for each row (path below ``root``, a path or URI, and content), by the executors."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content"), strict=True):
                store.put(f"{root}/{path.as_py()}", data.as_py())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def with_hash(files: DataFrame, out: str, full: bool) -> DataFrame:
    """``files`` with a hash of each; null where a file can't be read, with the reason in ``warning``. Paths are few bytes, so they are dealt anew."""
    ship(files.sparkSession)
    kept = [f for f in files.schema if f.name not in (out, "warning")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = full_hash if full else quick_hash
        for batch in batches:
            found, why = [], []
            for path, length in zip(batch.column("full_path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                try:
                    found.append(f(path, length))
                    why.append(None)
                except OSError as x:
                    found.append(None)
                    why.append(f"{path}: {store.reason(x)}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c.name) for c in kept), pa.array(found, pa.string()), pa.array(why, pa.string())], names=[*(c.name for c in kept), out, "warning"])

    return spread(files).mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType()), T.StructField("warning", T.StringType())]))


def hashed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that may have a copy, with their signature, by size, sample and full hash; and warnings."""
    quick = cut(with_hash(repeated(files, ["length"]), "quick", False))
    full = cut(with_hash(repeated(quick.filter("quick is not null"), ["length", "quick"]), "content_hash", True))
    warnings = quick.filter("warning is not null").select("warning").union(full.filter("warning is not null").select("warning"))
    good = full.filter("content_hash is not null").drop("quick", "warning")
    return good.withColumn("group_key", signature(F.col("length"), F.col("content_hash"))), warnings
