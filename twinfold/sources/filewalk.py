"""Directory listing in rounds: metadata only, hidden and empty files included.

A round deals the folders that are known to tasks, many to each where there are many. A task lists those it was given and goes on to what it finds
below, up to a number of folders and of files; the rest is what the next round deals. So a deep narrow tree is walked by one task and a
wide one by many, nothing is listed by the driver, and what can't be read becomes a warning row.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinfold.common import ship, written
from twinfold.operators import scan as filters
from twinfold.options import ScanOptions
from twinfold.sources import store
from twinfold.sources.bindings import from_paths

#: Folders dealt to a task, tasks of a round, folders found on the way that a task lists too, and files after which it lists no more of them.
FOLDERS, TASKS, FURTHER, FILES = 512, 4096, 512, 4096
#: Rows handed on at once.
ROWS = 4096
SCHEMA = "full_path string, length long, last_write_utc timestamp, is_hidden boolean, warning string, folder boolean"
TYPES = pa.schema([("full_path", pa.string()), ("length", pa.int64()), ("last_write_utc", pa.timestamp("us", "UTC")), ("is_hidden", pa.bool_()), ("warning", pa.string()), ("folder", pa.bool_())])


class Walker:
    """Lists folders: rows of files and warnings, and of folders that are left to the next round."""

    def __init__(self, recursive: bool, hidden: bool, excluded: tuple[str, ...]):
        self.recursive, self.hidden, self.excluded = recursive, hidden, {x.rstrip("/").lower() for x in excluded}

    def wanted(self, path: str) -> bool:
        return path.rstrip("/").lower() not in self.excluded

    def _listed(self, at: str, below: list[str] | None) -> Iterator[tuple]:
        """Rows of a folder; folders in it are added to ``below`` while that is short enough."""
        try:
            found = store.entries(at)
        except OSError as x:
            yield at, None, None, None, f"{at}: {store.reason(x)}", False
            return
        for e in found:
            if not e.folder:
                yield e.path, e.length, e.changed, e.name.startswith("."), None, False
            elif self.recursive and self.wanted(e.path) and (self.hidden or not e.name.startswith(".")):
                if below is not None and len(below) < FURTHER:
                    below.append(e.path)
                else:
                    yield e.path, None, None, None, None, True

    def rows(self, folders: Iterator[str]) -> Iterator[tuple]:
        below: list[str] = []
        seen = 0
        for at in folders:
            for row in self._listed(at, below):
                seen += 1
                yield row
        left = FURTHER
        while below:
            at = below.pop()
            if left and seen < FILES:
                left -= 1
                for row in self._listed(at, below):
                    seen += 1
                    yield row
            else:
                yield at, None, None, None, None, True

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in self.rows(p for b in batches for p in b.column(0).to_pylist()):
            held.append(row)
            if len(held) == ROWS:
                yield _batch(held)
                held = []
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(TYPES)], schema=TYPES)


def listing(spark: SparkSession, options: ScanOptions) -> DataFrame:
    """Files and warnings, each path once."""
    ship(spark)
    walker = Walker(options.recursive, options.include_hidden, tuple(store.absolute(f) for f in options.excluded_folders))
    roots = [r for r in filters.distinct_roots([store.absolute(r) for r in options.roots]) if walker.wanted(r)]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier, n, out = spark.createDataFrame([(r,) for r in roots], "full_path string"), len(roots), None
    while n or out is None:
        tasks = max(1, min(TASKS, max(-(-n // FOLDERS), min(n, width))))
        found, _, seen = written(frontier.repartition(tasks).mapInArrow(walker, SCHEMA), F.count_if("folder").alias("n"))
        rows = found.filter("not folder").drop("folder")
        out = rows if out is None else out.unionByName(rows)
        frontier, n = found.filter("folder").select("full_path"), seen["n"]
    return filters.once(out)


def scan(spark: SparkSession, options: ScanOptions) -> tuple[DataFrame, DataFrame]:
    """Files in the canonical schema after all filters, and warnings."""
    rows = listing(spark, options)
    found = rows.filter("warning is null")
    if not options.include_hidden:
        found = found.filter(~F.col("is_hidden"))
    files = from_paths(found.select(F.xxhash64("full_path").alias("file_id"), "full_path", "length", "last_write_utc"))
    return filters.apply(files, options), rows.filter("warning is not null").select("warning")


def distinct_folders(paths: list[str]) -> list[str]:
    """Folders for a list of dropped paths: a file stands for the folder it is in."""
    return filters.distinct_roots([p if store.kind(p) == "folder" else p.rpartition("/")[0] if store.URI.match(p) else str(Path(p).parent) for p in paths])
