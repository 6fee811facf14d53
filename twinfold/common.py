"""Session helpers shared by every operator: table access, lineage cuts, shared folders, module shipping."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package also where only the driver has it on its path.

    On a real cluster the package is installed or sent with ``--py-files``; this covers sessions
    started elsewhere on the same file system.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT
    return spark


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark's file systems reach."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a short text as a file, in place of what is there."""
    files, at = _file_system(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str | None:
    """A short text written by ``put_text``; None where there is no such file."""
    if not exists(spark, path):
        return None
    files, at = _file_system(spark, path)
    given = files.open(at)
    try:
        return bytes(given.readAllBytes()).decode()
    finally:
        given.close()


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of change of every file of a table, in order; none where there is no such path."""
    if not exists(spark, path):
        return []
    files, at = _file_system(spark, path)
    found, out = files.listFiles(at, True), []
    while found.hasNext():
        s = found.next()
        out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def joined_file(spark: SparkSession, parts: str, path: str, head: bytes, trimmed: int, tail: bytes) -> None:
    """One file of a head, the parts in a folder in the order of their names without the last ``trimmed`` bytes, and a tail.

    Bytes are streamed by the driver's JVM, a buffer at a time; no row is read. A path without a scheme is of the mounted file system. The
    folder of parts goes.
    """
    copy = spark._jvm.org.apache.commons.io.IOUtils.copyLarge
    names = [(p, n) for p, n, _ in files_below(spark, parts) if p.rpartition("/")[2].startswith("part-") and n]
    files, at = _file_system(spark, path if ":" in path.split("/")[0] else f"file:{Path(path).absolute()}")
    files.setWriteChecksum(False)
    out = files.create(at, True)
    try:
        out.write(bytearray(head))
        for k, (p, n) in enumerate(names):
            store, part = _file_system(spark, p)
            given = store.open(part)
            try:
                copy(given, out, 0, n - (trimmed if k == len(names) - 1 else 0))
            finally:
                given.close()
        if tail:
            out.write(bytearray(tail))
    finally:
        out.close()
        files.setWriteChecksum(True)
    remove(spark, parts)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the driver ends."""
    files, at = _file_system(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A temporary folder is made only where the session names none and runs on one machine, as in tests.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="twinfold-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to as many tasks as a shuffle has, however few bytes they are: for steps that make many rows of one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Folders:
    """Folders of intermediate data that one piece of work has made."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def close(self) -> None:
        """Deletes them all: what was read from them can't be read any more."""
        while self.paths:
            remove(self.spark, self.paths.pop())


_folders: ContextVar[Folders | None] = ContextVar("folders", default=None)


@contextmanager
def folders(spark: SparkSession) -> Iterator[Folders]:
    """Collects the folders made inside. An error, or a cancelled job, deletes them; else they stay until closed or the driver ends."""
    mine = Folders(spark)
    outer, token = _folders.get(), _folders.set(mine)
    try:
        yield mine
    except BaseException:
        mine.close()
        raise
    finally:
        _folders.reset(token)
        if outer:
            outer.paths += mine.paths


def _made(path: str) -> None:
    if mine := _folders.get():
        mine.paths.append(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    remove_at_exit(spark, path)
    _made(path)
    return path


_marked: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows go to the shared folder, so a lost executor loses nothing. Deleted when the driver ends.

    Where folders are collected it is a written table, whose folder is known before anything is in it.
    """
    spark = df.sparkSession
    if _folders.get():
        return written(df)[0]
    at = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    own = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if own not in _marked:
        _marked.add(own)
        remove_at_exit(spark, own)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *measures: Column) -> tuple[DataFrame, str, dict]:
    """The rows as a Parquet table in the shared folder: read again, its path, and measures taken while writing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "table")
    seen = Observation() if measures else None
    (df.observe(seen, *measures) if measures else df).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path, seen.get if measures else {}
