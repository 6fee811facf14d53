"""The scan: files once, detectors over them, one merged and ranked result.

A detector is any callable (files, options) -> (members, reasons); the registry is open to more.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from twinfold.common import Folders, cut, folders
from twinfold.operators import exact, groups, names, perceptual, stats
from twinfold.options import METHODS, ScanOptions

Detector = Callable[[DataFrame, ScanOptions], tuple[DataFrame, DataFrame]]


def _exact(files: DataFrame, o: ScanOptions) -> tuple[DataFrame, DataFrame]:
    if "content" in files.columns:
        return exact.detect(cut(exact.hashed(files.filter("content is not null")).drop("content")))
    from twinfold.sources import content

    return exact.detect(content.hashed(files)[0])


#: In the order in which they run and in which reasons stand.
DETECTORS: dict[str, Detector] = {
    "ExactContent": _exact,
    "NameSimilarity": lambda files, o: names.detect(files, o.name_threshold),
    "PerceptualImage": lambda files, o: perceptual.detect_images(files, o.perceptual_threshold),
    "PerceptualVideo": lambda files, o: perceptual.detect_videos(files, o.perceptual_threshold),
}
NEEDS = {"PerceptualImage": "perceptual_hash", "PerceptualVideo": "frame_hashes"}


@dataclass
class ScanResult:
    """Everything that a scan found; all DataFrames."""

    files: DataFrame
    members: DataFrame
    reasons: DataFrame
    groups: DataFrame
    summary: DataFrame
    file_types: DataFrame
    folders: Folders | None = None

    def close(self) -> None:
        """Deletes the intermediate data that the result is read from."""
        if self.folders:
            self.folders.close()


@dataclass(frozen=True)
class Event:
    """How far a phase is: tasks of its jobs, and when it is over, the files it looked at and their bytes."""

    phase: str
    tasks_done: int = 0
    tasks: int = 0
    items: int | None = None
    bytes: int | None = None

    @property
    def over(self) -> bool:
        return self.items is not None


Report = Callable[[Event], None]
#: Seconds between two looks at what is running.
LOOK = 0.5


def _tasks(spark: SparkSession, group: str) -> tuple[int, int]:
    """Tasks done, and tasks known, of all jobs of a group."""
    tracker, done, known = spark.sparkContext.statusTracker(), 0, 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else []:
            if s := tracker.getStageInfo(stage):
                done, known = done + s.numCompletedTasks, known + s.numTasks
    return done, known


@contextmanager
def _phase(spark: SparkSession, name: str, files: DataFrame, report: Report | None) -> Iterator[DataFrame]:
    """Runs a phase under its own job group; yields the files, observed as they are read, and reports how far it is."""
    sc, group, stop, seen = spark.sparkContext, f"{name}-{uuid4().hex}", threading.Event(), Observation()
    sc.setJobGroup(group, name, True)

    def look() -> None:
        last = None
        while not stop.wait(LOOK):
            if (now := _tasks(spark, group)) != last:
                last = now
                report(Event(name, *now))

    watcher = InheritableThread(target=look, daemon=True) if report else None
    if watcher:
        watcher.start()
    try:
        yield files.observe(seen, F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")) if report else files
        if report:
            stop.set()
            watcher.join()
            done = _tasks(spark, group)
            found = seen.get if done[1] else {"items": 0, "bytes": 0}
            report(Event(name, *done, found["items"], found["bytes"]))
    finally:
        stop.set()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(key, None)


def phases(methods: int) -> list[str]:
    """Names of what runs, in order; each sets the description of its Spark jobs."""
    out = ["Enumerating"]
    if methods & METHODS["ExactContent"]:
        out += ["QuickHashing", "FullHashing"]
    out += [m for m in DETECTORS if m != "ExactContent" and methods & METHODS[m]]
    return [*out, "Merging"]


def run(spark: SparkSession, files: DataFrame, options: ScanOptions, report: Report | None = None, tag: str | None = None) -> ScanResult:
    """Runs the detectors chosen over files in the canonical schema.

    ``report`` is called with an Event now and then while a phase runs, and once when it is over. ``tag`` is what ``cancel`` calls the run.
    A run that fails or is cancelled deletes all intermediate data that it made; that of a result lies in ``result.folders`` until
    it is closed or the driver ends.
    """
    with folders(spark) as made, _tagged(spark, tag):
        found = []
        for name, detector in DETECTORS.items():
            if options.methods & METHODS[name] and (name not in NEEDS or NEEDS[name] in files.columns):
                with _phase(spark, name, files, report) as given:
                    members, reasons = detector(given, options)
                    found.append((cut(members), cut(reasons)))
        if not found:
            raise ValueError("no detector was chosen that these files can feed")
        with _phase(spark, "Merging", files.select("length"), None):
            members, reasons = (reduce(DataFrame.unionByName, x) for x in zip(*found, strict=True))
            members, reasons = (cut(x) for x in groups.merge(members, reasons))
            plain = files.drop("content")
            ranked = groups.ranked(groups.measured(members, reasons, plain))
            return ScanResult(plain, members, reasons, ranked, stats.scan_summary(plain, ranked), stats.file_types(plain), made)


@contextmanager
def _tagged(spark: SparkSession, tag: str | None) -> Iterator[None]:
    if tag:
        spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        if tag:
            spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops the jobs of the run with that tag; it raises an error and leaves no intermediate data."""
    spark.sparkContext.cancelJobsWithTag(tag)
