"""Progress, cancellation, intermediate data, and plans that are carried out."""

import os
import threading
import time

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from twinfold.common import cut, folders, scratch, shared_dir, written
from twinfold.operators import actions
from twinfold.options import EXACT, NAME, ScanOptions
from twinfold.plans import engine
from twinfold.sources import filewalk

SCHEMA = "file_id long, full_path string, file_name string, directory_name string, extension string, length long, last_write_utc timestamp, content string"


def files(spark, n=40):
    rows = [(k, f"/a/name {k % 5} of {k}.txt", f"name {k % 5} of {k}.txt", "/a", ".txt", 3, None, f"c{k % 4:02}") for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def left(spark):
    """Every file below the shared folder."""
    at = shared_dir(spark).removeprefix("file:")
    return {os.path.join(d, f) for d, _, names in os.walk(at) for f in names}


def test_a_run_reports_items_and_bytes_of_each_phase(spark):
    seen = []
    result = engine.run(spark, files(spark), ScanOptions(methods=EXACT | NAME), seen.append)
    over = {e.phase: (e.items, e.bytes) for e in seen if e.over}
    assert over == {"ExactContent": (40, 120), "NameSimilarity": (40, 120)}
    assert all(0 < e.tasks_done <= e.tasks for e in seen if e.over) and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert result.groups.count() > 0


def test_a_closed_result_leaves_no_folder(spark):
    before = left(spark)
    result = engine.run(spark, files(spark), ScanOptions(methods=EXACT | NAME))
    assert result.groups.count() and left(spark) > before
    result.close()
    assert left(spark) == before


def test_a_cancelled_scan_stops_and_leaves_no_folder(spark):
    """The detector that never ends is one of names: what the one before it wrote goes as well."""
    before, started, failed = left(spark), threading.Event(), []

    def endless(rows, _):
        started.set()
        slow = rows.mapInPandas(lambda it: (time.sleep(0.2) or p for p in it for _ in range(10_000)), rows.schema)
        return slow.select(F.lit("g").alias("group_key"), F.lit(0).alias("pos"), "file_id"), slow.select("file_id")

    def work():
        try:
            engine.run(spark, files(spark), ScanOptions(methods=EXACT | NAME), tag="scan")
        except Exception as x:
            failed.append(x)

    kept = engine.DETECTORS["NameSimilarity"]
    engine.DETECTORS["NameSimilarity"] = endless
    try:
        thread = InheritableThread(target=work)
        thread.start()
        assert started.wait(60)
        for _ in range(100):
            engine.cancel(spark, "scan")
            thread.join(0.3)
            if not thread.is_alive():
                break
    finally:
        engine.DETECTORS["NameSimilarity"] = kept
    assert not thread.is_alive() and failed and "cancel" in str(failed[0]).lower()
    for _ in range(50):  # tasks that were told to stop may take a moment
        if left(spark) == before:
            break
        time.sleep(0.2)
    assert left(spark) == before and spark.range(3).count() == 3


def test_folders_go_with_an_error_and_nest(spark):
    before = left(spark)
    with pytest.raises(ZeroDivisionError), folders(spark):
        cut(spark.range(5))
        written(spark.range(5))
        1 / 0
    assert left(spark) == before
    with folders(spark) as outer:
        with folders(spark):
            table, _, _ = written(spark.range(5))
        assert table.count() == 5
    outer.close()
    assert left(spark) == before and scratch(spark, "x")


# Plans carried out


def tree(tmp_path, names):
    for n in names:
        at = tmp_path / "t" / n
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(n)


def plan_of(spark, rows):
    return spark.createDataFrame(rows, "action string, path string, bytes long, destination string")


def outcomes(df):
    return sorted((r.action, os.path.basename(r.path), r.error) for r in df.collect())


def test_a_plan_is_carried_out_once(spark, tmp_path):
    tree(tmp_path, ["a", "b", "c", "d/e", "taken"])
    t = f"{tmp_path}/t"
    rows = [("delete", f"{t}/a", 1, None), ("move", f"{t}/b", 1, f"{t}/to/b"), ("move", f"{t}/c", 1, f"{t}/taken"), ("delete", f"{t}/none", 1, None), ("move", f"{t}/none", 1, f"{t}/to/n"), ("delete", f"{t}/d", 1, None), ("burn", f"{t}/taken", 1, None)]
    at = str(tmp_path / "journal")
    first = outcomes(actions.apply(plan_of(spark, rows), at))
    errors = {(a, p): e for a, p, e in first}
    assert errors["delete", "a"] is None and errors["move", "b"] is None and errors["move", "c"] == "File exists"
    assert errors["delete", "none"] == errors["move", "none"] == "No such file or directory" and errors["delete", "d"] and errors["burn", "taken"] == "no such action: burn"
    files_ = lambda: sorted(r.full_path.removeprefix(t) for r in filewalk.scan(spark, ScanOptions(roots=(t,)))[0].collect())
    assert files_() == ["/c", "/d/e", "/taken", "/to/b"]
    # Again, and with a file that has come since: nothing more is done.
    tree(tmp_path, ["a"])
    assert outcomes(actions.apply(plan_of(spark, rows), at)) == first and "/a" in files_()
    assert actions.report(actions.apply(plan_of(spark, rows), at)).first()[:3] == (2, 2, 5)


def test_a_plan_goes_on_after_it_was_broken_off(spark, tmp_path):
    """What was done before the outcomes were written counts as done."""
    tree(tmp_path, ["a", "b", "c"])
    t, at = f"{tmp_path}/t", str(tmp_path / "journal")
    rows = [("delete", f"{t}/a", 1, None), ("move", f"{t}/b", 1, f"{t}/to/b"), ("delete", f"{t}/c", 1, None)]
    actions.apply(plan_of(spark, rows).filter("false"), f"{at}-empty")
    kept, actions.exists = actions.exists, lambda s, p: True if p.endswith("outcomes/_SUCCESS") else kept(s, p)
    try:
        with pytest.raises(Exception):
            actions.apply(plan_of(spark, rows), at)
    finally:
        actions.exists = kept
    os.remove(f"{t}/a")
    os.makedirs(f"{t}/to")
    os.rename(f"{t}/b", f"{t}/to/b")
    assert outcomes(actions.apply(plan_of(spark, rows), at)) == [("delete", "a", None), ("delete", "c", None), ("move", "b", None)]
    assert not os.path.exists(f"{t}/c") and os.path.exists(f"{t}/to/b")
