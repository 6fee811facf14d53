"""Trees walked in rounds, and files read, moved and deleted by path or URI."""

import hashlib
import os
import resource

import pytest
from pyspark.sql import functions as F

from twinfold.options import ScanOptions
from twinfold.sources import content, filewalk, store


def names(df):
    return sorted(r.full_path for r in df.collect())


def made(root, paths):
    for p in paths:
        at = root / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(p)


@pytest.mark.parametrize("before", ["", "file://", "file:"])
def test_a_tree_is_walked_by_path_or_uri(spark, tmp_path, before):
    made(tmp_path, ["a/b/c/d/x.txt", "a/y b%20é.txt", ".h/z.txt", "a/.w", "skip/k.txt"])
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "a/y b%20é.txt", tmp_path / "a/link.txt")
    root = f"{before}{tmp_path}"
    files, warnings = filewalk.scan(spark, ScanOptions(roots=(root, f"{root}/none"), excluded_folders=(f"{root}/SKIP",)))
    assert names(files) == [f"{root}/a/b/c/d/x.txt", f"{root}/a/y b%20é.txt"]
    assert [r.warning for r in warnings.collect()] == [f"{root}/none: No such file or directory"]
    every, _ = filewalk.scan(spark, ScanOptions(roots=(root,), include_hidden=True))
    assert len(names(every)) == 5 and all(r.last_write_utc for r in every.collect())
    assert names(filewalk.scan(spark, ScanOptions(roots=(f"{root}/a",), recursive=False))[0]) == [f"{root}/a/y b%20é.txt"]
    assert names(filewalk.scan(spark, ScanOptions())[0]) == []


def test_a_deep_tree_and_one_of_few_folders_a_task(spark, tmp_path, monkeypatch):
    """Rounds hand on what a task does not list itself; whatever they are, each file comes once."""
    paths = ["/".join(f"d{k}" for k in range(60)) + "/deep.txt"] + [f"w{k}/v{j}/f.txt" for k in range(9) for j in range(5)]
    made(tmp_path, paths)
    want = sorted(f"{tmp_path}/{p}" for p in paths)
    assert names(filewalk.scan(spark, ScanOptions(roots=(str(tmp_path),)))[0]) == want
    walker, rows = filewalk.Walker(True, False, ()), []
    monkeypatch.setattr(filewalk, "FURTHER", 3)
    todo, rounds = [str(tmp_path)], 0
    while todo:
        found = list(walker.rows(iter(todo)))
        todo, rounds, rows = [r[0] for r in found if r[5]], rounds + 1, rows + [r[0] for r in found if not r[5]]
    assert sorted(rows) == want and 10 < rounds < 40


def test_a_level_of_many_folders_has_a_bounded_number_of_partitions(spark, tmp_path, monkeypatch):
    for k in range(50_000):
        os.mkdir(tmp_path / f"d{k}")
    (tmp_path / "d77" / "x").write_text("x")
    seen, frame = [], type(spark.range(1))
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, n, *more: seen.append(n) or deal(df, n, *more))
    files, _ = filewalk.scan(spark, ScanOptions(roots=(str(tmp_path),)))
    assert names(files) == [f"{tmp_path}/d77/x"] and seen[0] == 1 and max(seen) <= 50_000 // filewalk.FOLDERS + 1


def test_hashes_are_the_same_by_path_and_uri(spark, tmp_path):
    data = os.urandom(700_000)
    made(tmp_path, ["a.bin"])
    (tmp_path / "b c%.bin").write_bytes(data)
    for path, want in (("b c%.bin", data), ("a.bin", b"a.bin")):
        sampled = want[: content.SAMPLE_BYTES] + (want[-content.SAMPLE_BYTES :] if len(want) > 2 * content.SAMPLE_BYTES else b"")
        for at in (f"{tmp_path}/{path}", f"file://{tmp_path}/{path}", f"file:{tmp_path}/{path}"):
            assert content.full_hash(at) == hashlib.sha256(want).hexdigest() and content.quick_hash(at, len(want)) == hashlib.sha256(sampled).hexdigest()
    rows = spark.createDataFrame([(f"file://{tmp_path}/gone", 3), (f"{tmp_path}/gone", 3), (f"{tmp_path}/a.bin", 5)], "full_path string, length long")
    found = {r.full_path: (r.h, r.warning) for r in content.with_hash(rows, "h", True).collect()}
    assert found[f"{tmp_path}/a.bin"][1] is None and all(found[p] == (None, f"{p}: No such file or directory") for p in (f"{tmp_path}/gone", f"file://{tmp_path}/gone"))


def test_a_large_file_is_not_held(tmp_path):
    at = tmp_path / "large"
    with open(at, "wb") as f:
        f.truncate(1 << 30)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    content.full_hash(f"file://{at}")
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


@pytest.mark.parametrize("before", ["", "file://"])
def test_files_are_written_moved_and_deleted(tmp_path, before):
    at = f"{before}{tmp_path}"
    store.put(f"{at}/a/b.txt", b"x")
    store.moved(f"{at}/a/b.txt", f"{at}/c/d.txt")
    assert store.kind(f"{at}/a/b.txt") == "none" and store.kind(f"{at}/c/d.txt") == "file" and store.kind(f"{at}/c") == "folder"
    store.put(f"{at}/e.txt", b"y")
    with pytest.raises(FileExistsError):
        store.moved(f"{at}/e.txt", f"{at}/c/d.txt")
    with pytest.raises(OSError):
        store.moved(f"{at}/e.txt", "s3://bucket/e.txt")
    store.deleted(f"{at}/e.txt")
    with pytest.raises(OSError):
        store.deleted(f"{at}/e.txt")
    assert filewalk.distinct_folders([f"{at}/c/d.txt", f"{at}/c"]) == [f"{at}/c"]


def test_task_that_has_listed_many_files_leaves_folders_to_others(tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"d{k}").mkdir()
        for j in range(5):
            (tmp_path / f"d{k}" / f"f{j}").write_text("x")
    monkeypatch.setattr(filewalk, "FILES", 8)
    rows = list(filewalk.Walker(True, False, ()).rows(iter([str(tmp_path)])))
    left = [r[0] for r in rows if r[5]]
    files = [r[0] for r in rows if not r[5]]
    assert len(left) == 4 and len(files) == 10
    files += [r[0] for r in filewalk.Walker(True, False, ()).rows(iter(left))]
    assert sorted(files) == sorted(str(p) for p in tmp_path.glob("*/f*"))


def test_files_are_read_by_several_tasks(spark, tmp_path):
    """Their paths are few bytes, which one task would read."""
    for k in range(40):
        (tmp_path / f"f{k}").write_text(str(k % 10))
    rows = spark.createDataFrame([(f"{tmp_path}/f{k}", 1) for k in range(40)], "full_path string, length long").coalesce(1)
    hashed = content.with_hash(rows, "quick", False)
    assert hashed.groupBy(F.spark_partition_id()).count().count() == 4
    assert hashed.select("quick").distinct().count() == 10
