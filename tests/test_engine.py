"""Detectors, merging, selection and sinks on temporary trees and small tables."""

import json
import os
import random
import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from twinfold.operators import actions, filters, groups, names, perceptual, scan, select, stats
from twinfold.operators.components import components
from twinfold.options import EXACT, NAME, ScanOptions
from twinfold.plans import engine
from twinfold.sources import content, filewalk, images, session, video


def write(root: Path, path: str, data) -> None:
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(data.encode() if isinstance(data, str) else data)


def run(spark, root, methods=EXACT, **more):
    o = ScanOptions(roots=(str(root),), methods=methods, **more)
    files, _ = filewalk.scan(spark, o)
    return engine.run(spark, files, o)


def paths(result) -> list[list[str]]:
    rows = result.members.join(result.files, "file_id").orderBy("group_key", "pos").collect()
    found: dict = {}
    for r in rows:
        found.setdefault(r.group_key, []).append(r.full_path)
    return sorted(sorted(os.path.basename(p) for p in v) for v in found.values())


def test_exact_by_content_not_name(spark, tmp_path):
    for p, t in (("a/movie.bin", "same"), ("b/c/completely-different-name.bin", "same"), ("c/unique.bin", "other")):
        write(tmp_path, p, t)
    r = run(spark, tmp_path)
    assert paths(r) == [["completely-different-name.bin", "movie.bin"]]
    assert r.groups.first().similarity == 1.0 and r.summary.first().files_scanned == 3


def test_filters_and_exclusions(spark, tmp_path):
    for p in ("a/photo.jpg", "a/copy.jpg", "a/tool.exe", "skip/tool2.exe"):
        write(tmp_path, p, "x" * 40)
    assert paths(run(spark, tmp_path, include_extensions=(".jpg",))) == [["copy.jpg", "photo.jpg"]]
    assert paths(run(spark, tmp_path, include_extensions=(".exe",), excluded_folders=(str(tmp_path / "SKIP"),))) == []
    assert paths(run(spark, tmp_path, include_extensions=(".exe",))) == [["tool.exe", "tool2.exe"]]
    assert paths(run(spark, tmp_path, recursive=False)) == []


def test_same_size_other_bytes(spark, tmp_path):
    write(tmp_path, "a.bin", "A" * 10)
    write(tmp_path, "b.bin", "B" * 10)
    assert paths(run(spark, tmp_path)) == []


def test_sampled_hash_is_confirmed(spark, tmp_path):
    middle = bytearray(b"\0" * 300_000)
    write(tmp_path, "a.bin", bytes(middle))
    middle[150_000] = 1
    write(tmp_path, "b.bin", bytes(middle))
    write(tmp_path, "c.bin", bytes(middle))
    assert content.quick_hash(str(tmp_path / "a.bin"), 300_000) == content.quick_hash(str(tmp_path / "b.bin"), 300_000)
    assert paths(run(spark, tmp_path)) == [["b.bin", "c.bin"]]


def test_names_with_copy_markers(spark, tmp_path):
    for k, p in enumerate(("Big Buck Bunny.mkv", "Big Buck Bunny (1).mkv", "Big Buck Bunny - Copy.mkv", "Totally Other Film.mkv")):
        write(tmp_path, p, "x" * (k + 1))
    r = run(spark, tmp_path, NAME, name_threshold=0.8)
    assert paths(r) == [["Big Buck Bunny (1).mkv", "Big Buck Bunny - Copy.mkv", "Big Buck Bunny.mkv"]]


def test_phases():
    assert engine.phases(EXACT)[1:3] == ["QuickHashing", "FullHashing"]


def test_two_methods_merge(spark, tmp_path):
    write(tmp_path, "a/Movie.mkv", "same bytes")
    write(tmp_path, "b/Movie (1).mkv", "same bytes")
    r = run(spark, tmp_path, EXACT | NAME, name_threshold=0.8)
    g = r.groups.collect()
    assert len(g) == 1 and g[0].methods == 3 and g[0].method == "ExactContent" and r.reasons.count() == 2


def test_empty_hidden_and_nested_roots(spark, tmp_path):
    for p in (".hid", "_under", "d/empty1", "d/empty2"):
        write(tmp_path, p, "")
    o = ScanOptions(roots=(str(tmp_path), str(tmp_path / "d"), str(tmp_path / "missing")))
    files, warnings = filewalk.scan(spark, o)
    assert sorted(r.file_name for r in files.collect()) == ["_under", "empty1", "empty2"] and warnings.count() == 1
    shown, _ = filewalk.scan(spark, ScanOptions(roots=(str(tmp_path),), include_hidden=True))
    assert shown.count() == 4
    assert scan.distinct_roots(["/A/", "/a", "/b"]) == ["/A/", "/b"]


def test_session_round_trip(spark, tmp_path):
    write(tmp_path, "a/x.bin", "same")
    write(tmp_path, "b/y,z.bin", "same")
    r = run(spark, tmp_path)
    at = str(tmp_path / "s.json")
    session.save(at, session.session_groups(r.groups, r.members, r.files, r.reasons))
    back = session.load(spark, at)
    m, reasons, files = session.unnest(back)
    assert back.count() == 1 and m.count() == 2 and reasons.first().method == "ExactContent" and files.count() == 2
    csv = str(tmp_path / "r.csv")
    session.write_csv(session.csv_rows(r.groups, r.members, r.files), csv)
    lines = Path(csv).read_bytes()
    assert lines.startswith(b"\xef\xbb\xbfGroupId,") and lines.count(b"\n") == 3 and b'"' in lines
    out = str(tmp_path / "r.json")
    session.write_json(out, {"filesScanned": 2}, [], session.json_groups(r.groups, r.members, r.files, r.reasons))
    assert len(json.loads(Path(out).read_text())["groups"][0]["files"]) == 2


def test_session_defaults(spark, tmp_path):
    at = tmp_path / "s.json"
    f = lambda n: [{"Path": f"/p{k}", "Length": 3, "LastWriteUtc": "2024-01-01T00:00:00Z", "ContentHash": None} for k in range(n)]
    at.write_text(json.dumps({"Version": 9, "SavedAtUtc": "", "Groups": [{"Reasons": [], "Files": f(2)}, {"Reasons": [], "Files": f(1)}]}))
    back = session.load(spark, str(at)).collect()
    assert len(back) == 1 and back[0].reasons[0].Method == "ExactContent" and back[0].reasons[0].Similarity == 1.0


@pytest.fixture
def members(spark):
    files = spark.createDataFrame([(1, "/a/b/m.txt", "m.txt", "/a/b", ".txt", 5, 2), (2, "/a/m (1).txt", "m (1).txt", "/a", ".txt", 9, 1), (3, "/a/c/m - Copy.txt", "m - Copy.txt", "/a/c", ".txt", 5, 3), (4, "/z/q.jpg", "q.jpg", "/z", ".jpg", 9, 3)], "file_id long, full_path string, file_name string, directory_name string, extension string, length long, day long").withColumn("last_write_utc", F.timestamp_seconds(F.col("day") * 86400)).drop("day")
    return files, spark.createDataFrame([("g", 0, 1), ("g", 1, 2), ("g", 2, 3), ("h", 0, 2), ("h", 1, 4)], "group_key string, pos int, file_id long")


@pytest.mark.parametrize("rule,kept", [("newest", {"g": 3, "h": 4}), ("oldest", {"g": 2, "h": 2}), ("largest", {"g": 2, "h": 2}), ("smallest", {"g": 1, "h": 2}), ("shortest_path", {"g": 1, "h": 4}), ("cleanest_name", {"g": 1, "h": 4}), ("first", {"g": 1, "h": 2})])
def test_keep_rules(members, rule, kept):
    files, m = members
    assert {r.group_key: r.file_id for r in select.keepers(m, files, rule).collect()} == kept
    assert select.redundant(m, files, rule).count() == 3


def test_merge_filters_and_stats(spark, members):
    files, m = members
    twin = m.filter("group_key = 'g'").select(F.lit("n").alias("group_key"), "pos", "file_id")
    reasons = spark.createDataFrame([("g", "ExactContent", 1.0, "k"), ("h", "PerceptualImage", 0.9, "p"), ("n", "NameSimilarity", 0.8, "m")], "group_key string, method string, similarity double, signature string")
    mm, rr = groups.merge(m.unionByName(twin), reasons)
    g = groups.ranked(groups.measured(mm, rr, files))
    rows = {r.group_key: r for r in g.collect()}
    assert set(rows) == {"g", "h"} and rows["g"].methods == 3 and rows["g"].reclaimable_bytes == 14 and rows["h"].reclaimable_bytes == 9 and rows["g"].ordinal == 1
    keys = lambda df: sorted(r.group_key for r in df.collect())
    assert keys(filters.min_count(g, 3)) == ["g"]
    assert keys(filters.with_text(g, mm, files, "Q.JPG")) == ["h"] and keys(filters.with_text(g, mm, files, " ")) == ["g", "h"]
    assert keys(filters.with_reasons(g, rr, {"NameSimilarity": 0.7, "PerceptualImage": 0.95})) == ["g"]
    assert keys(filters.with_reasons(g, rr, {"NameSimilarity": 0.7, "ExactContent": 1.0}, every=True)) == ["g"]
    assert keys(filters.with_reasons(g, rr, {}, floor=0.95)) == ["g"]
    s = stats.scan_summary(files, g).first()
    assert (s.files_scanned, s.duplicate_groups, s.duplicate_files, s.redundant_files, s.reclaimable_bytes) == (4, 2, 5, 3, 23)
    assert {r.category: r.n_files for r in stats.file_types(files).collect()} == {"Images": 1, "Videos": 0, "Other": 3}
    left = actions.after(mm, files, spark.createDataFrame([("/A/M (1).TXT",)], "path string"))
    assert keys(left.select("group_key").distinct()) == ["g"]


def test_move_plan_and_report(spark):
    files = spark.createDataFrame([("/a/x.txt", "x.txt", 3), ("/b/X.txt", "X.txt", 4), ("/c/y", "y", 5)], "full_path string, file_name string, length long")
    assert sorted(r.destination for r in actions.plan_move(files, "/t").collect()) == ["/t/X (1).txt", "/t/x.txt", "/t/y"]
    outcomes = spark.createDataFrame([("/a", 3, None), ("/C:b", 4, "denied")], "path string, bytes long, error string")
    r = actions.report(outcomes).first()
    assert (r.succeeded, r.bytes_freed, r.n_errors) == (1, 3, 1)
    assert [r.message for r in actions.errors(outcomes).collect()] == ["/C:b: denied"]


def test_planned_moves_never_meet(spark):
    def moved(paths, there=None):
        files = spark.createDataFrame([(p, 1, p.rsplit("/", 1)[1]) for p in paths], "full_path string, length long, file_name string")
        rows = actions.plan_move(files, "/t", None if there is None else spark.createDataFrame([(n,) for n in there], "file_name string")).collect()
        assert len(rows) == len(paths) and len({r.destination.lower() for r in rows}) == len(paths)
        assert not {r.destination.lower() for r in rows} & {f"/t/{n.lower()}" for n in there or ()}
        return {r.path: r.destination for r in rows}

    assert moved(["/a/x.txt", "/b/x.txt", "/c/x (1).txt"]) == {"/a/x.txt": "/t/x.txt", "/b/x.txt": "/t/x (2).txt", "/c/x (1).txt": "/t/x (1).txt"}
    assert moved(["/a/x.txt"], ["X.TXT", "x (1).txt", "x (3).txt"]) == {"/a/x.txt": "/t/x (2).txt"}
    assert moved(["/a/x", "/b/x", "/b/x (1)", "/c/x (1)"]) == {"/a/x": "/t/x", "/b/x": "/t/x (2)", "/b/x (1)": "/t/x (1)", "/c/x (1)": "/t/x (1) (1)"}
    rng = random.Random(21)
    names = ["x", "X (1)", "x (2)", "x (1) (1)", "x (01)", "y"]
    for _ in range(5):
        moved([f"/{k}/{rng.choice(names)}{rng.choice(['.txt', '', '.tar.gz'])}" for k in range(40)], [rng.choice(names) + ".txt" for _ in range(3)])


def test_hashes_are_found_with_any_slices(spark):
    rng = random.Random(22)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 12))) for v in values[:40]]
    values = list(dict.fromkeys(values))
    points = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)], "id long, h long")
    for most in (0, 3, 8, 10):
        got = sorted((r.a, r.b, r.bits) for r in perceptual.hash_pairs(points, most).collect())
        assert got == [(a, b, n) for a in range(len(values)) for b in range(a + 1, len(values)) if (n := (values[a] ^ values[b]).bit_count()) <= most]


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.85, 0.95, 1.0])
def test_name_pairs_lose_none(spark, threshold):
    rng = random.Random(24)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def changed(w):
        w = list(w)
        for _ in range(rng.randrange(1, 5)):
            at, kind = rng.randrange(len(w) + 1), rng.random()
            if kind < 0.4:
                w.insert(at, rng.choice("abc"))
            elif at < len(w) and len(w) > 1:
                w[at : at + 1] = [] if kind < 0.7 else [rng.choice("abc")]
        return "".join(w)

    base = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    words = sorted({w for x in base for w in (x, changed(x), changed(x), x + "a", x[:-1]) if w})
    got = {(r.a, r.b): round(r.ratio, 9) for r in names.pairs(spark.createDataFrame(list(enumerate(words)), "name_id long, name string"), threshold).collect()}
    want = {}
    for a, x in enumerate(words):
        for b in range(a + 1, len(words)):
            share = 1 - lev(x, words[b]) / max(len(x), len(words[b]))
            if x[0] == words[b][0] and share >= threshold:
                want[a, b] = round(share, 9)
    assert got == want


def test_portable_maps_and_targa(spark, tmp_path):
    import numpy as np

    grey = np.arange(12 * 10).reshape(10, 12) * 2
    colour = np.stack([grey, grey // 2, 255 - grey], 2).astype(np.uint8)
    luma = np.rint(colour @ np.array(images.LUMA))
    binary = (grey > 100).astype(int)
    (tmp_path / "a.pgm").write_bytes(b"P5\n# made\n12 10\n255\n" + grey.astype(np.uint8).tobytes())
    (tmp_path / "b.PPM").write_bytes(b"P6 12 10 255\n" + colour.tobytes())
    (tmp_path / "c.pbm").write_bytes(b"P4\n12 10\n" + np.packbits(1 - binary, axis=1).tobytes())
    (tmp_path / "d.pbm").write_bytes(b"P1 12 10\n" + b"\n".join(b" ".join(b"%d" % (1 - v) for v in r) for r in binary))
    (tmp_path / "e.ppm").write_bytes(b"P3 12 10 255\n" + b" ".join(b"%d" % v for v in colour.ravel()))
    head = lambda kind, depth, flags: struct.pack("<BBBHHBHHHHBB", 0, 0, kind, 0, 0, 0, 0, 0, 12, 10, depth, flags)
    (tmp_path / "f.tga").write_bytes(head(2, 24, 32) + colour[:, :, ::-1].tobytes())
    (tmp_path / "g.tga").write_bytes(head(2, 24, 0) + colour[::-1, :, ::-1].tobytes())
    (tmp_path / "h.tga").write_bytes(head(11, 8, 32) + b"".join(bytes([11]) + r.tobytes() for r in grey[:5].astype(np.uint8)) + bytes([128 | 59, 7]))
    (tmp_path / "i.tga").write_bytes(b"cut")
    flat = grey.copy()
    flat[5:] = 7
    for data, want in (("a.pgm", grey), ("b.PPM", luma), ("c.pbm", binary * 255), ("d.pbm", binary * 255), ("e.ppm", luma)):
        assert (images.portable_map((tmp_path / data).read_bytes()) == want).all()
    for data, want in (("f.tga", luma), ("g.tga", luma), ("h.tga", flat)):
        assert (images.targa((tmp_path / data).read_bytes()) == want).all()
    got = {os.path.basename(r.full_path): r for r in images.read(spark, str(tmp_path)).collect()}
    assert len(got) == 9 and got["i.tga"].perceptual_hash is None and got["f.tga"].perceptual_hash == got["b.PPM"].perceptual_hash and (got["a.pgm"].width, got["a.pgm"].height) == (12, 10)


def test_written_tables_and_hubs(spark, monkeypatch):
    from twinfold import common
    from twinfold.operators import components as c

    hub = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(500, 540)]
    for most in (500_000, 0):
        monkeypatch.setattr(c, "BROADCAST", most)
        got = {r.node: r.component for r in components(spark.createDataFrame(hub, "u long, v long")).collect()}
        assert got == {**{k: 0 for k in range(400)}, **{k: 500 for k in range(500, 541)}}
    rows, path, seen = common.written(spark.range(10), F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    assert rows.count() == 10 and seen == {"n": 10, "m": 9} and common.exists(spark, path)
    common.remove(spark, path)
    assert not common.exists(spark, path)


def test_reports_in_parts(spark, tmp_path):
    for p, t in (("a/one.bin", "same"), ("b/two.bin", "same"), ("c/x,y.bin", "more"), ("d/z.bin", "more")):
        write(tmp_path, f"tree/{p}", t)
    r = run(spark, tmp_path / "tree")
    session.write_csv_parts(session.csv_rows(r.groups, r.members, r.files), str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns == session.COLUMNS and back.count() == 4 and back.filter("FilePath like '%x,y.bin'").count() == 1
    session.write_json_parts(str(tmp_path / "json"), session.session_groups(r.groups, r.members, r.files, r.reasons))
    assert session.load_parts(spark, str(tmp_path / "json")).select(F.size("files").alias("n")).agg(F.sum("n")).first()[0] == 4


def brute_components(edges):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("n,m,seed", [(60, 40, 1), (30, 60, 2)])
def test_components(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute_components(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("most", [2, 17])
def test_banded_pairs_are_all_pairs(spark, most):
    rng = random.Random(3)
    hs = [rng.getrandbits(64) for _ in range(60)]
    hs += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, most + 2))) for h in hs[:30]]
    signed = [h - (1 << 64) if h >> 63 else h for h in hs]
    got = {(r.a, r.b, r.bits) for r in perceptual.hash_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, h long"), most).collect()}
    assert got == {(a, b, d) for a in range(len(hs)) for b in range(a + 1, len(hs)) if (d := (hs[a] ^ hs[b]).bit_count()) <= most}


def test_name_pairs_are_all_pairs(spark):
    rng = random.Random(4)
    pool = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(40)})
    got = {(r.a, r.b) for r in names.pairs(spark.createDataFrame(list(enumerate(pool)), "name_id long, name string"), 0.6).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a in range(len(pool)) for b in range(a + 1, len(pool)) if pool[a][0] == pool[b][0] and 1 - lev(pool[a], pool[b]) / max(len(pool[a]), len(pool[b])) >= 0.6}
    assert got == want


def png(pixels: list[list[int]]) -> bytes:
    h, w = len(pixels), len(pixels[0])
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + bytes(r) for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_photo_quality_of_files(spark, tmp_path):
    rng = random.Random(5)
    write(tmp_path, "flat.png", png([[128] * 800 for _ in range(600)]))
    write(tmp_path, "dark.png", png([[8] * 800 for _ in range(600)]))
    write(tmp_path, "noise.png", png([[rng.randrange(256) for _ in range(300)] for _ in range(200)]))
    write(tmp_path, "bad.png", b"no image")
    rows = images.read(spark, str(tmp_path)).withColumns({"file_name": F.regexp_extract("full_path", "([^/]*)$", 1), "extension": F.lit(".png")})
    got = {r.file_name: r for r in images.quality(rows).collect()}
    assert set(got) == {"flat.png", "dark.png", "noise.png"}
    assert "Blurry" in got["flat.png"].flags and "Dark" in got["dark.png"].flags and "Blurry" not in got["noise.png"].flags
    assert (got["flat.png"].width, got["flat.png"].height, got["flat.png"].perceptual_hash) == (800, 600, 0)


def test_video_tools():
    one = png([[1, 2]])
    assert video.split_png(b"junk" + one + one) == [one, one]
    assert video.find_tool("no-such-tool-here") is None
    assert video.Ffmpeg("/none", "/none").duration("/x") == 0.0


class Frames:
    """Makes a frame from the name of a file, so that copies look alike."""

    def duration(self, path):
        return 0.0 if "nolength" in path else 60.0

    def frame(self, path, second):
        rng = random.Random(f"{os.path.basename(path)[0]}{int(second)}")
        return png([[rng.randrange(256) for _ in range(32)] for _ in range(24)])

    def every(self, path, seconds, most):
        return [self.frame(path, k) for k in range(most)]


def test_videos_by_frames(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this module
    names_ = ["a1.mp4", "a2.mkv", "b.mp4", "c nolength.avi", "a.txt"]
    files = spark.createDataFrame([(k, f"/v/{n}", n, "/v", "." + n.rsplit(".", 1)[1], 100 - k) for k, n in enumerate(names_)], "file_id long, full_path string, file_name string, directory_name string, extension string, length long")
    rows = video.hashed(files, ScanOptions(), Frames(), jobs=2)
    got = {r.file_id: r.frame_hashes for r in rows.collect()}
    assert set(got) == {0, 1, 2, 3} and got[0] == got[1] != got[2] and len(got[3]) == 12
    members, reasons = perceptual.detect_videos(rows, 8)
    assert [(r.pos, r.file_id) for r in members.orderBy("pos").collect()] == [(0, 0), (1, 1)] and reasons.first().signature == "video:2"


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    import numpy as np

    rng = np.random.default_rng(kind)
    a = rng.integers(0, 256, (6, 5, 3))
    lines = []
    for y in range(6):
        up = a[y - 1] if y else np.zeros((5, 3), int)
        left = np.concatenate([np.zeros((1, 3), int), a[y, :-1]])
        corner = np.concatenate([np.zeros((1, 3), int), up[:-1]])
        p = left + up - corner
        far = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
        guess = [0 * up, left, up, (left + up) // 2, np.choose(far.argmin(0), [left, up, corner])][kind]
        lines.append(bytes([kind]) + ((a[y] - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    data = video.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    want = np.rint(a[..., 0] * 0.2126 + a[..., 1] * 0.7152 + a[..., 2] * 0.0722)
    assert (video.decode_png(data) == want).all() and video.decode_png(data[:40]) is None and video.decode_png(b"") is None
