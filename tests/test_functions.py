"""Column functions against golden values."""

import pytest
from pyspark.sql import functions as F

from twinfold.functions import media, photo, text
from twinfold.functions.bits import ball, chance, dhash, hamming, hex16, signed, sliced
from twinfold.functions.names import copy_marker_score, extension, file_name, normalize, ratio, stem
from twinfold.functions.video import frame_match, sample_positions


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.r for r in rows.select("k", f(F.col("v")).alias("r")).orderBy("k").collect()]


def test_normalize_golden(spark):
    golden = {
        "Movie": "movie", "Movie (1)": "movie", "Movie - Copy": "movie", "Movie 2": "movie", "Movie 2024": "movie", "Movie [copy]": "movie", "Movie - Copy (1)": "movie",
        "Movie (1) (2)": "movie 1", "photocopy": "photo", "12345": "", "copy": "", "New Final": "", "new_final": "new final", "report_final": "report final",
        "é copy é": "é é", "کپی فیلم (۱)": "کپی فیلم", "a\U0001d400b": "a b", "\tx\t": "x",
    }
    assert column(spark, list(golden), normalize) == list(golden.values())


def test_ratio(spark):
    rows = spark.createDataFrame([("", ""), ("abc", "abd"), ("kitten", "sitting"), ("é", "e")], "a string, b string")
    assert [round(r.r, 6) for r in rows.select(ratio(F.col("a"), F.col("b")).alias("r")).collect()] == [1.0, 0.666667, 0.571429, 0.0]


def test_path_parts(spark):
    paths = ["/a/b/x.tar.GZ", "/a/.gitignore", "/a/README", "top.txt"]
    assert column(spark, paths, file_name) == ["x.tar.GZ", ".gitignore", "README", "top.txt"]
    assert column(spark, paths, extension) == [".gz", ".gitignore", "", ".txt"]
    assert column(spark, ["a.b.c", "plain"], stem) == ["a.b", "plain"]


def test_copy_marker_score(spark):
    assert column(spark, ["a.txt", "a (1).txt", "a - Copy.txt", "Kopya (2).txt"], copy_marker_score) == [0, 1, 3, 3]


def test_humanize(spark):
    sizes = [0, 1023, 1024, 1536, 1 << 20, -2048, (1 << 63) - 1, -(1 << 63)]
    assert column(spark, sizes, text.humanize, "long") == ["0 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "-2 KB", "8192 PB", "-8192 PB"]


def test_texts(spark):
    assert column(spark, [1.0, 0.9991, 0.856], text.similarity_text, "double") == ["100%", "100%", "86%"]
    assert column(spark, ["jpg, .PNG;gif  jpg", "", None], text.parse_extensions) == [[".jpg", ".png", ".gif"], [], []]
    assert column(spark, ["a", "a,b", 'say "x"', "l\nm"], text.csv_escape) == ["a", '"a,b"', '"say ""x"""', '"l\nm"']


def test_bits(spark):
    rows = spark.createDataFrame([(-1, 0), (5, 5), (-(1 << 63), 1)], "a long, b long")
    assert [r.d for r in rows.select(hamming(F.col("a"), F.col("b")).alias("d")).collect()] == [64, 0, 2]
    assert column(spark, [-1, 255, 0], hex16, "long") == ["f" * 16, "0" * 14 + "ff", "0" * 16]


@pytest.mark.parametrize("most", [0, 3, 8, 17])
def test_slices_share_out_the_bits_that_vary(most):
    agree = {i: 0.5 + i % 7 / 20 for i in range(5, 61)}
    masks, radius = sliced(agree, 100_000, most)
    assert radius == most // len(masks) and sum(masks) == sum(1 << i for i in agree) and sum(m.bit_count() for m in masks) == len(agree)
    assert sliced({}, 10, most) == ([0], 0) and sliced({3: 0.5}, 10, most)[0] == [8]


def test_slices_go_by_what_hashes_agree_in():
    fair = {i: 0.5 for i in range(64)}
    assert len(sliced(fair, 100, 0)[0]) == 1 and len(sliced(fair, 10**9, 8)[0]) <= 4
    # A bit that hardly tells hashes apart does not make a slice narrower for the others.
    masks, _ = sliced({i: 0.5 if i < 24 else 0.999 for i in range(64)}, 10_000, 3)
    assert max(m & 0xFFFFFF for m in masks) and all((m & 0xFFFFFF).bit_count() == 24 // len(masks) for m in masks)


def test_balls_and_chances():
    assert ball(0b1010, 1) == [0, 2, 8] and ball(0, 3) == [0] and len(ball((1 << 64) - 1, 2)) == 1 + 64 + 2016
    assert abs(chance([0.5] * 4, 1) - 5 / 16) < 1e-12 and chance([], 0) == 1 and abs(chance([0.9, 0.2], 2) - 1) < 1e-12
    assert signed((1 << 64) - 1) == -1 and signed(5) == 5 and signed(1 << 63) == -(1 << 63)


def test_dhash(spark):
    rising, flat = [x for _ in range(8) for x in range(9)], [7] * 72
    assert column(spark, [rising, flat], dhash, "array<int>") == [-1, 0]


def test_photo_measures(spark):
    grid = [(x * 37 + y * 91) % 256 for y in range(8) for x in range(8)]
    inner = [4 * grid[y * 8 + x] - grid[y * 8 + x - 1] - grid[y * 8 + x + 1] - grid[y * 8 + x - 8] - grid[y * 8 + x + 8] for y in range(1, 7) for x in range(1, 7)]
    want = sum(v * v for v in inner) / 36 - (sum(inner) / 36) ** 2
    assert column(spark, [grid], lambda g: photo.sharpness(g, 8, 8), "array<int>")[0] == pytest.approx(want)
    assert column(spark, [grid], photo.brightness, "array<int>")[0] == sum(grid) / 64


def test_flags_and_score(spark):
    rows = spark.createDataFrame([(10.0, 20.0, 400, 300, "Screenshot 1.png", ".png"), (900.0, 128.0, 4000, 3000, "a.jpg", ".jpg"), (200.0, 240.0, 1920, 1080, "x.png", ".png")], "s double, b double, w int, h int, n string, e string")
    c = [F.col(x) for x in "sbwhne"]
    got = rows.withColumn("f", photo.flags(*c)).withColumn("q", photo.score(*c[:4], F.col("f"))).collect()
    assert [list(r.f) for r in got] == [["Blurry", "Dark", "LowResolution", "Screenshot"], [], ["Overexposed", "Screenshot"]]
    assert [r.q for r in got] == [0, 100, 33]


def test_media(spark):
    assert column(spark, [".JPG", ".mkv", ".txt"], media.media_class) == ["Images", "Videos", "Other"]
    assert media.extensions_of(["Archives"], "foo; .BAR")[:3] == [".7z", ".bar", ".bz2"]


def test_video(spark):
    got = column(spark, [100.0], lambda d: sample_positions(d, 2), "double")[0]
    assert got == pytest.approx([8 + 43.5 * 0.5, 8 + 43.5 * 1.5])
    seeded = column(spark, [100.0], lambda d: sample_positions(d, 12, seed=5), "double")[0]
    assert seeded == sorted(seeded) and len(seeded) == 12
    rows = spark.createDataFrame([([1, 2, 255], [1])], "x array<long>, y array<long>")
    assert rows.select(frame_match(F.col("x"), F.col("y"), 2).alias("m")).first().m == 2.0
