"""Hamming and frame-set joins over skewed, narrow and constant hashes: all pairs, and few candidates."""

import random

import pytest
from pyspark.sql import functions as F

from twinfold.functions.bits import signed
from twinfold.operators import hamming, perceptual
from twinfold.operators.components import components


def points(spark, values):
    return spark.createDataFrame([(k, signed(v)) for k, v in enumerate(values)], "id long, h long")


def every(values, most):
    return sorted((a, b, n) for a, x in enumerate(values) for b in range(a + 1, len(values)) if (n := (x ^ values[b]).bit_count()) <= most)


def skewed(rng, n):
    """A family with 40 bits in common, one with all but the top bits in common, narrow hashes, and single bits."""
    family, other = rng.getrandbits(64), rng.getrandbits(64)
    out = [(family & (1 << 40) - 1) | rng.getrandbits(24) << 40 for _ in range(n)]
    out += [(other & (1 << 44) - 1) | rng.getrandbits(12) << 44 for _ in range(n // 2)]
    out += [rng.getrandbits(16) for _ in range(n // 2)] + [rng.getrandbits(64) for _ in range(n // 2)] + [1 << k for k in range(64)]
    out += [x ^ 1 << rng.randrange(64) for x in out[: n // 4]]
    out = list(dict.fromkeys(out))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("most", [0, 2, 9, 30])
def test_skewed_hashes_lose_no_pair(spark, monkeypatch, most):
    monkeypatch.setattr(hamming, "HEAVY", 8)
    values = skewed(random.Random(most), 60)
    got = sorted((r.a, r.b, r.bits) for r in hamming.hash_pairs(points(spark, values), most).collect())
    assert got == every(values, most)
    if most == 2:
        monkeypatch.setattr(hamming, "BROADCAST", -1)
        assert sorted((r.a, r.b, r.bits) for r in hamming.hash_pairs(points(spark, values), most).collect()) == got


def test_hashes_that_are_null_equal_or_absent(spark):
    rows = spark.createDataFrame([(1, None), (2, 7), (3, 7), (4, None)], "id long, h long")
    assert [(r.a, r.b, r.bits) for r in hamming.hash_pairs(rows, 3).collect()] == [(2, 3, 0)]
    assert hamming.hash_pairs(rows.filter("false"), 3).count() == 0 and hamming.hash_pairs(rows.filter("id = 2"), 64).count() == 0


def test_constant_bits_bring_nothing_together(spark):
    """24 varying bits, or 20: what meets stays far below all pairs."""
    rng = random.Random(1)
    for bits, shift, most in ((24, 0, 2), (20, 37, 2)):
        values = list(dict.fromkeys(rng.getrandbits(bits) << shift | 5 << 60 for _ in range(3000)))
        met = hamming.candidates(points(spark, values), most).count()
        assert met < 0.05 * len(values) ** 2 / 2


def test_common_slices_are_refined(spark):
    """A third of the hashes share 44 bits, in which most slices lie: they meet by their other bits only."""
    rng = random.Random(2)
    family = rng.getrandbits(44)
    values = list(dict.fromkeys([family | rng.getrandbits(20) << 44 for _ in range(2500)] + [rng.getrandbits(64) for _ in range(5000)]))
    df = points(spark, values)
    met = hamming.candidates(df, 2).count()
    assert met < 0.05 * 2500**2 / 2
    assert hamming.hash_pairs(df, 2).count() == len(every_fast(values, 2))


def every_fast(values, most):
    import numpy as np

    x = np.array(values, np.uint64)
    return [(i, j) for i in range(len(x)) for j in (np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= most) + i + 1).tolist()]


# Frame sets


def videos(spark, sets):
    return spark.createDataFrame([(k, 1000 - k % 7, f) for k, f in sets], "file_id long, length long, frame_hashes array<long>")


def share(x, y, most):
    hits = sum(g is not None and any(q is not None and (g ^ q).bit_count() <= most for q in y) for g in x)
    return hits / min(len(x), len(y))


def linked(sets, most, least):
    rows = sorted((k, [None if g is None else g & (1 << 64) - 1 for g in f]) for k, f in sets if f)
    return {(a, b, s) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if (s := share(x, y, most)) >= max(least, 1e-9)}


def many(rng, n=70):
    black, base = 0, [rng.getrandbits(16) for _ in range(40)]
    out = []
    for k in range(n):
        f = [rng.choice(base) ^ (1 << rng.randrange(16) if rng.random() < 0.4 else 0) for _ in range(rng.choice([1, 2, 3, 4, 4, 4, 9]))]
        f += [black] * rng.choice([1, 1, 2])
        if rng.random() < 0.1:
            f[rng.randrange(len(f))] = None
        out.append((k, f))
    out += [(n, []), (n + 1, None), (n + 2, [black]), (n + 3, [None, None, 5]), (n + 4, [None, None, 5]), (n + 5, out[3][1]), (n + 6, out[3][1][::-1])]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("least", [0.0, 0.6, 1.0, 1.5])
def test_frame_pairs_lose_none(spark, least):
    sets = many(random.Random(int(least * 10)))
    got = {(r.a, r.b, r.share) for r in perceptual.frame_pairs(videos(spark, sets), 2, least).collect()}
    assert got == linked(sets, 2, least)


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_video_clusters_are_those_of_all_pairs(spark, least):
    sets = many(random.Random(7), 50)
    got = {(r.node, r.component) for r in perceptual.video_clusters(videos(spark, sets), 1, least).collect()}
    edges = spark.createDataFrame([(a, b) for a, b, _ in linked(sets, 1, least)], "u long, v long")
    assert got == {(r.node, r.component) for r in components(edges).collect()}


def test_frame_that_all_videos_share_brings_none_together(spark):
    """16-bit frames, one of them black in every video: few of all pairs are compared."""
    rng = random.Random(9)
    sets = [(k, [0, 0, *(rng.getrandbits(16) for _ in range(8))]) for k in range(1500)]
    sets += [(5000 + k, sets[k][1][:9] + [rng.getrandbits(16)]) for k in range(30)]
    df = videos(spark, sets).cache()
    compared = perceptual.frame_candidates(df, 1)
    assert compared.count() < 0.05 * 1530 * 1529 / 2
    found = {(r.a, r.b) for r in compared.filter("share >= 0.6").collect()}
    assert {(k, 5000 + k) for k in range(30)} <= found


@pytest.mark.parametrize("spread", [0, 3])
def test_links_outside_the_largest_component_are_all_found(spark, monkeypatch, spread):
    """Many sets that are all linked, pairs that are linked with none of them, and copies, compared with a few sets first."""
    monkeypatch.setattr(perceptual, "FIRST", 4)
    rng = random.Random(5 + spread)
    base = [rng.getrandbits(16) for _ in range(12)]
    sets = [(k, [rng.choice(base) ^ 1 << rng.randrange(16) for _ in range(rng.choice([2, 3, 4]))]) for k in range(160)]
    for k in range(160, 220, 2):
        pair = [rng.getrandbits(40) << 20 for _ in range(3)]  # far from all others
        sets += [(k, pair), (k + 1, [g ^ 1 << rng.randrange(60) if spread else g for g in pair[::-1]])]
    sets += [(230 + k, [rng.getrandbits(60), rng.getrandbits(60)]) for k in range(10)] + [(250, sets[0][1][::-1])]
    rng.shuffle(sets)
    seen = []
    links = perceptual._Frames.links
    monkeypatch.setattr(perceptual._Frames, "links", lambda self, some=None: seen.append(some if some is None else some.count()) or links(self, some))
    got = {(r.node, r.component) for r in perceptual.video_clusters(videos(spark, sets), 2).collect()}
    edges = spark.createDataFrame([(a, b) for a, b, _ in linked(sets, 2, 0.6)], "u long, v long")
    assert got == {(r.node, r.component) for r in components(edges).collect()}
    assert len(seen) == 2 and 0 < seen[0] < 110 and 0 < seen[1] < 190, seen


def test_copies_of_a_video_are_one_node(spark):
    sets = [(k, [1 << 9, 1 << 20, 3]) for k in range(400)] + [(900, [5 << 40, 7 << 50])]
    members, reasons = perceptual.detect_videos(videos(spark, sets), 2)
    assert members.count() == 400 and reasons.first().signature == "video:400" and members.agg(F.max("pos")).first()[0] == 399
    assert perceptual.needed(5, 0.6) == 3 and perceptual.needed(3, 1 / 3) == 1 and perceptual.needed(4, 0.0) == 1 and perceptual.needed(2, 1.5) == 3
