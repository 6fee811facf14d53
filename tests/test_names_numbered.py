"""Names that differ in their numbers only: all pairs, and few candidates."""

import random

import pytest

from twinfold.operators import names


def near(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(last[j] + (x != y), last[j + 1] + 1, now[j] + 1))
        last = now
    return 1 - last[-1] / max(len(a), len(b))


def given(spark, words):
    return spark.createDataFrame(list(enumerate(words)), "name_id long, name string")


def test_numbered_names_are_not_all_compared(spark):
    """They have the beginning in common, which is more than half of each."""
    words = [f"item {k}" for k in range(9000, 12000)]
    assert names.candidates(given(spark, words), 0.85).count() < 0.1 * len(words) ** 2 / 2


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85, 1.0])
def test_short_and_long_names_lose_no_pair(spark, threshold):
    """Lengths on both sides of what counts as short, with letters changed, dropped and added, the last and repeated ones too."""
    rng = random.Random(7)
    words = ["a", "ab", "aa", "aaa", "aaab", "b"] + ["x" + "".join(rng.choice("01") for _ in range(rng.randrange(0, 6))) + "y" * rng.randrange(24) for _ in range(70)]
    words += [f"item {k}" for k in range(95, 125)]
    words = list(dict.fromkeys(words))
    wanted = {(i, j): round(near(x, y), 9) for i, x in enumerate(words) for j, y in enumerate(words) if i < j and x[0] == y[0] and near(x, y) >= threshold}
    found = [(r.a, r.b, round(r.ratio, 9)) for r in names.pairs(given(spark, words), threshold).collect()]
    assert sorted(found) == sorted((*k, v) for k, v in wanted.items())
