"""Video sample positions and frame-set similarity."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

from twinfold.functions.bits import hamming

#: Frames of a video up to which comparisons are written out.
WRITTEN_OUT = 4


def sample_positions(duration: Column, samples: int = 12, intro: float = 0.08, outro: float = 0.05, seed: int = 0, key: Column | None = None) -> Column:
    """Seconds at which frames are taken: one in each of equal parts of what is left between intro and outro.

    Seed 0 takes the middle of each part; any other takes a place given by a hash of seed, key and part.
    """
    n = max(2, min(60, samples))
    intro, outro = max(0.0, min(0.4, intro)), max(0.0, min(0.4, outro))
    start, window = duration * intro, F.greatest(duration * (1 - intro - outro), F.lit(0.5))
    part = window / n
    offset = (lambda i: F.lit(0.5)) if not seed else (lambda i: F.pmod(F.xxhash64(F.lit(seed), key if key is not None else F.lit(0), i), F.lit(1_000_003)) / 1_000_003)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + part * (i + offset(i)))


def frame_match(xs: Column, ys: Column, most: int, longest: int | None = None) -> Column:
    """Frames of x that are within ``most`` bits of any of y's, over the smaller number of frames.

    Where no array is longer than ``longest`` and that is ``WRITTEN_OUT`` at most, the comparisons are written out one by one, which Spark compiles.
    """
    if longest is not None and longest <= WRITTEN_OUT:
        near = lambda i: reduce(or_, (hamming(F.get(xs, F.lit(i)), F.get(ys, F.lit(j))) <= most for j in range(longest)))
        hits = reduce(add, (F.when(near(i), 1).otherwise(0) for i in range(longest)))
    else:
        hits = F.size(F.filter(xs, lambda h: F.exists(ys, lambda g: hamming(h, g) <= most)))
    return hits / F.least(F.size(xs), F.size(ys))
