"""Photo-quality measures of luma grids (flat arrays, row by row), flags and score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from twinfold.functions.media import is_screenshot

BLUR, DARK, BRIGHT, LOW_RESOLUTION = 120.0, 42.0, 238.0, 500
FLAGS = ["Blurry", "Dark", "Overexposed", "LowResolution", "Screenshot"]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def brightness(grid: Column) -> Column:
    """Mean of integer levels."""
    return _sum(grid) / F.size(grid)


def laplacians(grid: Column, width: int, height: int) -> Column:
    """4c - l - r - u - d of every interior cell."""
    inner = F.array(*(F.lit(y * width + x) for y in range(1, height - 1) for x in range(1, width - 1))) if width > 2 and height > 2 else F.array().cast("array<int>")
    return F.transform(inner, lambda i: (F.get(grid, i) * 4 - F.get(grid, i - 1) - F.get(grid, i + 1) - F.get(grid, i - width) - F.get(grid, i + width)).cast("bigint"))


def sharpness(grid: Column, width: int, height: int) -> Column:
    """Population variance of the Laplacian, never below 0; 0 without interior cells."""
    if width <= 2 or height <= 2:
        return F.lit(0.0)
    cells = laplacians(grid, width, height)
    n = (width - 2) * (height - 2)
    mean = _sum(cells) / n
    return F.greatest(F.lit(0.0), _sum(F.transform(cells, lambda v: v * v)) / n - mean * mean)


def flags(sharp: Column, bright: Column, width: Column, height: Column, name: Column, ext: Column, blur: float = BLUR, dark: float = DARK, low: int = LOW_RESOLUTION) -> Column:
    tests = [sharp < blur, bright < dark, bright > BRIGHT, F.greatest(width, height) < low, is_screenshot(name, ext, width, height)]
    return F.filter(F.array(*(F.when(t, F.lit(f)) for t, f in zip(tests, FLAGS, strict=True))), lambda f: f.isNotNull())


def score(sharp: Column, bright: Column, width: Column, height: Column, found: Column) -> Column:
    """0 to 100, cut to a whole number."""
    clear = F.greatest(F.lit(0.0), F.least(F.lit(60.0), sharp / 8))
    light = F.lit(25.0) - F.least(F.lit(25.0), F.abs(bright - 128) / 5)
    size = F.greatest(F.lit(0.0), F.least(F.lit(15.0), width.cast("double") * height / 1_000_000 * 3))
    total = clear + light + size - F.when(F.array_contains(found, "Blurry"), F.lit(20.0)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)).cast("int")
