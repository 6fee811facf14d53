"""Filters of a scan over the canonical files schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinfold.options import ScanOptions


def distinct_roots(roots: list[str]) -> list[str]:
    """Roots in order, without those that differ in case only or by a trailing separator."""
    seen: dict[str, str] = {}
    for r in roots:
        seen.setdefault((r.rstrip("/") or "/").lower(), r)
    return list(seen.values())


def size_between(least: int = 0, most: int = 0) -> Column:
    length = F.col("length")
    return (length >= least if least > 0 else F.lit(True)) & (length <= most if most > 0 else F.lit(True))


def extension_allowed(include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Exclusion wins over inclusion; an empty include list allows all."""
    ext = F.lower("extension")
    out = F.lit(True)
    if exclude:
        out = out & ~ext.isin([e.lower() for e in exclude])
    return out & ext.isin([e.lower() for e in include]) if include else out


def outside(folders: tuple[str, ...] = ()) -> Column:
    """Not in an excluded folder or below it; case makes no difference."""
    out, at = F.lit(True), F.lower("directory_name")
    for f in folders:
        f = (f.rstrip("/") or "/").lower()
        out = out & ~((at == f) | at.startswith(f if f == "/" else f + "/"))
    return out


def once(files: DataFrame) -> DataFrame:
    """Each path once, though nested roots list it twice."""
    return files.dropDuplicates(["full_path"])


def apply(files: DataFrame, options: ScanOptions) -> DataFrame:
    return files.filter(size_between(options.min_bytes, options.max_bytes) & extension_allowed(options.include_extensions, options.exclude_extensions) & outside(options.excluded_folders))
