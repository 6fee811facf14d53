"""Bounded training samples, chosen by hash so that every run takes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Hash values that decide who is in.
STEPS = 1_000_000


def remainder(key: str, m: int) -> Column:
    """CRC-32 of the key's decimal text, modulo ``m``; a null key counts as 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % m, F.lit(0))


def bounded(df: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by`` (a column of few values), or all where there are fewer."""
    share = {r[by]: most / r["count"] for r in df.groupBy(by).count().collect() if r[by] is not None and r["count"] > most}
    if not share:
        return df
    limit = F.lit(STEPS)
    for value, part in share.items():
        limit = F.when(F.col(by) == F.lit(value), F.lit(int(part * STEPS))).otherwise(limit)
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(STEPS)) < limit)
