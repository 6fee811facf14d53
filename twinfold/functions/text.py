"""Display texts and option parsers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Units of size texts.
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _plain(x: Column) -> Column:
    """At most two decimals, trailing zeros dropped."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), "0+$", ""), r"\.$", "")


def humanize(size: Column) -> Column:
    """Bytes in steps of 1024, at most PB; a negative size is the text of its amount with a sign."""
    amount = F.abs(size.cast("decimal(20,0)")).cast("double")
    out = F.concat(_plain(amount / 1024 ** (len(UNITS) - 1)), F.lit(f" {UNITS[-1]}"))
    for k in range(len(UNITS) - 2, 0, -1):
        out = F.when(amount < 1024 ** (k + 1), F.concat(_plain(amount / 1024**k), F.lit(f" {UNITS[k]}"))).otherwise(out)
    out = F.when(amount < 1024, F.concat(amount.cast("long").cast("string"), F.lit(" B"))).otherwise(out)
    return F.concat(F.when(size < 0, F.lit("-")).otherwise(F.lit("")), out)


def similarity_text(x: Column) -> Column:
    return F.when(x >= 0.999, F.lit("100%")).otherwise(F.concat(F.round(x * 100).cast("int").cast("string"), F.lit("%")))


def similarity_number(x: Column) -> Column:
    """At most three decimals."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", x), "0+$", ""), r"\.$", "")


def resolution(width: Column, height: Column) -> Column:
    return F.when(width > 0, F.concat(width.cast("string"), F.lit("×"), height.cast("string"))).otherwise(F.lit("-"))


def megapixels(width: Column, height: Column) -> Column:
    return width.cast("double") * height / 1_000_000


def megapixels_text(width: Column, height: Column) -> Column:
    """One decimal, halves rounded up; exact, as it is counted in whole hundred thousands. A size of zero is a dash."""
    tenths = F.floor((width.cast("long") * height.cast("long") + 50_000) / 100_000).cast("long")
    return F.when((width > 0) & (height > 0), F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))).otherwise(F.lit("-"))


def parse_extensions(text: Column) -> Column:
    """Distinct extensions of a list split at commas, semicolons and spaces: lower case, with a dot."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[,; ]+"), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.when(p.startswith("."), p).otherwise(F.concat(F.lit("."), p))))


def csv_escape(text: Column) -> Column:
    """Quoted, quotes doubled, where a comma, a quote or a line feed makes it needed."""
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
