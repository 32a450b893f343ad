"""Values as people read them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of sizes.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def _fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def bytes_text(c: Column) -> Column:
    """1536 as 1.5 KB; nothing, and less than nothing, as 0 B."""
    out = F.lit("0 B")
    for i, unit in enumerate(BYTE_UNITS):
        out = F.when(c >= F.lit(1024.0**i), F.concat(_fixed(c / F.lit(1024.0**i), 1 if i else 0), F.lit(f" {unit}"))).otherwise(out)
    return F.when(c.isNull(), "0 B").otherwise(out)


def count_text(c: Column, millions: int = 1) -> Column:
    """1500 as 1.5k, two millions as 2.0M (``millions`` digits); null as 0."""
    n = F.coalesce(c, F.lit(0))
    return F.when(n >= 1_000_000, F.concat(_fixed(n / 1e6, millions), F.lit("M"))).when(n >= 1_000, F.concat(_fixed(n / 1e3, 1), F.lit("k"))).otherwise(n.cast("string"))


def tokens_text(c: Column) -> Column:
    """count_text() with two digits of millions; nothing, and less than nothing, as 0."""
    return F.when(F.coalesce(c, F.lit(0)) <= 0, "0").otherwise(count_text(c, 2))


def duration_text(ms: Column) -> Column:
    """125000 as 2m 05s; a dash for null and less than nothing."""
    s = F.floor(ms / 1000 + F.lit(0.5))
    long = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))
    return F.when(ms.isNull() | (ms < 0), "—").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(long)


def short_id(c: Column) -> Column:
    """The first eight characters of an id."""
    return F.left(c, F.lit(8))
