"""Column references and coercions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Reference a column whose name may hold dots."""
    return F.col(quoted(name))


def to_numeric(c: Column) -> Column:
    """Double value; NULL for what is not a number, NaN included. Both zeros are one."""
    value = c.try_cast("double") + F.lit(0.0)
    return F.when(~F.isnan(value), value)


def to_category(c: Column) -> Column:
    return c.cast("string")


def null_markers(c: Column, markers: Iterable[str]) -> Column:
    """NULL where the text equals one of the markers."""
    return F.when(~c.isin(list(markers)), c)


def positive_label(c: Column, needle: str | None = None) -> Column:
    """0/1 label: substring test on text, integer class otherwise."""
    if needle is None:
        return c.cast("int")
    return F.coalesce(c.cast("string").contains(needle), F.lit(False)).cast("int")


def hash_bucket(key: Column, seed: int, buckets: int = 10_000) -> Column:
    """Bucket 0..buckets-1 that depends on the key and the seed only."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.pmod(
        F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)
    )


def hash_order(key: Column, seed: int) -> Column:
    """Pseudo-random order key of 52 bits, exact as a double."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
