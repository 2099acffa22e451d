"""Keys, folds and orders from hashes: the same on every run and every machine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def short_sha1(x, n: int = 12) -> Column:
    return F.substring(F.sha1(_c(x).cast("string").cast("binary")), 1, n)


def entity_id(x, n: int = 20) -> Column:
    return F.substring(F.sha2(_c(x).cast("string").cast("binary"), 256), 1, n)


def hash_order(seed: int | str, x) -> Column:
    """A text to order by: sha256 of seed and id."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), _c(x).cast("string")).cast("binary"), 256)


def hash_number(seed: int | str, x) -> Column:
    """48 bits of sha1 of seed and id, as a number."""
    return F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), _c(x).cast("string")).cast("binary")), 1, 12), 16, 10).cast("bigint")


def fold(seed: int | str, x, k: int) -> Column:
    return (hash_number(seed, x) % k).cast("int")


def fraction(seed: int | str, x) -> Column:
    """A number from 0 to 1."""
    return hash_number(seed, x) / F.lit(float(2**48 - 1))


def entity_fraction(x) -> Column:
    return F.conv(F.substring(F.sha2(_c(x).cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("bigint") / F.lit(float(0xFFFFFFFF))


def distinct_mapped(df, column: str, fn, to: str):
    """df with fn(column), computed once for each distinct value: for costly functions of values that recur."""
    values = df.select(column).distinct()
    return df.join(values.withColumn(to, fn(F.col(column))), column, "left")
