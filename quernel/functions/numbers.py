"""Safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rate(a, b) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def f1(p, r) -> Column:
    return rate(2 * _c(p) * _c(r), _c(p) + _c(r))


def safe_double(x, default: float = 0.0) -> Column:
    """A number from anything; the default for what is none, for NaN and for infinities."""
    v = _c(x).cast("string").try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def score_or_low(x) -> Column:
    """A routing score; missing and non-finite ones rank below all."""
    return safe_double(x, float("-inf"))


def clamped(x, low: float, high: float) -> Column:
    return F.greatest(F.least(_c(x), F.lit(high)), F.lit(low))


def sigmoid(x) -> Column:
    """1 / (1 + e^-x) that never overflows."""
    x = _c(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def standardised(x, mean, sd) -> Column:
    """z-score; a spread of next to nothing counts as one."""
    sd = _c(sd)
    return (_c(x) - _c(mean)) / F.when(F.coalesce(sd, F.lit(0.0)) < 1e-8, F.lit(1.0)).otherwise(sd)


def tanimoto(a, b) -> Column:
    """Of two bit sets held as long integers in arrays."""
    ones = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + F.bit_count(x))
    both = ones(F.zip_with(_c(a), _c(b), lambda x, y: x.bitwiseAND(y)))
    return rate(both, ones(F.zip_with(_c(a), _c(b), lambda x, y: x.bitwiseOR(y))))


def pixel_box(box, width, height) -> Column:
    """A relative box (x1, y1, x2, y2) in pixels, clamped to the image."""
    b = _c(box)
    side = lambda i, n: F.greatest(F.lit(0), F.least(F.bround(b[i] * _c(n)).cast("int"), _c(n)))
    return F.array(side(0, width), side(1, height), side(2, width), side(3, height))


def nearest_rank(values, p: float) -> Column:
    """Percentile by nearest rank of an ascending array, the rank rounded half to even."""
    v = _c(values)
    return F.try_element_at(v, F.bround((F.size(v) - 1) * F.lit(p)).cast("int") + 1)


def floor_rank(values, p: float) -> Column:
    v = _c(values)
    return F.try_element_at(v, F.floor((F.size(v) - 1) * F.lit(p)).cast("int") + 1)
