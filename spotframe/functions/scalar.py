"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def gaussian_3d(z: Column, x: Column, y: Column, center: tuple, widths: tuple, height: Column) -> Column:
    total = F.lit(0.0)
    for v, c, w in zip((z, x, y), center, widths, strict=True):
        total = total + F.pow((v - c) / w, F.lit(2.0))
    return height * F.exp(-total / 2)


def gaussian_pdf(x: Column, mean: float, std: float) -> Column:
    return F.exp(-F.pow((x - mean) / std, F.lit(2.0)) / 2) / (std * (2 * 3.141592653589793) ** 0.5)


def negative_binomial_pmf(x: Column, r: int, p: float) -> Column:
    """For whole r: the binomial coefficient (x + r - 1 over r - 1) is a product of r - 1 factors."""
    out = F.lit(float(p**r)) * F.pow(F.lit(1 - p), x)
    for k in range(1, r):
        out = out * (x + k) / k
    return out


def exponential(d: Column, a: Column | float, b: Column | float, c: Column | float) -> Column:
    return F.lit(a) * F.exp(-F.lit(b) * d) + F.lit(c) if not isinstance(a, Column) else a * F.exp(-b * d) + c


def scaled_distance2(z1: Column, x1: Column, y1: Column, z2: Column, x2: Column, y2: Column, scale_z: float, scale_xy: float) -> Column:
    return F.pow((z1 - z2) * scale_z, F.lit(2.0)) + F.pow((x1 - x2) * scale_xy, F.lit(2.0)) + F.pow((y1 - y2) * scale_xy, F.lit(2.0))


def round_signed(value: Column, digits: int) -> Column:
    """Rounded double that keeps the sign of what rounds to zero (-0.0), as SQL engines that round in floating point have it; Spark's own ``round`` gives 0.0."""
    out = F.round(value, digits)
    return F.when(out == 0, value * 0.0).otherwise(out)


def vector_distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    term = (lambda x, y: F.abs(x - y)) if metric == "manhattan" else (lambda x, y: (x - y) * (x - y))
    total = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(total) if metric == "euclidean" else total


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def histogram_similarity(a: Column, b: Column, metric: str) -> Column:
    """Correlation, chisquare, intersection or bhattacharyya of two arrays of shares or counts."""
    n = F.size(a)
    if metric == "correlation":
        ma, mb = array_sum(a) / n, array_sum(b) / n
        top = array_sum(F.zip_with(a, b, lambda x, y: x * y)) - n * ma * mb
        var = lambda v, m: array_sum(F.transform(v, lambda x: x * x)) - n * m * m
        return F.try_divide(top, F.sqrt(var(a, ma) * var(b, mb)))
    if metric == "chisquare":
        return array_sum(F.zip_with(a, b, lambda x, y: F.when(x != 0, (x - y) * (x - y) / x).otherwise(0.0)))
    if metric == "intersection":
        return array_sum(F.zip_with(a, b, lambda x, y: F.least(x, y)))
    overlap = array_sum(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(overlap, F.sqrt(array_sum(a) * array_sum(b)))))


def molecules(nanomolar: Column, microns3: Column) -> Column:
    """Molecules at a concentration in a volume: 1 um3 is 1e-15 litres."""
    return nanomolar * 1e-9 * microns3 * 1e-15 * 6.02214076e23


def super_gaussian(d2: Column, intensity: float, sigma: float, power: float) -> Column:
    return intensity * F.exp(-F.pow(d2 / (2 * sigma**2), F.lit(float(power))))


def half_even(value: Column) -> Column:
    return F.rint(value)


def hash_order(*cols: Column, seed: int) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat_ws("_", *[c.cast("string") for c in cols], F.lit(str(seed))))
