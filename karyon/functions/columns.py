"""Column expressions shared by the operators. NULL stands for R's NA and for what is not finite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; NULL if b is 0, where R has Inf or NaN that later steps drop."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def strand_of(name: Column, r1: Column, r2: Column, n: int = 3) -> Column:
    """The last n characters of NAME:R1/R2."""
    return F.right(F.concat(name, F.lit(":"), r1, F.lit("/"), r2), F.lit(n))


def bin_start(start: Column | str, size: Column | int) -> Column:
    """1-based start of the bin that holds a 0-based place."""
    size = F.lit(size) if isinstance(size, int) else size
    return (F.floor(col(start) / size) * size + 1).cast("long")


def gaussian_log_density(values: Column, mean: Column, sigma: Column) -> Column:
    return -0.5 / (sigma * sigma) * (values - mean) * (values - mean) - F.log(sigma) - F.lit(0.9189385332046727)


def inv_manhattan(x: Column | str, y: Column | str) -> Column:
    """1 / (1 + L1 distance) of two arrays."""
    total = F.aggregate(F.zip_with(col(x), col(y), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: s + d)
    return 1 / (1 + total)


def inv_wasserstein(x: Column | str, y: Column | str) -> Column:
    """1 / (1 + sum of absolute differences of running sums). Arrays of different length raise an error."""
    differences = F.when(F.size(col(x)) == F.size(col(y)), F.zip_with(col(x), col(y), lambda a, b: a - b)).otherwise(F.raise_error(F.lit("x and y must be of the same length")))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda s, d: F.struct((s["run"] + d).alias("run"), (s["sum"] + F.abs(s["run"] + d)).alias("sum"))
    return 1 / (1 + F.aggregate(differences, start, step, lambda s: s["sum"]))


def inv_ccc(x: Column | str, y: Column | str) -> Column:
    """1 - Lin's concordance: 2 s_xy / (s_x^2 + s_y^2 + (mean x - mean y)^2), with sums over n in all three. NULL if that is 0/0."""
    x, y = col(x), col(y)
    n = F.size(x).cast("double")
    add = lambda s, v: s + v
    mx, my = F.aggregate(x, F.lit(0.0), add) / n, F.aggregate(y, F.lit(0.0), add) / n
    xx = F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), add) / n - mx * mx
    yy = F.aggregate(F.transform(y, lambda v: v * v), F.lit(0.0), add) / n - my * my
    xy = F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), add) / n - mx * my
    return 1 - F.try_divide(2 * xy, xx + yy + (mx - my) * (mx - my))


AFFINITIES = {"inv_manhattan": inv_manhattan, "inv_wasserstein": inv_wasserstein, "inv_ccc": inv_ccc}
