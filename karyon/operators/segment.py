"""Noise, scaling and segmentation of each cell's binned reads.

The unbalanced Haar transform looks at a cell's whole vector, so it gets a cell's bins as one array (those of a genome, some thousands, whatever the
number of cells), a batch of cells at a time. All steps around it are windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import MAD_SCALE


def scale_reads(rows: DataFrame, total: float = 10_000) -> DataFrame:
    """reads scaled so that a cell's sum is `total`; NULL bins stay NULL."""
    sums = F.sum("reads").over(W.partitionBy("cell_id"))
    return rows.withColumn("__all", sums).withColumn("reads", F.try_divide(F.col("reads") * F.lit(float(total)), F.col("__all"))).drop("__all")


def mad_offset(rows: DataFrame, value: str = "reads") -> DataFrame:
    """(cell_id, sigma): 1.4826 times the median absolute deviation of sqrt(2) times the absolute steps between neighbouring values."""
    present = rows.where(F.col(value).isNotNull())
    step = F.lit(float(np.sqrt(2))) * F.abs(F.col(value) - F.lag(value).over(W.partitionBy("cell_id").orderBy("bin_idx")))
    steps = present.select("cell_id", step.alias("x")).where("x is not null")
    centre = steps.groupBy("cell_id").agg(F.median("x").alias("m"))
    return steps.join(centre, "cell_id").groupBy("cell_id").agg((MAD_SCALE * F.median(F.abs(F.col("x") - F.col("m")))).alias("sigma"))


def haar_reconstructions(vectors: list[np.ndarray], sigmas: list[float]) -> list[np.ndarray]:
    """Best unbalanced Haar transform of each vector, coefficients up to sigma sqrt(2 log n) set to zero, and its inverse.

    An interval is split where the Haar coefficient of its two parts is largest in absolute value (the first such place). All intervals of a
    level, of all vectors, are looked at in one pass over their running sums.
    """
    sizes = np.array([len(v) for v in vectors], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] if len(sizes) else np.zeros(0, np.int64)  # running sums have a place more than the vector
    total = np.concatenate([np.zeros(0), *(np.concatenate([[0.0], np.cumsum(v)]) for v in vectors)])
    out = np.concatenate([np.zeros(0), *(np.full(len(v) + 1, v.mean() if len(v) else 0.0) for v in vectors)])
    limit = np.array([s * np.sqrt(2 * np.log(n)) if n > 1 else 0.0 for s, n in zip(sigmas, sizes, strict=True)])
    a, b, most = first, first + sizes, limit
    while True:
        long_ = b - a >= 2
        a, b, most = a[long_], b[long_], most[long_]
        if not len(a):
            break
        n = b - a - 1
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        of = np.repeat(np.arange(len(a)), n)
        cut = np.arange(n.sum()) - begin[of] + a[of] + 1
        left, right, size = cut - a[of], b[of] - cut, (b - a)[of]
        c = np.sqrt(right / (size * left)) * (total[cut] - total[a][of]) - np.sqrt(left / (size * right)) * (total[b][of] - total[cut])
        height = np.abs(c)
        at_top = np.flatnonzero(height == np.maximum.reduceat(height, begin)[of])
        k = at_top[np.unique(of[at_top], return_index=True)[1]]
        strong = np.flatnonzero(height[k] > most)
        for i, j in zip(strong.tolist(), k[strong].tolist(), strict=True):
            out[a[i] : cut[j]] += c[j] * np.sqrt(right[j] / (size[j] * left[j]))
            out[cut[j] : b[i]] -= c[j] * np.sqrt(left[j] / (size[j] * right[j]))
        a, b, most = np.concatenate([a, cut[k]]), np.concatenate([cut[k], b]), np.concatenate([most, most])
    return [out[f : f + n] for f, n in zip(first, sizes, strict=True)]


def haar_reconstruction(x: np.ndarray, sigma: float) -> np.ndarray:
    return haar_reconstructions([np.asarray(x, float)], [sigma])[0]


def _mad_offset(x: np.ndarray) -> float:
    steps = np.sqrt(2) * np.abs(np.diff(x))
    return float(MAD_SCALE * np.median(np.abs(steps - np.median(steps)))) if len(steps) else 0.0


#: Values whose intervals are looked at together.
TOGETHER = 500_000


def _haar(values: pa.Array) -> pa.Array:
    """Of each cell's values: the thresholded reconstruction, as `haar_segments` says."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)  # NULL is NaN
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    group = ends // TOGETHER
    out = np.full(len(flat), np.nan)
    for g in np.unique(group):
        spans = [flat[e - n : e] for e, n in zip(ends[group == g].tolist(), sizes[group == g].tolist(), strict=True)]
        real = [x[~np.isnan(x)] for x in spans]
        made = haar_reconstructions(real, [_mad_offset(x) for x in real])
        for x, own, found, e in zip(spans, real, made, ends[group == g].tolist(), strict=True):
            out[e - len(x) : e][~np.isnan(x)] = np.where((own == 0) | (found < 0), 0, found)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out, pa.float64(), mask=np.isnan(out)))


def with_array(rows: DataFrame, made: Callable[[Callable[[str], Column]], Column], name: str, kind: str) -> DataFrame:
    """rows with a column computed from whole cells: made gets a function from a column's name to its array in order of bins, and returns an array. One shuffle by cell; nothing is joined back."""
    others = [c for c in rows.columns if c not in ("cell_id", name)]
    whole = rows.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("bin_idx", *[F.col(c) for c in others if c != "bin_idx"]))).alias("__bins"))  # bins of one genome
    both = whole.withColumn("__made", made(lambda c: F.transform("__bins", lambda b: b[c])))
    each = both.select("cell_id", F.inline(F.arrays_zip("__bins", F.col("__made").cast(f"array<{kind}>").alias("__made"))).alias("__bin", "__one"))
    return each.select("cell_id", *[F.col(f"__bin.{c}").alias(c) for c in others], F.col("__one").alias(name))


def haar_segments(rows: DataFrame, value: str = "reads") -> DataFrame:
    """rows with haar: the thresholded reconstruction; 0 where the value is 0 or the reconstruction negative, NULL where the value is."""
    transform = F.arrow_udf(_haar, "array<double>")
    return with_array(rows, lambda array: transform(array(value).cast("array<double>")), "haar", "double")


def bridge_gaps(rows: DataFrame, raw: str = "reads", segmented: str = "haar") -> DataFrame:
    """A NULL bin takes the next bin's value, in one step, so only the last of a run is filled; the final bin takes the one before it."""
    w = W.partitionBy("cell_id").orderBy("bin_idx")
    fill = F.coalesce(F.lead(segmented).over(w), F.when(F.lead("bin_idx").over(w).isNull(), F.lag(segmented).over(w)))
    return rows.withColumn(segmented, F.when(F.col(raw).isNull(), fill).otherwise(F.col(segmented)))


def repair_singlets(rows: DataFrame, raw: str = "reads", segmented: str = "haar") -> DataFrame:
    """Steps of one bin: a high one far from its raw value takes the raw value; then one below the upper tenth takes the next bin's value.

    A cell's limits are windows over its rows: nothing is joined to its own aggregates, so what made the rows (the transform) runs once."""
    cell = W.partitionBy("cell_id")
    w = cell.orderBy("bin_idx")
    s = F.col(segmented)
    singlet = F.coalesce((s != F.lag(s).over(w)) & (s != F.lead(s).over(w)), F.lit(False))
    marked = rows.withColumn("singlet", singlet).withColumn("q", F.percentile(segmented, F.array(F.lit(0.05), F.lit(0.95), F.lit(0.9))).over(cell))
    marked = marked.withColumn("bin_var", F.var_samp(F.when((s > F.col("q")[0]) & (s < F.col("q")[1]), s)).over(cell))
    high = F.col("singlet") & (F.abs(s - F.col(raw)) > F.col("bin_var")) & (s > F.col("q")[2])
    raised = marked.withColumn("raised", F.when(F.coalesce(high, F.lit(False)), F.col(raw)).otherwise(s))
    again = raised.withColumn("q9", F.percentile("raised", 0.9).over(cell))
    low = F.coalesce(F.col("singlet") & (F.col("raised") < F.col("q9")), F.lit(False))
    return again.withColumn("segmented", F.when(low, F.lead("raised").over(w)).otherwise(F.col("raised"))).drop("q", "singlet", "bin_var", "raised", "q9")


def segment(rows: DataFrame, value: str = "reads") -> DataFrame:
    """rows with segmented and bin_depth = reads / segmented."""
    done = repair_singlets(bridge_gaps(haar_segments(rows, value), value), value).drop("haar")
    return done.withColumn("bin_depth", F.try_divide(F.col(value), F.col("segmented")))
