"""Integer copy numbers: reads per copy of each cell, fitted over candidate modal states."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, gaussian_log_density
from .segment import with_array


def modal_states(ploidy: Column | str) -> Column:
    """Array of candidate states: floor(e) to the half-even rounding of 1.75 e, above 0, of a ploidy e brought to 2 if under 0.5 and to 15 if over 15; 2 to 8 for NULL."""
    e = col(ploidy)
    e = F.when(e < 0.5, F.lit(2.0)).when(e > 15, F.lit(15.0)).otherwise(e)
    low, high = F.greatest(F.floor(e).cast("int"), F.lit(1)), F.rint(e * 1.75).cast("int")
    return F.when(e.isNull(), F.sequence(F.lit(2), F.lit(8))).otherwise(F.sequence(low, high))


def est_cn(values: Column | str, rpcn: Column | str, sigma: Column | str) -> tuple[Column, Column]:
    """(nearest integer state, Gaussian log density of the value around it)."""
    v, r, s = col(values), col(rpcn), col(sigma)
    state = F.rint(v / r)
    return state, gaussian_log_density(v, state * r, s)


def bin_noise(rows: DataFrame) -> DataFrame:
    """(cell_id, sigma): 0.9 times the sample deviation of segmented - reads; a zero becomes the least positive one of all cells."""
    own = rows.groupBy("cell_id").agg((0.9 * F.stddev_samp(F.col("segmented") - F.col("reads"))).alias("own"))
    least = own.agg(F.min(F.when(F.col("own") > 0, F.col("own"))).alias("least"))
    return own.join(F.broadcast(least)).select("cell_id", F.when(F.col("own") == 0, F.col("least")).otherwise(F.col("own")).alias("sigma"))


def usable(rows: DataFrame, least: float = 1e-3) -> DataFrame:
    return rows.where(F.col("segmented") > least)


def _states(ploidy: float | None) -> np.ndarray:
    """The same as `modal_states`."""
    if ploidy is None or np.isnan(ploidy):
        return np.arange(2, 9)
    e = 2.0 if ploidy < 0.5 else 15.0 if ploidy > 15 else ploidy
    return np.arange(max(int(np.floor(e)), 1), int(np.rint(e * 1.75)) + 1)


def _best_of_grid(v: np.ndarray, sigma: float, ploidy: float | None, steps: int) -> tuple[int, float, float]:
    """(state, rpcn, score) of one cell's usable bins: all candidates against all bins as one matrix."""
    n, known = len(v), ploidy is not None and not np.isnan(ploidy)
    inside = np.abs(v - v.mean()) / sigma < 3
    mid = inside if inside.sum() >= 100 else np.ones(n, bool)
    null = v.min() + (np.arange(n) + 0.5) / n * (v.max() - v.min())
    states, peak = _states(ploidy), np.median(v)
    low, high = peak / (states + 0.5), peak / (states - 0.5)
    rpcn = (low[:, None] + (high - low)[:, None] * np.arange(steps + 1) / steps).ravel()[:, None]
    squares = lambda x: (x - np.rint(x / rpcn) * rpcn) ** 2
    own, reference = squares(v[None, :]), squares(null[None, :])
    constant = -np.log(sigma) - 0.5 * np.log(2 * np.pi)
    loglik = lambda s: -s.sum(axis=1) / (2 * sigma * sigma) + s.shape[1] * constant
    fit, score = loglik(own[:, mid]) - loglik(reference), loglik(own[:, mid]) - loglik(reference[:, mid])
    if known:
        score -= 0.5 * mid.sum() * ((np.rint(v[None, :] / rpcn).mean(axis=1) - ploidy) / ploidy) ** 2
    tuned = np.round(fit, 6).reshape(len(states), -1).argmax(axis=1) + np.arange(len(states)) * (steps + 1)  # the first of equal ones
    i = int(np.round(score[tuned], 6).argmax())
    return int(states[i]), float(rpcn[tuned[i], 0]), float(score[tuned[i]])


def fit_grid(rows: DataFrame, cells: DataFrame, steps: int = 40, least: float = 1e-3) -> DataFrame:
    """(cell_id, state, rpcn, score): the best of `steps` + 1 values of reads per copy for each modal state.

    cells has sigma and ploidy (NULL: unknown). The middle bins are those within 3 sigma of the mean, or all if fewer than
    100 are. The null values are the midpoints of as many equal parts of the range of the bins as there are bins. A cell's
    bins are one array of a genome's length; cells go through one Arrow map in batches, and one cell's candidates and bins are a matrix in it.
    """
    vectors = usable(rows, least).groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin_idx", F.col("segmented").cast("double").alias("segmented")))), lambda b: b["segmented"]).alias("v"))
    vectors = vectors.join(cells.select("cell_id", F.col("sigma").cast("double").alias("sigma"), F.col("ploidy").cast("double").alias("ploidy")), "cell_id")

    def best(v: pa.Array, sigma: pa.Array, ploidy: pa.Array) -> pa.Array:
        made = [_best_of_grid(np.array(x), s, p, steps) if s is not None and s > 0 else (None, None, None) for x, s, p in zip(v.to_pylist(), sigma.to_pylist(), ploidy.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.float64()))], names=["state", "rpcn", "score"])

    return vectors.withColumn("b", F.arrow_udf(best, "state int, rpcn double, score double")("v", "sigma", "ploidy")).select("cell_id", "b.*")


def _log_density(v: np.ndarray, rpcn: float, sigma: float) -> np.ndarray:
    return -0.5 * (v - np.rint(v / rpcn) * rpcn) ** 2 / sigma**2 - np.log(sigma) - 0.5 * np.log(2 * np.pi)


def minimise(f, low: float, high: float, tolerance: float = 1.5e-8, most: int = 200) -> float:
    """A local minimum of f between low and high: golden sections, with a parabola through the three best points where it is trusted."""
    golden = 0.5 * (3 - np.sqrt(5))
    x = w = v = low + golden * (high - low)
    fx = fw = fv = f(x)
    step = before = 0.0
    for _ in range(most):
        middle = 0.5 * (low + high)
        near = tolerance * abs(x) + tolerance / 3
        if abs(x - middle) <= 2 * near - 0.5 * (high - low):
            break
        use_golden = True
        if abs(before) > near:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p = (x - v) * q - (x - w) * r
            q = 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(0.5 * q * before) and q * (low - x) < p < q * (high - x):
                before, step = step, p / q
                if x + step - low < 2 * near or high - x - step < 2 * near:
                    step = near if x < middle else -near
                use_golden = False
        if use_golden:
            before = (low if x >= middle else high) - x
            step = golden * before
        u = x + (step if abs(step) >= near else np.copysign(near, step))
        fu = f(u)
        if fu <= fx:
            low, high = (x, high) if u >= x else (low, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            low, high = (u, high) if u < x else (low, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x


def fit_means(values: np.ndarray, sigma: float, ploidy: float | None, null: str = "grid", seed: int = 0) -> tuple[np.ndarray, float | None]:
    """(copy number of each value, reads per copy). NaN stays NaN; without a usable value all are NaN."""
    out = np.full(len(values), np.nan)
    with np.errstate(invalid="ignore"):
        good = values > 1e-3
    v = values[good]
    if not len(v) or not sigma > 0:
        return out, None
    known = ploidy is not None and not np.isnan(ploidy)
    e = 2.0 if known and ploidy < 0.5 else 15.0 if known and ploidy > 15 else ploidy
    states = [m for m in range(int(np.floor(e)), int(np.rint(e * 1.75)) + 1) if m > 0] if known else list(range(2, 9))
    peak = float(np.median(v))
    mid = np.abs(v - v.mean()) / sigma < 3
    if mid.sum() < 100:
        mid[:] = True
    low, high = v.min(), v.max()
    if null == "grid":
        reference = low + (np.arange(len(v)) + 0.5) / len(v) * (high - low)
    else:
        reference = np.random.default_rng(seed).uniform(low, high, len(v))
    best = (-np.inf, None)
    for m in states:
        loss = lambda r: _log_density(reference, r, sigma).sum() - _log_density(v[mid], r, sigma).sum()
        rpcn = minimise(loss, peak / (m + 0.5), peak / (m - 0.5))
        score = _log_density(v, rpcn, sigma)[mid].sum() - _log_density(reference, rpcn, sigma)[mid].sum()
        if known:
            score -= 0.5 * mid.sum() * ((np.rint(v / rpcn).mean() - ploidy) / ploidy) ** 2
        if score > best[0]:
            best = (score, rpcn)
    return np.rint(values / best[1]), best[1]


def copy_call(rows: DataFrame, cells: DataFrame, null: str = "grid", seed: int = 0) -> DataFrame:
    """rows (cell_id, bin_idx, segmented, ...) with copy; cells has sigma and ploidy. One Arrow map over cells' arrays of bins."""

    def fitted(values: pa.Array, sigma: pa.Array, ploidy: pa.Array) -> pa.Array:
        out = []
        for v, s, p in zip(values.to_pylist(), sigma.to_pylist(), ploidy.to_pylist(), strict=True):
            states, _ = fit_means(np.array(v, dtype=float), np.nan if s is None else s, p, null, seed)
            out.append([None if np.isnan(x) else int(x) for x in states])
        return pa.array(out, pa.list_(pa.int32()))

    fit = F.arrow_udf(fitted, "array<int>")
    joined = rows.drop("copy").join(cells.select("cell_id", F.col("sigma").cast("double").alias("__sigma"), F.col("ploidy").cast("double").alias("__ploidy")), "cell_id")
    one = lambda array, c: F.element_at(array(c), 1)
    return with_array(joined, lambda array: fit(array("segmented").cast("array<double>"), one(array, "__sigma"), one(array, "__ploidy")), "copy", "int").drop("__sigma", "__ploidy")
