"""Correction of binned reads for GC content and mappability.

The published correction is done by an external package; these are stand-ins of the same purpose, without a claim to its figures.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correct_reads(rows: DataFrame, how: str = "none") -> DataFrame:
    """reads from counts. none: as they are; median_gc: divided by the median of the cell's bins of like GC (5 % steps); loess: by a local quadratic in GC."""
    if how == "none":
        return rows.withColumn("reads", F.col("counts").cast("double"))
    if how == "median_gc":
        keyed = rows.withColumn("gc_step", F.floor(F.col("gc") / 5))
        medians = keyed.where("counts > 0").groupBy("cell_id", "gc_step").agg(F.median("counts").alias("own"))
        whole = keyed.where("counts > 0").groupBy("cell_id").agg(F.median("counts").alias("whole"))
        joined = keyed.join(medians, ["cell_id", "gc_step"], "left").join(whole, "cell_id", "left")
        return joined.withColumn("reads", F.try_divide(F.col("counts") * F.col("whole"), F.col("own"))).drop("gc_step", "own", "whole")
    if how != "loess":
        raise ValueError("how must be none, median_gc or loess")

    def one(cell: pd.DataFrame) -> pd.DataFrame:
        y, x = cell["counts"].to_numpy(dtype=float), cell["gc"].to_numpy(dtype=float)
        good = ~np.isnan(y) & (y > 0)
        trend = local_quadratic(x[good], y[good], x) if good.sum() >= 10 else np.full(len(y), np.nan)
        with np.errstate(all="ignore"):
            out = y / trend * np.median(y[good]) if good.any() else y
        return pd.DataFrame({"cell_id": cell["cell_id"], "bin_idx": cell["bin_idx"], "reads": [v if np.isfinite(v) else None for v in out]})

    kind = rows.schema["cell_id"].dataType.simpleString()
    made = rows.select("cell_id", "bin_idx", "counts", "gc").groupBy("cell_id").applyInPandas(one, f"cell_id {kind}, bin_idx int, reads double")
    return rows.join(made, ["cell_id", "bin_idx"])


def local_quadratic(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.65, points: int = 60) -> np.ndarray:
    """Tricube-weighted local quadratic fits at `points` places, interpolated between them."""
    places = np.linspace(x.min(), x.max(), points) if x.max() > x.min() else x[:1]
    k = max(4, int(np.ceil(span * len(x))))
    out = []
    for p in places:
        d = np.abs(x - p)
        width = max(np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1], 1e-9)
        w = np.clip(1 - (d / width) ** 3, 0, None) ** 3
        z = np.stack([np.ones(len(x)), x - p, (x - p) ** 2], axis=1)
        fit = np.linalg.lstsq(z * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        out.append(fit[0])
    return np.interp(at, places, out)
