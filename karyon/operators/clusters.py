"""Subclones: informative changepoints, nearest neighbours, affinities, a modularity partition."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import AFFINITIES
from .neighbours import nearest as nearest


def bin_mask(rows: DataFrame, least: float = 30, around: int = 2) -> DataFrame:
    """(bin_idx, keep): a bin whose mean count over cells is at most `least` is dropped, and so are those exactly `around` before and after it; a mean of NULL keeps its bin."""
    means = rows.groupBy("bin_idx").agg(F.avg("counts").alias("mean_count"))
    bad = means.where(F.col("mean_count") <= least).select(F.explode(F.array(F.col("bin_idx") - around, "bin_idx", F.col("bin_idx") + around)).alias("bin_idx")).distinct()
    return means.select("bin_idx").join(bad.withColumn("bad", F.lit(True)), "bin_idx", "left").select("bin_idx", F.col("bad").isNull().alias("keep"))


def changes(rows: DataFrame, mask: DataFrame, value: str) -> DataFrame:
    """(cell_id, place, bin_idx, change): steps of the value between kept bins that follow each other. place counts kept bins from 0; the first has no change."""
    kept = mask.where("keep").withColumn("place", (F.row_number().over(W.orderBy("bin_idx")) - 1).cast("int")).drop("keep")  # bins of one genome
    own = rows.select("cell_id", "bin_idx", F.col(value).alias("value")).join(F.broadcast(kept), "bin_idx")
    w = W.partitionBy("cell_id").orderBy("place")
    return own.withColumn("change", F.col("value") - F.lag("value").over(w)).where("place > 0").drop("value")


def select_changepoints(steps: DataFrame, least_step: float = 0.1, low: float = 0.05, high: float = 0.9) -> DataFrame:
    """(place, share): places where the share of cells with two or more large steps among the place and its two neighbours is strictly between low and high."""
    w = W.partitionBy("cell_id").orderBy("place")
    flag = F.coalesce(F.abs(F.col("change")) > least_step, F.lit(False)).cast("int")
    flagged = steps.withColumn("flag", flag)
    near = F.sum("flag").over(w.rowsBetween(-1, 1))
    inner = F.lag("place").over(w).isNotNull() & F.lead("place").over(w).isNotNull()
    # at either end the flag stands alone, so it never exceeds 1
    counted = flagged.select("place", F.when(inner & (near > 1), 1).otherwise(0).alias("hit"))
    return counted.groupBy("place").agg(F.avg("hit").alias("share")).where((F.col("share") > low) & (F.col("share") < high))


def changepoint_places(selected: DataFrame, steps: DataFrame, window: int = 2) -> DataFrame:
    """(place, ord): the selected places, each with those `window` before and after, within bounds and once; ord is their order of appearance."""
    last = steps.agg(F.max("place").alias("last"))
    listed = selected.select(F.posexplode(F.array(F.col("place") - window, "place", F.col("place") + window)).alias("part", "p"), F.col("place").alias("from"))
    inside = listed.join(F.broadcast(last)).where((F.col("p") > 0) & (F.col("p") <= F.col("last")))
    first = inside.groupBy("p").agg(F.min(F.struct("part", "from")).alias("first"))
    return first.select(F.col("p").alias("place"), (F.row_number().over(W.orderBy("first")) - 1).cast("int").alias("ord"))  # places of one genome


def changepoint_features(steps: DataFrame, places: DataFrame) -> DataFrame:
    """(cell_id, features): each cell's steps at the places, in order; a step of NULL is 0."""
    own = steps.join(F.broadcast(places), "place")
    listed = own.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("change", F.lit(0.0)).cast("double").alias("change")))).alias("all"))
    return listed.select("cell_id", F.transform("all", lambda f: f["change"]).alias("features"))


def neighbour_edges(knn: DataFrame, features: DataFrame, method: str | Callable[[Column, Column], Column] = "inv_manhattan", id_col: str = "cell_id") -> DataFrame:
    """(src, dst, weight): each neighbour but the first, without loops, weighted by the affinity of the two feature arrays.

    method is a name in AFFINITIES or a function of two array columns (a pandas UDF of two arrays will do).
    """
    affinity = AFFINITIES[method] if isinstance(method, str) else method
    x = features.select(F.col(id_col).alias("src"), F.col("features").alias("x"))
    y = features.select(F.col(id_col).alias("dst"), F.col("features").alias("y"))
    pairs = knn.where("rank > 1 and src <> dst").select("src", "dst").join(x, "src").join(y, "dst")
    return pairs.select("src", "dst", affinity(F.col("x"), F.col("y")).alias("weight"))


def modularity(edges: DataFrame, membership: DataFrame, id_col: str = "cell_id", weight: str | None = None) -> DataFrame:
    """(modularity): of the undirected multigraph of edges under (id, label); unweighted unless a weight column is named."""
    w = F.col(weight) if weight else F.lit(1.0)
    lab = membership.select(F.col(id_col).alias("id"), "label")
    rows = edges.select("src", "dst", w.alias("w")).join(lab.withColumnsRenamed({"id": "src", "label": "a"}), "src").join(lab.withColumnsRenamed({"id": "dst", "label": "b"}), "dst")
    ends = rows.select("w", F.explode(F.array("a", "b")).alias("label"), (F.col("a") == F.col("b")).alias("inside"))
    by = ends.groupBy("label").agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("inside"), F.col("w") / 2).otherwise(0.0)).alias("inside"))
    total = by.agg((F.sum("degree") / 2).alias("m"))
    return by.join(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m") - (F.col("degree") / (2 * F.col("m"))) * (F.col("degree") / (2 * F.col("m")))).alias("modularity"))


def modularities(edges: DataFrame, membership: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """(nr, modularity): of the unweighted undirected multigraph of edges under each of some partitions (nr, id, label)."""
    lab = membership.select("nr", F.col(id_col).alias("id"), "label")
    rows = edges.select("src", "dst").join(lab.withColumnsRenamed({"id": "src", "label": "a"}), "src").join(lab.withColumnsRenamed({"id": "dst", "label": "b"}), ["nr", "dst"])
    ends = rows.select("nr", F.explode(F.array("a", "b")).alias("label"), (F.col("a") == F.col("b")).alias("inside"))
    by = ends.groupBy("nr", "label").agg(F.count("*").alias("degree"), (F.count_if("inside") / 2).alias("inside"))
    m = F.sum("degree") / 2
    return by.groupBy("nr").agg((F.sum("inside") / m - F.sum(F.col("degree").cast("double") * F.col("degree")) / (4 * m * m)).alias("modularity"))


def collapse_small(membership: DataFrame, least: int = 5) -> DataFrame:
    """Labels of clusters with fewer than `least` members become 0."""
    sizes = membership.groupBy("label").agg(F.count("*").alias("n"))
    return membership.join(sizes, "label").withColumn("label", F.when(F.col("n") < least, F.lit(0)).otherwise(F.col("label"))).drop("n")


def gauss_smooth(rows: DataFrame, value: str, n: int) -> DataFrame:
    """smoothed: sums of n neighbouring bins weighted by a Gaussian of deviation n / 6, scaled to 1 at the middle; 0 where the kernel does not fit."""
    if n % 2 == 0:
        raise ValueError("n must be odd")
    half = n // 2
    weights = [float(np.exp(-0.5 * ((i - half) / (n / 6)) ** 2)) for i in range(n)]
    w = W.partitionBy("cell_id").orderBy("bin_idx")
    total = sum((F.lit(x) * F.lag(F.col(value), half - i).over(w) for i, x in enumerate(weights)), F.lit(0.0))
    fits = F.count("*").over(w.rowsBetween(-half, half)) == n
    return rows.withColumn("smoothed", F.when(fits, total).otherwise(0.0))
