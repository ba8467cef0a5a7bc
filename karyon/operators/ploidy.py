"""Ploidy of each cell from overlap ratios, and its correction within groups of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .bins import bin_quality, bin_summary, focal_selector, good_bins, on_all_bins
from .fragments import enough_fragments, length_filter, load_fragments
from .overlaps import count_overlaps


def ploidy_bins(bedpe: DataFrame, bins: DataFrame, size: int, min_length: int = 50, max_length: float | None = None, tag_overlap: int = 10, focal: bool = True, window: int = 1, how: str = "intended", least_fragments: int = 100, cells: DataFrame | None = None) -> DataFrame:
    """A row for each cell and bin with all measures and bin_ratio. A cell with too few fragments keeps its rows, with NULLs, and so does one of `cells` (cell_id) without any.

    Fragments are dealt by cell once, and so are the bins with the cells' grid; all measures, limits and counts are windows and aggregates within these."""
    fragments = load_fragments(bedpe, tag_overlap, how)
    counted = count_overlaps(length_filter(enough_fragments(fragments, least_fragments), min_length, max_length), min_length, window)
    rows = bin_quality(on_all_bins(bin_summary(counted, size), bins, _listed(bedpe, cells)))
    rows = focal_selector(rows) if focal else rows.withColumn("depth_ok", F.lit(True))
    selected = F.col("depth_ok") & good_bins()
    return rows.withColumn("selected", selected).withColumn("bin_ratio", F.when(F.col("selected"), ratio("norm_over", "norm_upstream")))


def _listed(rows: DataFrame, cells: DataFrame | None) -> DataFrame:
    own = rows.select("cell_id")
    return own if cells is None else own.unionByName(cells.select("cell_id"))


def cell_ploidy(rows: DataFrame) -> DataFrame:
    """(cell_id, selected_bins, mean_ratio, est_ploidy): 1 / (1 - mean ratio), neither clamped nor checked."""
    means = rows.groupBy("cell_id").agg(F.count("bin_ratio").alias("selected_bins"), F.avg("bin_ratio").alias("mean_ratio"))
    return means.withColumn("est_ploidy", ratio(F.lit(1.0), 1 - F.col("mean_ratio")))


def with_ploidy(rows: DataFrame) -> DataFrame:
    """rows with their cell's est_ploidy, as `cell_ploidy` has it; a window, so what made the rows runs once."""
    return rows.withColumn("est_ploidy", ratio(F.lit(1.0), 1 - F.avg("bin_ratio").over(W.partitionBy("cell_id"))))


def trusted(cells: DataFrame, min_reads: int) -> DataFrame:
    return cells.where((F.col("est_ploidy") > 0) & (F.col("est_ploidy") < 10) & (F.col("total_reads") > min_reads))


def group_means(cells: DataFrame, min_reads: int = 100_000, least: int = 10) -> DataFrame:
    """(group, n_trusted, mean_ploidy): over a group's trusted cells; NULL for a group with `least` or fewer of them."""
    means = trusted(cells, min_reads).groupBy("group").agg(F.count("*").alias("n_trusted"), F.avg("est_ploidy").alias("mean_ploidy"))
    groups = cells.select("group").distinct().join(means, "group", "left").withColumn("n_trusted", F.coalesce("n_trusted", F.lit(0)).cast("long"))
    return groups.withColumn("mean_ploidy", F.when(F.col("n_trusted") > least, F.col("mean_ploidy")))


def two_means(cells: DataFrame, min_reads: int = 100_000, least: int = 10) -> DataFrame:
    """(group, low_centre, high_centre, separation) of the best split of a group's trusted ploidies in two.

    In one dimension the best split is a cut of the sorted values, so running sums give the exact optimum.
    separation is the share of the squares between the two; groups with fewer than two values have no row.
    """
    order = W.partitionBy("group").orderBy("est_ploidy", "cell_id")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("group")
    p = F.col("est_ploidy")
    rows = trusted(cells, min_reads).select("group", p, F.lead(p).over(order).alias("following"), F.count("*").over(upto).alias("n1"), F.sum(p).over(upto).alias("s1"), F.count("*").over(whole).alias("n"), F.sum(p).over(whole).alias("s"), F.sum(p * p).over(whole).alias("ss"))
    cuts = rows.where((F.col("following") > p) & (F.col("n") > least)).withColumns(
        {
            "low_centre": F.col("s1") / F.col("n1"),
            "high_centre": (F.col("s") - F.col("s1")) / (F.col("n") - F.col("n1")),
            "total": F.col("ss") - F.col("s") * F.col("s") / F.col("n"),
        }
    )
    between = F.col("n1") * F.col("low_centre") * F.col("low_centre") + (F.col("n") - F.col("n1")) * F.col("high_centre") * F.col("high_centre") - F.col("s") * F.col("s") / F.col("n")
    cuts = cuts.withColumn("separation", F.try_divide(between, F.col("total")))
    return cuts.groupBy("group").agg(F.max_by(F.struct("low_centre", "high_centre", "separation"), F.struct("separation", -F.col("n1"))).alias("best")).select("group", "best.*")


def correct_ploidy(cells: DataFrame, min_reads: int = 100_000, least: int = 10, call_wgd: bool = True, least_separation: float = 0.7) -> DataFrame:
    """cells with wgd and corr_ploidy: the group's mean, doubled for cells nearer the upper centre of a well separated group."""
    rows = cells.join(group_means(cells, min_reads, least).drop("n_trusted"), "group", "left").join(two_means(cells, min_reads, least), "group", "left")
    nearer = F.abs(F.col("est_ploidy") - F.col("high_centre")) < F.abs(F.col("est_ploidy") - F.col("low_centre"))
    wgd = F.coalesce((F.col("separation") > least_separation) & nearer, F.lit(False)) & F.lit(call_wgd)
    return rows.withColumn("wgd", wgd).withColumn("corr_ploidy", F.col("mean_ploidy") * F.when(F.col("wgd"), 2).otherwise(1)).drop("mean_ploidy", "low_centre", "high_centre", "separation")
