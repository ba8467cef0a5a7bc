"""Genome bins and the summary of fragments by bin.

Bins are a small annotation table (bins of a genome, whatever the number of cells). It is joined, not collected; Catalyst broadcasts it if it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bin_start, ratio
from ..sources.shared import computed_once
from .fragments import dealt

MEASURES = ["bin_reads", "count_upstream", "norm_upstream", "count_over", "norm_over", "bin_coverage", "avg_length", "num_doublets", "olap_count"]


def make_bins(spark: SparkSession, chrom_sizes: list[tuple[str, int]], bin_size: int) -> DataFrame:
    """(bin_idx, chromosome, start, end), 1-based closed; the last bin of a chromosome ends with it."""
    sizes = spark.createDataFrame([(k, c, n) for k, (c, n) in enumerate(chrom_sizes)], "ord int, chromosome string, size long")
    cut = sizes.select("ord", "chromosome", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / bin_size))).alias("b"))
    offsets = sizes.select(F.col("ord").alias("o"), F.ceil(F.col("size") / bin_size).alias("n"))
    before = sizes.join(offsets, F.col("o") < F.col("ord"), "left").groupBy("ord").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("offset"))
    rows = cut.join(before, "ord")
    return rows.select((F.col("offset") + F.col("b")).cast("int").alias("bin_idx"), "chromosome", (F.col("b") * bin_size + 1).alias("start"), F.least((F.col("b") + 1) * bin_size, F.col("size")).alias("end"))


def bin_size(bins: DataFrame) -> int:
    return int(bins.agg(F.max(F.col("end") - F.col("start"))).first()[0]) + 1


def bin_summary(counted: DataFrame, size: int) -> DataFrame:
    """Nine measures of each cell's fragments by the bin of their start; bins without fragments have no row."""
    keyed = counted.withColumn("bin_start", bin_start("start", size))
    return keyed.groupBy("cell_id", "chr", "bin_start").agg(
        F.count("*").alias("bin_reads"),
        F.sum("count_upstream").alias("count_upstream"),
        F.sum("norm_upstream").alias("norm_upstream"),
        F.sum("count_over").alias("count_over"),
        F.sum("norm_over").alias("norm_over"),
        F.sum("length").alias("bin_coverage"),
        F.avg("length").alias("avg_length"),
        F.sum(F.col("doublet").cast("int")).alias("num_doublets"),
        F.sum("olap_count").alias("olap_count"),
    )


#: Rows of cells x bins of a task.
GRID_ROWS = 300_000


def cells_with_bins(rows: DataFrame, bins: DataFrame, cells: DataFrame) -> DataFrame:
    """A row for each cell and bin, with the bin's columns and those of rows (cell_id, bin_idx, ...; one for each cell and bin at most), NULL where there is none. Cells are those of `cells`.

    Rows and cells are dealt by cell together, to tasks that grow in number and not in rows, and only there a cell is laid out over the bins; what follows by cell needs no further shuffle.
    """
    own = computed_once(cells.select("cell_id").distinct())
    n = int(bins.count())
    measures = [c for c in rows.columns if c not in ("cell_id", "bin_idx")]
    both = dealt(rows.where("bin_idx IS NOT NULL").unionByName(own, allowMissingColumns=True), own.count() * n, GRID_ROWS)
    places = F.when(F.col("bin_idx").isNull(), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array("bin_idx"))
    laid = both.where(F.lit(n > 0)).select("cell_id", F.explode(places).alias("bin_idx"), *measures)
    return laid.groupBy("cell_id", "bin_idx").agg(*[F.max(c).alias(c) for c in measures]).join(F.broadcast(bins), "bin_idx")


def on_all_bins(summary: DataFrame, bins: DataFrame, cells: DataFrame) -> DataFrame:
    """A row for each cell and bin; measures of empty bins are NULL, not 0. The grid is what the result is: cells x bins rows."""
    keyed = summary.withColumnRenamed("bin_start", "start").withColumn("chromosome", F.expr("substring(chr, 4)")).drop("chr")
    found = keyed.join(F.broadcast(bins.select("bin_idx", "chromosome", "start")), ["chromosome", "start"]).drop("chromosome", "start")
    return cells_with_bins(found, bins, cells)


def bin_quality(rows: DataFrame) -> DataFrame:
    """Coverage by bases (end - start), share of doublets, and their ratio."""
    coverage = ratio("bin_coverage", F.col("end") - F.col("start"))
    doublets = ratio("num_doublets", "bin_reads")
    return rows.withColumns({"bin_coverage": coverage, "bin_prop_doublets": doublets, "bin_quality": ratio(coverage, doublets)})


def good_bins(least_mappability: float = 90, least_bases: float = 90) -> Column:
    return F.coalesce((F.col("mappability") >= least_mappability) & (F.col("bases") >= least_bases) & F.col("use"), F.lit(False))


def focal_selector(rows: DataFrame, low: float = 0.1, high: float = 0.9, least: int = 50) -> DataFrame:
    """depth_ok: overlap count strictly between the cell's quantiles; true everywhere in a cell with fewer than `least` such bins."""
    cell = W.partitionBy("cell_id")
    q_low, q_high = F.percentile("olap_count", low).over(cell), F.percentile("olap_count", high).over(cell)
    flagged = rows.withColumn("__low", q_low).withColumn("__high", q_high)
    flagged = flagged.withColumn("__between", F.coalesce((F.col("olap_count") > F.col("__low")) & (F.col("olap_count") < F.col("__high")), F.lit(False)))
    return flagged.withColumn("depth_ok", (F.sum(F.col("__between").cast("int")).over(cell) < least) | F.col("__between")).drop("__low", "__high", "__between")
