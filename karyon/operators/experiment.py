"""The annotated set of cells, and the end-to-end analyses."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import computed_once
from . import clusters, communities, copyfit, ploidy, segment
from .bins import bin_size, cells_with_bins
from .correct import correct_reads

GENOMES = ("hg38", "hg19", "hs1", "mm10")


@dataclass(frozen=True)
class CellExperiment:
    """cells keyed by cell_id, bins keyed by bin_idx, cell_bins keyed by both; changepoints holds cells' features once computed."""

    cells: DataFrame
    bins: DataFrame
    cell_bins: DataFrame
    changepoints: DataFrame | None = None


def cell_qc(rows: DataFrame, null_total: bool = False) -> DataFrame:
    """(cell_id, total_reads, state_variance, est_ploidy, coverage, est_genome_size). With null_total, one NULL bin makes total_reads NULL."""
    residual = F.col("reads") - F.col("segmented")
    total = F.sum("counts")
    if null_total:
        total = F.when(F.count("counts") == F.count("*"), total)
    return rows.groupBy("cell_id").agg(
        total.alias("total_reads"),
        F.sqrt(F.sum(residual * residual) / F.count("*")).alias("state_variance"),
        F.avg("est_ploidy").alias("est_ploidy"),
        F.avg("bin_coverage").alias("coverage"),
        F.avg("bin_quality").alias("est_genome_size"),
    )


def bin_names(bins: DataFrame) -> DataFrame:
    return bins.withColumn("bin_name", F.concat("chromosome", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


#: Rows of a task that makes rows of a wide matrix.
PIVOT_ROWS = 500_000


def pivot_matrix(rows: DataFrame, value: str, bins: list[int] | None = None) -> DataFrame:
    """cells x bins, a column bin_<idx> for each bin: for export; inside, rows stay long. Cells are dealt before anything is grouped, to tasks that grow in number and not in rows."""
    if bins is None:
        bins = [r[0] for r in rows.select("bin_idx").distinct().orderBy("bin_idx").collect()]  # bins of one genome
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // PIVOT_ROWS)
    one = rows.select("cell_id", "bin_idx", value).repartition(parts, "cell_id").groupBy("cell_id", "bin_idx").agg(F.first(value, ignorenulls=True).alias("value"))
    listed = one.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("bin_idx").isNotNull(), F.struct("bin_idx", "value")))).alias("values"))
    return listed.select("cell_id", *[F.try_element_at("values", F.lit(b)).alias(f"bin_{b}") for b in bins])


def total_counts(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("cell_id").agg(F.sum(value).alias("total"))


def unpivot_matrix(wide: DataFrame, value: str = "value", key: str = "cell_id") -> DataFrame:
    """(cell_id, col, value) of a wide matrix."""
    return wide.unpivot(key, [c for c in wide.columns if c != key], "col", value)


def process_batch(
    bins: DataFrame, bedpe: DataFrame | None = None, reads: DataFrame | None = None, genome: str = "hg38", min_length: int = 50, max_length: float | None = None, tag_overlap: int = 10, focal_amps: bool = True, window: int = 1, correction: str = "none", how: str = "intended", least_fragments: int = 100, cells: DataFrame | None = None
) -> CellExperiment:
    """Loads, corrects, scales, segments and estimates ploidy of all cells.

    bedpe: rows of all cells with cell_id; reads: (cell_id, bin_idx, counts) from BAM files. With reads, they are corrected and scaled to
    10,000 a cell; with bedpe alone, the counts are its fragments by bin and are not scaled; without bedpe there is no ploidy.
    cells: a list (cell_id) of all cells of the run, as a manifest or `bedpe.cells_of_files` gives it; a cell without rows stays to the end, with NULLs.
    """
    if genome not in GENOMES:
        raise ValueError(f"genome must be one of {', '.join(GENOMES)}")
    if bedpe is None and reads is None:
        raise ValueError("give bedpe, reads, or both")
    rows = None
    if bedpe is not None:
        rows = ploidy.ploidy_bins(bedpe, bins, bin_size(bins), min_length, max_length, tag_overlap, focal_amps, window, how, least_fragments, cells)
        rows = ploidy.with_ploidy(rows)
    if reads is not None:
        own = reads.select("cell_id", "bin_idx", F.col("counts").cast("double").alias("counts"))
        if rows is None:
            rows = _read_grid(own, bins, cells).withColumns({c: F.lit(None).cast("double") for c in ("est_ploidy", "bin_coverage", "bin_quality")})
        else:
            rows = rows.join(own, ["cell_id", "bin_idx"], "left")
        rows = segment.scale_reads(correct_reads(rows, correction))
    else:
        rows = correct_reads(rows.withColumn("counts", F.col("bin_reads").cast("double")), correction)
    rows = computed_once(segment.segment(rows))  # every later step reads it
    return CellExperiment(cell_qc(rows), bin_names(bins), rows)


def _read_grid(own: DataFrame, bins: DataFrame, cells: DataFrame | None) -> DataFrame:
    """A row for each cell and bin: bins without reads have 0 in a cell with any, NULL in one without."""
    own = computed_once(own)
    listed = own.select("cell_id") if cells is None else own.select("cell_id").unionByName(cells.select("cell_id"))
    counted = cells_with_bins(own, bins, listed)
    some = F.max("counts").over(W.partitionBy("cell_id")).isNotNull()
    return counted.withColumn("counts", F.when(some, F.coalesce("counts", F.lit(0.0))))


def from_bin_reads(rows: DataFrame, bins: DataFrame) -> CellExperiment:
    """From (cell_id, bin_idx, counts, reads) binned elsewhere; segments here."""
    made = segment.segment(rows)
    return CellExperiment(total_counts(made, "counts").withColumnRenamed("total", "total_reads"), bin_names(bins), made)


def copy_calls(x: CellExperiment, null: str = "grid", seed: int = 0) -> CellExperiment:
    """copy in cell_bins, bin_noise in cells. Uses corr_ploidy of cells if there, else states 2 to 8."""
    noise = copyfit.bin_noise(x.cell_bins)
    known = F.col("corr_ploidy") if "corr_ploidy" in x.cells.columns else F.lit(None).cast("double")
    cells = x.cells.join(noise, "cell_id")
    rows = copyfit.copy_call(x.cell_bins, cells.select("cell_id", "sigma", known.alias("ploidy")), null, seed)
    return replace(x, cells=cells.withColumnRenamed("sigma", "bin_noise"), cell_bins=rows)


def identify_subclones(x: CellExperiment, assay: str = "copy", k: int = 30, resolution: float | str = "auto", method="inv_manhattan", min_size: int = 5, seed: int = 1234, least_count: float = 30, column: str = "subclone") -> CellExperiment:
    """Adds `column` to cells: clusters of cells by changepoints; 0 for clusters under min_size. Without informative changepoints all cells are one cluster."""
    mask = clusters.bin_mask(x.cell_bins, least_count)
    steps = computed_once(clusters.changes(x.cell_bins, mask, assay))
    places = computed_once(clusters.changepoint_places(clusters.select_changepoints(steps), steps))
    features = computed_once(clusters.changepoint_features(steps, places))
    ids = x.cells.select("cell_id")
    if not places.limit(1).count():
        labels = ids.withColumn("label", F.lit(1))
    else:
        n = int(features.count())
        knn = clusters.nearest(features, min(k, n), "cell_id")
        edges = computed_once(clusters.neighbour_edges(knn, features, method))
        found = best_partition(edges, ids, seed) if resolution == "auto" else communities.partition(edges, ids, float(resolution), seed=seed)
        found = computed_once(found)
        numbers = found.groupBy("label").agg(F.count("*").alias("n"))
        numbers = numbers.select("label", F.row_number().over(W.orderBy(F.desc("n"), "label")).alias("number"))  # clusters, not cells
        labels = computed_once(found.join(numbers, "label").select("cell_id", F.col("number").alias("label")))
    labels = clusters.collapse_small(labels, min_size).withColumnRenamed("label", column)
    return replace(x, cells=x.cells.drop(column).join(labels, "cell_id", "left"), changepoints=features)


#: Bounds of the resolution, and resolutions within them that are tried first.
RESOLUTION_LEAST, RESOLUTION_MOST = 1e-4, 10.0
RESOLUTIONS = (1.0, 0.5, 2.0, 0.1, 5.0)


#: Resolutions of a section that are evaluated at the same time: with 7, two sections come from a factor of 2 to each side to the width.
SECTION = 7


def search_resolution(edges: DataFrame, ids: DataFrame, seed: int = 1234, width: float = 0.1, id_col: str = "cell_id") -> tuple[float, float, DataFrame]:
    """(resolution, modularity, partition) of the greatest modularity between the bounds; of equal ones the resolution nearest to 1.

    A driver's search whose evaluations are Spark jobs on one stored graph: the first resolutions together, then `SECTION` equal steps of the logarithm together
    between the neighbours of the best, until these are `width` apart. Each resolution is evaluated once; those of the sections start from the best partition so far.
    """
    edges = computed_once(edges.select("src", "dst", "weight"))
    graph = communities.summed_graph(edges)
    known: dict[float, tuple[float, DataFrame]] = {}

    def look(logs: list[float], start: DataFrame | None = None) -> None:
        logs = [x for x in dict.fromkeys(round(x, 9) for x in logs) if x not in known]
        if logs:
            found = computed_once(communities.partition_graphs(graph, ids, [math.exp(x) for x in logs], seed, id_col, start))
            scores = {r.nr: r.modularity for r in clusters.modularities(edges, found, id_col).collect()}  # a row for each resolution
            known.update({x: (scores.get(i) or 0.0, found.where(F.col("nr") == i).drop("nr")) for i, x in enumerate(logs)})

    def best() -> float:
        return max(known, key=lambda x: (round(known[x][0], 9), -abs(x)))

    def around() -> tuple[float, float]:
        ends = sorted({*known, math.log(RESOLUTION_LEAST), math.log(RESOLUTION_MOST)})
        i = ends.index(best())
        return ends[max(i - 1, 0)], ends[min(i + 1, len(ends) - 1)]

    look([math.log(r) for r in RESOLUTIONS])
    low, high = around()
    while high - low > width:
        look([low + (high - low) * i / (SECTION + 1) for i in range(1, SECTION + 1)], known[best()][1])
        low, high = around()
    return math.exp(best()), *known[best()]


def best_partition(edges: DataFrame, ids: DataFrame, seed: int = 1234) -> DataFrame:
    return search_resolution(edges, ids, seed)[2]


def ploidy_correction(x: CellExperiment, min_reads: int = 100_000, k: int = 45, call_wgd: bool = True, least_cells: int = 10, least_count: float = 30, resolution: float | str = "auto", min_size: int = 5) -> CellExperiment:
    """Groups cells by their segmented profiles (pc_groups), averages trusted ploidies by group and doubles those of genome-doubled cells: wgd, corr_ploidy."""
    grouped = identify_subclones(x, "segmented", k, resolution, min_size=min_size, column="pc_groups", least_count=least_count)
    cells = grouped.cells.withColumnRenamed("pc_groups", "group")
    return replace(grouped, cells=ploidy.correct_ploidy(cells, min_reads, least_cells, call_wgd).withColumnRenamed("group", "pc_groups"))
