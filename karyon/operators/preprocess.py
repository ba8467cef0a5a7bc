"""From BAM files to fragments: filter, split by barcode, pair mates, drop duplicates, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.alignments import flag_filter, header_cell_ids, template_pairs
from ..sources.bam import register, write_cell_bams
from ..sources.bedpe import cell_of_path, write_bedpe, write_cell_ids
from ..sources.shared import computed_once


def _reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    register(spark)
    return spark.read.format("bam").option("paths", ",".join(paths)).option("full", "true").load()


def _header(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("bam").option("paths", path).option("header", "true").load()


def _pairs(reads: DataFrame) -> DataFrame:
    return template_pairs(reads.select("cell_id", "qname", "flag", "chrom", "pos", "mapq", "cigar", "base_quality"))


def _manifest(cells: DataFrame, found: DataFrame, bams: str | None, bedpes: str) -> DataFrame:
    """(cell_id, well, bam_file, bedpe_file, pairs) of every listed cell; files are NULL, pairs 0 for a cell without any."""
    file = lambda folder, ending: F.when(F.col("pairs").isNotNull(), F.concat(F.lit(f"{folder}/"), "cell_id", F.lit(ending)))
    bam = file(bams, ".bam") if bams else F.lit(None).cast("string")
    return cells.join(found, "cell_id", "left").select("cell_id", "well", bam.alias("bam_file"), file(bedpes, ".bedpe.gz").alias("bedpe_file"), F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"))


def preprocess_merged_bam(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """One BAM file of many cells: writes CellIDList, a filtered BAM file for each cell that the header lists, and its BEDPE file. Returns the manifest of the listed cells."""
    lines = _header(spark, path)
    cells = computed_once(header_cell_ids(lines).distinct())
    write_cell_ids(cells, f"{folder}/CellIDList")
    listed = cells.select(F.col("cell_id").alias("cell_barcode"))
    reads = computed_once(flag_filter(_reads(spark, [path])).join(listed, "cell_barcode", "left_semi").withColumn("cell_id", F.col("cell_barcode")))
    header = "".join(f"{r.value}\n" for r in lines.collect())  # the lines of one header
    write_cell_bams(reads, f"{folder}/individualBams", header)
    pairs = computed_once(_pairs(reads))
    write_bedpe(pairs, f"{folder}/bedpe")
    return _manifest(cells, pairs.groupBy("cell_id").agg(F.count("*").alias("pairs")), f"{folder}/individualBams", f"{folder}/bedpe")


def preprocess_split_bams(spark: SparkSession, paths: list[str], folder: str) -> DataFrame:
    """A BAM file for each cell: writes a BEDPE file for each. Returns the manifest of the files' cells."""
    reads = flag_filter(_reads(spark, paths)).withColumn("cell_id", cell_of_path(F.col("path")))
    pairs = computed_once(_pairs(reads))
    write_bedpe(pairs, f"{folder}/bedpe")
    cells = spark.createDataFrame([(p,) for p in paths], "path string").select(cell_of_path(F.col("path")).alias("cell_id")).distinct().withColumn("well", F.col("cell_id"))
    return _manifest(cells, pairs.groupBy("cell_id").agg(F.count("*").alias("pairs")), None, f"{folder}/bedpe")
