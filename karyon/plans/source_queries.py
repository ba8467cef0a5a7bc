"""Aligned reads made from the driver's tables: mates, bins, and BAM files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiment
from ..sources import alignments, bam
from ..sources.shared import application_folder
from . import fixtures
from .registry import query

#: Two reads of each fragment; places are multiples of 40, so that templates repeat, and every 11th template has no second mate. Valid in Spark and in DuckDB.
READS_SQL = """
SELECT cell_id, qname, CASE WHEN mate = 1 THEN 99 ELSE 147 END AS flag, chrom, CAST(CASE WHEN mate = 1 THEN s ELSE e - size END + 1 AS BIGINT) AS pos, mapq, concat(CASE WHEN mate = 1 THEN '' ELSE '2S' END, size - CASE WHEN mate = 1 THEN 0 ELSE 2 END, 'M') AS cigar,
       CAST(size * quality AS BIGINT) AS base_quality, size, quality, CAST(CASE WHEN mate = 2 THEN s ELSE e - size END + 1 AS BIGINT) AS mate_pos, CAST(CASE WHEN mate = 1 THEN e - s ELSE s - e END AS BIGINT) AS template_length
FROM (SELECT f.*, m.i AS mate FROM
  (SELECT concat('cell_', l_suppkey) AS cell_id, concat('r', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', CAST(round(l_extendedprice * 100) AS BIGINT)) AS qname, concat('chr', 1 + l_partkey % 4) AS chrom,
          ((l_orderkey * 7919 + l_linenumber * 104729) % 250) * 40 AS s, ((l_orderkey * 7919 + l_linenumber * 104729) % 250) * 40 + 100 + (l_partkey % 3) * 40 AS e,
          CAST(20 + l_orderkey % 41 AS INT) AS mapq, CAST(20 + l_partkey % 20 AS INT) AS size, CAST(15 + l_orderkey % 25 AS INT) AS quality, l_orderkey % 11 = 0 AS single FROM {lineitem}) f
  CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2) m WHERE NOT (single AND m.i = 2)) r
"""
READS = READS_SQL.format(lineitem="lineitem")
HEADER = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:chr{k}\tLN:20000\n" for k in range(1, 5))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(READS_SQL, lineitem=fixtures.table(spark, sf_dir, "lineitem"))


_OF_READS = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def _full_reads(templates: DataFrame) -> DataFrame:
    """Both reads of each template, with mates, bases, qualities and tags."""
    reads = templates.sparkSession.sql(READS_SQL, lineitem=templates)
    quality = F.unhex(F.repeat(F.lpad(F.hex("quality"), 2, "0"), F.col("size")))
    tag = F.concat(F.unhex(F.lit("43425A")), F.col("cell_id").cast("binary"), F.unhex(F.lit("00")))  # CB:Z:cell
    return reads.select("*", F.col("chrom").alias("mate_chrom"), F.repeat(F.lit("A"), F.col("size")).alias("sequence"), quality.alias("qualities"), tag.alias("tags"))


# the 5' end of a second mate is behind its clipped bases, on the reverse strand: pos + size - 2 without a clip at that end
@query(
    f"""WITH r AS ({READS}), a AS (SELECT * FROM r WHERE flag = 99), b AS (SELECT * FROM r WHERE flag = 147),
p AS (SELECT a.cell_id, a.qname, a.chrom, a.pos AS pos1, a.size AS size1, b.pos AS pos2, b.size - 2 AS size2, a.mapq, row_number() OVER (PARTITION BY a.cell_id, a.chrom, a.pos, b.pos + b.size ORDER BY a.base_quality + b.base_quality DESC, a.qname) AS k FROM a JOIN b USING (cell_id, qname))
SELECT cell_id, qname AS name, chrom, pos1 - 1 AS start1, pos1 - 1 + size1 AS end1, pos2 - 1 AS start2, pos2 - 1 + size2 AS end2, mapq::DOUBLE AS score FROM p WHERE k = 1"""
)
def mate_pairs(spark, sf_dir):
    made = alignments.template_pairs(_reads(spark, sf_dir))
    return made.select("cell_id", F.col("Name").alias("name"), F.col("Chr1").alias("chrom"), *[F.col(c).alias(c.lower()) for c in ("Start1", "End1", "Start2", "End2", "Score")])


@query(f"WITH r AS ({READS}) SELECT cell_id, substr(chrom, 4) AS chromosome, ((pos - 1) // 500) * 500 + 1 AS start, count(*) AS counts FROM r WHERE flag = 99 AND mapq >= 37 GROUP BY ALL")
def binned_counts(spark, sf_dir):
    return alignments.binned_counts(_reads(spark, sf_dir), 500)


@query(
    f"""SELECT cell_id, count(*) AS reads, count(DISTINCT qname) AS names, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(mate_pos) AS BIGINT) AS mate_pos, CAST(sum(flag) AS BIGINT) AS flags, CAST(sum(mapq) AS BIGINT) AS mapq,
CAST(sum(size) AS BIGINT) AS bases, CAST(sum(template_length * flag) AS BIGINT) AS lengths, CAST(sum(base_quality) AS BIGINT) AS base_quality, count(*) FILTER (WHERE cigar LIKE '2S%') AS clipped FROM ({READS}) GROUP BY cell_id"""
)
def bam_round_trip(spark, sf_dir):
    """All reads, written as a BAM file for each cell to the shared folder, then read back in ranges of 32 kB."""
    folder = f"{application_folder(spark)}/bam-{uuid.uuid4().hex}"
    reads = _reads(spark, sf_dir)
    bam.write_cell_bams(fixtures.table(spark, sf_dir, "lineitem").select(*_OF_READS), folder, HEADER, bam.FILE_ROWS // 2, "l_suppkey", ["l_orderkey", "l_linenumber"], _full_reads)
    cells = [r.cell_id for r in reads.select("cell_id").distinct().collect()]  # names of the files
    back = spark.read.format("bam").option("paths", ",".join(f"{folder}/{c}.bam" for c in cells)).option("split_bytes", 32 << 10).option("full", "true").load()
    return back.groupBy(F.col("cell_barcode").alias("cell_id")).agg(
        F.count("*").alias("reads"), F.countDistinct("qname").alias("names"), F.sum("pos").alias("pos"), F.sum("mate_pos").alias("mate_pos"), F.sum(F.col("flag").cast("long")).alias("flags"), F.sum(F.col("mapq").cast("long")).alias("mapq"),
        F.sum(F.length("sequence").cast("long")).alias("bases"), F.sum(F.col("template_length") * F.col("flag")).alias("lengths"), F.sum("base_quality").alias("base_quality"), F.sum(F.col("cigar").startswith("2S").cast("long")).alias("clipped"),
    )


@query(f"WITH r AS ({READS}), c AS (SELECT cell_id, count(*) AS n FROM r WHERE flag = 99 AND mapq >= 37 GROUP BY cell_id) SELECT cell_id, n::DOUBLE AS total_reads, 320 AS bins, 10000.0::DOUBLE AS scaled FROM c UNION ALL SELECT 'cell_empty', NULL, 320, NULL")
def batch_from_reads(spark, sf_dir):
    """process_batch over binned reads, with a listed cell that has none: reads in all, bins, and the sum of the scaled reads."""
    bins = fixtures.bins(spark)
    counts = alignments.binned_counts(_reads(spark, sf_dir), fixtures.BIN_SIZE).join(bins.select("bin_idx", "chromosome", "start"), ["chromosome", "start"])
    cells = spark.createDataFrame([("cell_empty",)], "cell_id string")
    x = experiment.process_batch(bins, reads=counts, cells=cells)
    sums = x.cell_bins.groupBy("cell_id").agg(F.count("*").cast("int").alias("bins"), F.round(F.sum("reads"), 6).alias("scaled"))
    return x.cells.select("cell_id", "total_reads").join(sums, "cell_id")


@query("SELECT 1 + count(DISTINCT l_suppkey) AS cells, 0::BIGINT AS uneven, 1::BIGINT AS without FROM lineitem")
def ploidy_correction_run(spark, sf_dir):
    """process_batch over fragments, then ploidy_correction: every cell once, one mean a group but for doubling, and no ploidy for a listed cell without fragments."""
    cells = spark.createDataFrame([("cell_empty",)], "cell_id string")
    x = experiment.process_batch(fixtures.bins(spark), bedpe=fixtures.bedpe(spark, sf_dir), cells=cells)
    found = experiment.ploidy_correction(x, min_reads=0, k=5, least_cells=2, least_count=0, resolution=1.0, min_size=2).cells
    mean = F.round(F.col("corr_ploidy") / F.when(F.col("wgd"), 2).otherwise(1), 6)
    groups = found.withColumn("mean", mean).groupBy("pc_groups").agg(F.countDistinct("mean").alias("means"), F.count("*").alias("cells"), F.count(F.when((F.col("cell_id") == "cell_empty") & F.col("est_ploidy").isNull(), 1)).alias("without"))
    return groups.agg(F.sum("cells").alias("cells"), F.count(F.when(F.col("means") > 1, 1)).alias("uneven"), F.sum("without").alias("without"))
