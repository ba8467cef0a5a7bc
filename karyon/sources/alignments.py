"""Aligned reads: filters, cell ids of headers, mates to BEDPE, reads by bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROPER, DUPLICATE_OR_SUPPLEMENTARY = 3, 3072


def flag_filter(reads: DataFrame, least_mapq: int = 30, has: int = PROPER, lacks: int = DUPLICATE_OR_SUPPLEMENTARY) -> DataFrame:
    flag = F.col("flag")
    return reads.where((F.col("mapq") >= least_mapq) & (flag.bitwiseAND(F.lit(has)) == has) & (flag.bitwiseAND(F.lit(lacks)) == 0))


def header_cell_ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """(cell_id, well) of the @CO lines of a header: what follows the last CB: in the line, or all of it without one."""
    text = F.col(column)
    cell = F.regexp_replace(text, r".*CB:(.*)", "$1")
    return lines.where(text.startswith("@CO")).select(cell.alias("cell_id"), cell.alias("well"))


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that a CIGAR string spans."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1)
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, n: s + n.cast("long"))


def template_pairs(reads: DataFrame) -> DataFrame:
    """BEDPE rows of properly paired reads, mate 1 first, one of each set of duplicates.

    reads: (cell_id, qname, flag, chrom, pos (1-based), mapq, cigar, base_quality). Templates with both unclipped 5' ends and strands
    equal are duplicates; the one of the highest total base quality stays, then the least name.
    """
    flag = F.col("flag")
    own = reads.where((flag.bitwiseAND(F.lit(0x900)) == 0)).withColumn("end", F.col("pos") - 1 + reference_length(F.col("cigar"))).withColumn("strand", F.when(flag.bitwiseAND(F.lit(16)) == 0, "+").otherwise("-"))
    lead = F.coalesce(F.nullif(F.regexp_extract("cigar", r"^(?:\d+H)?(\d+)S", 1), F.lit("")).cast("long"), F.lit(0))
    tail = F.coalesce(F.nullif(F.regexp_extract("cigar", r"(\d+)S(?:\d+H)?$", 1), F.lit("")).cast("long"), F.lit(0))
    own = own.withColumn("five", F.when(F.col("strand") == "+", F.col("pos") - lead).otherwise(F.col("end") + tail))
    keep = ["cell_id", "qname", "chrom", "pos", "end", "strand", "five", "mapq", "base_quality"]
    first = own.where(flag.bitwiseAND(F.lit(64)) != 0).select(*keep)
    second = own.where(flag.bitwiseAND(F.lit(128)) != 0).select("cell_id", "qname", *[F.col(c).alias(f"{c}2") for c in keep[2:]])
    pairs = first.join(second, ["cell_id", "qname"])
    ends = F.sort_array(F.array(F.struct("chrom", "five", "strand"), F.struct(F.col("chrom2").alias("chrom"), F.col("five2").alias("five"), F.col("strand2").alias("strand"))))
    w = W.partitionBy("cell_id", "ends").orderBy(F.desc(F.col("base_quality") + F.col("base_quality2")), "qname")
    best = pairs.withColumn("ends", ends).withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return best.select(
        "cell_id",
        F.col("chrom").alias("Chr1"),
        (F.col("pos") - 1).alias("Start1"),
        F.col("end").alias("End1"),
        F.col("chrom2").alias("Chr2"),
        (F.col("pos2") - 1).alias("Start2"),
        F.col("end2").alias("End2"),
        F.col("qname").alias("Name"),
        F.least("mapq", "mapq2").cast("double").alias("Score"),
        F.col("strand").alias("R1_direction"),
        F.col("strand2").alias("R2_direction"),
    )


def binned_counts(reads: DataFrame, bin_size: int, least_mapq: int = 37) -> DataFrame:
    """(cell_id, chromosome, start, counts): first mates of proper pairs by the bin of their position."""
    flag = F.col("flag")
    own = reads.where((F.col("mapq") >= least_mapq) & (flag.bitwiseAND(F.lit(2 | 64)) == (2 | 64)) & (flag.bitwiseAND(F.lit(0x400 | 0x900)) == 0))
    start = (F.floor((F.col("pos") - 1) / bin_size) * bin_size + 1).cast("long")
    return own.groupBy("cell_id", F.regexp_replace("chrom", "^chr", "").alias("chromosome"), start.alias("start")).agg(F.count("*").alias("counts"))
