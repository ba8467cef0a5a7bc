"""Fragments from paired-end rows: orient, prefix, filter contigs, flag doublets, trim, drop near duplicates.

Every step is keyed by cell_id, so any number of cells is one DataFrame. A unique `name` within a cell breaks ties. `load_fragments` deals the rows by cell once, to tasks that grow in number and not in rows;
flags, counts and limits of all later steps are windows over cells or parts of them, which need no further shuffle and no join of rows to their own aggregates.
Windows spill, so a cell with very many fragments costs its task time and not memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import strand_of

CONTIGS = r"(chr[0-9]+|X|Y)$"
TAG_OVERLAP = 10
TOLERANCE = 1
#: Fragments of a task.
TASK_ROWS = 200_000


def dealt(rows: DataFrame, n: int, task_rows: int) -> DataFrame:
    """rows, n in all when they are worked on, dealt by cell: to as many tasks as a shuffle has, or fewer of few rows, or so many that a task has about task_rows."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, n // task_rows, min(usual, 4 * n // task_rows)), "cell_id")


def orient(bedpe: DataFrame) -> DataFrame:
    """(cell_id, chr, start, end, name, strand): the span of both mates, on the first mate's chromosome."""
    return bedpe.select(
        "cell_id",
        F.col("Chr1").alias("chr"),
        F.least("Start1", "Start2").cast("long").alias("start"),
        F.greatest("End1", "End2").cast("long").alias("end"),
        F.col("Name").alias("name"),
        strand_of(F.col("Name"), F.col("R1_direction"), F.col("R2_direction")).alias("strand"),
    )


def chr_prefix(fragments: DataFrame) -> DataFrame:
    """Adds `chr` to all names of a cell none of whose names has it."""
    prefixed = F.max(F.contains(F.substring("chr", 1, 3), F.lit("chr"))).over(W.partitionBy("cell_id"))
    return fragments.withColumn("__prefixed", prefixed).withColumn("chr", F.when(F.col("__prefixed"), F.col("chr")).otherwise(F.concat(F.lit("chr"), "chr"))).drop("__prefixed")


def contig_filter(fragments: DataFrame) -> DataFrame:
    return fragments.where(F.col("chr").rlike(CONTIGS))


def laid(fragments: DataFrame, own: list[Column], marks: list[list[Column]], names: list[str], keys: list[str]) -> DataFrame:
    """Each fragment with `names` = own, and a row for each of marks: their values of `names`, and of the fragment only `keys`, so that marks are short. __own tells them apart."""
    others = [c for c in fragments.columns if c not in keys]
    rest = lambda whole: [F.when(F.lit(whole), F.col(c)).alias(c) for c in others]
    each = lambda values, whole: F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)], F.lit(whole).alias("__own"), *rest(whole))
    return fragments.select(*keys, F.inline(F.array(each(own, True), *[each(m, False) for m in marks])))


def flag_doublets(fragments: DataFrame, tag_overlap: int = TAG_OVERLAP) -> DataFrame:
    """doublet: some fragment of the cell and chromosome ends tag-1 or tag bases after this one's start. Starts and a mark `tag` before each end meet in a window of two places; no range join."""
    both = laid(fragments, [F.col("start")], [[F.col("end") - tag_overlap]], ["__at"], ["cell_id", "chr"])
    near = W.partitionBy("cell_id", "chr").orderBy("__at").rangeBetween(-1, 0)
    return both.withColumn("doublet", F.max(~F.col("__own")).over(near)).where("__own").select(*fragments.columns, "doublet")


def trim(fragments: DataFrame, tag_overlap: int = TAG_OVERLAP) -> DataFrame:
    return fragments.withColumn("end", F.col("end") - tag_overlap).withColumn("length", F.col("end") - F.col("start"))


def near_duplicate_flags(fragments: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """duplicate: start or end within `tolerance` of the row before, by cell, chromosome and strand, whether or not that row is one."""
    w = W.partitionBy("cell_id", "chr", "strand").orderBy("start", "end", "name")
    near = lambda c: F.abs(F.col(c) - F.lag(c).over(w)) <= tolerance
    return fragments.withColumn("duplicate", F.coalesce(near("start") | near("end"), F.lit(False)))


def drop_near_duplicates(fragments: DataFrame, tolerance: int = TOLERANCE, how: str = "intended") -> DataFrame:
    """how='intended' drops the flagged rows. how='positional' drops the row that stands, in order of (start, end, strand),
    where a flagged row stands in order of (strand, start, end), by cell and chromosome: the published procedure to the letter."""
    flagged = near_duplicate_flags(fragments, tolerance)
    if how == "intended":
        return flagged.where(~F.col("duplicate")).drop("duplicate")
    if how != "positional":
        raise ValueError("how must be 'intended' or 'positional'")
    by = W.partitionBy("cell_id", "chr")
    placed = flagged.withColumn("__own", F.row_number().over(by.orderBy("start", "end", "strand", "name"))).withColumn("__mask", F.row_number().over(by.orderBy("strand", "start", "end", "name")))
    laid = placed.select("*", F.posexplode(F.array("__own", "__mask")).alias("__kind", "__place"))
    masked = F.max(F.when(F.col("__kind") == 1, F.col("duplicate"))).over(W.partitionBy("cell_id", "chr", "__place"))
    return laid.withColumn("__masked", masked).where("__kind = 0 AND NOT __masked").drop("duplicate", "__own", "__mask", "__kind", "__place", "__masked")


def load_fragments(bedpe: DataFrame, tag_overlap: int = TAG_OVERLAP, how: str = "intended") -> DataFrame:
    """(cell_id, chr, start, end, name, strand, doublet, length)."""
    rows = flag_doublets(dealt(orient(bedpe), bedpe.count(), TASK_ROWS), tag_overlap)
    rows = contig_filter(chr_prefix(rows))  # by names as they are or with chr, chromosomes of a cell are the same, so one sort does for both
    return drop_near_duplicates(trim(rows, tag_overlap), how=how).select("cell_id", "chr", "start", "end", "name", "strand", "doublet", "length")


def enough_fragments(fragments: DataFrame, least: int = 100) -> DataFrame:
    """Fragments of the cells that have at least `least`."""
    return fragments.withColumn("__n", F.count("*").over(W.partitionBy("cell_id"))).where(F.col("__n") >= least).drop("__n")


def length_limits(fragments: DataFrame, quantile: float = 0.99) -> DataFrame:
    """(cell_id, max_length): the exact quantile of each cell's lengths."""
    return fragments.groupBy("cell_id").agg(F.percentile("length", quantile).alias("max_length"))


def length_filter(fragments: DataFrame, min_length: int = 50, max_length: float | None = None) -> DataFrame:
    """Lengths strictly between the limits; adds max_length, the cell's 0.99 quantile unless given."""
    limit = F.percentile("length", 0.99).over(W.partitionBy("cell_id")) if max_length is None else F.lit(float(max_length))
    limited = fragments.withColumn("max_length", limit)
    return limited.where((F.col("length") > min_length) & (F.col("length") < F.col("max_length")))


def breadth(fragments: DataFrame) -> DataFrame:
    """(cell_id, breadth): bases covered at least once by the closed intervals [start, end]."""
    w = W.partitionBy("cell_id", "chr").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("end").over(w)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, F.coalesce(reach, F.col("start") - 1)))
    return fragments.select("cell_id", new.alias("new")).groupBy("cell_id").agg(F.sum("new").alias("breadth"))
