"""Fragments, bins, copy matrices and cells made from the driver's tables, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Valid in Spark and in DuckDB. Cells with an odd number have names without chr; a few rows lie on other contigs.
BEDPE_SQL = """
SELECT cell_id, CASE WHEN odd = 1 THEN contig ELSE concat('chr', contig) END AS Chr1, fs AS Start1, fs + least(60, rl) AS End1,
       CASE WHEN odd = 1 THEN contig ELSE concat('chr', contig) END AS Chr2, fs + rl - least(60, rl) AS Start2, fs + rl AS End2,
       Name, 60.0 AS Score, R1_direction, R2_direction
FROM (SELECT concat('cell_', l_suppkey) AS cell_id, l_suppkey % 2 AS odd,
             CASE WHEN l_orderkey % 97 = 0 THEN 'M' WHEN l_orderkey % 89 = 0 THEN '1_alt' ELSE concat('', 1 + l_partkey % 4) END AS contig,
             (l_orderkey * 7919 + l_linenumber * 104729 + CAST(round(l_extendedprice * 100) AS BIGINT)) % 40000 AS fs,
             40 + ((l_partkey * 31 + l_orderkey * 17 + l_linenumber * 7) % 400) AS rl,
             concat('r', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', CAST(round(l_extendedprice * 100) AS BIGINT)) AS Name,
             CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS R1_direction, CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS R2_direction
      FROM {lineitem}) x
"""

BINS_SQL = """
SELECT CAST(i AS INT) AS bin_idx, concat('', 1 + CAST(floor(i / 80.0) AS INT)) AS chromosome, (i % 80) * 500 + 1 AS bs, (i % 80) * 500 + 500 AS be,
       CAST(85 + ((i % 80) * 11) % 16 AS DOUBLE) AS bases, CAST(30 + ((i % 80) * 7) % 30 AS DOUBLE) AS gc, CAST(80 + ((i % 80) * 13) % 21 AS DOUBLE) AS mappability, ((i % 80) % 17) <> 0 AS use
FROM {bins}
"""

MATRIX_SQL = """
SELECT concat('cell_', k) AS cell_id, CAST(b AS INT) AS bin_idx, cp, cp * 10.0 + ((k * 31 + b * 17) % 7 - 3) * 0.3 AS reads, CASE WHEN (k * 7 + b) % 41 = 0 THEN NULL ELSE cp * 10.0 END AS seg
FROM (SELECT s_suppkey AS k, i AS b, CAST(CASE WHEN s_suppkey % 3 = 1 AND i IN (40, 79) THEN 3 WHEN s_suppkey % 3 = 1 AND i BETWEEN 41 AND 78 THEN 4
             WHEN s_suppkey % 3 = 2 AND i IN (160, 199) THEN 3 WHEN s_suppkey % 3 = 2 AND i BETWEEN 161 AND 198 THEN 5
             WHEN s_suppkey % 3 = 0 AND i = 100 THEN 1 ELSE 2 END AS DOUBLE) AS cp
      FROM {supplier} CROSS JOIN {bins}) m
"""

CELLS_SQL = """
SELECT concat('cell_', s_suppkey) AS cell_id, s_suppkey % 3 AS grp, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2.0 ELSE 4.0 END + ((s_suppkey * 37) % 11 - 5) * 0.02 AS DOUBLE) AS est_ploidy,
       100000 + (s_suppkey * 7919) % 50000 - CASE WHEN s_suppkey % 13 = 0 THEN 40000 ELSE 0 END AS total_reads
FROM {supplier}
"""

DUCK = {"lineitem": "lineitem", "supplier": "supplier", "bins": "(SELECT range AS i FROM range(320)) r"}
BEDPE_DUCK, BINS_DUCK, MATRIX_DUCK, CELLS_DUCK = (s.format(**DUCK) for s in (BEDPE_SQL, BINS_SQL, MATRIX_SQL, CELLS_SQL))
BIN_SIZE = 500
#: Bins, and rows of the matrix that a task makes.
PLACES, MATRIX_ROWS = 320, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession) -> DataFrame:
    return spark.range(PLACES).withColumnRenamed("id", "i")


def bedpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BEDPE_SQL, lineitem=table(spark, sf_dir, "lineitem"))


def bins(spark: SparkSession) -> DataFrame:
    return spark.sql(BINS_SQL, bins=_places(spark)).withColumnsRenamed({"bs": "start", "be": "end"})


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, bin_idx, copy, reads, counts, seg); seg has NULL bins."""
    cells = table(spark, sf_dir, "supplier")
    parts = max(1, cells.count() * PLACES // MATRIX_ROWS)  # a short file is one task, and what is made of it would be too
    rows = spark.sql(MATRIX_SQL, supplier=cells.repartition(parts, "s_suppkey"), bins=_places(spark))
    return rows.withColumnRenamed("cp", "copy").withColumn("counts", F.rint("reads").cast("long"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CELLS_SQL, supplier=table(spark, sf_dir, "supplier")).withColumnRenamed("grp", "group")
