"""BEDPE files, one for each cell, as one DataFrame; and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bam import dealt_by_cell, register

SCHEMA = "Chr1 string, Start1 long, End1 long, Chr2 string, Start2 long, End2 long, Name string, Score double, R1_direction string, R2_direction string"


def cell_of_path(path):
    """The file's name without directories and without .bedpe, .bam, .gz and part endings."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.part-\d+)?(\.bam)?(\.bedpe)?(\.gz|\.bgz)?$", "")


def read_bedpe(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of all files with cell_id from the file name; headerless, tab-separated, plain or gzip. Empty files have no rows."""
    raw = spark.read.schema(SCHEMA).option("sep", "\t").option("quote", "").option("header", "false").csv(paths)
    return raw.select(cell_of_path(F.col("_metadata.file_path")).alias("cell_id"), "*")


def cells_of_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(cell_id) of all files of folders, files or patterns, those without rows too; no file is read."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        store = hadoop.Path(path).getFileSystem(conf)
        for entry in store.globStatus(hadoop.Path(path)) or []:
            found += [f.getPath().toString() for f in (store.listStatus(entry.getPath()) if entry.isDirectory() else [entry]) if f.isFile()]
    named = spark.createDataFrame([(f,) for f in found], "path string").where(~F.element_at(F.split("path", "/"), -1).rlike("^[._]"))
    return named.select(cell_of_path(F.col("path")).alias("cell_id")).distinct()


def manifest(spark: SparkSession, rows: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """(cell_id, bam_file, bedpe_file) of the cells of a run, so that a cell without rows is kept."""
    return spark.createDataFrame(rows, "cell_id string, bam_file string, bedpe_file string")


def write_bedpe(bedpe: DataFrame, path: str) -> None:
    """Blocked gzip BEDPE files `<cell_id>.bedpe.gz`, in order of names; a large cell has several, numbered."""
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = dealt_by_cell(bedpe.select(F.col("cell_id").cast("string").alias("cell_id"), "Name", line.alias("line")), ["Name"])
    register(bedpe.sparkSession)
    rows.sortWithinPartitions("cell_id", "Name", "line").select("cell_id", "line").write.format("cell_lines").mode("append").option("ending", ".bedpe.gz").save(path)


def write_cell_ids(cells: DataFrame, path: str) -> None:
    """Tab-separated cell ids and wells."""
    cells.select("cell_id", "well").write.option("sep", "\t").csv(path)
