"""BEDPE files as they arrive: the steps that look at one row at a time, as a stream.

Everything else of the analysis needs all rows of a cell, so it stays a batch over what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bin_start
from ..operators.fragments import contig_filter, orient, trim
from ..sources.bedpe import SCHEMA, cell_of_path


def arriving_fragments(spark: SparkSession, folder: str, bin_size: int = 500_000) -> DataFrame:
    """(cell_id, chr, start, end, name, strand, length, bin_start) of files that arrive in a folder."""
    raw = spark.readStream.schema(SCHEMA).option("sep", "\t").option("quote", "").csv(folder)
    rows = raw.select(cell_of_path(F.col("_metadata.file_path")).alias("cell_id"), "*")
    return trim(contig_filter(orient(rows))).withColumn("bin_start", bin_start("start", bin_size))
