"""Tables behind the plots: heatmap cells, annotation bars, one cell's profile, chromosome labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .roworder import row_order

#: The order of chromosomes, and the colours of copy numbers 0 to 11.
CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y"]
COPY_COLOURS = ["#496bab", "#9fbdd7", "#c1c1c1", "#e9c47e", "#d6804f", "#b3402e", "#821010", "#6a0936", "#ab1964", "#b6519f", "#ad80b9", "#c2a9d1"]


def heatmap_data(rows: DataFrame, assay: str = "copy", attributes: list[str] | None = None) -> DataFrame:
    """(cell_id, bin_idx, chr_order, value, low, high): NULL as 0; copies over 12 as 12 on a scale from 0 to 11, others on a scale between the 0.01 and 0.99 quantiles of all values."""
    missing = [a for a in attributes or [] if a not in rows.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    value = F.coalesce(F.col(assay).cast("double"), F.lit(0.0))
    order = F.array_position(F.array(*[F.lit(c) for c in CHROMOSOMES]), F.col("chromosome"))
    made = rows.select("cell_id", "bin_idx", F.when(order > 0, order.cast("int")).alias("chr_order"), value.alias("value"), *(attributes or []))
    if "copy" in assay:
        return made.withColumn("value", F.least("value", F.lit(12.0))).withColumn("low", F.lit(0.0)).withColumn("high", F.lit(11.0))
    low, high = exact_quantiles(made, "value", [0.01, 0.99])
    return made.withColumn("low", F.lit(low).cast("double")).withColumn("high", F.lit(high).cast("double"))


def annotation_bar(df: DataFrame, value: str, limits: tuple[float, float] | None = None) -> DataFrame:
    """bar: the value held between the limits, or between the 0.01 and 0.99 quantiles of all; a value that is not a number is returned as it is."""
    if df.schema[value].dataType.typeName() in ("string", "boolean"):
        return df.withColumn("bar", F.col(value))
    if limits:
        return df.withColumn("bar", F.greatest(F.least(F.col(value).cast("double"), F.lit(float(limits[1]))), F.lit(float(limits[0]))))
    low, high = (F.lit(x).cast("double") for x in exact_quantiles(df, value, [0.01, 0.99]))
    return df.withColumn("bar", F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value).cast("double"), high), low)))


def heatmap_rows(rows: DataFrame, assay: str = "copy", row_split: str | None = None) -> DataFrame:
    """(cell_id, [row_split,] row_number): the heatmap's rows from top to bottom, clustered within each split. Copies over 12 count as 12."""
    value = F.coalesce(F.col(assay).cast("double"), F.lit(0.0))
    shown = F.least(value, F.lit(12.0)) if "copy" in assay else value
    return row_order(rows.select("cell_id", "bin_idx", shown.alias("value"), *([row_split] if row_split else [])), "value", row_split)


def cell_profiles(rows: DataFrame, assay: str = "copy", chromosome: str | None = None) -> DataFrame:
    """(cell_id, bin_number, chromosome, copy, adj_reads, outlier, ymax) of every cell: reads scaled to the mean of the assay.

    For copy, ymax is the greatest value that is no outlier (over the 0.95 quantile), 10 at least, and values over 11 are shown as 11; otherwise the 0.99 quantile.
    """
    v = F.col(assay).cast("double")
    stats = rows.groupBy("cell_id").agg(F.percentile(v, 0.95).alias("q95"), F.percentile(v, 0.99).alias("q99"), F.avg(v).alias("mean_v"), F.avg("reads").alias("mean_r"))
    own = rows.join(stats, "cell_id").withColumn("outlier", v > F.col("q95"))
    tops = own.where(~F.col("outlier")).groupBy("cell_id").agg(F.max(v).alias("top"))
    own = own.join(tops, "cell_id", "left").withColumn("bin_number", F.row_number().over(W.partitionBy("cell_id").orderBy("bin_idx")))
    ymax = F.greatest(F.lit(10.0), F.col("top")) if assay == "copy" else F.col("q99")
    shown = F.least(v, F.lit(11.0)) if assay == "copy" else v
    out = own.select("cell_id", "bin_number", "chromosome", F.when(v.isNotNull(), shown).alias("copy"), (F.col("reads") * F.try_divide("mean_v", "mean_r")).alias("adj_reads"), "outlier", ymax.alias("ymax"))
    return out if chromosome is None else out.where(F.col("chromosome") == chromosome)


def chromosome_labels(bins: DataFrame) -> DataFrame:
    """(chromosome, label_at, border_at): mean and last bin number of each chromosome; the last chromosome has no border."""
    numbered = bins.select("chromosome", F.row_number().over(W.orderBy("bin_idx")).alias("n"))  # bins of one genome
    spans = numbered.groupBy("chromosome").agg(F.avg("n").alias("label_at"), F.max("n").alias("border_at"))
    last = F.max("border_at").over(W.partitionBy())
    return spans.withColumn("border_at", F.when(F.col("border_at") < last, F.col("border_at")))
