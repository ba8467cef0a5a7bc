"""Labels of documents, and bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def known_labels(labels: DataFrame, id_col: str, label_col: str, usable: Column) -> DataFrame:
    """(id, label) of the usable labels. A null label or id is unlabelled; an id with two labels has the greater one."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    return known.where(usable).groupBy("id").agg(F.max("label").alias("label"))


def picked(known: DataFrame, docs: DataFrame, id_col: str, most: int) -> DataFrame:
    """(id, label) of at most `most` labels of each class that have a document, in the order of a hash of the id."""
    here = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    by_class = [here.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k in (0, 1)]
    return by_class[0].unionByName(by_class[1])


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, label, text): one row for each chosen id; of rows that repeat the id, the least text (null first)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return rows.groupBy("id", "label").agg(F.min("text").alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column, most: int) -> DataFrame:
    """(label, part, text): at most `most` labelled documents of each class, one row for each id. part: one of 0 to 4, by a hash of the id."""
    chosen = picked(known_labels(labels, id_col, label_col, usable), docs, id_col, most)
    return texts_of(docs, chosen, id_col, text_col).select("label", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)).cast("int").alias("part"), "text")


def label_rate(labels: DataFrame, id_col: str, label_col: str, usable: Column) -> tuple[int, int]:
    """(rows, rows with label 1) of all usable labels."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).where(usable)
    n, ones = known.agg(F.count("*"), F.sum("label")).first()
    return int(n), int(ones or 0)
