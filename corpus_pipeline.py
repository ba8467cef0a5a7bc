"""The corpus pipeline: documents to byte-level BPE digests in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

1. quality: documents that the classifier rejects go.
2. toxicity: documents that it finds toxic go.
3. near_duplicates: of each group linked by 5-gram Jaccard similarity of 0.8 or more, one row stays, with the least doc_id.
   Rows of one id with different texts are different documents, and a row without an id is a document of its own.
4. decontamination: documents with a benchmark passage go.
5. byte_bpe: token counts and digests of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyon.llm import quality, toxicity
from karyon.llm.decontaminate import benchmark_hits
from karyon.llm.jaccard_join import one_of_each_group
from karyon.llm.queries import byte_bpe_file
from karyon.llm.byte_bpe import bpe_round_trip
from karyon.llm.tables import columns_of, cut, table

_OWN = "__stage_"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, prefix=_OWN).where(F.col(f"{_OWN}predicted") == 1).select(*columns_of(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, prefix=_OWN).where(F.col(f"{_OWN}predicted") == 0).select(*columns_of(docs))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(docs, table(spark, sf_dir, "benchmark"), prefix=_OWN)
    return hits.where(F.size(f"{_OWN}hit_words") == 0).select(*columns_of(docs))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs, byte_bpe_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The classifiers are fitted models and the near-duplicate groups are components, so no SQL gives these rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
