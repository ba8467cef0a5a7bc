"""The registered queries of the thirteen operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_round_trip
from .chat_format import digests, digests_sql, format_turns
from .decontaminate import benchmark_hits, contamination
from .fill_middle import fill_digests, fill_digests_sql, fill_in_middle
from .fingerprints import neighbour_fingerprints
from .html_extract import extract_pages
from .jaccard_join import jaccard_groups
from .licences import licence_scan, licence_scan_sql
from .mixing import mix_sources, mixing_sql
from .quality import quality
from .spelling import spelling_groups, spelling_groups_sql, typed_words, vocabulary
from .tables import table
from .token_counts import token_counts
from .toxicity import toxicity


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe_file() -> str:
    return _tokenizer("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), byte_bpe_file())


#: Conversation -1: control strings inside texts.
_CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(_CONTROL_TEXT).alias("text"))
    return digests(format_turns(rows.unionByName(own)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(benchmark_hits(docs, table(spark, sf_dir, "benchmark"), keep_text=False))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: One run in so many, by its hash, has a letter deleted, so that variants are there to be found.
_TYPO_EVERY = 199


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(vocabulary(typed_words(table(spark, sf_dir, "documents"), _TYPO_EVERY)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_digests(fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality": op6_quality,
    "op7_licence_scan": op7_licence_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_fingerprints": op9_fingerprints,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_mixing": op11_mixing,
    "op12_spelling": op12_spelling,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": digests_sql(f"SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{_CONTROL_TEXT}'), (-1, 1, 'assistant', '{_CONTROL_TEXT}')"),
    "op7_licence_scan": licence_scan_sql(),
    "op11_mixing": mixing_sql(),
    "op12_spelling": spelling_groups_sql(_TYPO_EVERY),
    "op13_fill_in_middle": fill_digests_sql(),
}
