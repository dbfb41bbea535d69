"""The queries of the operators, with production parameters, and the SQL of those SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from dossier.llm import divergence, exact_dedup, jaccard_join, language_id, line_dedup, mixing
from dossier.llm import oracles, packing, sharding, structure, suffix_dedup, token_files, toxicity
from dossier.llm import vp_search
from dossier.llm.common import small_batches

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str, folder: str | None = None) -> str:
    """The path of a public tokenizer's file; ``folder`` replaces the installed package's."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(
        _documents(spark, sf_dir), bits=line_dedup.GRAM_BITS, grams=line_dedup.GRAMS
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(_documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_groups(_documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_documents(spark, sf_dir), vocabulary(WORD_BPE))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"
    )
    return toxicity.toxic_documents(_documents(spark, sf_dir), labels)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(_documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir), vocabulary(BYTE_BPE))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_documents(spark, sf_dir))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_list(_documents(spark, sf_dir))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return structure.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Query] = {
    "op1_vp_search": op1_vp_search,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_divergence": op11_divergence,
    "op12_sharding": op12_sharding,
    "op13_structure_repair": op13_structure_repair,
}

SQL = {
    "op5_exact_dedup": oracles.EXACT_DEDUP,
    "op11_divergence": oracles.DIVERGENCE,
    "op12_sharding": oracles.SHARDING,
    "op13_structure_repair": oracles.STRUCTURE_REPAIR,
}
