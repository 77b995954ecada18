"""The operators' registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import (
    alignment,
    bpe_replay,
    decontaminate,
    jaccard_join,
    line_frequency,
    outliers,
    pii_crf,
    ppm_language,
    projection_forest,
    secret_scan,
    token_files,
    toxicity,
    whitening,
)
from tradewind.llm.common import table
from tradewind.sources.checkpoints import shared_folder

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
SECRET_RANKS = "byte_bpe_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def op1_semi_markov_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii_crf.find_personal_data(table(spark, sf, "documents"))


def op2_site_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("site"),
        line_frequency.html_lines(F.col("html")).alias("text"),
    )
    kept = line_frequency.drop_boilerplate(pages, "site", "text")
    return kept.select(
        "page_id",
        "n_lines",
        "n_dropped",
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op4_bpe_merge_replay(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_replay.bpe_encode(
        table(spark, sf, "documents"),
        public_tokenizers.path(BYTE_RANKS),
        public_tokenizers.PATTERN,
        with_ids=False,
    )


def op5_robust_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.quality_verdicts(table(spark, sf, "documents")).drop("distance")


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = token_files.token_folder(shared_folder(spark))
    token_files.write_token_files(table(spark, sf, "documents"), folder, public_tokenizers.path(WORD_VOCABULARY))
    return token_files.read_token_files(spark, folder)


def op7_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.ngram_classes(table(spark, sf, "documents"))


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_ppm_language(spark: SparkSession, sf: str) -> DataFrame:
    return ppm_language.predict_language(table(spark, sf, "documents"))


def op10_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan_secrets(
        table(spark, sf, "documents"), public_tokenizers.path(SECRET_RANKS), public_tokenizers.PATTERN
    )


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align_tokens(
        table(spark, sf, "documents"),
        public_tokenizers.path(BYTE_VOCABULARY),
        public_tokenizers.path(PIECE_MODEL),
        with_groups=False,
    )


def op12_projection_forest(spark: SparkSession, sf: str) -> DataFrame:
    return projection_forest.nearest_vectors(table(spark, sf, "embeddings"))


def op13_polarisation_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_semi_markov_pii": op1_semi_markov_pii,
        "op2_site_line_dedup": op2_site_line_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_bpe_merge_replay": op4_bpe_merge_replay,
        "op5_robust_outliers": op5_robust_outliers,
        "op6_token_files": op6_token_files,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_toxicity": op8_toxicity,
        "op9_ppm_language": op9_ppm_language,
        "op10_secret_scan": op10_secret_scan,
        "op11_token_alignment": op11_token_alignment,
        "op12_projection_forest": op12_projection_forest,
        "op13_polarisation_whitening": op13_polarisation_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_site_line_dedup": line_frequency.oracle(),
        "op5_robust_outliers": outliers.oracle(),
        "op7_ngram_jaccard": jaccard_join.oracle(),
    }
