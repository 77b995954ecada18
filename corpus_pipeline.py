"""The corpus pipeline: five operators, each on all that the one before has kept.

``run`` writes every stage's rows to the shared folder and rereads them for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tradewind.llm import bpe_replay, decontaminate, jaccard_join, line_frequency, outliers
from tradewind.llm.common import table, written
from tradewind.llm.queries import BYTE_RANKS

NEAR_WORDS, NEAR_PERCENT = 5, 80  # of the near-copy stage; op7's own setting binds its query only


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the robust outlier test reject."""
    return outliers.quality_kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines and repeated passages; a document keeps its row even if no line stays.

    The source is the site, whatever its size; a repeated passage stays in one text. ``n_chars`` is the length of what is left.
    """
    kept = line_frequency.drop_repeated(docs, "source", "text")
    changed = {"n_chars": "if(n_dropped > 0, cast(length(text) as bigint), n_chars) as n_chars"}
    return kept.selectExpr(*[changed.get(name, f"`{name}`") for name in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked ones, that with the least id; linked by five-word shingles, 80 % alike."""
    return jaccard_join.one_of_each_class(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document that is left."""
    return bpe_replay.bpe_encode(
        docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, with_ids=False
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# The last two stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
