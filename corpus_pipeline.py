"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

Cases: a null text counts as empty, and all empty texts are equal, so one of them stays.  Rows without doc_id pass the
filters as rows of their own unless their text is equal to another's.  Rows that repeat are one.  A null source is the
source ''.  Without labels of both kinds no text is toxic.  Other columns are handed on whatever their names; the last stage
gives its own columns.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenum.llm import byte_bpe, exact_dedup, mixing, near_dedup, toxicity
from plenum.llm.common import read_table, work_dir
from plenum.llm.queries import split_pattern, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the grammar is learned from the labels of these documents."""
    return toxicity.keep_rows(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_rows(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8 or more)."""
    return near_dedup.keep_rows(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources are mixed."""
    return mixing.mixed_rows(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, the digest of what they decode to, and its position in the mix.

    Reading files again loses the order of rows, so the position is worked out anew: it depends on the rows only.
    """
    rows = mixing.placed_rows(docs).select("__row.doc_id", "__row.text", "position")
    return byte_bpe.round_trip(rows, tokenizer_path("byte_bpe_multi_50k.tiktoken"), split_pattern(), place_col="position")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The toxicity grammar, near duplicates and BPE are not SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
