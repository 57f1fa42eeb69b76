"""The queries of the corpus operators, with production parameters, and their SQL where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import byte_bpe, change_points, conversation_repair, exact_dedup, mixing, near_dedup, prefix_forest, pseudonyms, search
from plenum.llm import substring_dedup, token_store, toxicity, warc
from plenum.llm.common import read_table, work_dir


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers; the folder is a parameter of the environment."""
    folder = os.environ.get("PLENUM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "tokens")
    token_store.write_store(read_table(spark, sf_dir, "documents"), out, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.read_summary(spark, out)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_to_derivatives(read_table(spark, sf_dir, "pages"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read_table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100, with its whole text, against all documents."""
    docs = read_table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.filter("doc_id % 100 = 0"), k=10)


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(read_table(spark, sf_dir, "documents"), os.environ.get("PLENUM_PSEUDONYM_KEY", "example key"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(
        read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), split_pattern()
    )


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vendor's daily quantities of lines that were kept or swapped, cut into segments."""
    return change_points.change_points(read_table(spark, sf_dir, "sale_lines").filter("flag IN ('kept', 'swapped')"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with faults of a fixed draw, repaired."""
    rows = read_table(spark, sf_dir, "conversations")
    return conversation_repair.digests(conversation_repair.damage(rows), "conv", every=rows.select(F.col("conv_id").alias("conv")))


def op13_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others."""
    rows = read_table(spark, sf_dir, "embeddings")
    return prefix_forest.nearest(rows, rows.filter("vec_id % 20 = 0"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_warc": op2_warc,
    "op3_near_dedup": op3_near_dedup,
    "op4_search": op4_search,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_change_points": op11_change_points,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_forest": op13_prefix_forest,
}

ORACLE_SQL: dict[str, str] = {
    "op6_mixing": """
        WITH RECURSIVE c AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
        e AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * 1000 AS exact FROM c),
        f AS (SELECT source, greatest(1, CAST(floor(exact) AS BIGINT)) AS low, row_number() OVER (ORDER BY floor(exact) - exact, source) AS place FROM e),
        s AS (SELECT source, low + CASE WHEN place <= 1000 - (SELECT sum(low) FROM f) THEN 1 ELSE 0 END AS share, row_number() OVER (ORDER BY source) AS k FROM f),
        l AS (SELECT list(share ORDER BY k) AS shares FROM s),
        g AS (
            SELECT 0 AS t, list_transform(shares, lambda x: CAST(0 AS BIGINT)) AS done, shares, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS turn FROM l
            UNION ALL
            SELECT t + 1, list_transform(done, lambda d, i: CASE WHEN i = p THEN d + 1 ELSE d END), shares, p, CASE WHEN p > 0 THEN done[p] ELSE 0 END
            FROM (SELECT *, CASE WHEN list_min(due) < 9999999 THEN list_position(due, list_min(due)) ELSE 0 END AS p
                  FROM (SELECT *, list_transform(done, lambda d, i: CASE WHEN d < shares[i] AND d * 1000 // shares[i] <= t THEN ((d + 1) * 1000 + shares[i] - 1) // shares[i] ELSE 9999999 END) AS due FROM g WHERE t < 1000))
        ),
        plan AS (SELECT pick AS k, turn, t - 1 AS at_slot FROM g WHERE pick > 0),
        d AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS seq FROM documents),
        b AS (SELECT d.*, seq // 8 AS block, share, s.k FROM d JOIN s USING (source))
        SELECT doc_id, source, share / 1000 AS weight, block, block * 1000 // share AS "release", ((block + 1) * 1000 + share - 1) // share AS deadline,
               block // share * 1000 + at_slot AS slot, (block // share * 1000 + at_slot) * 8 + seq % 8 AS position
        FROM b JOIN plan ON plan.k = b.k AND plan.turn = b.block % b.share
    """,
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id
            FROM d
        )
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
}
