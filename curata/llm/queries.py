"""The registered queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from curata.llm import (
    alignment, bpe, forest, huffman, neighbours, oracle, packing, pagetext, quality, rules, suffixes,
    toxicity, turns, warc,
)
from curata.llm.common import read
from curata.llm.tokens import vocabulary_path


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.encode_and_read(read(spark, sf_dir, "documents"))


def op2_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(read(spark, sf_dir, "documents"), size=2)


def op4_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read(spark, sf_dir, "pages"))


def op5_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(read(spark, sf_dir, "pages"))


def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(read(spark, sf_dir, "documents"))
    # the verdict is taken on the full distances; sums in another order differ in their last digits
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op8_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encode_and_decode(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"),
                                 public_tokenizers.PATTERN)


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours_of_twentieths(read(spark, sf_dir, "embeddings"))


def op10_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"),
                           vocabulary_path("piece_bpe_32k.model"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired_digests(turns.damage(read(spark, sf_dir, "conversations")))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_huffman_ids, op2_swap_packing, op3_lsh_forest, op4_seekable_warc, op5_mincut_html, op6_ftrl_quality,
        op7_divergence_rules, op8_distinct_word_bpe, op9_multi_index, op10_mil_toxicity,
        op11_interval_alignment, op12_turn_repair, op13_suffix_dedup, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_lsh_forest": oracle.NEAR_DUPLICATES, "op4_seekable_warc": oracle.ARCHIVE,
            "op7_divergence_rules": oracle.RULES}
