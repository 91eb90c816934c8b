"""The training-data pipeline: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of the documents. A stage's result is written as Parquet to the shared folder and
read again as the next one's documents, so a lost executor costs no earlier stage.

Defined results: a verdict belongs to the row, not to its id, so rows with null or repeated
ids are judged like all others; a null text has no words, so the quality rules reject it; of
a group of near-duplicates the row of the smallest doc_id stays, null ids last, and of two
rows with one id one; an empty table gives no rows; extra columns pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curata.llm import forest, packing, rules, toxicity
from curata.llm.common import read, stage
from curata.session import ship_package

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model (fitted on the labels of these documents) passes."""
    ship_package(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.passing(docs, model)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and do not diverge from their language."""
    ship_package(spark)
    return rules.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    ship_package(spark)
    return forest.representatives(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents, packed into sequences."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", apply_rules),
    ("near-duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: a trained model and a search over bins are not for SQL; tests/llm compares every stage with
#: a plain version on a small table
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
