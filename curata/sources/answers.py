"""Model answers for the answer merge (J8), derived by Spark from ``labels``.

Batch inference runs outside this library (on the prompt table); its output is a
table (item_id, stop_reason, text). For tests and the correctness gate such a table
is derived from the labelled documents: toxic ones are refusals, low-quality ones
are malformed JSON, the rest are valid answers; unlabelled items have no answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answers_from_labels(labels: DataFrame, items: DataFrame) -> DataFrame:
    j = labels.select(F.col("doc_id").alias("item_id"), "quality", "toxic").join(
        items.select("item_id", "title", "source_id"), "item_id")
    valid = F.to_json(F.struct(
        F.concat(F.lit("Model summary of item "), F.col("item_id").cast("string"), F.lit(": "),
                 F.col("title")).alias("what_changed"),
        F.concat(F.lit("It matters to readers of "), F.col("source_id"), F.lit(".")).alias("why_it_matters"),
        F.lit("").alias("comparison")))
    return j.select(
        "item_id",
        F.when(F.col("toxic") == 1, F.lit("refusal")).otherwise(F.lit("end_turn")).alias("stop_reason"),
        F.when(F.col("toxic") == 1, F.lit(""))
         .when(F.col("quality") == 0, F.concat(F.lit('{"what_changed": "'), F.substring("title", 1, 20)))
         .otherwise(valid).alias("text"))
