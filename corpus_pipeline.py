"""A corpus made ready for training: five stages, each an operator of faultline.llm over what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import stages
from faultline.llm.common import materialize, table

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language_id", stages.language_id),
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", stages.near_duplicates),
    ("repeated_strings", stages.repeated_strings),
    ("packing", stages.packing),
]

#: SQL can't express hypervectors, hashing and tokenization; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each keeps is written in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
