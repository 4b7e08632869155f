"""Corpus pipeline: language, toxicity, near-duplicates, repeated passages, packing.

Each stage reads what the one before kept, as a Parquet table in the shared
folder; all but the last return the columns of ``documents``.  A stage's table is
removed when the next one's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from belated.llm import common, language, minhash, packing, suffix, toxicity

STAGES = [
    ("language", language.keep_identified),
    ("toxicity", toxicity.keep_civil),
    ("near_dedup", minhash.keep_one_of_each),
    ("suffix_dedup", suffix.remove_repeats),
    ("packing", packing.pack_stage),
]

#: Classifiers, similarity joins and tokenizers are not SQL; the stages are
#: tested, one by one and together, in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        spent, docs = docs, common.stage(stage(spark, docs, sf_dir), name)
        if k:
            common.free(spent)
    return STAGES[-1][1](spark, docs, sf_dir)
