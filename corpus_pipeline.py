"""A training-data pipeline over documents: each stage reads what the one before has kept.

Rejected by quality, repeated, and holding benchmark items: such documents go. The mix then takes each
source's documents to its target, some of them up to three times, and the last stage writes token files
and returns each document's place in them. Models and sets of documents are learnt anew from what a
stage reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from studylake.llm import decontaminate, mixing, near_dedup, quality, tokens
from studylake.llm.common import written

STAGES = [
    ("quality classifier", quality.keep_good_documents),
    ("MinHash near-dedup", near_dedup.one_of_each_stage),
    ("benchmark decontamination", decontaminate.clean_stage),
    ("mixing sources to target weights", mixing.mix_stage),
    ("token-ID / binary output", tokens.token_file_stage),
]
#: A learnt model, MinHash and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs, "stage") if i < len(STAGES) else docs
    return docs
