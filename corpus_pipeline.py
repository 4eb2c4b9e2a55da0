"""The corpus pipeline: five stages over ``documents``, each calling one corpus operator.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import op02_sentencepiece, op05_source_mix, op06_ngram_join, op08_quality_rules, op09_secret_scans
from arbora.llm.common import staged, table

STAGES = [
    ("quality_rules", op08_quality_rules.stage),  # rejected documents go
    ("ngram_jaccard_join", op06_ngram_join.stage),  # one document of each near-duplicate group stays
    ("secret_scans", op09_secret_scans.stage),  # secrets are redacted
    ("source_mix", op05_source_mix.stage),  # a row for every time the mix takes a document
    ("sentencepiece", op02_sentencepiece.stage),  # piece ids instead of text
]

#: SQL cannot express the flow, the seeded order and the Viterbi search of the later stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
