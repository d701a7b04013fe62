"""Training-data pipeline over the documents table: five stages, each written as Parquet and read by the next.

quality: documents that the quality rules reject go. lines: boilerplate lines of a source go. near: one document of each group of
near-duplicates stays. leaks: documents that contain a benchmark item go. encode: token ids of what is left, checked by decoding.
Every stage works on all rows that the one before kept. A stage's own tables are deleted once its result is written, and that one once
the next stage's is.

Defined cases: null or empty texts fail the quality rules; of rows that share a doc_id one passes the near-duplicates stage; repeated
rows are copies of each other, of which the least doc_id stays, and of equal texts without one the row with the least hash; an empty
table runs through; further columns pass, whatever their names, until the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velum.llm import bpe, decontamination, line_dedup, near_dedup, quality_rules
from velum.llm.common import discard, materialise, scratch, table

STAGES = [
    ("quality", quality_rules.stage),
    ("lines", line_dedup.stage),
    ("near", near_dedup.stage),
    ("leaks", decontamination.stage),
    ("encode", bpe.stage),
]

#: SQL cannot express the language model, MinHash, the embedding or the encoder; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
