"""A corpus in five stages: language ID, line dedup, SimHash near-dedup, mixing to target weights, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; what it returns is
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import stages
from loomgraph.sources.shared import cut

STAGES = [
    ("language_id", stages.identify_language),
    ("line_dedup", stages.drop_repeated_lines),
    ("simhash_near_dedup", stages.drop_near_copies),
    ("mix_sources", stages.mix_sources),
    ("bpe", stages.encode),
]

#: SQL has no filters, fingerprints or tokenizers; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
