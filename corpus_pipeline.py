"""From raw documents to packed training sequences: five stages over the whole table of documents.

Each stage gets all rows that its predecessor kept, as Parquet in the shared folder. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavefield.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from wavefield.llm.common import discard, stored, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL cannot express the line, join and packing stages; tests/llm checks each stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
