"""The corpus pipeline: documents lose toxic, poor and near-duplicate ones and are packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthline.llm import line_rules, near_dedup, packing, toxicity
from hearthline.llm.tables import keep, table

#: Each function takes (spark, docs, sf_dir); its result, written and read again, is the next one's docs.
STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("quality rules", line_rules.drop_poor),
    ("near duplicates", near_dedup.drop_near_duplicates),
    ("packing", packing.pack),
]

#: No SQL: the first stage's model is trained.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
