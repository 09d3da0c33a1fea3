"""From raw documents to a training mix: five operators, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
rows of `docs` with all their columns. The last returns the mix: a row for each document in
it, with its size, its source's size and target, and the words taken (repeats counted).
Nulls, empty tables and repeated rows are treated as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.llm import decontam, jaccard, langid, mixing, rules
from sievewell.llm.common import forget, scratch, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the network knows."""
    return langid.accepted(docs, langid.fit(docs, F.lit(True)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the current policy keeps."""
    return rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard.deduplicated(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that repeat no test item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix of sources to target weights."""
    return mixing.plan(docs).filter("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: SQL can express neither the network nor the index.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix; of all tables written on the way, those of the last stage and its input are left."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}", stays=True)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
