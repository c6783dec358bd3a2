"""From raw documents to shards: toxicity, near-duplicates, benchmark leaks, mixing, sharding.

Each stage reads what the one before it has written.  All but the last return the columns of
documents; the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farpoint.llm import histogram_shards, pivotal_mix, simhash_balls, string_tiling, toxicity_grammar
from farpoint.llm.common import table
from farpoint.session import materialize, ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the grammar predicts to be toxic."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity_grammar.clean_rows(docs, toxicity_grammar.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates, the document with the least id.

    Shingles of four words and at most four differing bits, as op9 takes them.
    """
    ship_package(spark)
    return simhash_balls.one_of_each(docs, radius=4, words=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a benchmark item leaks into."""
    ship_package(spark)
    return string_tiling.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as its source's target asks for."""
    return pivotal_mix.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the mix into 16 shards of near equal bytes."""
    return histogram_shards.with_shards(docs, shards=16)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The learned grammar and the random draws cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
