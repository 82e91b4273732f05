"""From raw documents to training shards: five stages, each on all that the one before kept.

1. ``quality``: documents that the line CRF rejects go.
2. ``near_duplicates``: of each component of the n-gram Jaccard join one document stays.
3. ``decontamination``: documents that hold a benchmark item go.
4. ``mixing``: each document is repeated as often as the weighted fair queue takes it, 0 to 3 times.
5. ``sharding``: rows get a shard and a slot in it.

Every stage takes and returns the columns of ``documents``; the last adds ``shard`` and ``slot``. Nulls, empty texts,
repeated rows and empty tables are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtab.llm import decontam, jaccard, mixing, quality, sharding
from symtab.llm.common import fresh, materialize, table

N_SHARDS = 24


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_per_component(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.fair_mix(docs).filter("copies > 0")
    (again,) = fresh(mixed, "copy")
    return mixed.withColumn(again, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.interleaved_shards(docs, N_SHARDS, tie_col="text")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier's training can't be written in SQL; tests compare each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
