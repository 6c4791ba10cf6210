"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written and read again as the next stage's
documents.  All stages but the last return the columns of documents; mixing
returns a document as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flockwatch.llm.common import read_table
from flockwatch.llm.decontaminate import decontaminated
from flockwatch.llm.jaccard import one_per_group
from flockwatch.llm.mixing import mixed_documents
from flockwatch.llm.sharding import shard_documents
from flockwatch.llm.toxicity import without_toxic
from flockwatch.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word Jaccard similarity of 0.8 and more."""
    return one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage worth a twentieth of their words."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target weights; documents as often as they are taken."""
    return mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return shard_documents(docs, 40)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

# Rows of an Arrow batch.  Stages follow each other in the same executors, and the JVM keeps the
# buffers of its largest batches, so they are small here.
BATCH_ROWS = 1000

# A trained classifier and near-duplicate components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, BATCH_ROWS)
    try:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(setting, before)
    return STAGES[-1][1](spark, docs, sf_dir)
