"""From raw documents to a training mix, in five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept, and returns a DataFrame that is written and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from motifloom.llm import common, decontaminate, near_dedup, quality, secret_scan, source_mix
from motifloom.sources.storage import remove


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap with no benchmark item."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kinds."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in its training positions, with epoch and position."""
    return source_mix.mixed(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_copies),
    ("decontamination", decontaminated),
    ("secrets", redacted),
    ("mix", mixed),
]

#: SQL can express neither the classifier nor the near duplicates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages; between stages they are written to the shared checkpoint folder.

    A stage's table goes once the next one is written; that of the last but
    one stays, as the rows returned are read from it.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder, before = common.shared_folder(spark) + f"/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
