"""A corpus pipeline of five stages over the documents table.

Quality rules reject documents; line dedup cuts passages that an earlier
document has; near-dedup keeps one document of each group; decontamination
drops documents that hold a benchmark window; the last stage encodes what is
left and reports on it. Each stage reads the Parquet its predecessor wrote.

No stage but decontamination can be said in SQL (estimates, alignments,
signatures, pieces), so ORACLE_SQL is None; the stages are tested against
brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from halosift.llm import leaks, near, passages, pieces, quality
from halosift.llm.tables import shared_dir, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.report(docs)


STAGES = [
    ("quality_rules", reject_low_quality),
    ("line_dedup", cut_repeated_passages),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents; tables between them go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
