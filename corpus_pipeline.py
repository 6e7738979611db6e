"""A corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of documents.

Each stage judges rows, not ids: rows with a null doc_id are documents like all others, and of rows that share a doc_id each
has its own verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, ngram_join, packing, pii, quality
from tessera.llm.common import ROW, row_keys
from tessera.session import materialize, table


def _keep(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key is in ``rows`` (doc_id: row keys, unique), without the key."""
    kept = keyed.join(rows.select(F.col("doc_id").alias("__keep")), F.col(ROW) == F.col("__keep"), "left_semi")
    return kept.drop(ROW)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go.  Each row of a repeated id has the labels of that id."""
    keyed = row_keys(docs)
    labels = table(spark, sf_dir, "labels")
    labels = labels.join(keyed.select("doc_id", ROW), "doc_id").drop("doc_id").withColumnRenamed(ROW, "doc_id")
    return _keep(keyed, quality.judge(keyed, labels, id_col=ROW, unique=True).filter("keep"))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one of the least id, null last, and one of those among equal ids."""
    keyed = row_keys(docs)
    groups = ngram_join.ngram_components(keyed, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    chosen = groups.join(keyed.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min_by(ROW, order).alias("doc_id"))
    return _keep(keyed, chosen)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    keyed = row_keys(docs)
    verdict = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=ROW)
    return _keep(keyed, verdict.filter("not contaminated"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the sign of its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The stages hold a trained model, a set join and a tokenizer; SQL cannot state them, tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
