"""A corpus pipeline of five operators, in order: quality, near duplicates, contamination, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.llm import bpe, decontaminate, importance, near_dup, secrets
from tierstone.llm.common import Scratch, broadcast_few, table

#: SQL can't express the classifier, the signatures or the merges: the stages are tested against brute force.
ORACLE_SQL = None


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows of those ids; rows without an id stay. The ids are written first, and broadcast only while they are few."""
    ids = Scratch(docs.sparkSession, "dropped").save(ids.select(F.col("doc_id").alias("dropped_id")).where("dropped_id IS NOT NULL").distinct())
    return docs.join(broadcast_few(ids), docs["doc_id"] == F.col("dropped_id"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier samples. An id of several rows goes if each of them is rejected."""
    judged = importance.importance_resample(docs, table(spark, sf_dir, "labels"))
    return without(docs, judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id. Of rows that repeat an id, one stays."""
    found = near_dup.near_duplicates(docs)
    alone = without(docs, found.where("NOT kept"))
    again = Scratch(spark, "again").save(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("again_id")).count().where("count > 1").select("again_id"))
    if again.isEmpty():
        return alone
    once = alone.join(broadcast_few(again), alone["doc_id"] == F.col("again_id"), "left_semi").dropDuplicates(["doc_id"])
    return without(alone, again.withColumnRenamed("again_id", "doc_id")).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark contaminates."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where(decontaminate.is_contaminated()))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret. Owner and repository are those of op9_ownership_frequency."""
    placed = docs.withColumn("repository__", F.concat_ws("/", "source", "lang"))
    return secrets.redact(placed, repository_col="repository__").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, bpe.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secret_scan),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir; what each stage before it returns is written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
