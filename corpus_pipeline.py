"""A training corpus from `documents`: quality, near duplicates, benchmark leaks, source weights, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes each result as Parquet in the shared folder and reads it again. All stages but the last return the columns of `documents`.

Stages decide by row, not by doc_id: a row is known by a hash of all its columns, so rows that share a doc_id, or have none, are told apart. Rows that are equal in every column are decided alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.common import delete_scratch, free_name, row_key, scratch_scope, stash
from quizmill.llm.decontaminate import contaminated
from quizmill.llm.importance import resample
from quizmill.llm.mixing import mixed_texts
from quizmill.llm.ngram_join import near_classes
from quizmill.llm.sharding import shard_rows


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with their key, and its name: one that `docs` does not have."""
    row = free_name(docs, "row_key")
    return docs.withColumn(row, row_key(docs)), row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling selects; labelled rows of the labels table set the target."""
    rows, row = _keyed(docs)
    chosen = resample(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=(row,)).where("selected").select(row)
    return rows.join(chosen.hint("merge"), row, "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that of the least doc_id (none: last), then of the least row hash."""
    rows, row = _keyed(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    stays = near_classes(rows, keep=(row,)).groupBy("group").agg(F.min(order).alias("first")).select(f"first.{row}")
    return rows.join(stays.hint("merge"), row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, row = _keyed(docs)
    leaks = contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=(row,)).select(row).distinct()
    return rows.join(leaks.hint("merge"), row, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document, epoch and output shard of the draw."""
    rows, row = _keyed(docs)
    return mixed_texts(rows, key=row).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard, slot in the shard and the shard with one shard more."""
    return shard_rows(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing), ("sharding", sharding)]

#: Hashed models, MinHash and a randomised SVD: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against planted and odd rows, the operators' own tests against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. When a stage's result is written, what it and its predecessor left in the shared folder is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch_scope() as paths:
        for i, (_, stage) in enumerate(STAGES):
            docs = stash(stage(spark, docs, sf_dir), f"stage{i}")
            delete_scratch(spark, paths, keep=(paths[-1],))
    return docs
