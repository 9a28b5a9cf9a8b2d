"""Preparation of a corpus in five stages: language, near copies, repeated units, benchmark leaks, source mix.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; its result is
written as Parquet and read again as the next one's input. The last adds what the sampling decided.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import common, decontam, langid, mixing, setjoin, unitdedup
from spanlake.session import bound_batches, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages."""
    bound_batches(spark)
    return langid.keep_known(docs, langid.labelled_sample(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    bound_batches(spark)
    return setjoin.keep_one(docs, k=5, num=8, den=10)


def repeated_units(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and sentences that an earlier one has; those of which no word is left go."""
    bound_batches(spark)
    cut = unitdedup.dedup_units(docs)
    left = F.col("text").isNull() | (F.size("cut") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(left).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    bound_batches(spark)
    return decontam.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target mix, with the weight of each."""
    mixed = mixing.mix_sources(docs)
    return mixed.where("sampled").select(*docs.columns, "topic", "n_tokens", F.round("probability", 6).alias("probability"), F.round("weight", 6).alias("weight"))


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_units", repeated_units), ("benchmark_leaks", benchmark_leaks), ("source_mix", source_mix)]

#: Automata, the latent space and the set join of earlier stages are not SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
