"""From raw documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import hostrules, mixing, packing, toxicity
from cadenza.llm.minhash import BROADCAST_IDS, near_duplicates
from cadenza.session import drop, read, stored


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: a document stays that passes the base rules and whose host isn't rejected."""
    return hostrules.passing(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: a document stays whose most toxic window scores below 0.5; learnt from the labelled ones among docs."""
    return toxicity.acceptable(docs, toxicity.fit_in_task(docs, read(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the smallest id of each group stays, once; rows without an id stay.

    Rows of one id are one document: of several that stay, the one with the smallest text (null first) does.
    """
    verdicts = stored(near_duplicates(docs).where("doc_id is not null").select("doc_id", "kept"), "verdicts")
    gone = stored(verdicts.where("not kept").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    named = docs.where("doc_id is not null").join(gone, F.col("doc_id") == F.col("_id"), "left_anti")
    twice = stored(verdicts.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")), "twice")
    if not twice.isEmpty():
        same = F.col("doc_id") == F.col("_id")
        one = named.join(twice, same, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row"))
        named = named.join(twice, same, "left_anti").unionByName(one.select("row.*"))
    return named.unionByName(docs.where("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as many times as systematic sampling takes it."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A classifier and a tokenizer are part of it, which SQL can't express; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stored(stage(spark, docs, sf_dir), name)
        drop(docs)  # what an earlier stage has written; nothing that is read from sf_dir
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
