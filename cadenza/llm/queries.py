"""The registered queries of this subpackage: QUERIES by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import hostrules, minhash, mixing, vectordup
from cadenza.llm.crf import quality
from cadenza.llm.hostrules import quality_rules
from cadenza.llm.idfiles import id_file_digests
from cadenza.llm.minhash import near_duplicates
from cadenza.llm.mixing import mix_sources
from cadenza.llm.ngram import held_out_scores
from cadenza.llm.packing import pack
from cadenza.llm.rollup import token_counts
from cadenza.llm.toxicity import toxicity
from cadenza.llm.vectordup import near_duplicate_vectors
from cadenza.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


ORACLES["op10_minhash"] = minhash.ORACLE


@query
def op9_hostrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


ORACLES["op9_hostrules"] = hostrules.ORACLE


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLES["op4_mixing"] = mixing.ORACLE


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


@query
def op5_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(read(spark, sf_dir, "documents"), least=1)


@query
def op6_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_file_digests(read(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).withColumn("held_out", F.coalesce("held_out", F.lit(False)))


@query
def op8_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).withColumn("held_out", F.coalesce("held_out", F.lit(False)))


@query
def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


ORACLES["op1_hnsw"] = vectordup.ORACLE


@query
def op2_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
