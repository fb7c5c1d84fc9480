"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, nbest, near_dedup, packing, posting_ann, quality, sharding, surrogates, token_files, toxicity
from .scratch import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), forest).drop("text")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogates.session_key(spark))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return posting_ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op9_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encode_digest(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = token_files.token_folder(docs)
    return token_files.read_token_files(token_files.write_token_files(docs, folder, WORD_BPE), folder)


QUERIES = {
    "op1_pack": op1_pack,
    "op2_near_dedup": op2_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_surrogates": op6_surrogates,
    "op7_shards": op7_shards,
    "op8_nearest": op8_nearest,
    "op9_sentencepiece_nbest": op9_sentencepiece_nbest,
    "op10_token_files": op10_token_files,
}
ORACLE_SQL = {"op3_line_dedup": line_dedup.ORACLE_SQL, "op7_shards": sharding.oracle_sql()}
