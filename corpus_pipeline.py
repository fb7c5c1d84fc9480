"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that its predecessor kept, written as a table between them.  All but the
last return the columns of documents: n_chars is set anew where a text was changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import line_dedup, near_dedup, packing, quality, surrogates
from tidelog.llm.queries import WORD_BPE
from tidelog.llm.scratch import materialise, ship


def _with_columns_of(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs`` and, if there is one, a true n_chars."""
    kind = dict(docs.dtypes).get("n_chars")
    return changed.select(*(F.length("text").cast(kind).alias(c) if c == "n_chars" else c for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the trees reject go; so do null texts, which have no words."""
    ship(spark)
    forest = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, forest).where("kept").select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one of them; a document may become empty."""
    ship(spark)
    return _with_columns_of(docs, line_dedup.dedup_lines(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id stays."""
    ship(spark)
    return near_dedup.keep_one(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; every document stays."""
    ship(spark)
    return _with_columns_of(docs, surrogates.replace_entities(docs, surrogates.session_key(spark)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    ship(spark)
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", minhash_near_dedup),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage is a trained model, which SQL can't express; tests hold all stages against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents: the stages in order, a table between each and the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
