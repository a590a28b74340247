"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns the columns of
documents; the last returns the places of the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import digest_index, near_dup, packing, quality, toxicity
from furrow.llm.common import load, materialise, run_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.learn(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, model, accepted_only=True).select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic spans."""
    model = toxicity.learn(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, spans=False, clean_only=True).select(*docs.columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each text."""
    work = run_dir(spark, "exact")
    return digest_index.keep_first(docs, digest_index.DigestIndex(spark, f"{work}/index"), work)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates."""
    kept = near_dup.groups(docs, run_dir(spark, "near")).filter("kept").select(F.col("doc_id").alias("__kept"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of fixed capacity."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_clean),
    ("exact dedup", keep_first_copies),
    ("near dedup", keep_one_of_each_group),
    ("best-fit packing", pack_sequences),
]

#: Scores, token ids and packing can't be told in SQL; tests/llm holds each stage's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    work = run_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"{work}/{k}")
    return docs
