"""A training corpus from the documents table, in five stages; each works on what the one before it kept.

Cases are defined by the operators' docstrings; every stage but the last returns the columns it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutes.llm import decontam, mixing, pii, quality, simhash
from minutes.llm.common import crc_bucket, stored, table
from minutes.llm.queries import PII_KEY


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; a fifth of the labels is left unlearned, as in op9."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), crc_bucket(F.col("doc_id"), 5) != 0)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, a similarity of 0.8."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten words in a row of a benchmark item; a row with a null id stays only if no
    such row is hit."""
    found = decontam.judge(docs, table(spark, sf_dir, "benchmark"), window=10)
    hit = stored(found.where("contaminated").select(F.col("doc_id").alias("__id")).distinct(), "contaminated")
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With pseudonyms for personal data; n_chars follows the text."""
    out = pii.pseudonymise(docs, PII_KEY, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled to tempered weights under a budget of as many tokens as there are."""
    return mixing.mix(docs, budget_share=1.0, entropy_gain=0.5, max_repeat=4.0)


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
]

#: A trained model, an index and bisection are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
