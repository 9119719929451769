"""The corpus pipeline: from raw documents to packed training sequences.

Each stage reads what its predecessor wrote, works on all of it, and but for
the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, minhash, mix, pack, pii
from tessera.llm.common import fresh, release, stored, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; rejected ones go."""
    predicted, score, rejected = fresh(docs, "lang_pred", "score", "rejected")
    judged = langid.identify(docs, langid.fitted(docs), into=(predicted, score, rejected))
    return judged.where(~F.col(rejected)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8.

    Groups are made of texts, not of ids: of a group one row stays, that of
    the smallest id; different texts of one id are documents of their own.
    """
    return minhash.one_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of its kinds; lengths follow the new texts."""
    out = pii.mask_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target share asks, in one random order.

    A null source is the empty source, a null text has size 1, and no rows
    give none.
    """
    return mix.poisson_mix(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences of at most 1024.

    A null text is the end mark alone; repeated documents have pieces of their
    own; no rows give none.
    """
    return pack.pack_documents(docs, with_ids=True)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: No SQL: language models, MinHash and packing have no SQL form; the tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the whole table; scratch tables go as soon as a later stage is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = written() - (name != STAGES[0][0])  # from the previous stage's result on
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, mark)
    return docs
