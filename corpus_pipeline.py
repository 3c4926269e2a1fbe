"""A training corpus from `documents`: quality, exact copies, near copies, benchmark leaks, tokens.

Each stage takes all that the one before it kept, writes nothing itself and returns a DataFrame; run() stores
every stage in the shared folder and reads it again, so a lost executor costs no more than its own stage's work.
All stages but the last return the columns of `documents`, unchanged.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm import bpe, decontaminate, exact_dedup, gam, near_dedup
from feedweave.llm.common import read_table, stored
from feedweave.llm.queries import BYTE_BPE
from feedweave.session import ship_package

NEAR = Fraction(8, 10)
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier of labels.quality scores LEAST_QUALITY or more; it is fitted on `docs`.

    A row is judged by its text alone, a null one as an empty one; rows without doc_id are judged but teach nothing.
    """
    ship_package(spark)
    return gam.keep_good(docs, gam.train(docs, read_table(spark, sf_dir, "labels")), LEAST_QUALITY)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row for each text: of equal texts that with the largest doc_id.

    A row without doc_id stays only if no row of its text has one; texts that share a doc_id are judged each for
    itself; of rows that repeat doc_id and text one stays.
    """
    ship_package(spark)
    return exact_dedup.distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of NEAR or more keeps the document with the smallest doc_id.

    A row without doc_id links nothing and stays; texts that share a doc_id are judged each for itself, and of a
    group whose smallest doc_id has several texts in it one of these stays.
    """
    ship_package(spark)
    return near_dedup.without_near_copies(docs, NEAR)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of `benchmark`, copied or edited; a row is judged by its text alone, whatever its doc_id."""
    ship_package(spark)
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row's text (null: empty), and whether decoding gives the text back."""
    ship_package(spark)
    coded = bpe.encode_documents(docs, BYTE_BPE, keep=("doc_id", "text"))
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", leaks), ("bpe", tokens)]

#: No SQL: the first stage is a fitted model. tests/llm/test_pipeline.py holds the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    out = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stored(stage(spark, out, sf_dir), f"stage-{name.replace(' ', '-')}")
    return out
