"""A corpus from documents: language ID, line dedup, near-dedup, benchmark decontamination, tokens.

STAGES are (name, function) of (spark, docs, sf_dir); each works on all that the one before kept, and its result is
written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, decontaminate, language, lines, near
from eventloom.llm.shared import cut, of_ids, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; a null lang becomes the predicted one."""
    found = language.identify(docs.select(COLUMNS), language.learn(docs))
    return found.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with a word that match an earlier one go, and documents that have no word left after that; n_chars follows the text."""
    out = lines.dedup_lines(docs.select(COLUMNS), least=1)
    out = out.where((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id."""
    return of_ids(docs.select(COLUMNS), near.dedup(docs).where(~F.col("kept")).select("doc_id"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the decoded ids are the text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs.select(COLUMNS), path, public_tokenizers.PATTERN, exact="exact")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: Near-dedup's signatures and the trained language model are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
