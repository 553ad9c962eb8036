"""The registered queries over the text tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html, language, lines, near, oracles, quality, secrets, warc
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digest(chat.format_chats(turns.unionByName(more)))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC archives against a replica with changed and lost records."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    replica = warc.archive_pages(warc.damaged(pages), bodies=False).where(~F.coalesce(F.col("page_id") % warc.LOST[0] == warc.LOST[1], F.lit(False)))
    return warc.audit(warc.leaves(warc.archive_pages(pages, bodies=False)), warc.leaves(replica))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", language.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "base_failed", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_decontaminate": op6_decontaminate,
    "op2_chat_format": op2_chat_format,
    "op3_html_extract": op3_html_extract,
    "op4_near_dedup": op4_near_dedup,
    "op7_language_id": op7_language_id,
    "op9_byte_bpe": op9_byte_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op10_secret_scan": op10_secret_scan,
}
ORACLES: dict[str, str] = {"op1_line_dedup": oracles.LINES, "op2_chat_format": oracles.CHATS, "op5_warc_fixity": warc.ORACLE, "op6_decontaminate": decontaminate.ORACLE, "op8_quality_rules": quality.ORACLE}
