"""Helpers shared by the text operators: tables, lineage cuts, let-bindings and word splitting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..state import cut, release, shared_dir  # noqa: F401

#: Byte and code-point class that separates words.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows instead of the default 10,000, so that workers hold few texts; a setting of the caller's stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column, lower: bool = False) -> Column:
    """The maximal runs of characters outside SPACE; null text has none."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(F.translate(flat, UPPER, UPPER.lower()) if lower else flat, " "), "")


#: Ids, 16 bytes each, up to which a list of documents is broadcast.
BROADCAST_IDS = 1_000_000


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, text: str = "text", row: str = "row") -> DataFrame:
    """docs with the column `row`, which tells texts of one doc_id apart."""
    return docs.withColumn(row, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def of_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The docs of these ids (left_anti: the others); the list is broadcast only if its count is within BROADCAST_IDS."""
    ids = cut(ids.distinct().toDF("_id"))
    small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(small, F.col("doc_id").eqNullSafe(F.col("_id")), how)


#: Elements of an array that are folded at once.
BLOCK = 512


def blocks(values: Column, size: int) -> Column:
    """An array that isn't empty as arrays of `size` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, size))


def _running(sizes: Column) -> Column:
    """Sums before each element."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(sizes, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def starts(sizes: Column) -> Column:
    """Sums before each element, block by block: an array that grows by one is copied within a block only."""
    def by_block(b: Column) -> Column:
        totals = F.transform(b, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v))
        return F.flatten(F.zip_with(b, _running(totals), lambda x, at: F.transform(_running(x), lambda v: v + at)))

    return F.when(F.size(sizes) == 0, F.array().cast("array<long>")).otherwise(let(sizes, lambda s: let(blocks(s, BLOCK), by_block)))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
