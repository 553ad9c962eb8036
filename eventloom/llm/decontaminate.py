"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A text's words are its runs of letters and digits in lower case; its set, its distinct five-word shingles. An item is in
a document if PERCENT hundredths or more of the item's set are in the document's.

Documents are partitioned by the size of their set, one partition for each power of two. A partition's signature is a
one-permutation MinHash: the hash space is cut into bins, and each bin keeps its minimum. A short item inside a long
document has a small Jaccard similarity, so the number of bins follows from the partition's largest size and the smallest
item: with `load` shingles a bin, a shared shingle is its bin's minimum with probability (1 - exp(-load)) / load, and an
item is missed only if all its shared shingles are not; the load is the largest whose miss is at most MISS. Items of
five words need every shingle, and the signature then is the whole set. A document and an item that agree in a bin are a
candidate; candidates are verified on the words themselves.

The item signatures are broadcast only if their counted rows are within BROADCAST_ROWS, else joined by a shuffle.

Cases: null or empty text has no set and is in nothing; fewer than five words make one shingle, found in a document of
just these words; items with one item_id are one item, the union; repeated rows of documents give one pair; null item_id
is left out, null doc_id is kept; an empty table gives no pairs; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, free, let, numbered, of_ids

WORDS, PERCENT, MISS = 5, 75, 1e-9
BROADCAST_ROWS = 2_000_000
#: Powers of two of set sizes; a larger set belongs to the last partition, whose bins are then all the hashes.
PARTITIONS = 40


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")


def shingles(w: Column) -> Column:
    """Distinct shingles as text."""
    runs = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - WORDS + 1), lambda i: F.array_join(F.slice(v, i, WORDS), " "))
    of = lambda v: F.when(F.size(v) >= WORDS, F.array_distinct(runs(v))).when(F.size(v) > 0, F.array(F.array_join(v, " "))).otherwise(F.array().cast("array<string>"))
    return let(w, of)


def hashes(w: Column) -> Column:
    """Sorted distinct hashes of the shingles of words w."""
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))
    of = lambda h: F.when(F.size(h) >= WORDS, F.sort_array(F.array_distinct(runs(h)))).when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))).otherwise(F.array().cast("array<long>"))
    return let(F.transform(w, lambda x: F.xxhash64(x)), of)


def bits(smallest: int, percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """Of each partition, the bits of a hash that name its bin."""
    shared = max(1, math.ceil(percent * smallest / 100))
    kept = 1 - miss ** (1 / shared)
    load = 16.0
    while -math.expm1(-load) / load < kept and load > 1e-12:
        load /= 2
    return [min(62, max(1, math.ceil(math.log2(2 ** (p + 1) / load)))) for p in range(PARTITIONS)]


def partition_of(size: Column) -> Column:
    return F.least(F.lit(PARTITIONS - 1), F.floor(F.log2(size.cast("double"))).cast("int"))


def minima(sorted_hashes: Column, shift: Column) -> Column:
    """The first hash of each bin."""
    bin_ = lambda x: F.call_function("shiftrightunsigned", x, shift)
    return F.filter(sorted_hashes, lambda x, i: (i == 0) | (bin_(x) != bin_(F.get(sorted_hashes, i - 1))))


def _shifts(widths: list[int]) -> Column:
    return F.array(*[F.lit(64 - b) for b in widths])


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, row, item_id, n_shared, n_item for each item inside a document. docs: doc_id, row, text; items: item_id, text."""
    known = items.where("item_id is not null").select("item_id", F.explode(shingles(words(F.col("text")))).alias("s")).distinct()
    known = cut(known)
    sizes = known.groupBy("item_id").agg(F.count("*").alias("n_item"))
    smallest = sizes.agg(F.min("n_item")).first()[0]
    widths = bits(smallest or 1, percent)

    # an item's hashes are those that its words give inside a document
    item_sets = known.select("item_id", let(hashes(F.split("s", " ")), lambda h: F.get(h, F.lit(0))).alias("h")).groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("h"))
    of_parts = item_sets.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTITIONS - 1)))).withColumn("shift", F.get(_shifts(widths), F.col("part")))
    item_rows = cut(of_parts.select("part", "item_id", F.explode(minima(F.col("h"), F.col("shift"))).alias("h")).distinct())

    def signed(h: Column) -> Column:
        part = partition_of(F.size(h))
        return F.struct(part.alias("part"), let(F.get(_shifts(widths), part), lambda shift: minima(h, shift)).alias("m"))

    sets = docs.select("doc_id", "row", let(hashes(words(F.col("text"))), signed).alias("x"))
    rows = sets.select("doc_id", "row", "x.part", F.explode("x.m").alias("h"))
    small = F.broadcast(item_rows) if item_rows.count() <= BROADCAST_ROWS else item_rows
    candidates = cut(rows.join(small, ["part", "h"]).groupBy("doc_id", "row", "item_id").agg(F.count("*").alias("bins")))

    texts = of_ids(docs, candidates.select("doc_id")).dropDuplicates(["doc_id", "row"])
    found = texts.select("doc_id", "row", F.explode(shingles(words(F.col("text")))).alias("s"))
    spelled = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    shared = found.join(spelled, "s").groupBy("doc_id", "row", "item_id").agg(F.count("*").alias("n_shared"))
    told = shared.join(sizes, "item_id").where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    keys = ["doc_id", "row", "item_id"]
    same = F.lit(True)
    for k in keys:
        same = same & told[k].eqNullSafe(candidates[k])
    return told.join(candidates, same, "left_semi").select(*keys, "n_shared", "n_item")


def find(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shared (largest of the id's texts), n_item."""
    pairs = contained(numbered(docs.select("doc_id", "text")), items.select("item_id", "text"), percent)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The docs that hold no item; ids with several texts lose those that do."""
    row = free(docs, "row")
    rows = numbered(docs, row=row)
    bad = cut(contained(numbered(docs.select("doc_id", "text")), items.select("item_id", "text"), percent).select("doc_id", "row").distinct())
    small = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return rows.join(small, rows["doc_id"].eqNullSafe(small["doc_id"]) & (rows[row] == small["row"]), "left_anti").drop(row)


#: The same containment by brute force in SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
si AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(any_value(n_item) AS BIGINT) AS n_item
FROM ds JOIN si USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n_item)
"""
