"""Scores over distributions and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def divergence(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], category: str, n: str) -> DataFrame:
    """Jensen-Shannon divergence, base 2, of the counts n of categories in a (rows of keys + by) and b (rows of by).

    Both empty: 0, one empty: 1. Returns keys, by and jsd for each (keys, by) of a."""
    unit = [*keys, *by]
    units = a.select(*unit).distinct()
    p = a.groupBy(*unit, category).agg(F.sum(n).alias("x"))
    q = units.join(b.groupBy(*by, category).agg(F.sum(n).alias("y")), by)
    both = p.withColumn("y", F.lit(0).cast("long")).unionByName(q.withColumn("x", F.lit(0).cast("long"))).groupBy(*unit, category).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    totals = both.groupBy(*unit).agg(F.sum("x").alias("xs"), F.sum("y").alias("ys"))
    share = both.join(totals, unit).withColumns({"p": F.when(F.col("xs") > 0, F.col("x") / F.col("xs")), "q": F.when(F.col("ys") > 0, F.col("y") / F.col("ys"))})
    middle = (F.col("p") + F.col("q")) / 2
    term = lambda v: F.when(F.col(v) > 0, 0.5 * F.col(v) * F.log2(F.col(v) / middle)).otherwise(0.0)
    out = share.groupBy(*unit).agg(F.max("xs").alias("xs"), F.max("ys").alias("ys"), F.sum(term("p") + term("q")).alias("s"))
    score = F.when((F.col("xs") == 0) & (F.col("ys") == 0), 0.0).when((F.col("xs") == 0) | (F.col("ys") == 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "s")))
    return out.select(*unit, score.alias("jsd"))


def deviation(indicators: list[Column], jsd: Column) -> Column:
    """Mean of yes-or-no indicators and a divergence."""
    return (reduce(Column.__add__, [F.when(x, 1.0).otherwise(0.0) for x in indicators]) + jsd) / (len(indicators) + 1)


def confidence(dates: Column, ratio: Column) -> Column:
    return F.when((dates >= 5) & (ratio >= 0.5), "high").when((dates >= 3) & (ratio >= 0.2), "medium").otherwise("low")
