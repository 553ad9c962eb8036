"""Choice of a time window: coverage, buckets of five widths, comparison and recommendation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled
from ..functions.times import bucket, floor

# Widths in seconds, in order, and the gates of coverage.
WIDTHS = {"1min": 60, "5min": 300, "15min": 900, "1h": 3600, "1d": 86400}
MIN_HOSTS, MIN_MEMBERS, MIN_DATES, MIN_HOURS, MIN_PARSEABLE = 2, 3, 2, 24.0, 95.0
SAMPLED = ("head_per_member", "global_head")


def coverage(df: DataFrame) -> DataFrame:
    """One row: totals, exact distinct counts and the span of time."""
    t = F.col("event_time")
    return df.agg(
        F.count("*").alias("n_events"), F.count(t).alias("n_parseable"),
        F.count_distinct(filled(F.col("host_raw"))).alias("n_hosts"), F.count_distinct(filled(F.col("member_name"))).alias("n_members"),
        F.count_distinct(floor(t, "day")).alias("n_dates"), F.min(t).alias("first_time"), F.max(t).alias("last_time"),
    )


def gate(covered: DataFrame, strategy: str = "full") -> DataFrame:
    """coverage with span_seconds, status (ok or insufficient) and the gates that fail; sampled input never passes."""
    span = (F.unix_micros(F.col("last_time").cast("timestamp")) - F.unix_micros(F.col("first_time").cast("timestamp"))) / 1_000_000
    share = F.when(F.col("n_events") > 0, 100.0 * F.col("n_parseable") / F.col("n_events")).otherwise(0.0)
    tests = {
        "hosts": F.col("n_hosts") < MIN_HOSTS, "members": F.col("n_members") < MIN_MEMBERS, "dates": F.col("n_dates") < MIN_DATES,
        "span": F.coalesce(F.col("span_seconds"), F.lit(0.0)) < MIN_HOURS * 3600, "parseable": share < MIN_PARSEABLE, "sampling": F.lit(strategy in SAMPLED),
    }
    out = covered.withColumn("span_seconds", span)
    fails = F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()]))
    return out.withColumn("failed", F.array_join(fails, ";")).withColumn("status", F.when(F.size(fails) == 0, "ok").otherwise("insufficient"))


def buckets(df: DataFrame, seconds: int, exact: bool = False) -> DataFrame:
    """window_start, n_events, n_hosts, and distinct processes, destinations and users (by sketch unless exact)."""
    count = F.count_distinct if exact else F.approx_count_distinct
    some = df.where(F.col("event_time").isNotNull())
    return some.groupBy(bucket(F.col("event_time"), seconds).alias("window_start")).agg(
        F.count("*").alias("n_events"), F.count_distinct(filled(F.col("host_raw"))).alias("n_hosts"),
        *[count(filled(F.col(c))).alias(n) for c, n in (("process_raw", "n_processes"), ("destination_raw", "n_destinations"), ("user_raw", "n_users"))],
    )


def summarize(found: DataFrame, size: str) -> DataFrame:
    """One row of the comparison; the number of windows is arithmetic, none is made."""
    w = WIDTHS[size]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = found.agg(
        F.min("window_start").alias("lo"), F.max("window_start").alias("hi"), F.count("*").alias("n_filled"), F.sum("n_events").alias("n_events"),
        F.median("n_events").alias("median_events"), F.avg("n_events").alias("mean_events"), F.max("n_events").alias("max_events"),
        *[F.median(F.when(F.col(c) > 0, F.col(c))).alias(f"median_{c[2:]}") for c in ("n_hosts", "n_processes", "n_destinations", "n_users")],
    )
    total = F.coalesce(((micros("hi") - micros("lo")) / (w * 1_000_000) + 1).cast("long"), F.lit(0).cast("long"))
    return a.select(F.lit(size).alias("window_size"), total.alias("n_windows"), "n_filled", F.when(total > 0, 100.0 * (total - F.col("n_filled")) / total).alias("empty_pct"), "n_events", "median_events", "mean_events", "max_events", "median_hosts", "median_processes", "median_destinations", "median_users")


def compare(df: DataFrame, exact: bool = False) -> DataFrame:
    return reduce(DataFrame.unionByName, [summarize(buckets(df, w, exact), size) for size, w in WIDTHS.items()])


def recommend(compared: DataFrame, status: str | Column = "ok") -> DataFrame:
    """primary, backup, no or review_needed for each size, and why: the first two that are under half empty with a median of 5."""
    from pyspark.sql.window import Window

    order = F.lit(0)
    for i, s in enumerate(WIDTHS):
        order = F.when(F.col("window_size") == s, i).otherwise(order)
    fits = F.coalesce((F.col("empty_pct") < 50) & (F.col("median_events") >= 5) & (F.lit(status) == "ok"), F.lit(False))
    w = Window.orderBy("_i")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = compared.withColumn("_i", order).withColumn("_fits", fits).withColumn("_nth", F.count_if("_fits").over(w))
    first = F.min(F.when(F.col("_fits"), F.col("_i"))).over(every)
    second = F.coalesce(F.min(F.when(F.col("_fits") & (F.col("_nth") == 2), F.col("_i"))).over(every), F.lit(list(WIDTHS).index("1h")))
    d = d.withColumns({"_first": first, "_second": second})
    said = F.when(F.col("_first").isNull(), "review_needed").when(F.col("_i") == F.col("_first"), "primary").when(F.col("_i") == F.col("_second"), "backup").otherwise("no")
    empty = F.coalesce(F.col("empty_pct").cast("string"), F.lit("?"))
    named = lambda at: F.element_at(F.array(*[F.lit(s) for s in WIDTHS]), at + 1)
    why = (
        F.when(~(F.lit(status) == "ok"), "coverage is not sufficient to choose a window").when(F.col("_first").isNull(), "no window is under half empty with a median of 5 events")
        .when(said == "primary", F.format_string("smallest window under half empty (%s%%) with a median of %s events", empty, F.col("median_events").cast("string")))
        .when(said == "backup", F.format_string("next choice, %s%% empty", empty))
        .when(F.col("_i") < F.col("_first"), F.format_string("too fine: %s%% empty or a median under 5 events; %s is better", empty, named(F.col("_first"))))
        .otherwise(F.format_string("coarser than %s; only for sparse data", named(F.col("_second"))))
    )
    return d.withColumns({"recommendation": said, "reason": why}).drop("_i", "_fits", "_nth", "_first", "_second")
