"""Relational building blocks of the stages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..state import cut

#: Intervals up to which their frame is broadcast.
PERIODS = 10_000

UNASSIGNED = ("full_pilot_unassigned", "unassigned")
BENIGN, EVALUATION, OTHER = "verified_benign", "evaluation", "other"


class Interval(NamedTuple):
    """[start, end) with a name and a role; times as ISO text, naive UTC."""

    period: str
    start: str
    end: str
    role: str


def check_policy(intervals: list[Interval]) -> None:
    """Raises unless names, roles, order, and the place of benign before evaluation are right."""
    roles: dict[str, str] = {}
    for i in intervals:
        if not i.period.strip() or i.period == UNASSIGNED[0]:
            raise ValueError(f"a period needs a name other than {UNASSIGNED[0]}")
        if i.role not in (BENIGN, EVALUATION, OTHER):
            raise ValueError(f"{i.period}: unknown role {i.role}")
        if roles.setdefault(i.period, i.role) != i.role:
            raise ValueError(f"{i.period} has two roles")
        if not i.start < i.end:
            raise ValueError(f"{i.period} ends before it starts")
    ordered = sorted(intervals, key=lambda i: i.start)
    for a, b in zip(ordered, ordered[1:], strict=False):
        if b.start < a.end:
            raise ValueError(f"{a.period} and {b.period} overlap")
    ends = [i.end for i in intervals if i.role == BENIGN]
    starts = [i.start for i in intervals if i.role == EVALUATION]
    if ends and starts and max(ends) > min(starts):
        raise ValueError("a benign period ends after the first evaluation starts")


def assign_period(df: DataFrame, time: str, intervals: list[Interval]) -> DataFrame:
    """df with period and period_role, from the interval that holds `time`: one projection, no join."""
    check_policy(intervals)
    name, role = F.lit(UNASSIGNED[0]), F.lit(UNASSIGNED[1])
    for i in intervals:
        inside = (F.col(time) >= F.lit(i.start).cast("timestamp_ntz")) & (F.col(time) < F.lit(i.end).cast("timestamp_ntz"))
        name, role = F.when(inside, i.period).otherwise(name), F.when(inside, i.role).otherwise(role)
    return df.withColumns({"period": name, "period_role": role})


def join_periods(df: DataFrame, time: str, periods: DataFrame) -> DataFrame:
    """The same from a frame of intervals (period, start_time, end_time, period_role), broadcast if PERIODS rows or fewer are counted."""
    inside = (df[time] >= periods["start_time"]) & (df[time] < periods["end_time"])
    small = F.broadcast(periods) if periods.count() <= PERIODS else periods
    out = df.join(small, inside, "left").drop("start_time", "end_time")
    return out.withColumns({"period": F.coalesce("period", F.lit(UNASSIGNED[0])), "period_role": F.coalesce("period_role", F.lit(UNASSIGNED[1]))})


def order_key(locator: list[str]) -> Column:
    """A struct that sorts by locator with nulls last."""
    return F.struct(*[y for c in locator for y in (F.col(c).isNull().alias(f"_{c}"), F.col(c).alias(c))])


def earliest(columns: list[str], locator: list[str]) -> Column:
    """Aggregate: these columns of the row that comes first by locator."""
    return F.min_by(F.struct(*columns), order_key(locator))


def first_k(df: DataFrame, keys: list[str], locator: list[str], k: int, value: str, out: str) -> DataFrame:
    """keys and the list of `value` of the first k rows of each group; only k rows of a task's share of a group are shuffled on."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in locator]))
    top = df.withColumn("_k", place).where(F.col("_k") <= k)
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", value))).alias("_v")).select(*keys, F.transform("_v", lambda x: x[value]).alias(out))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank_number") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def new_in_evaluation(df: DataFrame, keys: list[str], role: str = "period_role") -> DataFrame:
    """Distinct keys of evaluation rows that no benign row has."""
    return df.where(F.col(role) == EVALUATION).select(*keys).distinct().join(df.where(F.col(role) == BENIGN).select(*keys).distinct(), keys, "left_anti")


def gap_segments(df: DataFrame, keys: list[str], time: str, seconds: int, out: str = "segment") -> DataFrame:
    """Rows numbered by runs whose neighbours are `seconds` apart."""
    w = Window.partitionBy(*keys).orderBy(time)
    step = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    return df.withColumn("_new", F.when(step == seconds * 1_000_000, 0).otherwise(1)).withColumn(out, F.sum("_new").over(w)).drop("_new")


def densify(buckets: DataFrame, time: str, seconds: int, values: list[str], limit: int = 1_000_000) -> DataFrame:
    """All buckets from the first to the last, values 0 where there was none; more than `limit` buckets raise."""
    lo, hi = buckets.agg(F.min(time), F.max(time)).first()
    if lo is None:
        return buckets.select(time, *values)
    n = int((hi - lo).total_seconds()) // seconds + 1
    if n > limit:
        raise ValueError(f"{n} buckets; at most {limit} are made")
    start = F.lit(lo.isoformat()).cast("timestamp_ntz")
    grid = buckets.sparkSession.range(n).select((start + F.make_dt_interval(secs=F.col("id") * seconds)).alias(time))
    return grid.join(buckets.select(time, *values), time, "left").fillna(0, values)


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1..n over all rows: ranges of the order are numbered apart, then shifted by the counts before them.

    The ranges are written once, since both the numbers and the counts must come from the same ones."""
    parts = df.orderBy(*order).withColumn("_part", F.spark_partition_id())
    within = cut(parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = within.groupBy("_part").agg(F.max("_k").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(out, (F.col("_k") + F.col("_before")).cast("long")).drop("_part", "_k", "_before")
