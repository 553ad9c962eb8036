"""Field audit, quality issues and coverage of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import floor
from ..schema import APPLIES, COLUMNS, role_of

DROP_ABOVE, REVIEW_ABOVE = 80, 20


def long_form(df: DataFrame, fields: list[str], group: str, kind: str | None = None) -> DataFrame:
    """A row for each field of each row: group, object_type, field, value."""
    each = F.array(*[F.struct(F.lit(c).alias("field"), (F.col(c).cast("string") if c in df.columns else F.lit("")).alias("value")) for c in fields])
    return df.select(F.col(group).alias("source_type"), (F.upper(F.trim(F.col(kind))) if kind else F.lit("")).alias("object_type"), F.explode(each).alias("f")).select("source_type", "object_type", "f.field", "f.value")


def field_audit(df: DataFrame, fields: list[str] | None = None, group: str = "source_type", kind: str | None = "object_raw", approximate: bool = False) -> DataFrame:
    """source_type, field, total, missing, non_empty, distinct, applicable and applicable_missing of each field.

    One scan: rows become field rows, which the partial aggregate folds before the shuffle. `approximate` counts distinct
    values by sketch, with 0, 1 and more told apart exactly by minimum and maximum."""
    rows = long_form(df, fields or COLUMNS, group, kind)
    empty = F.coalesce(F.col("value"), F.lit("")) == ""
    applies = F.lit(True)
    for field, kinds in APPLIES.items():
        if kinds:
            applies = F.when(F.col("field") == field, F.col("object_type").isin(kinds)).otherwise(applies)
    value = F.when(~empty, F.col("value"))
    several = F.when(F.min(value).isNull(), 0).when(F.min(value) == F.max(value), 1).otherwise(F.greatest(F.lit(2), F.approx_count_distinct(value)))
    return rows.withColumns({"empty": empty, "applies": applies}).groupBy("source_type", "field").agg(
        F.count("*").alias("total"),
        F.count_if("empty").alias("missing"),
        F.count_if(~F.col("empty")).alias("non_empty"),
        (several if approximate else F.count_distinct(value)).cast("long").alias("distinct_values"),
        F.count_if("applies").alias("applicable"),
        F.count_if(F.col("applies") & F.col("empty")).alias("applicable_missing"),
    )


def decide(audit: DataFrame, hosts: Column | int = 2) -> DataFrame:
    """The audit with role, missing_pct and decision (keep, review or drop), by rules in a fixed order."""
    role = F.lit("entity")
    for c in COLUMNS:
        role = F.when(F.col("field") == c, role_of(c)).otherwise(role)
    hosts = F.lit(hosts) if isinstance(hosts, int) else hosts
    a = audit.withColumn("role", role)
    specific = F.col("role") == "object_specific"
    overall = F.when(F.col("total") > 0, 100.0 * F.col("missing") / F.col("total")).otherwise(100.0)
    own = F.when(F.col("applicable") > 0, 100.0 * F.col("applicable_missing") / F.col("applicable")).otherwise(100.0)
    a = a.withColumns({"missing_pct": overall, "pct": F.when(specific, own).otherwise(overall), "n": F.when(specific, F.col("applicable")).otherwise(F.col("total"))})
    host = F.col("field") == "host_raw"
    decision = (
        F.when(F.col("role").isin("provenance", "control"), "keep")
        .when(F.col("field") == "unmapped_property_keys_raw", F.when(F.col("distinct_values") == 0, "keep").otherwise("review"))
        .when(F.col("role") == "discovery", "keep")
        .when(specific & (F.col("applicable") == 0), "review")
        .when(host & (hosts <= 1), "keep")
        .when(F.col("pct") > DROP_ABOVE, "drop")
        .when((F.col("distinct_values") <= 1) & (F.col("n") > 10) & ~host, "drop")
        .when((F.col("field") == "timestamp_parsed") & (overall > 50), "review")
        .when(F.col("pct") > REVIEW_ABOVE, "review")
        .otherwise("keep")
    )
    return a.withColumn("decision", decision).drop("pct", "n")


def top_values(df: DataFrame, fields: list[str], group: str, k: int = 3) -> DataFrame:
    """The k most frequent values of each field: source_type, field, value, n, rank_number; ties by value."""
    counts = long_form(df, fields, group).where(F.coalesce("value", F.lit("")) != "").groupBy("source_type", "field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source_type", "field").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank_number", F.row_number().over(w).cast("long")).where(F.col("rank_number") <= k)


def approximate_top(df: DataFrame, field: str, group: str, k: int = 3) -> DataFrame:
    return df.groupBy(group).agg(F.expr(f"approx_top_k({field}, {k})").alias("top"))


# Quality issues in order of report: type, field, severity.
ISSUES = (
    ("json_parse_error", "parse_status", "high"),
    ("missing_timestamp", "timestamp_raw", "high"),
    ("timestamp_parse_failure", "timestamp_parsed", "high"),
    ("missing_host", "host_raw", "medium"),
    ("missing_action", "action_raw", "low"),
)


def quality_issues(df: DataFrame) -> DataFrame:
    """issue_id, issue_type, affected_field, severity, n and an example id of each kind of fault that occurs; one scan."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    ok = F.col("parse_status") == "ok"
    tests = [F.col("parse_status") == "json_parse_error", ok & blank("timestamp_raw"), ok & ~blank("timestamp_raw") & blank("timestamp_parsed"), ok & blank("host_raw"), ok & blank("action_raw")]
    counts = df.agg(*[x for i, t in enumerate(tests) for x in (F.count_if(t).alias(f"n{i}"), F.max(F.when(t, F.col("raw_event_id"))).alias(f"e{i}"))])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("issue_type"), F.lit(f).alias("affected_field"), F.lit(s).alias("severity"), F.col(f"n{i}").alias("n"), F.col(f"e{i}").alias("example_id")) for i, (k, f, s) in enumerate(ISSUES)])
    found = counts.select(F.explode(F.filter(rows, lambda x: x["n"] > 0)).alias("x")).select("x.*")
    number = F.row_number().over(Window.orderBy("i"))
    return found.select(F.format_string("ISSUE_%03d", number).alias("issue_id"), "issue_type", "affected_field", "severity", "n", "example_id")


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Occurrences beyond the first of ids that weren't generated."""
    real = df.where(~F.col("raw_event_id").startswith("gen_"))
    return real.groupBy("raw_event_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def time_gaps(df: DataFrame, keys: list[str], time: str, large: int = 14_400) -> DataFrame:
    """Of each group the consecutive gaps: their number, those over `large` seconds, and the longest, in microseconds."""
    w = Window.partitionBy(*keys).orderBy(time)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    return df.withColumn("gap", gap).where("gap is not null").groupBy(*keys).agg(F.count("*").alias("n_gaps"), F.count_if(F.col("gap") > large * 1_000_000).alias("n_large"), F.max("gap").alias("longest_us"))


def hourly(df: DataFrame, time: str, keys: list[str] | None = None) -> DataFrame:
    return df.where(F.col(time).isNotNull()).groupBy(*(keys or []), floor(F.col(time), "hour").alias("hour")).agg(F.count("*").alias("n"))
