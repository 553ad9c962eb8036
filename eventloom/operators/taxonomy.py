"""Taxonomy of objects and actions by period, with first sight and rarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import MISSING, json_array, label, pattern_id
from ..schema import LOCATOR
from .relational import BENIGN, EVALUATION, Interval, assign_period, earliest, order_key

# Semantic groups of object types.
GROUPS = {
    "process_activity": "PROCESS THREAD", "file_activity": "FILE", "module_activity": "MODULE", "network_activity": "FLOW",
    "configuration_activity": "REGISTRY SERVICE TASK", "identity_session_activity": "USER_SESSION",
}
#: Rows of a semantic map up to which it is broadcast.
MAP_ROWS = 100_000


def semantic_group(kind: Column) -> Column:
    key, out = F.upper(F.trim(F.coalesce(kind, F.lit("")))), F.lit("other_activity")
    for name, kinds in GROUPS.items():
        out = F.when(key.isin(kinds.split()), name).otherwise(out)
    return out


def primary(events: DataFrame, intervals: list[Interval]) -> DataFrame:
    """The one scan: count, span and earliest evidence of each period, host, raw and normalized pair."""
    ok = events.where((F.lower(F.trim("parse_status")) == "ok") & F.col("event_time").isNotNull())
    named = assign_period(ok, "event_time", intervals).withColumns({"host": label(F.col("host_raw")), "object_type": label(F.col("object_raw")), "action_type": label(F.col("action_raw"))})
    return named.groupBy("period", "period_role", "host", "object_raw", "action_raw", "object_type", "action_type").agg(
        F.count("*").alias("n"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), earliest(LOCATOR, LOCATOR).alias("evidence")
    )


def t6(compact: DataFrame) -> DataFrame:
    keys = ["period", "period_role", "object_type", "action_type"]
    out = compact.groupBy(*keys).agg(F.sum("n").alias("event_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by("evidence", order_key_of("evidence")).alias("e"))
    share = F.col("event_count") * 100.0 / F.sum("event_count").over(Window.partitionBy("period"))
    return out.withColumn("percent_of_period", share).select(*keys, "event_count", "percent_of_period", "first_seen", "last_seen", F.col("e.raw_event_id").alias("example_id"))


def order_key_of(struct: str) -> Column:
    return F.struct(*[y for c in LOCATOR for y in (F.col(f"{struct}.{c}").isNull().alias(f"_{c}"), F.col(f"{struct}.{c}").alias(c))])


# Rules of the semantic groups, and what the map says of every pair.
RULES = {
    "process_activity": "object_type_in_PROCESS_THREAD", "file_activity": "object_type_FILE", "module_activity": "object_type_MODULE",
    "network_activity": "object_type_FLOW", "configuration_activity": "object_type_in_REGISTRY_SERVICE_TASK",
    "identity_session_activity": "object_type_USER_SESSION", "other_activity": "object_type_missing_or_unrecognized",
}
RATIONALE = "Closed object-type rule; raw object/action retained; action text does not imply maliciousness or any behavioral classification."


def mapping_rule(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair]), semantic_group(kind))


def t7(compact: DataFrame) -> DataFrame:
    """The semantic map: each raw pair as it is (a missing side by the marker), its group, rule and rationale."""
    raw = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", MISSING).otherwise(F.col(c))
    pairs = compact.select(raw("object_raw").alias("raw_object_type"), raw("action_raw").alias("raw_action_type")).distinct()
    kind = F.col("raw_object_type")
    return pairs.withColumns({"semantic_group": semantic_group(kind), "mapping_rule": mapping_rule(kind), "keep_raw_fields_yes_no": F.lit("yes"), "rationale": F.lit(RATIONALE)})


def map_events(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """events with semantic_group and mapping_rule of the map's exact raw pair; null where the map has none.

    The map has a row a distinct pair; it is broadcast if MAP_ROWS or fewer are counted."""
    raw = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", MISSING).otherwise(F.col(c))
    rows = mapping.select(F.col("raw_object_type").alias("_object"), F.col("raw_action_type").alias("_action"), "semantic_group", "mapping_rule")
    small = F.broadcast(rows) if rows.count() <= MAP_ROWS else rows
    return events.join(small, (raw("object_raw") == F.col("_object")) & (raw("action_raw") == F.col("_action")), "left").drop("_object", "_action")


def map_disagreements(mapping: DataFrame) -> DataFrame:
    """Rows of a semantic map that repeat a pair, drop raw fields, or name another group or rule than the code does."""
    twice = F.count("*").over(Window.partitionBy("raw_object_type", "raw_action_type")) > 1
    kind = F.col("raw_object_type")
    why = (
        F.when(twice, "duplicate_pair").when(~F.col("keep_raw_fields_yes_no").eqNullSafe("yes"), "raw_fields_dropped")
        .when(~F.col("semantic_group").eqNullSafe(semantic_group(kind)), "semantic_group").when(~F.col("mapping_rule").eqNullSafe(mapping_rule(kind)), "mapping_rule")
    )
    return mapping.withColumn("disagreement", why).where("disagreement is not null")


def t8(compact: DataFrame, rare_max: int = 5) -> DataFrame:
    """Patterns of host and pair: frequencies, first sight and status."""
    pair = json_array(F.col("object_type"), F.col("action_type"))
    rows = compact.groupBy("host", "object_type", "action_type").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("period_role") == BENIGN, F.col("n")).otherwise(0)).alias("benign_count"),
        F.sum(F.when(F.col("period_role") == EVALUATION, F.col("n")).otherwise(0)).alias("evaluation_count"), F.min("first_seen").alias("first_seen"),
        F.sum(F.when(~F.col("period_role").isin(BENIGN, EVALUATION), F.col("n")).otherwise(0)).alias("outside"),
        F.min_by(F.struct("evidence.raw_event_id", "evidence.archive_name", "evidence.member_name", "evidence.line_number", "period", "period_role", "object_raw"), order_key_of("evidence")).alias("e"),
    )
    status = (
        F.when(~F.col("e.period_role").isin(BENIGN, EVALUATION), "unresolved_unassigned")
        .when((F.col("e.period_role") == EVALUATION) & (F.col("benign_count") == 0), "first_seen_in_evaluation")
        .when(F.col("benign_count") <= rare_max, "rare_in_verified_benign").otherwise("common_in_verified_benign")
    )
    # fixed values: the reasons of the statuses
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    benign = F.col("benign_count").cast("string")
    reason = (
        F.when(status == "unresolved_unassigned", said("Earliest evidence occurs outside verified benign and evaluation intervals (", F.col("outside").cast("string"), " event(s) outside those roles); threshold status is unresolved and descriptive only."))
        .when(status == "first_seen_in_evaluation", "First observed in an evaluation interval and absent from verified benign intervals; descriptive status only.")
        .when(status == "rare_in_verified_benign", said("Verified-benign frequency ", benign, f" is at or below configured threshold {rare_max}; descriptive only."))
        .otherwise(said("Verified-benign frequency ", benign, f" exceeds configured threshold {rare_max}; descriptive only."))
    )
    place = [F.col(f"e.{c}").alias(c) for c in ("archive_name", "member_name", "line_number", "period")]
    return rows.select(*place, semantic_group(F.col("object_type")).alias("semantic_group"), reason.alias("rare_reason"), pattern_id(F.col("host"), pair).alias("pattern_id"), "host", pair.alias("object_action_pair"), "total", "benign_count", "evaluation_count", "first_seen", F.col("e.raw_event_id").alias("example_id"), status.alias("rarity_status"))


# Fixed value: the reason where no period is verified benign.
DEFERRED = "Frequency-threshold fitting was deferred because no verified benign period was provided; this row is descriptive first-seen evidence only."


def t8_deferred(rows: DataFrame) -> DataFrame:
    """t8 where no period is verified benign: frequencies and status are left open."""
    null = F.lit(None).cast("long")
    return rows.withColumns({"benign_count": null, "evaluation_count": null, "rarity_status": F.lit("deferred"), "rare_reason": F.lit(DEFERRED)})


def heatmap(t6_rows: DataFrame, objects: int = 10, actions: int = 10) -> DataFrame:
    """Counts of the most frequent objects (rows) and actions, in long form."""
    top = lambda c, n: t6_rows.groupBy(c).agg(F.sum("event_count").alias("t")).orderBy(F.desc("t"), c).limit(n).select(c)
    kept = t6_rows.join(F.broadcast(top("object_type", objects)), "object_type").join(F.broadcast(top("action_type", actions)), "action_type")
    return kept.groupBy("object_type", "action_type").agg(F.sum("event_count").alias("event_count"), F.log1p(F.sum("event_count")).alias("log_count"))


def pivot(rows: DataFrame, row: str, column: str, values: list[str], n: str) -> DataFrame:
    """A row for each `row`, a column for each of `values`, 0 where there is none."""
    return rows.groupBy(row).pivot(column, values).agg(F.sum(n)).fillna(0)


__all__ = ["heatmap", "map_disagreements", "map_events", "mapping_rule", "order_key", "pivot", "primary", "semantic_group", "t6", "t7", "t8", "t8_deferred"]
