"""Entity dictionary: canonical values of hosts, users, processes, files and destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ip, paths
from ..functions.text import MISSING_SCOPE, entity_id, filled, first_filled
from ..functions.times import floor
from ..schema import LOCATOR
from .relational import order_key

TYPES = ["host", "user_principal", "process", "file_path", "destination"]
PROCESS_KINDS = "PROCESS FLOW FILE MODULE THREAD SHELL".split()


def observations(events: DataFrame) -> DataFrame:
    """A row for each entity of each event: entity_type, raw_value, scope, source_field, alias_mismatch and the locator; one scan."""
    kind, host = F.upper(F.trim("object_raw")), F.coalesce("host_raw", F.lit(""))
    image, parent = first_filled(F.col("image_path_raw"), F.col("process_raw")), first_filled(F.col("parent_image_path_raw"), F.col("parent_process_raw"))
    dest = first_filled(F.col("dest_ip_raw"), F.col("destination_raw"))
    differ = lambda a, b: (F.coalesce(F.col(a), F.lit("")) != F.coalesce(F.col(b), F.lit(""))) & (F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != "")
    one = lambda when, name, raw, scope, field, off=None: F.when(
        when & (F.trim(F.coalesce(raw, F.lit(""))) != ""),
        F.struct(F.lit(name).alias("entity_type"), raw.alias("raw_value"), scope.alias("scope"), F.lit(field).alias("source_field"), F.coalesce(off if off is not None else F.lit(False), F.lit(False)).alias("alias_mismatch")),
    )
    found = F.array_compact(F.array(
        one(F.lit(True), "host", F.col("host_raw"), F.lit(""), "host_raw"),
        one(F.lit(True), "user_principal", F.col("user_raw"), host, "user_raw"),
        one(kind.isin(PROCESS_KINDS), "process", image, host, "image_path_raw", differ("image_path_raw", "process_raw")),
        one(kind == "PROCESS", "process", parent, host, "parent_image_path_raw", differ("parent_image_path_raw", "parent_process_raw")),
        one(kind == "FILE", "file_path", F.col("file_path_raw"), host, "file_path_raw"),
        one(kind == "FLOW", "destination", dest, F.lit(""), "dest_ip_raw", differ("dest_ip_raw", "destination_raw")),
    ))
    ok = events.where((F.lower(F.trim("parse_status")) == "ok") & F.col("event_time").isNotNull())
    return ok.select(*LOCATOR, F.explode(found).alias("x")).select("x.*", *LOCATOR)


def normalize(df: DataFrame, v6: bool = True) -> DataFrame:
    """df (entity_type, raw_value, scope) with normalized_value, rule, reliability, entity_status, category and canonical_id."""
    kind, raw, scope = F.col("entity_type"), F.col("raw_value"), F.coalesce("scope", F.lit(""))
    windows, scoped = paths.windows_looking(raw), scope != ""
    address = ip.canonical(raw, v6)
    is_path = kind.isin("process", "file_path")
    value = F.when(is_path & windows, paths.backslashed(raw)).when(kind == "destination", F.coalesce(address, raw)).otherwise(raw)
    rule = (
        F.when(kind == "host", "host_exact_v1").when(kind == "user_principal", "user_host_scoped_exact_v1")
        .when(kind == "process", F.when(windows, "process_path_separator_v1").otherwise("process_path_literal_unresolved_v1"))
        .when(kind == "file_path", F.when(windows, "file_path_separator_v1").otherwise("file_path_literal_unresolved_v1"))
        .otherwise(F.when(address.isNotNull(), "destination_ip_v1").otherwise("destination_literal_unresolved_v1"))
    )
    resolved = F.when(kind == "host", True).when(kind == "user_principal", scoped).when(is_path, windows & scoped).otherwise(address.isNotNull())
    reliability = F.when(~resolved, "low").when(kind == "process", "medium").otherwise("high")
    category = F.when(kind == "destination", ip.structural_class(raw, v6)).otherwise("")
    shown = F.when(kind.isin("host", "destination"), "").when(scoped, scope).otherwise(MISSING_SCOPE)
    out = df.withColumns({"normalized_value": value, "rule": rule, "entity_status": F.when(resolved, "resolved").otherwise("unresolved"), "reliability": reliability, "structural_category": category, "host_if_applicable": shown})
    return out.withColumn("canonical_id", entity_id(kind, F.col("host_if_applicable"), F.col("rule"), F.col("normalized_value")))


def t9(events: DataFrame, v6: bool = True) -> DataFrame:
    """The dictionary: one row for each type, scope and raw value. Values are normalized after they are grouped."""
    rows = observations(events).groupBy("entity_type", "raw_value", "scope").agg(
        F.count("*").alias("observation_count"), F.count_distinct(F.struct("archive_name", "member_name")).alias("source_count"),
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.count_if("alias_mismatch").alias("alias_mismatches"),
        F.min_by(F.struct("source_field", *LOCATOR[1:]), order_key([*LOCATOR, "source_field"])).alias("e"),
    )
    named = normalize(rows, v6)
    return named.select(
        "canonical_id", "entity_type", "raw_value", "normalized_value", "host_if_applicable", "first_seen", "last_seen", "source_count", F.col("reliability"), F.col("rule").alias("normalization_rule_id"),
        "observation_count", "entity_status", "structural_category", "alias_mismatches", "e.source_field", F.col("e.raw_event_id").alias("example_id"), "e.archive_name", "e.member_name", "e.line_number",
    )


def t10(dictionary: DataFrame) -> DataFrame:
    """Of each of the five types: raw values, canonical ids, unresolved ones, merged ones, observations."""
    types = dictionary.sparkSession.createDataFrame([(t,) for t in TYPES], "entity_type string")
    out = dictionary.groupBy("entity_type").agg(
        F.count("*").alias("raw_values"), F.count_distinct("canonical_id").alias("canonical_entities"), F.count_if(F.col("entity_status") == "unresolved").alias("unresolved"),
        F.sum("observation_count").alias("observations"),
    )
    out = types.join(out, "entity_type", "left").fillna(0)
    return out.withColumn("merged", F.col("raw_values") - F.col("canonical_entities"))


def new_entity_rate(dictionary: DataFrame, unit: str = "minute") -> DataFrame:
    """First sights of canonical entities by unit of time and type."""
    first = dictionary.groupBy("entity_type", "canonical_id").agg(F.min("first_seen").alias("t"))
    return first.groupBy(floor(F.col("t"), unit).alias("window_start"), "entity_type").agg(F.count("*").alias("n_new"))


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    dictionary.write.partitionBy("entity_type").mode("errorifexists").parquet(path)


def broken(dictionary: DataFrame) -> DataFrame:
    """Keys that occur twice, and canonical ids that stand for several rules or values: none in a sound dictionary."""
    keys = dictionary.groupBy("entity_type", "host_if_applicable", "raw_value").agg(F.count("*").alias("n")).where("n <> 1").select(F.lit("key").alias("fault"), F.col("raw_value").alias("what"))
    ids = dictionary.groupBy("canonical_id").agg(F.count_distinct(F.struct("entity_type", "host_if_applicable", "normalization_rule_id", "normalized_value")).alias("n")).where("n <> 1")
    return keys.union(ids.select(F.lit("canonical_id"), "canonical_id"))


def lookup(dictionary: DataFrame, kind: str, *more: Column) -> DataFrame:
    """The part of one type, keyed by raw value and host."""
    return dictionary.where(F.col("entity_type") == kind).select(F.col("raw_value").alias("_raw"), filled(F.col("host_if_applicable")).alias("_scope"), F.col("canonical_id").alias("_id"), F.col("entity_status").alias("_status"), F.col("normalized_value").alias("_value"), *more)


def attach(events: DataFrame, dictionary: DataFrame, kind: str, raw: Column, out: str, host: str | None = "host_raw") -> DataFrame:
    """events with `out`, the canonical id of a raw value, and out_status, by an outer equi-join."""
    d = lookup(dictionary, kind)
    e = events.withColumn("_key", raw)
    on = e["_key"] == d["_raw"]
    if host is not None:
        on = on & (F.coalesce(filled(e[host]), F.lit(MISSING_SCOPE)) == d["_scope"])
    return e.join(d, on, "left").withColumnsRenamed({"_id": out, "_status": f"{out}_status"}).drop("_key", "_raw", "_scope", "_value")
