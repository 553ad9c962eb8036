"""Behaviour of hosts and users in verified benign time, and deviations from it in evaluation time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ip, paths
from ..functions.stats import confidence, deviation, divergence
from ..functions.text import cell, filled, first_filled, observed_chain_key
from ..functions.times import bucket
from ..schema import LOCATOR
from .entities import attach
from .relational import BENIGN, EVALUATION, Interval, assign_period, earliest, first_k, new_in_evaluation, top_n
from .taxonomy import semantic_group

#: Columns of prepared events that the aggregates read.
READ = [
    *LOCATOR, "period_role", "window_start", "archive_date", "hour", "host_id", "user_id", "semantic_group", "object_raw", "host_raw",
    "image_path_raw", "process_raw", "parent_image_path_raw", "parent_process_raw", "file_path_raw", "dest_ip_raw", "destination_raw",
]
KINDS = {"process": ["PROCESS"], "file": ["FILE"], "destination": ["FLOW"]}


def prepared(events: DataFrame, dictionary: DataFrame, intervals: list[Interval], seconds: int = 60) -> DataFrame:
    """Events in time order of use: period, window, archive date, hour, host_id, user_id and semantic group."""
    ok = events.where(F.col("event_time").isNotNull())
    e = assign_period(ok, "event_time", intervals)
    date = filled(F.regexp_extract("archive_name", r"(\d{4}-\d{2}-\d{2})", 1)).try_cast("date")
    e = e.withColumns({"window_start": bucket(F.col("event_time"), seconds), "archive_date": date, "hour": F.hour("event_time").cast("long"), "semantic_group": semantic_group(F.col("object_raw"))})
    e = attach(e, dictionary, "host", F.col("host_raw"), "host_id", None)
    return attach(e, dictionary, "user_principal", F.col("user_raw"), "user_id")


def core(e: DataFrame) -> DataFrame:
    return e.groupBy("period_role", "window_start", "archive_date", "hour", "host_id", "user_id", "semantic_group").agg(
        F.count("*").alias("n"), F.count_if(F.col("host_id").isNull()).alias("unmapped_hosts"), F.count_if(F.col("user_id").isNull()).alias("unmapped_users")
    )


def evidence(e: DataFrame, k: int = 20) -> DataFrame:
    """The first k event ids of each evaluation window of a host."""
    return first_k(e.where(F.col("period_role") == EVALUATION), ["window_start", "host_id"], LOCATOR, k, "raw_event_id", "evidence_ids")


def processes(e: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Counts of process starts by child and parent, with the key of the observed chain and its earliest evidence."""
    p = e.where(F.upper(F.trim("object_raw")).isin(KINDS["process"]))
    child, parent = first_filled(F.col("image_path_raw"), F.col("process_raw")), first_filled(F.col("parent_image_path_raw"), F.col("parent_process_raw"))
    p = attach(p, dictionary, "process", child, "process_id")
    shown = paths.normalized(parent)
    status = F.when(parent == "", "missing").when(paths.windows_looking(parent), "normalized").otherwise("literal")
    key = F.when((parent != "") & F.col("process_id").isNotNull() & F.col("host_id").isNotNull(), observed_chain_key(F.col("host_id"), shown, F.col("process_id")))
    p = p.withColumns({"parent_normalized": shown, "parent_status": status, "chain_key": key})
    return p.groupBy("period_role", "window_start", "host_id", "user_id", "process_id", "parent_normalized", "parent_status", "chain_key").agg(F.count("*").alias("n"), earliest(LOCATOR, LOCATOR).alias("evidence"))


def files(e: DataFrame) -> DataFrame:
    f = e.where(F.upper(F.trim("object_raw")).isin(KINDS["file"])).withColumn("path_category", paths.category(F.col("file_path_raw")))
    return f.groupBy("period_role", "window_start", "host_id", "path_category").agg(F.count("*").alias("n"))


def destinations(e: DataFrame, dictionary: DataFrame, v6: bool = True) -> DataFrame:
    raw = first_filled(F.col("dest_ip_raw"), F.col("destination_raw"))
    f = attach(e.where(F.upper(F.trim("object_raw")).isin(KINDS["destination"])), dictionary, "destination", raw, "destination_id", None)
    return f.withColumn("destination_category", ip.category(raw, v6)).groupBy("period_role", "window_start", "host_id", "destination_id", "destination_category").agg(F.count("*").alias("n"))


def top_benign(rows: DataFrame, entity: str, item: str, n: int) -> DataFrame:
    """The n most frequent items of each entity in benign time: entity, item, n, rank_number."""
    some = rows.where((F.col("period_role") == BENIGN) & F.col(entity).isNotNull() & F.col(item).isNotNull()).groupBy(entity, item).agg(F.sum("n").alias("n"))
    return top_n(some, [entity], [F.desc("n"), F.col(item)], n).withColumn("rank_number", F.col("rank_number").cast("long"))


def possible_windows(intervals: list[Interval], seconds: int = 60) -> int:
    """Windows that the benign intervals touch."""
    from datetime import datetime, timezone

    at = lambda s: int(datetime.fromisoformat(s).replace(tzinfo=timezone.utc).timestamp())
    seen = {(at(i.start) // seconds, -(-at(i.end) // seconds)) for i in intervals if i.role == BENIGN}
    return sum(b - a for a, b in seen)


def activity(c: DataFrame, entity: str, possible: int) -> DataFrame:
    """Of each entity in benign time: dates, windows, events and confidence."""
    b = c.where((F.col("period_role") == BENIGN) & F.col(entity).isNotNull())
    a = b.groupBy(entity).agg(F.count_distinct("archive_date").alias("n_dates"), F.count_distinct("window_start").alias("n_windows"), F.sum("n").alias("n_events"))
    return a.withColumn("confidence", confidence(F.col("n_dates"), F.col("n_windows") / F.lit(max(1, possible))))


def active_hours(c: DataFrame, entity: str) -> DataFrame:
    """Hours of an entity with activity on half its dates or more: entity, hour, n_dates."""
    b = c.where((F.col("period_role") == BENIGN) & F.col(entity).isNotNull())
    dates = b.groupBy(entity).agg(F.count_distinct("archive_date").alias("all_dates"))
    return b.groupBy(entity, "hour").agg(F.count_distinct("archive_date").alias("n_dates")).join(dates, entity).where(F.col("n_dates") >= F.ceil(F.col("all_dates") / 2)).select(entity, "hour", "n_dates")


def new_by_window(rows: DataFrame, item: str) -> DataFrame:
    """Distinct items of each host's evaluation window that the host has not in benign time: window_start, host_id, n_new."""
    some = rows.where(F.col("host_id").isNotNull() & F.col(item).isNotNull())
    new = new_in_evaluation(some, ["host_id", item])
    return some.where(F.col("period_role") == EVALUATION).join(new, ["host_id", item], "left_semi").groupBy("window_start", "host_id").agg(F.count_distinct(item).alias("n_new"))


def new_hosts(c: DataFrame) -> DataFrame:
    """Hosts of users in evaluation time on which they aren't in benign time."""
    return new_in_evaluation(c.where(F.col("user_id").isNotNull() & F.col("host_id").isNotNull()), ["user_id", "host_id"])


def semantic_divergence(c: DataFrame) -> DataFrame:
    some = c.where(F.col("host_id").isNotNull())
    return divergence(some.where(F.col("period_role") == EVALUATION), some.where(F.col("period_role") == BENIGN), ["window_start"], ["host_id"], "semantic_group", "n")


def t11(c: DataFrame, p: DataFrame, f: DataFrame, d: DataFrame, possible: int) -> DataFrame:
    """Profiles of hosts: activity, confidence, hours and the most frequent of each kind as compact JSON."""
    out = activity(c, "host_id", possible)
    for rows, item, n, name in ((p, "process_id", 10, "top_processes"), (p, "chain_key", 10, "top_chains"), (c, "semantic_group", 5, "top_groups"), (f, "path_category", 5, "top_path_categories"), (d, "destination_category", 5, "top_destination_categories")):
        out = out.join(_cells(top_benign(rows, "host_id", item, n), "host_id", item, name), "host_id", "left")
    return out.join(_hours(c, "host_id"), "host_id", "left")


def t12(c: DataFrame, p: DataFrame, possible: int) -> DataFrame:
    """Profiles of users with benign activity, and flags of new hosts, new processes and unusual hours."""
    out = activity(c, "user_id", possible)
    for rows, item, n, name in ((p, "process_id", 10, "top_processes"), (c, "semantic_group", 5, "top_groups")):
        out = out.join(_cells(top_benign(rows, "user_id", item, n), "user_id", item, name), "user_id", "left")
    out = out.join(_hours(c, "user_id"), "user_id", "left")
    count = lambda df, name: df.groupBy("user_id").agg(F.count("*").alias(name))
    hosts = count(new_hosts(c), "n_new_hosts")
    started = count(new_in_evaluation(p.where(F.col("user_id").isNotNull() & F.col("process_id").isNotNull()), ["user_id", "process_id"]), "n_new_processes")
    odd = c.where((F.col("period_role") == EVALUATION) & F.col("user_id").isNotNull()).join(active_hours(c, "user_id"), ["user_id", "hour"], "left_anti")
    odd = odd.groupBy("user_id").agg(F.count_distinct("window_start").alias("n_unusual_windows"))
    for more in (hosts, started, odd):
        out = out.join(more, "user_id", "left")
    return out.fillna(0, ["n_new_hosts", "n_new_processes", "n_unusual_windows"])


def _cells(top: DataFrame, entity: str, item: str, name: str) -> DataFrame:
    each = F.struct("rank_number", cell(count=F.col("n"), value=F.col(item)).alias("j"))
    return top.groupBy(entity).agg(F.sort_array(F.collect_list(each)).alias("v")).select(entity, F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: x["j"]), ","), F.lit("]")).alias(name))


def _hours(c: DataFrame, entity: str) -> DataFrame:
    return active_hours(c, entity).groupBy(entity).agg(F.array_join(F.transform(F.sort_array(F.collect_list("hour")), lambda h: h.cast("string")), ";").alias("active_hours"))


def t13(c: DataFrame, p: DataFrame, f: DataFrame, d: DataFrame) -> DataFrame:
    """Evaluation windows of hosts: what is new, whether the hour is unusual, the divergence, and their mean score."""
    keys = ["window_start", "host_id"]
    out = c.where((F.col("period_role") == EVALUATION) & F.col("host_id").isNotNull()).groupBy(*keys).agg(F.sum("n").alias("n_events"), F.min("hour").alias("hour"))
    for rows, item, name in ((p, "process_id", "new_processes"), (p, "chain_key", "new_chains"), (d, "destination_id", "new_destinations"), (f, "path_category", "new_path_categories")):
        out = out.join(new_by_window(rows, item).withColumnRenamed("n_new", name), keys, "left")
    usual = active_hours(c, "host_id").select("host_id", "hour", F.lit(True).alias("_usual"))
    out = out.join(usual, ["host_id", "hour"], "left").join(semantic_divergence(c), keys, "left")
    names = ["new_processes", "new_chains", "new_destinations", "new_path_categories"]
    out = out.fillna(0, names).withColumn("unusual_hour", F.col("_usual").isNull()).drop("_usual", "hour")
    score: Column = deviation([*[F.col(n) > 0 for n in names], F.col("unusual_hour")], F.col("jsd"))
    return out.withColumn("deviation_score", score)
