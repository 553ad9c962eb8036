"""Readers and writers of event caches, dimensions and reports."""

from __future__ import annotations

import csv as csv_files
import json
import os
import shutil
import subprocess
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import ntz
from ..operators.relational import Interval, check_policy
from ..schema import COLUMNS, EVENT_SCHEMA, SCHEMA_VERSION


def events(spark: SparkSession, path: str) -> DataFrame:
    """A cache of flat events with event_time."""
    return spark.read.schema(EVENT_SCHEMA).parquet(path).withColumn("event_time", ntz(F.col("timestamp_parsed")))


def write_events(df: DataFrame, path: str, rows: int = 100_000, compression: str = "zstd", strategy: str = "full") -> dict:
    """A cache of at most `rows` rows a file, and its metadata; refuses a path that is there."""
    df.select(COLUMNS).write.option("maxRecordsPerFile", rows).option("compression", compression).mode("errorifexists").parquet(path)
    back = df.sparkSession.read.schema(EVENT_SCHEMA).parquet(path)
    n = back.count()
    meta = {"schema_version": SCHEMA_VERSION, "total_events_written": n, "sampling_strategy": strategy}
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}_metadata")
    return meta


def footers(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each file, from footers and batch counts only."""
    return spark.read.schema(EVENT_SCHEMA).parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("archive_name", "member_name", "parse_status").agg(F.count("*").alias("n"), F.max("line_number").alias("last_line"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Where a cache ends: the last line of the last member of each archive."""
    return df.groupBy("archive_name").agg(F.max_by(F.struct("member_name", "line_number", "raw_event_id"), F.struct("file_id")).alias("x")).select("archive_name", "x.*")


def error_examples(df: DataFrame, n: int = 20) -> DataFrame:
    return df.where(F.col("parse_status") != "ok").orderBy("archive_name", "member_name", "line_number").limit(n)


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, all text, empty cells kept empty."""
    return spark.read.option("header", True).option("emptyValue", "").schema(", ".join(f"`{c}` string" for c in columns)).csv(path).fillna("")


def periods(spark: SparkSession, path: str) -> list[Interval]:
    """A period map, a list of fixed length."""
    rows = csv(spark, path, ["period", "start_time", "end_time", "period_role"]).collect()
    out = [Interval(r[0], r[1].rstrip("Z"), r[2].rstrip("Z"), r[3]) for r in rows]
    check_policy(out)
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    names = ["archive_filename", "member_name", "archive_date", "inferred_host_or_client", "member_size_gib", "manifest_version"]
    out = csv(spark, path, names).withColumn("member_size_gib", F.col("member_size_gib").try_cast("double"))
    twice = out.groupBy("archive_filename", "member_name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated in the manifest: {twice[0][0]}:{twice[0][1]}")
    return out


def missing_members(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    return wanted.join(inventory, ["archive_filename", "member_name"], "left_anti")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def publish(path: str, write: Callable[[str], None]) -> None:
    """Runs write(staging folder beside path) and renames it to path; a path that is there, even a broken link, is refused."""
    if os.path.lexists(path):
        raise FileExistsError(path)
    staging = f"{os.path.dirname(os.path.abspath(path))}/.{os.path.basename(path)}.staging-{os.getpid()}"
    os.makedirs(staging)
    try:
        write(staging)
        left = [f for _, _, names in os.walk(staging) for f in names if f.endswith((".tmp", ".partial"))]
        if left:
            raise RuntimeError(f"unfinished files: {left[:3]}")
        os.rename(staging, path)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def report_csv(df: DataFrame, path: str, limit: int = 1_000_000) -> int:
    """A report as one CSV file, all values quoted; rows come a partition at a time; more than `limit` raise."""
    n = 0
    with open(f"{path}.tmp", "w", encoding="utf-8", newline="") as f:
        out = csv_files.writer(f, quoting=csv_files.QUOTE_ALL, lineterminator="\n")
        out.writerow(df.columns)
        for n, row in enumerate(df.toLocalIterator(), 1):
            if n > limit:
                raise ValueError(f"more than {limit} rows")
            out.writerow(["" if v is None else v for v in row])
    os.replace(f"{path}.tmp", path)
    return n


def write_text(path: str, text: str) -> None:
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.tmp", path)


def run_metadata(stage: str, started: float, **more) -> dict:
    """What ran when, for the JSON beside a stage's tables."""
    import resource

    found = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True)
    return {"stage": stage, "runtime_seconds": round(time.time() - started, 3), "peak_rss_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, "git_commit": found.stdout.strip() or None, **more}
