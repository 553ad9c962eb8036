"""Intake of raw files: ledger, scope and catalogue."""

from __future__ import annotations

import itertools
import json
import os
import tarfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import date_token, filled, source_type, storage_priority
from ..state import cut


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, length and modification time of all files below a folder; contents only if asked for."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f if content else f.select("path", "length", "modificationTime")


def checksums(found: DataFrame) -> DataFrame:
    return found.select("path", F.sha2("content", 256).alias("sha256"))


def inclusion(name: Column, length: Column, status: Column, version: Column, wanted: str) -> Column:
    """included (yes, no or review) and reason: hidden, then empty, then unreadable, then another version."""
    said = lambda inc, why: F.struct(F.lit(inc).alias("included"), F.lit(why).alias("reason"))
    return (
        F.when(name.startswith("."), said("no", "hidden_file")).when(length == 0, said("no", "empty_file")).when(status == "error", said("review", "parse_error"))
        .when((version != "unknown") & (version != wanted), said("no", "other_version")).otherwise(said("yes", "none"))
    )


def ledger(found: DataFrame, wanted: str = "v1", status: Column | None = None) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    low = F.lower(name)
    ending = F.coalesce(filled(F.regexp_extract(low, r"(\.json\.gz|\.jsonl\.gz|\.tar\.gz|\.[a-z0-9]+)$", 1)), F.lit("none"))
    version = F.coalesce(filled(F.regexp_extract(low, r"(?:^|[_.-])(v\d+)(?:[_.-]|$)", 1)), F.lit("unknown"))
    out = found.select("path", name.alias("file_name"), ending.alias("extension"), "length", source_type(F.col("path")).alias("source_type"), date_token(name).alias("file_date"), version.alias("version"), (status if status is not None else F.lit("not_tested")).alias("parse_status"))
    return out.withColumn("x", inclusion(F.col("file_name"), F.col("length"), F.col("parse_status"), F.col("version"), wanted)).select("*", "x.included", "x.reason").drop("x")


def size_by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_type", "included").agg(F.count("*").alias("n_files"), F.sum("length").alias("total_bytes"))


def scope(rows: DataFrame, catalog_dates: list[str]) -> DataFrame:
    """What of the catalogue is here: item and value."""
    a = rows.where("included = 'yes'").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.array_sort(F.collect_set(filled(F.col("file_date")))).alias("seen"), F.array_sort(F.collect_set("source_type")).alias("kinds"))
    dates = F.array(*[F.lit(d) for d in catalog_dates]).cast("array<string>")
    items = [("files", F.col("n").cast("string")), ("bytes", F.coalesce("bytes", F.lit(0)).cast("string")), ("source_types", F.array_join("kinds", ";")), ("dates_available", F.array_join(F.array_intersect(dates, "seen"), ";")), ("dates_pending", F.array_join(F.array_except(dates, "seen"), ";")), ("dates_outside_catalog", F.array_join(F.array_except("seen", dates), ";"))]
    return a.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.alias("value")) for k, v in items])).alias("x")).select("x.*")


def catalogue(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """The catalogue (file, size_gb) with what is here of it, and each archive's storage priority."""
    here = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("local_bytes"))
    out = catalog.join(here, "file", "left")
    return out.withColumns({"downloaded": F.when(F.col("local_bytes").isNull(), "no").otherwise("yes"), "storage_priority": storage_priority(F.col("size_gb"))})


def storage(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_archives"), F.sum("size_gb").alias("catalog_gb"), F.count_if(F.col("downloaded") == "yes").alias("n_downloaded"), F.coalesce(F.sum("local_bytes"), F.lit(0)).alias("local_bytes"))


def member_classes(members: DataFrame) -> DataFrame:
    return members.groupBy(source_type(F.col("member_name")).alias("member_class")).agg(F.count("*").alias("n_members"), F.sum("size").alias("total_bytes"))


def collection_summary(events: DataFrame, top: int = 10) -> DataFrame:
    """item, name and n: events, those parsed and not, members and archives with events, parsed events by source type,
    and the `top` members by events (ties by name). Events are grouped once; all else reads the groups."""
    text = lambda c, other="": F.coalesce(F.col(c), F.lit(other))
    a = cut(events.groupBy(text("member_name").alias("member"), text("archive_name").alias("archive"), text("source_type", "unknown").alias("kind"), F.col("parse_status").eqNullSafe("ok").alias("ok")).agg(F.count("*").alias("n")))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    one = a.agg(total(F.lit(True)).alias("events"), total(F.col("ok")).alias("ok"), total(~F.col("ok")).alias("not_ok"), F.count_distinct("member").alias("members"), F.count_distinct("archive").alias("archives"))
    counts = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.lit("").alias("name"), F.col(c).alias("n")) for c in one.columns])).alias("x")).select("x.*")
    kinds = a.where("ok").groupBy(F.col("kind").alias("name")).agg(F.sum("n").alias("n"))
    members = a.groupBy(F.col("member").alias("name")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    named = lambda df, item: df.select(F.lit(item).alias("item"), "name", "n")
    return counts.union(named(kinds, "source_type")).union(named(members, "top_member"))


# Members, rows and lines that a smoke test reads; parsers and statuses.
FIRST = {"members": 20, "rows": 5, "lines": 5}
OPENED, READ, NOT_TRIED = "tar_open_success", "readable_smoke_test_passed", ("not_attempted", "not_attempted_or_unknown_format")


def _tar(path: str) -> None:
    with tarfile.open(path, "r:*") as t:
        list(itertools.islice(t, FIRST["members"]))


def _table(path: str, sep: str = ",") -> None:
    pd.read_csv(path, sep=sep, nrows=FIRST["rows"], low_memory=False)


def _json(path: str, whole: bool = False) -> None:
    with open(path, encoding="utf-8", errors="replace") as f:
        if whole:
            json.load(f)
        else:
            for line in itertools.islice(f, FIRST["lines"]):
                json.loads(line)


#: Of each ending the readers that are tried in turn, with their names; the first one's error is told.
READERS = {
    ".tar": [("tar_smoke_parser", _tar)], ".csv": [("pandas_csv_tsv", _table)], ".tsv": [("pandas_csv_tsv", lambda p: _table(p, "\t"))],
    ".json": [("json_line_reader", _json), ("json_full_reader", lambda p: _json(p, True))],
}
READERS[".jsonl"] = READERS[".json"]


def _smoke(path: str) -> tuple[str, str]:
    ending, said = os.path.splitext(path)[1].lower(), []
    good, bad = (OPENED, "tar_open_failed") if ending == ".tar" else (READ, "parse_error")
    for parser, read in READERS.get(ending, []):
        try:
            read(path)
            return parser, good
        except Exception as e:  # whatever is wrong with a file is its status
            said.append((parser, f"{bad}: {str(e)[:120]}"))
    return said[0] if said else NOT_TRIED


def smoke_test(found: DataFrame) -> DataFrame:
    """path, parser and parse_status of each file that executors can open: its first members, rows or lines are read."""
    def run(batches):
        for b in batches:
            read = [_smoke(p.removeprefix("file://").removeprefix("file:")) for p in b["path"]]
            yield b.assign(parser=[r[0] for r in read], parse_status=[r[1] for r in read])

    return found.select("path").mapInPandas(run, "path string, parser string, parse_status string")
