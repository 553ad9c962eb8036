"""Tar archives of JSON lines as data sources: `tar_lines` (a row for each line) and `tar_members` (for each member)."""

from __future__ import annotations

import fnmatch
import gzip
import io
import json
import os
import tarfile
from collections.abc import Iterator
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.text import date_token, host_token, source_type

ENDINGS = (".json.gz", ".jsonl.gz", ".json", ".jsonl")


class Member(InputPartition):
    def __init__(self, path: str, name: str, offset: int, size: int):
        self.path, self.name, self.offset, self.size = path, name, offset, size


def _paths(pattern: str) -> list[str]:
    return sorted(glob(os.path.join(pattern, "*.tar"))) if os.path.isdir(pattern) else sorted(glob(pattern))


def _members(pattern: str) -> Iterator[tuple[str, tarfile.TarInfo]]:
    """Headers only: contents are skipped by offset."""
    for path in _paths(pattern):
        with tarfile.open(path, "r:") as tar:
            for m in tar:
                if m.isfile():
                    yield path, m


def _lines(p: Member) -> Iterator[str]:
    with open(p.path, "rb") as f:
        f.seek(p.offset)
        raw = io.BytesIO(f.read(p.size)) if p.size < 1 << 26 else _Part(f, p.size)
        stream = gzip.open(raw) if p.name.endswith(".gz") else raw
        yield from io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n")


class _Part(io.RawIOBase):
    """The next `size` bytes of a file."""

    def __init__(self, f, size: int):
        self.f, self.left = f, size

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        got = self.f.read(min(len(b), self.left))
        b[: len(got)] = got
        self.left -= len(got)
        return len(got)


class LinesReader(DataSourceReader):
    """A partition for each member. Equality and IN on member_name and archive_name leave out members before any is opened."""

    def __init__(self, options: dict):
        self.pattern, self.contains = options["path"], options.get("contains", "")
        self.per_member = int(options.get("maxlinespermember", 0))
        self.max_members = int(options.get("maxmembers", 0))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if column in ("member_name", "archive_name"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Member]:
        keep = lambda path, m: m.name.endswith(ENDINGS) and self.contains in m.name and m.name in self.wanted.get("member_name", {m.name}) and os.path.basename(path) in self.wanted.get("archive_name", {os.path.basename(path)})
        found = [Member(path, m.name, m.offset_data, m.size) for path, m in _members(self.pattern) if keep(path, m)]
        return found[: self.max_members] if self.max_members else found

    def read(self, partition: Member) -> Iterator[tuple]:
        kept = 0
        for number, line in enumerate(_lines(partition), 1):
            if line.strip():
                yield os.path.basename(partition.path), partition.name, number, line.rstrip("\r\n")
                kept += 1
                if kept == self.per_member:
                    return


class TarLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_lines"

    def schema(self) -> str:
        return "archive_name string, member_name string, line_number long, line string"

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options)


class MembersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern, self.sample, self.include = options["path"], int(options.get("samplelines", 5)), options.get("include", "*")

    def partitions(self) -> list[Member]:
        return [Member(path, m.name, m.offset_data, m.size) for path, m in _members(self.pattern) if fnmatch.fnmatch(m.name, self.include)]

    def read(self, partition: Member) -> Iterator[tuple]:
        valid = invalid = lines = 0
        times, keys, status = [], set(), "not_sampled"
        if partition.name.endswith(ENDINGS):
            try:
                for line in _lines(partition):
                    if not line.strip():
                        continue
                    lines += 1
                    try:
                        event = json.loads(line)
                        valid += isinstance(event, dict)
                        keys |= set(event) if isinstance(event, dict) else set()
                        times += [str(event["timestamp"])] if isinstance(event, dict) and event.get("timestamp") else []
                    except ValueError:
                        invalid += 1
                    if lines >= self.sample:
                        break
                status = "sample_ok" if valid and not invalid else "sample_invalid"
            except OSError as e:
                status = f"error: {e}"[:80]
        yield os.path.basename(partition.path), partition.name, partition.size, partition.offset, "no" if status.startswith("error") else "yes", status, lines, valid, invalid, min(times, default=""), max(times, default=""), ",".join(sorted(keys))


class TarMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "archive_filename string, member_name string, size long, offset long, readable string, sample_status string, sampled_lines int, valid_lines int, invalid_lines int, first_time string, last_time string, top_level_keys string"

    def reader(self, schema) -> DataSourceReader:
        return MembersReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarLines)
    spark.dataSource.register(TarMembers)


def read_lines(spark: SparkSession, path: str, manifest: DataFrame | None = None, max_events: int | None = None, **options: str) -> DataFrame:
    """Lines of archives; a manifest (archive_filename, member_name) leaves its members, max_events the first lines."""
    register(spark)
    lines = spark.read.format("tar_lines").options(path=path, **options).load()
    if manifest is not None:
        allowed = manifest.select(F.col("archive_filename").alias("archive_name"), "member_name").distinct()
        names = [r[0] for r in allowed.select("member_name").distinct().limit(2001).collect()]
        if len(names) <= 2000:  # few enough for a pushed filter; the join below holds in either case
            lines = lines.where(F.col("member_name").isin(names))
        lines = lines.join(allowed, ["archive_name", "member_name"], "left_semi")
    return lines.orderBy("archive_name", "member_name", "line_number").limit(max_events) if max_events else lines


def inventory(spark: SparkSession, path: str, sample_lines: int = 5) -> DataFrame:
    """A row for each member with its kind, host and date."""
    register(spark)
    m = spark.read.format("tar_members").options(path=path, samplelines=str(sample_lines)).load()
    name = F.col("member_name")
    return m.withColumns({"archive_date": date_token(F.col("archive_filename")), "source_type": source_type(name), "host": host_token(name), "size_gib": F.col("size") / float(1 << 30), "ground_truth": F.when(F.lower(name).rlike("ground.?truth|label"), "yes").otherwise("no")})
