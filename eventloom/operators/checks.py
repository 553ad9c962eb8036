"""Reconciliation: each function raises AssertionError with what doesn't agree."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entities import broken
from .relational import BENIGN, EVALUATION, Interval, check_policy
from .taxonomy import map_disagreements


def columns(df: DataFrame, required: list[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    assert not missing, f"columns missing: {missing}"


def total(df: DataFrame, n: str, expected: int) -> None:
    found = df.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    assert found == expected, f"{n} adds up to {found}, not {expected}"


def shares(df: DataFrame, key: str, percent: str, tolerance: float = 1e-7) -> None:
    off = df.groupBy(key).agg(F.sum(percent).alias("s")).where(F.abs(F.col("s") - 100) > tolerance).limit(5).collect()
    assert not off, f"shares don't add up: {off}"


def unique(df: DataFrame, keys: list[str]) -> None:
    twice = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    assert not twice, f"repeated: {twice}"


def complete(df: DataFrame, fields: list[str]) -> None:
    test = F.lit(False)
    for f in fields:
        test = test | F.col(f).isNull()
    some = df.where(test).limit(5).collect()
    assert not some, f"without {fields}: {some}"


def mapped(core: DataFrame) -> None:
    bad = core.agg(F.sum("unmapped_hosts").alias("h"), F.sum("unmapped_users").alias("u"), F.sum(F.when(F.col("period_role") == "unassigned", F.col("n")).otherwise(0)).alias("p")).first()
    assert not any(bad), f"unmapped hosts, users, unassigned events: {tuple(bad)}"


def dictionary(t9: DataFrame) -> None:
    found = broken(t9).limit(5).collect()
    assert not found, f"dictionary: {found}"


def bounded(df: DataFrame, column: str, low: float, high: float) -> None:
    some = df.where(~F.col(column).between(low, high)).limit(5).collect()
    assert not some, f"{column} outside {low}..{high}: {some}"


def at_most(df: DataFrame, rows: int) -> None:
    n = df.limit(rows + 1).count()
    assert n <= rows, f"more than {rows} rows"


# Words that a report may not use of an observation.
BANNED = re.compile(r"\b(malicious|attack(?:er)?|malware|compromised?|benign user)\b", re.I)


def wording(text: str) -> None:
    found = BANNED.search(text)
    assert not found, f"wording: {found[0]}"


def chunks(names: list[str]) -> None:
    """Chunk files are numbered 0.. without gaps or repeats."""
    numbers = sorted(int(m[1]) for n in names if (m := re.search(r"chunk_(\d+)_", n)))
    assert numbers == list(range(len(numbers))), f"chunk numbers: {numbers[:20]}"


def resumable(manifest: DataFrame, archive: str, member: str) -> None:
    n = manifest.where((F.col("archive_filename") == archive) & (F.col("member_name") == member)).count()
    assert n == 1, f"{archive}:{member} is {n} times in the manifest"


def semantic_map(mapping: DataFrame) -> None:
    """A semantic map that isn't empty, keeps raw fields, has each pair once and agrees with the code."""
    columns(mapping, ["raw_object_type", "raw_action_type", "semantic_group", "mapping_rule", "keep_raw_fields_yes_no", "rationale"])
    assert mapping.limit(1).count(), "an empty semantic map"
    some = map_disagreements(mapping).limit(5).collect()
    assert not some, f"semantic map: {some}"


# Hours and dates that verified benign periods must cover for a baseline.
BENIGN_HOURS, BENIGN_DATES = 24, 2


def benign_cover(intervals: list[Interval]) -> None:
    """A policy for baselines: benign and evaluation periods, the benign ones of a day or more on two dates or more."""
    check_policy(intervals)
    roles = {i.role for i in intervals}
    assert {BENIGN, EVALUATION} <= roles, f"a baseline needs {BENIGN} and {EVALUATION} periods, not {sorted(roles)}"
    spans = [(datetime.fromisoformat(i.start), datetime.fromisoformat(i.end)) for i in intervals if i.role == BENIGN]
    length = sum((end - start for start, end in spans), timedelta())
    assert length >= timedelta(hours=BENIGN_HOURS), f"benign periods of {length}"
    last = [(start.date(), (end - timedelta(microseconds=1)).date()) for start, end in spans]
    dates = {a + timedelta(days=k) for a, b in last for k in range((b - a).days + 1)}
    assert len(dates) >= BENIGN_DATES, f"benign periods on {len(dates)} date"


def threshold(rare_max: int | None, intervals: list[Interval]) -> None:
    """A count for rarity is given, and 1 or more, exactly where a period is verified benign."""
    benign = any(i.role == BENIGN for i in intervals)
    assert rare_max is None or rare_max >= 1, f"a rarity count of {rare_max}"
    assert benign == (rare_max is not None), "a rarity count goes with verified benign periods"


def roles(all_events: DataFrame, processes: DataFrame, expected: int) -> dict[str, int]:
    """Counts by role (period_role, n) add up: all events to `expected`, and no role has more process events than events."""
    every, some = ({r[0]: r[1] for r in df.groupBy("period_role").agg(F.sum("n")).collect()} for df in (all_events, processes))
    assert sum(every.values()) == expected, f"{sum(every.values())} events by role, not {expected}"
    off = {k: v for k, v in some.items() if v > every.get(k, 0)}
    assert not off, f"more process events than events: {off}"
    return {"process_total": sum(some.values()), **{f"process_{k}": v for k, v in sorted(some.items())}}


def settings(**values) -> None:
    """Settings of a run: *_path values name something, others are numbers of 1 or more (None: not set); sizes don't fall from least to most."""
    for k, v in values.items():
        if k.endswith("_path"):
            assert isinstance(v, str) and v.strip(), f"{k} is empty"
        elif v is not None:
            assert not isinstance(v, bool) and isinstance(v, int | float) and v > 0, f"{k} = {v!r} isn't positive"
            assert not k.endswith("_n") or isinstance(v, int), f"{k} = {v!r} isn't whole"
    sizes = [values[k] for k in ("least", "target", "most") if values.get(k) is not None]
    assert sizes == sorted(sizes), f"sizes out of order: {sizes}"
