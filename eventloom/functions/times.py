"""Timestamps: naive UTC, microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"
ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def ntz(x: Column) -> Column:
    """Null unless x is an ISO date or time; bare numbers and padded texts are none."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), x.try_cast("timestamp_ntz"))


def parse(raw: Column) -> Column:
    """ISO text (with an offset: brought to UTC; without: taken as UTC) or epoch seconds, milliseconds above 1e12,
    nanoseconds above 1e15. Null if neither."""
    x = F.trim(raw)
    number = F.when(x.rlike(r"^[+-]?\d+(\.\d+)?$"), x.try_cast("double"))
    micros = F.when(F.abs(number) > 1e15, number / 1e3).when(F.abs(number) > 1e12, number * 1e3).otherwise(number * 1e6)
    plain = F.regexp_replace(x, ZONE, "")
    zone = F.regexp_replace(F.regexp_replace(F.regexp_extract(x, ZONE, 1), "^Z$", "+00:00"), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(plain.rlike(ISO), F.when(zone == "", F.concat(plain, F.lit("+00:00"))).otherwise(F.concat(plain, zone)).try_cast("timestamp"))
    return F.coalesce(F.timestamp_micros(micros.cast("long")), iso).cast("timestamp_ntz")


def bucket(time: Column, seconds: int) -> Column:
    """Start of the bucket of this width, aligned with the epoch."""
    return F.window(time, f"{seconds} seconds")["start"]


def floor(time: Column, unit: str) -> Column:
    return F.date_trunc(unit, time).cast("timestamp_ntz")
