from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.functions import commands, ip, paths, stats, text, times


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "expected"), [
    ("2019-09-16T10:00:00Z", dt.datetime(2019, 9, 16, 10)), ("2019-09-16T10:00:00+02:00", dt.datetime(2019, 9, 16, 8)), ("2019-09-16 10:00:00.5", dt.datetime(2019, 9, 16, 10, 0, 0, 500000)),
    ("1568628000", dt.datetime(2019, 9, 16, 10)), ("1568628000000", dt.datetime(2019, 9, 16, 10)), ("1568628000000000000", dt.datetime(2019, 9, 16, 10)), ("", None), ("soon", None), (None, None),
])
def test_timestamps(spark, raw, expected):
    assert one(spark, raw, "string", times.parse) == expected


@pytest.mark.parametrize(("raw", "expected"), [("2019-09-16", dt.datetime(2019, 9, 16)), ("12345", None), ("2019", None), (" 2019-09-16", None), ("", None)])
def test_parseable(spark, raw, expected):
    assert one(spark, raw, "string", times.ntz) == expected


@pytest.mark.parametrize(("raw", "expected"), [
    (r"C:\Temp\a", "temporary"), (r"\\srv\share\a", "network"), (r"C:\Windows\x.dll", "system"), ("C:/Program Files/x", "program"), (r"C:\Program Files (x86)\x", "other"), ("/home/u", "user"),
    (r"\\?\C:\Windows\x", "system"), (r"\\?\UNC\srv\x", "network"), ("bare", "unknown"), ("", "unknown"), (None, "unknown"),
])
def test_path_category(spark, raw, expected):
    assert one(spark, raw, "string", paths.category) == expected


def test_path_forms(spark):
    assert one(spark, " C:/Apps/A.exe ", "string", paths.comparison) == r"c:\apps\a.exe"
    assert one(spark, "/usr/Bin", "string", paths.comparison) == "/usr/Bin"
    assert one(spark, "C:/Apps/A.exe", "string", paths.display) == r"C:\Apps\A.exe"


@pytest.mark.parametrize(("raw", "expected", "kind"), [
    ("127.0.0.1", "loopback", "loopback"), ("169.254.1.1", "link_local", "other_non_global/unresolved"), ("224.0.0.1", "multicast", "multicast"), ("0.0.0.0", "unspecified", "other_non_global/unresolved"),
    ("172.16.0.1", "private", "internal-looking"), ("8.8.8.8", "global_syntax", "external-looking"), ("192.0.2.1", "reserved", "other_non_global/unresolved"), ("255.255.255.255", "reserved", "limited_broadcast"),
    ("256.1.1.1", "hostname_or_other", "other_non_global/unresolved"), ("::1", "loopback", "loopback"), ("fe80::1", "link_local", "other_non_global/unresolved"), ("fc00::1", "private", "internal-looking"), ("2001:4860::1", "global_syntax", "external-looking"), ("x.example", "hostname_or_other", "other_non_global/unresolved"), ("", "unknown", "other_non_global/unresolved"),
])
def test_addresses(spark, raw, expected, kind):
    assert one(spark, raw, "string", ip.category) == expected
    assert one(spark, raw, "string", ip.structural_class) == kind


def test_address_text(spark):
    assert one(spark, "2001:0DB8::0001", "string", ip.canonical) == "2001:db8::1"
    assert one(spark, "10.0.0.1", "string", ip.canonical) == "10.0.0.1"
    assert one(spark, "10.0.0.999", "string", ip.canonical) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=20, max_size=60))
def test_address_numbers(spark, numbers):
    rows = spark.createDataFrame([(str(ipaddress.IPv4Address(n)), n) for n in numbers], "x string, n long")
    assert rows.where(ip.number(F.col("x")) != F.col("n")).count() == 0


@pytest.mark.parametrize(("raw", "expected"), [
    ("run 12345678", "run <NUMBER>"), ("run 1234567", "run 1234567"), ("run id=12345678", "run id=12345678"), ('x "0xDEADBEEF" y', 'x "<HEX>" y'), ("a1b2c3d4-0000-1111-2222-333344445555", "<UUID>"),
    ('run "foo 12345678 bar"', 'run "foo 12345678 bar"'), ("run '12345678' 12345678", "run '<NUMBER>' <NUMBER>"), ('a "b \\" 0xDEADBEEF" c"d\'12345678\'"', 'a "b \\" 0xDEADBEEF" c"d\'12345678\'"'),
    ('x "12345678', 'x "12345678'), ("  a  12345678\t x ", "a  <NUMBER>\t x"), ('"' + "a" * 20000 + '" 12345678', '"' + "a" * 20000 + '" <NUMBER>'), ("  ", ""), (None, ""),
])
def test_commands(spark, raw, expected):
    assert one(spark, raw, "string", commands.normalized) == expected


def test_ids(spark):
    row = spark.createDataFrame([("h", 'q"é/', ["a", "b"])], "h string, v string, n array<string>").select(
        text.pattern_id(F.col("h"), F.col("v")), text.entity_id(F.lit("process"), F.col("h"), F.lit("r"), F.col("v")), text.chain_id(F.col("h"), F.lit("observed"), F.col("n")),
        text.event_id(F.lit("a"), F.lit("m"), F.lit(3)), text.framed(F.col("h"), F.col("v")),
    ).first()
    dumps = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    sha = lambda x: hashlib.sha256(dumps(x).encode()).hexdigest()
    assert row[0] == "pattern_" + sha(["h", 'q"é/'])[:24]
    assert row[1] == "ent_" + sha(["entity_v1", "process", dumps(["host", "h"]), "r", 'q"é/'])[:32]
    assert row[2] == "pch_" + sha(["chain_v1", "h", "observed", ["a", "b"]])[:32]
    assert row[3] == "gen_" + hashlib.md5(b"a:m:3").hexdigest()[:12]
    assert row[4] == '1:h4:q"é/'


def test_divergence(spark):
    a = spark.createDataFrame([("w", "h", "x", 1), ("w", "g", "y", 2), ("w", "k", "z", 3)], "w string, h string, c string, n long")
    b = spark.createDataFrame([("h", "x", 5), ("g", "x", 5)], "h string, c string, n long")
    got = {r.h: r.jsd for r in stats.divergence(a, b, ["w"], ["h"], "c", "n").collect()}
    assert got == {"h": 0.0, "g": 1.0, "k": 1.0}


def test_scores(spark):
    row = spark.range(1).select(stats.deviation([F.lit(True)] * 3 + [F.lit(False)] * 2, F.lit(0.5)), stats.confidence(F.lit(5), F.lit(0.5)), stats.confidence(F.lit(4), F.lit(0.3)), stats.confidence(F.lit(2), F.lit(0.9))).first()
    assert tuple(row) == (3.5 / 6, "high", "medium", "low")


def test_source_types(spark):
    assert [one(spark, x, "string", text.source_type) for x in ("a/ground_truth.csv", "flow_host.json", "ecar/h.json", "x")] == ["ground_truth", "network", "endpoint", "unknown"]
