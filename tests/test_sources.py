from __future__ import annotations

import gzip
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.schema import COLUMNS
from eventloom.sources import archives, normalize, tables
from eventloom.streaming import ingest


def event(i, **props):
    return json.dumps({"id": f"e{i}", "hostname": "h1", "action": "CREATE", "object": "PROCESS", "objectID": f"o{i}", "actorID": "a", "pid": 1, "principal": "u", "timestamp": "2019-09-16T00:00:00Z", "properties": {"image_path": "C:\\x.exe"} | props})


@pytest.fixture
def tar(tmp_path):
    with tarfile.open(tmp_path / "2019-09-16.tar", "w") as t:
        for name, lines in (("ecar/hostA.ecar.json.gz", [event(i) for i in range(30)]), ("ecar/hostB.ecar.json.gz", ["", "{bad", "[1, 2]", event(1, zz=True), "  "])):
            raw = gzip.compress("\n".join(lines).encode())
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    return str(tmp_path)


def test_lines(spark, tar):
    rows = archives.read_lines(spark, tar).orderBy("member_name", "line_number").collect()
    assert len(rows) == 33 and [r.line_number for r in rows if "hostB" in r.member_name] == [2, 3, 4]
    m = spark.createDataFrame([("2019-09-16.tar", "ecar/hostB.ecar.json.gz")], "archive_filename string, member_name string")
    assert archives.read_lines(spark, tar, m).count() == 3
    assert archives.read_lines(spark, tar, maxLinesPerMember="2").count() == 4
    assert archives.read_lines(spark, tar, max_events=5).count() == 5


def test_inventory(spark, tar):
    got = {r.member_name: (r.sample_status, r.valid_lines, r.host, r.source_type, r.archive_date) for r in archives.inventory(spark, tar).collect()}
    assert got["ecar/hostA.ecar.json.gz"] == ("sample_ok", 5, "hostA", "endpoint", "2019-09-16") and got["ecar/hostB.ecar.json.gz"][0] == "sample_invalid"


def test_normalize(spark, tar):
    flat = normalize.normalize(archives.read_lines(spark, tar))
    assert flat.columns == [*COLUMNS, "error_snippet"] and len(COLUMNS) == 77
    rows = flat.where("member_name like '%hostB%'").orderBy("line_number").collect()
    assert [(r.file_id, r.parse_status, r.line_number) for r in rows] == [(31, "json_parse_error", 2), (32, "ok", 4)]
    assert rows[0].raw_event_id.startswith("gen_") and rows[1].unmapped_property_keys_raw == "zz" and rows[1].timestamp_parsed == "2019-09-16T00:00:00" and rows[1].process_raw == "C:\\x.exe" and rows[1].object_value_raw == "C:\\x.exe"


def test_scalars(spark):
    line = json.dumps({"host": "b", "time": 1568592000, "object": "SERVICE", "properties": {"name": True, "start_type": 1.5, "info_class": None}})
    r = normalize.normalize(spark.createDataFrame([("a", "m", 1, line), ("a", "m", 2, json.dumps({"properties": 3}))], "archive_name string, member_name string, line_number int, line string")).orderBy("line_number").collect()
    assert (r[0].host_raw, r[0].service_name_raw, r[0].service_start_type_raw, r[0].info_class_raw, r[0].timestamp_parsed) == ("b", "True", "1.5", "", "2019-09-16T00:00:00")
    assert r[1].properties_keys_raw == "" and r[1].parse_status == "ok"


def test_cache_round_trip(spark, tar, tmp_path):
    flat = normalize.normalize(archives.read_lines(spark, tar))
    out = str(tmp_path / "cache")
    assert tables.write_events(flat, out)["total_events_written"] == 32
    back = tables.events(spark, out)
    assert back.where("event_time is not null").count() == 31 and tables.checkpoint(back).first().line_number == 4
    assert tables.error_examples(back).count() == 1 and tables.footers(spark, out).agg(F.sum("n")).first()[0] == 32
    with pytest.raises(Exception, match="(?i)already exists"):
        tables.write_events(flat, out)


def test_publish(tmp_path):
    out = str(tmp_path / "r")
    tables.publish(out, lambda d: tables.write_text(f"{d}/a.txt", "x"))
    assert open(f"{out}/a.txt").read() == "x"
    with pytest.raises(FileExistsError):
        tables.publish(out, lambda d: None)
    os.symlink(tmp_path / "nowhere", tmp_path / "link")
    with pytest.raises(FileExistsError):
        tables.publish(str(tmp_path / "link"), lambda d: None)
    with pytest.raises(RuntimeError):
        tables.publish(str(tmp_path / "s"), lambda d: tables.write_text(f"{d}/a.partial", "x"))
    assert not os.path.exists(tmp_path / "s")


def test_period_map(spark, tmp_path):
    (tmp_path / "p.csv").write_text("period,start_time,end_time,period_role\na,2020-01-01T00:00:00Z,2020-01-02T00:00:00Z,verified_benign\n")
    assert tables.periods(spark, str(tmp_path / "p.csv"))[0].end == "2020-01-02T00:00:00"


def test_stream_windows(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    src.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.windows(ingest.read(spark, str(tmp_path / "in"), src.schema), "ts", 86400, ["event_type"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    expected = src.groupBy(F.window("ts", "1 day").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    assert spark.table("w").exceptAll(expected).count() == 0 and expected.exceptAll(spark.table("w")).count() == 0


def test_resume_reads_each_file_once(spark, tmp_path):
    schema = T.StructType.fromDDL("archive_name string, member_name string, line_number long, line string")
    def put(name):
        spark.createDataFrame([(name, "m", i, event(i)) for i in range(4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k, name in enumerate(("a", "b"), 1):
        put(name)
        ingest.resume(ingest.read(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == 4 * k


def test_report_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"'), (None, "c,d")], "x long, y string")
    assert tables.report_csv(rows, str(tmp_path / "r.csv")) == 2
    assert sorted((tmp_path / "r.csv").read_text().splitlines()) == ['"","c,d"', '"1","a ""b"""', '"x","y"']
    with pytest.raises(ValueError):
        tables.report_csv(rows, str(tmp_path / "s.csv"), 1)
    assert not (tmp_path / "s.csv").exists()
