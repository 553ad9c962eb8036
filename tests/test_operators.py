from __future__ import annotations

import datetime as dt
import tarfile

import pytest
from pyspark.sql import functions as F

from eventloom.operators import audit, baseline, checks, entities, intake, lineage, relational, selection, taxonomy, windows
from eventloom.operators.relational import Interval
from eventloom.plans import adapter

GOOD = [Interval("a", "2020-01-01", "2020-01-03", "verified_benign"), Interval("b", "2020-01-03", "2020-01-04", "evaluation")]
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bad", [
    [Interval("", "1", "2", "other")], [Interval("full_pilot_unassigned", "1", "2", "other")], [Interval("a", "1", "2", "x")], [Interval("a", "2", "1", "other")],
    [Interval("a", "1", "3", "other"), Interval("b", "2", "4", "other")], [Interval("a", "1", "2", "evaluation"), Interval("b", "3", "4", "verified_benign")], [Interval("a", "1", "2", "other"), Interval("a", "3", "4", "evaluation")],
])
def test_policy(bad):
    with pytest.raises(ValueError):
        relational.check_policy(bad)


def test_half_open(spark):
    rows = spark.createDataFrame([("2019-12-31 23:59:59",), ("2020-01-03 00:00:00",), ("2020-01-04 00:00:00",)], "s string").selectExpr("cast(s as timestamp_ntz) t")
    assert [r.period for r in relational.assign_period(rows, "t", GOOD).orderBy("t").collect()] == ["full_pilot_unassigned", "b", "full_pilot_unassigned"]


def test_nulls_sort_last(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, 5, "y"), (1, 7, "z")], "k int, o int, v string")
    assert rows.groupBy("k").agg(relational.earliest(["v"], ["o"]).alias("e")).first().e.v == "y"
    assert relational.first_k(rows, ["k"], ["o"], 2, "v", "l").first().l == ["y", "z"]


def test_densify_and_guard(spark):
    b = spark.createDataFrame([("2020-01-01 00:00:00", 2), ("2020-01-01 03:00:00", 1)], "s string, n long").selectExpr("cast(s as timestamp_ntz) t", "n")
    assert [r.n for r in relational.densify(b, "t", 3600, ["n"]).orderBy("t").collect()] == [2, 0, 0, 1]
    with pytest.raises(ValueError):
        relational.densify(b, "t", 3600, ["n"], limit=3)


def test_global_rank(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    got = relational.global_rank(rows, [F.desc("v")], "r").orderBy("r").collect()
    assert [x.v for x in got] == list(range(499, -1, -1)) and [x.r for x in got] == list(range(1, 501))


def test_bucket_table(spark):
    e = spark.createDataFrame([("2020-01-01 00:59:00",), ("2020-01-01 02:01:00",)], "s string").selectExpr("cast(s as timestamp_ntz) event_time", "'h' host_raw", "'' process_raw", "'' destination_raw", "'' user_raw")
    got = {r.window_size: (r.n_windows, round(r.empty_pct, 1)) for r in windows.compare(e).collect()}
    assert got == {"1min": (63, 96.8), "5min": (14, 85.7), "15min": (6, 66.7), "1h": (3, 33.3), "1d": (1, 0.0)}


@pytest.mark.parametrize(("rows", "status", "expected"), [
    ([("1min", 90.0, 1.0), ("5min", 40.0, 6.0), ("15min", 10.0, 9.0), ("1h", 0.0, 50.0), ("1d", 0.0, 99.0)], "ok", ["no", "primary", "backup", "no", "no"]),
    ([("1min", 90.0, 1.0), ("5min", 40.0, 6.0), ("15min", 10.0, 9.0), ("1h", 0.0, 50.0), ("1d", 0.0, 99.0)], "insufficient", ["review_needed"] * 5),
    ([("1min", 90.0, 1.0), ("5min", 90.0, 6.0), ("15min", 60.0, 9.0), ("1h", 70.0, 50.0), ("1d", 0.0, 99.0)], "ok", ["no", "no", "no", "backup", "primary"]),
])
def test_recommendation(spark, rows, status, expected):
    c = spark.createDataFrame(rows, "window_size string, empty_pct double, median_events double")
    got = {r.window_size: r.recommendation for r in windows.recommend(c, status).collect()}
    assert [got[s] for s in windows.WIDTHS] == expected


def test_taxonomy_checks(spark):
    e = adapter.events(spark, DATA)
    compact = taxonomy.primary(e, adapter.PERIODS)
    t6 = taxonomy.t6(compact)
    checks.total(t6, "event_count", e.where("parse_status = 'ok' and event_time is not null").count())
    checks.shares(t6, "period", "percent_of_period")
    checks.unique(taxonomy.t7(compact), ["raw_object_type", "raw_action_type"])
    checks.complete(taxonomy.t8(compact), ["example_id", "pattern_id"])
    assert taxonomy.t8_deferred(taxonomy.t8(compact)).where("benign_count is not null").count() == 0


def test_dictionary_is_sound_and_ignores_order(spark):
    e = adapter.events(spark, DATA)
    d = entities.t9(e)
    checks.dictionary(d)
    assert d.exceptAll(entities.t9(e.repartition(7).orderBy(F.rand(3)))).count() == 0


def test_baseline_sees_no_evaluation(spark):
    e = adapter.events(spark, DATA)
    d = entities.t9(e)
    more = e.where("event_time >= '2024-01-24' and event_time < '2024-01-30'").withColumn("host_raw", F.lit("h1"))
    one, two = (baseline.top_benign(baseline.core(baseline.prepared(x, d, adapter.PERIODS, 3600)), "host_id", "semantic_group", 5) for x in (e, e.unionByName(more)))
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_chain_rules(spark):
    at = dt.datetime(2020, 1, 1)
    e = lambda a, b, w=at, h="h": ("verified_benign", w, h, a, b, 1, at, at, (at, "a", "m", 1, f"{a}{b}", a, b, "resolved"))
    schema = "period_role string, window_start timestamp_ntz, host_id string, parent_cmp string, child_cmp string, n long, first_time timestamp_ntz, last_time timestamp_ntz, e struct<event_time:timestamp_ntz,archive_name:string,member_name:string,line_number:long,raw_event_id:string,parent_show:string,child_show:string,mapping:string>"
    edges = spark.createDataFrame([e("a", "b"), e("b", "c"), e("c", "a"), e("a", "a"), e("c", "d", dt.datetime(2020, 1, 2)), e("c", "e", at, "g")], schema)
    got = sorted(r.chain for r in lineage.chains(edges).collect())
    assert got == sorted(["a -> b", "b -> c", "c -> a", "c -> d", "c -> e", "a -> b -> c", "b -> c -> a", "c -> a -> b"])


def test_quality_and_decisions(spark):
    e = adapter.events(spark, DATA)
    assert [r.issue_id for r in audit.quality_issues(e).orderBy("issue_id").collect()][:2] == ["ISSUE_001", "ISSUE_002"]
    d = {r.field: r.decision for r in audit.decide(audit.field_audit(e, ["parse_status", "parent_process_raw", "module_path_raw"])).where("source_type = 'endpoint'").collect()}
    assert d == {"parse_status": "keep", "parent_process_raw": "drop", "module_path_raw": "review"}


def test_selection_keeps_caps(spark):
    rows = [(f"2020-01-{d:02d}", f"{d}.tar", f"m{d}{h}{i}.json.gz", f"h{h}", "endpoint", 0.1) for d in range(1, 9) for h in range(6) for i in range(3)]
    m = spark.createDataFrame(rows, "archive_date string, archive_filename string, member_name string, host string, source_type string, size_gib double")
    got = selection.select(m, [f"h{i}" for i in range(5)], 8.0, 7.0, 9.0).toPandas()
    assert got.size_gib.sum() <= 9.0 and got.member_name.is_unique
    assert (got.groupby("archive_date").size_gib.sum() / got.size_gib.sum()).max() <= 0.22
    assert selection.manifest(spark.createDataFrame(got)).where("manifest_id = 'P10_00001'").count() == 1


def test_selection_verdict(spark):
    kinds = "archive_date string, archive_filename string, member_name string, host string, source_type string, size_gib double, readable string, sample_status string, valid_lines string, invalid_lines string, first_time string, last_time string"
    member = lambda d, h, size, **more: tuple({"d": f"2020-01-{d:02d}", "a": f"{d}.tar", "m": f"{d}{h}.json.gz", "h": f"h{h}", "t": "endpoint", "s": size, "r": "yes", "k": "sample_ok", "v": "5", "i": "0", "b": "a", "e": "b", **more}.values())
    good = [member(d, h, 0.1) for d in range(1, 6) for h in range(4)]

    def verdict(chosen, inventory):
        some = spark.createDataFrame(chosen, kinds).select("archive_date", "archive_filename", "member_name", "host", "source_type", "size_gib")
        return {r.check: (r.value, r.result) for r in selection.validate(some, spark.createDataFrame(inventory, kinds), 1.0, 3.0).collect()}

    got = verdict(good, good)
    assert {k for k, (_, r) in got.items() if r == "fail"} == set() and len(got) == 16
    assert got["repeated_hosts"] == got["hosts_on_all_dates"] == (4.0, "info")
    skewed = [member(d, h, 0.106 if d == 1 else 0.1) for d in range(1, 6) for h in range(4)]
    assert {k for k, (_, r) in verdict(skewed, skewed).items() if r == "fail"} == {"date_share"}
    later = [*good, member(6, 1, 0.1), member(7, 1, 0.1)]
    got = verdict(good, later)
    assert got["all_inventory_dates_represented"] == (2.0, "fail") and got["hosts_on_all_dates"][0] == 0.0
    for change, name in (({"r": "no"}, "readable"), ({"v": "0"}, "valid_sampled_json"), ({"i": None}, "valid_sampled_json"), ({"k": "x"}, "valid_sampled_json"), ({"e": " "}, "have_sampled_timestamps")):
        assert {k for k, (_, r) in verdict(good, [*good[1:], member(1, 0, 0.1, **change)]).items() if r == "fail"} == {f"selected_members_{name}"}
    unknown = verdict(good, good[1:])
    assert [unknown[f"selected_members_{k}"] for k in ("readable", "valid_sampled_json", "have_sampled_timestamps")] == [(1.0, "fail")] * 3
    empty = verdict([], good)
    assert empty["all_inventory_dates_represented"] == (5.0, "fail") and empty["selected_members_readable"][1] == "fail" and empty["repeated_hosts"] == (0.0, "info")


def test_intake(spark):
    f = spark.createDataFrame([("raw/.x.json", 5), ("raw/flow_v1_.json", 0), ("raw/host_v2.json.gz", 9), ("raw/ecar_2020-01-01.json.gz", 9)], "path string, length long")
    rows = {r.file_name: (r.included, r.reason, r.source_type) for r in intake.ledger(f).collect()}
    assert rows["ecar_2020-01-01.json.gz"] == ("yes", "none", "endpoint") and rows[".x.json"][:2] == ("no", "hidden_file") and rows["flow_v1_.json"][:2] == ("no", "empty_file") and rows["host_v2.json.gz"][:2] == ("no", "other_version")
    scope = {r.item: r.value for r in intake.scope(intake.ledger(f), ["2020-01-01", "2020-01-02"]).collect()}
    assert scope["dates_available"] == "2020-01-01" and scope["dates_pending"] == "2020-01-02"
    c = intake.catalogue(spark.createDataFrame([("flow_v1_.json", 50.0), ("y", 200.0)], "file string, size_gb double"), f)
    assert sorted((r.file, r.downloaded, r.storage_priority) for r in c.collect()) == [("flow_v1_.json", "yes", "high"), ("y", "no", "low")]


def test_report_checks():
    checks.chunks(["chunk_00000_a", "chunk_00001_b"])
    for bad in (lambda: checks.chunks(["chunk_00000_a", "chunk_00002_b"]), lambda: checks.wording("a Malicious host")):
        with pytest.raises(AssertionError):
            bad()


def test_semantic_map(spark):
    rows = spark.createDataFrame([("PROCESS", "START"), (" flow", ""), (None, "x"), ("", "x")], "object_raw string, action_raw string")
    t7 = taxonomy.t7(rows)
    got = {(r.raw_object_type, r.raw_action_type): (r.semantic_group, r.mapping_rule) for r in t7.collect()}
    assert got == {
        ("PROCESS", "START"): ("process_activity", "object_type_in_PROCESS_THREAD"), (" flow", "<MISSING>"): ("network_activity", "object_type_FLOW"),
        ("<MISSING>", "x"): ("other_activity", "object_type_missing_or_unrecognized"),
    }
    assert taxonomy.map_events(rows, t7).where("mapping_rule is null").count() == 0
    checks.semantic_map(t7)
    for wrong in (t7.union(t7), t7.withColumn("mapping_rule", F.lit("x")), t7.withColumn("keep_raw_fields_yes_no", F.lit(None).cast("string")), t7.limit(0)):
        with pytest.raises(AssertionError):
            checks.semantic_map(wrong)


def test_policies_and_settings():
    benign, short, evaluation = Interval("b", "2024-01-01", "2024-01-03", "verified_benign"), Interval("b", "2024-01-01", "2024-01-01T12:00:00", "verified_benign"), Interval("e", "2024-01-03", "2024-01-04", "evaluation")
    one_date = Interval("b", "2024-01-01", "2024-01-02", "verified_benign")
    checks.benign_cover([benign, evaluation])
    checks.threshold(5, [benign, evaluation])
    checks.threshold(None, [evaluation])
    checks.settings(cache_path="x", threads_n=4, least=9.0, target=9.5, most=None)
    bad = [
        lambda: checks.benign_cover([benign]), lambda: checks.benign_cover([short, evaluation]), lambda: checks.benign_cover([one_date, evaluation]), lambda: checks.threshold(0, [benign]),
        lambda: checks.threshold(None, [benign]), lambda: checks.threshold(5, [evaluation]), lambda: checks.settings(cache_path=" "), lambda: checks.settings(threads_n=0),
        lambda: checks.settings(threads_n=1.5), lambda: checks.settings(threads_n=True), lambda: checks.settings(least=10, most=9),
    ]
    for f in bad:
        with pytest.raises(AssertionError):
            f()


def test_roles_add_up(spark):
    every, some = (spark.createDataFrame(rows, "period_role string, n long") for rows in ([("evaluation", 5), ("verified_benign", 7)], [("evaluation", 2)]))
    assert checks.roles(every, some, 12) == {"process_total": 2, "process_evaluation": 2}
    for f in (lambda: checks.roles(every, some, 13), lambda: checks.roles(some, every, 2)):
        with pytest.raises(AssertionError):
            f()


def test_smoke_and_manifest_quality(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "b.json").write_text('{\n"a": 1}')
    (tmp_path / "c.jsonl").write_text("{no")
    (tmp_path / "d.tar").write_text("no archive")
    (tmp_path / "e.csv").write_text("x,y\n1,2\n")
    (tmp_path / "f.bin").write_text("x")
    with tarfile.open(tmp_path / "g.tar", "w") as t:
        t.add(tmp_path / "a.json", "a.json")
    got = {r.path[-6:]: (r.parser, r.parse_status.split(":")[0]) for r in intake.smoke_test(intake.files(spark, str(tmp_path))).collect()}
    assert got == {
        "a.json": ("json_line_reader", intake.READ), "b.json": ("json_full_reader", intake.READ), ".jsonl": ("json_line_reader", "parse_error"), "/d.tar": ("tar_smoke_parser", "tar_open_failed"),
        "/e.csv": ("pandas_csv_tsv", intake.READ), "/f.bin": intake.NOT_TRIED, "/g.tar": ("tar_smoke_parser", intake.OPENED),
    }
    inventory = spark.createDataFrame([("a", "m", "yes", "sample_ok", 1, 0, "t", "u")], "archive_filename string, member_name string, readable string, sample_status string, valid_lines int, invalid_lines int, first_time string, last_time string")
    chosen = spark.createDataFrame([("a", "m", "x"), ("a", "n", None)], "archive_filename string, member_name string, readable string")
    rows = {r.member_name: r for r in selection.with_quality(chosen, inventory).collect()}
    assert (rows["m"].readable, rows["m"].readable_inv, rows["n"].valid_lines) == ("x", "yes", None)


def test_collection_summary(spark):
    rows = [("m", "a", "endpoint", "ok")] * 3 + [("n", "a", None, "ok"), (None, None, "network", None)]
    got = {(r.item, r.name): r.n for r in intake.collection_summary(spark.createDataFrame(rows, "member_name string, archive_name string, source_type string, parse_status string"), 1).collect()}
    assert got == {("events", ""): 5, ("ok", ""): 4, ("not_ok", ""): 1, ("members", ""): 3, ("archives", ""): 2, ("source_type", "endpoint"): 3, ("source_type", "unknown"): 1, ("top_member", "m"): 3}
