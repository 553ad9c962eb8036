"""The synthetic tables as event tables: the same expressions in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import Interval

PERIODS = [Interval("benign_weeks", "2024-01-01", "2024-01-24", "verified_benign"), Interval("evaluation_week", "2024-01-24", "2024-01-30", "evaluation")]
HOUR = 3600

EVENT = {
    "event_time": "CASE WHEN event_id % 83 = 0 THEN NULL ELSE ts END",
    "archive_name": "concat(substr(CAST(ts AS {TEXT}), 1, 10), '.tar')",
    "member_name": "concat('ecar/h', user_id % 8, '.ecar.json.gz')",
    "line_number": "event_id + 1",
    "raw_event_id": "concat('e', CASE WHEN event_id % 211 = 1 THEN event_id - 1 ELSE event_id END)",
    "parse_status": "CASE WHEN event_id % 97 = 0 THEN 'json_parse_error' ELSE 'ok' END",
    "timestamp_raw": "CASE WHEN event_id % 89 = 0 THEN '' ELSE concat('t', event_id) END",
    "timestamp_parsed": "CASE WHEN event_id % 83 = 0 THEN '' ELSE concat('p', event_id) END",
    "source_type": "CASE WHEN user_id % 3 = 0 THEN 'network' ELSE 'endpoint' END",
    "host_raw": "CASE WHEN event_id % 101 = 0 THEN '' ELSE concat('h', user_id % 8) END",
    "user_raw": "CASE WHEN event_id % 103 = 0 THEN '' ELSE concat('u', user_id % 40) END",
    "object_raw": "CASE event_type WHEN 'click' THEN 'PROCESS' WHEN 'view' THEN 'FILE' WHEN 'error' THEN ' flow' WHEN 'signup' THEN 'USER_SESSION' ELSE 'REGISTRY' END",
    "action_raw": "CASE WHEN event_id % 107 = 0 THEN '' ELSE event_type END",
    "image_path_raw": "CASE WHEN event_type = 'click' THEN concat('C:', chr(92), 'apps', chr(92), 'p', k % 7, '.exe') ELSE '' END",
    "parent_image_path_raw": "CASE WHEN event_type = 'click' AND event_id % 31 <> 0 THEN concat(CASE WHEN k % 2 = 0 THEN 'C:/Apps/p' ELSE 'C:/apps/p' END, (k + 1 + event_id % 3) % 7, '.exe') ELSE '' END",
    "file_path_raw": "CASE WHEN event_type <> 'view' THEN '' WHEN k % 6 = 0 THEN concat('C:', chr(92), 'Temp', chr(92), 'f', k) WHEN k % 6 = 1 THEN concat('C:', chr(92), 'Users', chr(92), 'u', k) WHEN k % 6 = 2 THEN concat('C:', chr(92), 'Windows', chr(92), 's', k, '.dll') WHEN k % 6 = 3 THEN concat(chr(92), chr(92), 'srv', chr(92), 'share', chr(92), k) WHEN k % 6 = 4 THEN concat('/usr/lib/x', k) ELSE concat('bare', k) END",
    "dest_ip_raw": "CASE WHEN event_type <> 'error' THEN '' WHEN k % 8 = 0 THEN concat('8.8.', k % 4, '.', user_id % 16) WHEN k % 8 = 1 THEN '127.0.0.1' WHEN k % 8 = 2 THEN concat('192.168.1.', k) WHEN k % 8 = 3 THEN concat('224.0.0.', k) WHEN k % 8 = 4 THEN concat('169.254.1.', k) WHEN k % 8 = 5 THEN concat('host', k, '.example') WHEN k % 8 = 6 THEN concat('256.1.1.', k) ELSE concat('10.0.', k % 4, '.', user_id % 16) END",
    "command_line_raw": "CASE WHEN event_type <> 'click' THEN '' WHEN k % 5 = 0 THEN concat('run.exe /id ', 10000000 + event_id) WHEN k % 5 = 1 THEN concat('svc 0xdeadbeef', 10 + k, ' /q') WHEN k % 5 = 2 THEN concat('job id=12345678 n', k % 3) WHEN k % 5 = 3 THEN '' ELSE concat('tool ', 'a1b2c3d4-0000-1111-2222-', 333344445500 + k) END",
}
BLANK = ["process_raw", "parent_process_raw", "destination_raw"]


def _expressions(text: str) -> list[str]:
    return [f"{v.replace('{TEXT}', text)} AS {c}" for c, v in EVENT.items()] + [f"'' AS {c}" for c in BLANK]


#: DuckDB: ev has the events, ok those that are parsed, pe the timed ones with their period.
EV = (
    "e0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), ev AS (SELECT " + ", ".join(_expressions("VARCHAR")) + " FROM e0), "
    "ok AS (SELECT * FROM ev WHERE parse_status = 'ok' AND event_time IS NOT NULL), "
    "pe AS (SELECT *, CASE WHEN event_time >= TIMESTAMP '2024-01-01' AND event_time < TIMESTAMP '2024-01-24' THEN 'benign_weeks' WHEN event_time >= TIMESTAMP '2024-01-24' AND event_time < TIMESTAMP '2024-01-30' THEN 'evaluation_week' ELSE 'full_pilot_unassigned' END AS period, "
    "CASE WHEN event_time >= TIMESTAMP '2024-01-01' AND event_time < TIMESTAMP '2024-01-24' THEN 'verified_benign' WHEN event_time >= TIMESTAMP '2024-01-24' AND event_time < TIMESTAMP '2024-01-30' THEN 'evaluation' ELSE 'unassigned' END AS period_role, "
    "date_trunc('hour', event_time) AS window_start, CAST(regexp_extract(archive_name, '(\\d{4}-\\d{2}-\\d{2})', 1) AS DATE) AS archive_date, CAST(extract(hour FROM event_time) AS BIGINT) AS hour FROM ev WHERE event_time IS NOT NULL)"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.selectExpr(*_expressions("STRING"))


#: Orders as archive members: a host for each twelfth customer, a date for each month.
MEMBER = {
    "archive_date": "concat(substr(CAST(o_orderdate AS {TEXT}), 1, 7), '-01')",
    "archive_filename": "concat(substr(CAST(o_orderdate AS {TEXT}), 1, 7), '-01.tar')",
    "member_name": "concat('ecar/h', o_custkey % 12, '/m', o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN '.csv' ELSE '.json.gz' END)",
    "host": "CASE WHEN o_orderkey % 29 = 0 THEN 'unknown' ELSE concat('h', o_custkey % 12) END",
    "source_type": "CASE WHEN o_orderkey % 4 = 0 THEN 'network' ELSE 'endpoint' END",
    "size_gib": "CAST(o_orderkey % 64 AS DOUBLE) / 1024",
    "readable": "CASE WHEN o_orderkey % 31 = 0 THEN 'no' ELSE 'yes' END",
    "sample_status": "CASE WHEN o_orderkey % 37 = 0 THEN 'sample_invalid' ELSE 'sample_ok' END",
    "valid_lines": "CAST(5 AS INT)",
    "invalid_lines": "CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END",
    "first_time": "'a'",
    "last_time": "'b'",
}
MEMBERS = "inv AS (SELECT " + ", ".join(f"{v.replace('{TEXT}', 'VARCHAR')} AS {c}" for c, v in MEMBER.items()) + " FROM orders), el AS (SELECT * FROM inv WHERE member_name LIKE '%.json.gz' AND readable = 'yes' AND sample_status = 'sample_ok' AND invalid_lines = 0 AND host <> 'unknown')"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*[f"{v.replace('{TEXT}', 'STRING')} AS {c}" for c, v in MEMBER.items()])
