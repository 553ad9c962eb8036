"""Queries over the structure of events: audit, windows, taxonomy, entities, selection, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commands, ip, paths
from ..functions.text import MISSING
from ..operators import audit, entities, intake, relational, selection, taxonomy, windows
from ..sources.normalize import normalize
from ..state import cut
from .adapter import EV, MEMBERS, PERIODS, events, members
from .common import Registry

_r = Registry()
query, QUERIES, ORACLES = _r.query, _r.queries, _r.oracles

LABELS = "coalesce(nullif(upper(trim({0})), ''), '<MISSING>')"
COMPACT = (
    f"c AS (SELECT period, period_role, {LABELS.format('host_raw')} AS host, object_raw, action_raw, {LABELS.format('object_raw')} AS object_type, {LABELS.format('action_raw')} AS action_type, "
    "event_time, archive_name, member_name, line_number, raw_event_id, row_number() OVER (ORDER BY event_time, archive_name, member_name, line_number, raw_event_id) AS k FROM pe WHERE parse_status = 'ok')"
)


def _compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.primary(events(spark, sf_dir), PERIODS)


@query(f"WITH {EV}, {COMPACT} SELECT period, period_role, object_type, action_type, count(*) AS event_count, count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY period) AS percent_of_period, min(event_time) AS first_seen, max(event_time) AS last_seen, arg_min(raw_event_id, k) AS example_id FROM c GROUP BY 1, 2, 3, 4")
def taxonomy_t6(spark, sf_dir):
    return taxonomy.t6(_compact(spark, sf_dir))


GROUP_SQL = "CASE WHEN upper(trim({0})) IN ('PROCESS', 'THREAD') THEN 'process_activity' WHEN upper(trim({0})) = 'FILE' THEN 'file_activity' WHEN upper(trim({0})) = 'MODULE' THEN 'module_activity' WHEN upper(trim({0})) = 'FLOW' THEN 'network_activity' WHEN upper(trim({0})) IN ('REGISTRY', 'SERVICE', 'TASK') THEN 'configuration_activity' WHEN upper(trim({0})) = 'USER_SESSION' THEN 'identity_session_activity' ELSE 'other_activity' END"


RULE_SQL = "CASE WHEN upper(trim({0})) IN ('PROCESS', 'THREAD') THEN 'object_type_in_PROCESS_THREAD' WHEN upper(trim({0})) IN ('FILE', 'MODULE', 'FLOW', 'USER_SESSION') THEN 'object_type_' || upper(trim({0})) WHEN upper(trim({0})) IN ('REGISTRY', 'SERVICE', 'TASK') THEN 'object_type_in_REGISTRY_SERVICE_TASK' ELSE 'object_type_missing_or_unrecognized' END"
T7_SQL = f"SELECT DISTINCT CASE WHEN coalesce(object_raw, '') = '' THEN '{MISSING}' ELSE object_raw END AS raw_object_type, CASE WHEN coalesce(action_raw, '') = '' THEN '{MISSING}' ELSE action_raw END AS raw_action_type, {GROUP_SQL.format('object_raw')} AS semantic_group, {RULE_SQL.format('object_raw')} AS mapping_rule, 'yes' AS keep_raw_fields_yes_no, '{taxonomy.RATIONALE}' AS rationale FROM c"


@query(f"WITH {EV}, {COMPACT} {T7_SQL}")
def taxonomy_t7(spark, sf_dir):
    return taxonomy.t7(_compact(spark, sf_dir))


@query(f"WITH {EV} SELECT {GROUP_SQL.format('object_raw')} AS semantic_group, {RULE_SQL.format('object_raw')} AS mapping_rule, count(*) AS n FROM ok GROUP BY 1, 2")
def semantic_map_join(spark, sf_dir):
    """Parsed events by what the semantic map says of their raw pair."""
    rows = events(spark, sf_dir).where("parse_status = 'ok' and event_time is not null")
    return taxonomy.map_events(rows, cut(taxonomy.t7(_compact(spark, sf_dir)))).groupBy("semantic_group", "mapping_rule").agg(F.count("*").alias("n"))


@query(f"WITH {EV}, {COMPACT}, m AS ({T7_SQL}) SELECT raw_object_type, raw_action_type, 'semantic_group' AS disagreement FROM m WHERE semantic_group <> 'other_activity'")
def semantic_map_disagreements(spark, sf_dir):
    """A map whose groups are all other_activity against the code."""
    wrong = taxonomy.t7(_compact(spark, sf_dir)).withColumn("semantic_group", F.lit("other_activity"))
    return taxonomy.map_disagreements(wrong).select("raw_object_type", "raw_action_type", "disagreement")


@query(f"""WITH {EV}, {COMPACT}, g AS (SELECT host, to_json([object_type, action_type])::VARCHAR AS pair, object_type, count(*) AS total, count(*) FILTER (WHERE period_role = 'verified_benign') AS b, count(*) FILTER (WHERE period_role = 'evaluation') AS v, count(*) FILTER (WHERE period_role NOT IN ('verified_benign', 'evaluation')) AS o, arg_min(archive_name, k) AS archive_name, arg_min(member_name, k) AS member_name, arg_min(line_number, k) AS line_number, arg_min(period, k) AS period, min(event_time) AS first_seen, arg_min(raw_event_id, k) AS e, arg_min(period_role, k) AS role FROM c GROUP BY 1, 2, 3)
SELECT 'pattern_' || sha256(to_json([host, pair])::VARCHAR)[1:24] AS pattern_id, host, pair AS object_action_pair, total, b AS benign_count, v AS evaluation_count, first_seen, e AS example_id, CASE WHEN role NOT IN ('verified_benign', 'evaluation') THEN 'unresolved_unassigned' WHEN role = 'evaluation' AND b = 0 THEN 'first_seen_in_evaluation' WHEN b <= 5 THEN 'rare_in_verified_benign' ELSE 'common_in_verified_benign' END AS rarity_status, archive_name, member_name, line_number, period, {GROUP_SQL.format('object_type')} AS semantic_group,
CASE WHEN role NOT IN ('verified_benign', 'evaluation') THEN 'Earliest evidence occurs outside verified benign and evaluation intervals (' || o || ' event(s) outside those roles); threshold status is unresolved and descriptive only.' WHEN role = 'evaluation' AND b = 0 THEN 'First observed in an evaluation interval and absent from verified benign intervals; descriptive status only.' WHEN b <= 5 THEN 'Verified-benign frequency ' || b || ' is at or below configured threshold 5; descriptive only.' ELSE 'Verified-benign frequency ' || b || ' exceeds configured threshold 5; descriptive only.' END AS rare_reason FROM g""")
def taxonomy_t8(spark, sf_dir):
    return taxonomy.t8(_compact(spark, sf_dir))


@query(f"WITH {EV}, {COMPACT}, o AS (SELECT object_type FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), a AS (SELECT action_type FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4) SELECT object_type, action_type, count(*) AS event_count, round(ln(1 + count(*)), 9) AS log_count FROM c JOIN o USING (object_type) JOIN a USING (action_type) GROUP BY 1, 2")
def taxonomy_heatmap(spark, sf_dir):
    return taxonomy.heatmap(taxonomy.t6(_compact(spark, sf_dir)), 3, 4).withColumn("log_count", F.round("log_count", 9))


@query("SELECT event_type, CAST(coalesce(sum(n) FILTER (WHERE h = 'h0'), 0) AS BIGINT) AS h0, CAST(coalesce(sum(n) FILTER (WHERE h = 'h1'), 0) AS BIGINT) AS h1 FROM (SELECT event_type, concat('h', user_id % 8) AS h, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def heatmap_pivot(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", F.concat(F.lit("h"), (F.col("user_id") % 8).cast("string")).alias("h")).agg(F.count("*").alias("n"))
    return taxonomy.pivot(rows, "event_type", "h", ["h0", "h1"], "n")


@query(f"WITH {EV} SELECT period, period_role, count(*) AS n FROM pe GROUP BY 1, 2")
def period_assign(spark, sf_dir):
    return relational.assign_period(events(spark, sf_dir).where("event_time is not null"), "event_time", PERIODS).groupBy("period", "period_role").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT period, period_role, count(*) AS n FROM pe GROUP BY 1, 2")
def period_join(spark, sf_dir):
    p = spark.createDataFrame(PERIODS, "period string, s string, e string, period_role string").selectExpr("period", "cast(s as timestamp_ntz) start_time", "cast(e as timestamp_ntz) end_time", "period_role")
    return relational.join_periods(events(spark, sf_dir).where("event_time is not null"), "event_time", p).groupBy("period", "period_role").agg(F.count("*").alias("n"))


FIELDS = ["host_raw", "user_raw", "action_raw", "image_path_raw", "parent_image_path_raw", "file_path_raw", "dest_ip_raw", "command_line_raw", "timestamp_parsed", "parse_status"]
APPLY = {"image_path_raw": "upper(trim(object_raw)) IN ('PROCESS','FLOW','FILE','MODULE','THREAD','SHELL')", "parent_image_path_raw": "upper(trim(object_raw)) = 'PROCESS'", "command_line_raw": "upper(trim(object_raw)) = 'PROCESS'", "file_path_raw": "upper(trim(object_raw)) = 'FILE'", "dest_ip_raw": "upper(trim(object_raw)) = 'FLOW'"}
LONG = "f AS (" + " UNION ALL ".join(f"SELECT source_type, '{c}' AS field, {c} AS value, {APPLY.get(c, 'TRUE')} AS applies FROM ev" for c in FIELDS) + ")"
AUDIT = f"WITH {EV}, {LONG}, a AS (SELECT source_type, field, count(*) AS total, count(*) FILTER (WHERE coalesce(value, '') = '') AS missing, count(*) FILTER (WHERE coalesce(value, '') <> '') AS non_empty, count(DISTINCT nullif(value, '')) AS distinct_values, count(*) FILTER (WHERE applies) AS applicable, count(*) FILTER (WHERE applies AND coalesce(value, '') = '') AS applicable_missing FROM f GROUP BY 1, 2)"


@query(f"{AUDIT} SELECT * FROM a")
def field_audit_long(spark, sf_dir):
    return audit.field_audit(events(spark, sf_dir), FIELDS)


@query(f"""{AUDIT}, r AS (SELECT *, CASE field WHEN 'parse_status' THEN 'provenance' WHEN 'host_raw' THEN 'core' WHEN 'action_raw' THEN 'core' WHEN 'timestamp_parsed' THEN 'core' WHEN 'user_raw' THEN 'entity' ELSE 'object_specific' END AS role, CASE WHEN total > 0 THEN 100e0 * missing / total ELSE 100e0 END AS missing_pct, CASE WHEN applicable > 0 THEN 100e0 * applicable_missing / applicable ELSE 100e0 END AS own FROM a),
q AS (SELECT *, CASE WHEN role = 'object_specific' THEN own ELSE missing_pct END AS pct, CASE WHEN role = 'object_specific' THEN applicable ELSE total END AS m FROM r)
SELECT source_type, field, total, missing, non_empty, distinct_values, applicable, applicable_missing, role, missing_pct, CASE WHEN role = 'provenance' THEN 'keep' WHEN role = 'object_specific' AND applicable = 0 THEN 'review' WHEN pct > 80 THEN 'drop' WHEN distinct_values <= 1 AND m > 10 AND field <> 'host_raw' THEN 'drop' WHEN field = 'timestamp_parsed' AND missing_pct > 50 THEN 'review' WHEN pct > 20 THEN 'review' ELSE 'keep' END AS decision FROM q""")
def field_decisions(spark, sf_dir):
    return audit.decide(audit.field_audit(events(spark, sf_dir), FIELDS))


@query("WITH f AS (SELECT o_orderstatus AS source_type, 'o_orderpriority' AS field, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderstatus, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders), g AS (SELECT source_type, field, value, count(*) AS n FROM f GROUP BY 1, 2, 3) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_type, field ORDER BY n DESC, value) AS rank_number FROM g) WHERE rank_number <= 3")
def field_audit_topk(spark, sf_dir):
    return audit.top_values(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderpriority", "o_custkey"], "o_orderstatus")


@query()
def approx_distinct(spark, sf_dir):
    return audit.field_audit(events(spark, sf_dir), FIELDS, approximate=True)


@query()
def approx_topk(spark, sf_dir):
    return audit.approximate_top(events(spark, sf_dir), "action_raw", "source_type")


@query(f"""WITH {EV}, t AS (SELECT 0 AS i, 'json_parse_error' AS issue_type, 'parse_status' AS affected_field, 'high' AS severity, raw_event_id FROM ev WHERE parse_status = 'json_parse_error' UNION ALL SELECT 1, 'missing_timestamp', 'timestamp_raw', 'high', raw_event_id FROM ev WHERE parse_status = 'ok' AND timestamp_raw = '' UNION ALL SELECT 2, 'timestamp_parse_failure', 'timestamp_parsed', 'high', raw_event_id FROM ev WHERE parse_status = 'ok' AND timestamp_raw <> '' AND timestamp_parsed = '' UNION ALL SELECT 3, 'missing_host', 'host_raw', 'medium', raw_event_id FROM ev WHERE parse_status = 'ok' AND host_raw = '' UNION ALL SELECT 4, 'missing_action', 'action_raw', 'low', raw_event_id FROM ev WHERE parse_status = 'ok' AND action_raw = '')
SELECT printf('ISSUE_%03d', row_number() OVER (ORDER BY i)) AS issue_id, issue_type, affected_field, severity, count(*) AS n, max(raw_event_id) AS example_id FROM t GROUP BY i, issue_type, affected_field, severity""")
def quality_issues(spark, sf_dir):
    return audit.quality_issues(events(spark, sf_dir))


@query(f"WITH {EV} SELECT CAST(count(*) - count(DISTINCT raw_event_id) AS BIGINT) AS n_duplicates FROM ev")
def dup_ids(spark, sf_dir):
    return audit.duplicate_ids(events(spark, sf_dir))


@query("WITH g AS (SELECT l_suppkey, epoch_us(l_shipdate) - epoch_us(lag(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate)) AS gap FROM lineitem) SELECT l_suppkey, count(*) AS n_gaps, count(*) FILTER (WHERE gap > 14400000000) AS n_large, max(gap) AS longest_us FROM g WHERE gap IS NOT NULL GROUP BY 1")
def time_gaps(spark, sf_dir):
    return audit.time_gaps(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_suppkey"], "l_shipdate")


@query(f"WITH {EV} SELECT source_type, date_trunc('hour', event_time) AS hour, count(*) AS n FROM ev WHERE event_time IS NOT NULL GROUP BY 1, 2")
def hourly_coverage(spark, sf_dir):
    return audit.hourly(events(spark, sf_dir), "event_time", ["source_type"])


@query(f"""WITH {EV}, c AS (SELECT count(*) AS n_events, count(event_time) AS n_parseable, count(DISTINCT nullif(host_raw, '')) AS n_hosts, count(DISTINCT member_name) AS n_members, count(DISTINCT date_trunc('day', event_time)) AS n_dates, min(event_time) AS first_time, max(event_time) AS last_time FROM ev)
SELECT *, CAST(epoch_us(last_time) - epoch_us(first_time) AS DOUBLE) / 1000000 AS span_seconds, '' AS failed, 'ok' AS status FROM c""")
def coverage_gate(spark, sf_dir):
    return windows.gate(windows.coverage(events(spark, sf_dir)))


def _buckets(seconds: int) -> str:
    return f"SELECT time_bucket(INTERVAL {seconds} SECOND, event_time) AS window_start, count(*) AS n_events, count(DISTINCT nullif(host_raw, '')) AS n_hosts, count(DISTINCT nullif(process_raw, '')) AS n_processes, count(DISTINCT nullif(destination_raw, '')) AS n_destinations, count(DISTINCT nullif(user_raw, '')) AS n_users FROM ev WHERE event_time IS NOT NULL GROUP BY 1"


for _size, _seconds in windows.WIDTHS.items():
    query(f"WITH {EV} {_buckets(_seconds)}", f"window_{_size}")(lambda spark, sf_dir, s=_seconds: windows.buckets(events(spark, sf_dir), s, exact=True))

COMPARE = f"WITH {EV}, " + ", ".join(f"b{s} AS ({_buckets(w)})" for s, w in windows.WIDTHS.items()) + ", cmp AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS window_size, (epoch_us(max(window_start)) - epoch_us(min(window_start))) // {w * 1_000_000} + 1 AS n_windows, count(*) AS n_filled, CAST(sum(n_events) AS BIGINT) AS n_events, median(n_events) AS median_events, avg(n_events) AS mean_events, max(n_events) AS max_events, median(n_hosts) FILTER (WHERE n_hosts > 0) AS median_hosts, median(n_processes) FILTER (WHERE n_processes > 0) AS median_processes, median(n_destinations) FILTER (WHERE n_destinations > 0) AS median_destinations, median(n_users) FILTER (WHERE n_users > 0) AS median_users FROM b{s}" for s, w in windows.WIDTHS.items()
) + "), cp AS (SELECT window_size, CAST(n_windows AS BIGINT) AS n_windows, n_filled, 100e0 * (n_windows - n_filled) / n_windows AS empty_pct, n_events, median_events, mean_events, max_events, median_hosts, median_processes, median_destinations, median_users FROM cmp)"


@query(f"{COMPARE} SELECT * FROM cp")
def window_compare(spark, sf_dir):
    return windows.compare(events(spark, sf_dir), exact=True)


@query(f"""{COMPARE}, o AS (SELECT *, CASE window_size WHEN '1min' THEN 0 WHEN '5min' THEN 1 WHEN '15min' THEN 2 WHEN '1h' THEN 3 ELSE 4 END AS i FROM cp), f AS (SELECT min(i) AS a FROM o WHERE empty_pct < 50 AND median_events >= 5), s AS (SELECT coalesce(min(i), 3) AS b FROM o, f WHERE empty_pct < 50 AND median_events >= 5 AND i > a)
SELECT window_size, empty_pct, median_events, CASE WHEN a IS NULL THEN 'review_needed' WHEN i = a THEN 'primary' WHEN i = b THEN 'backup' ELSE 'no' END AS recommendation FROM o, f, s""")
def window_recommend(spark, sf_dir):
    return windows.recommend(windows.compare(events(spark, sf_dir))).select("window_size", "empty_pct", "median_events", "recommendation")


@query(f"WITH {EV}, h AS (SELECT date_trunc('hour', event_time) AS hour, count(*) AS n FROM ev WHERE event_time IS NOT NULL AND user_id_ok GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour) SELECT hour, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (hour)".replace("AND user_id_ok", "AND host_raw = 'h3' AND action_raw = 'signup'"))
def densify_hourly(spark, sf_dir):
    some = events(spark, sf_dir).where("host_raw = 'h3' and action_raw = 'signup'")
    return relational.densify(audit.hourly(some, "event_time"), "hour", 3600, ["n"])


@query(f"WITH {EV}, h AS (SELECT host_raw, date_trunc('hour', event_time) AS hour, count(*) AS n FROM ev WHERE event_time IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, CASE WHEN epoch_us(hour) - epoch_us(lag(hour) OVER (PARTITION BY host_raw ORDER BY hour)) = 3600000000 THEN 0 ELSE 1 END AS f FROM h) SELECT host_raw, hour, n, CAST(sum(f) OVER (PARTITION BY host_raw ORDER BY hour) AS BIGINT) AS segment FROM s")
def gap_segments(spark, sf_dir):
    return relational.gap_segments(audit.hourly(events(spark, sf_dir), "event_time", ["host_raw"]), ["host_raw"], "hour", 3600)


#: DuckDB: ob has a row for each entity of each parsed event, t9 the dictionary.
WINDOWS_SQL = "(regexp_matches({0}, '^[A-Za-z]:[\\\\/]') OR {0} LIKE '//%' OR position(chr(92) IN {0}) > 0)"
IPV4_SQL = "regexp_full_match({0}, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}')"
_W, _I = WINDOWS_SQL.format("raw_value"), IPV4_SQL.format("raw_value")
CLASS_SQL = "CASE WHEN NOT " + IPV4_SQL + " THEN 'other_non_global/unresolved' WHEN {0} LIKE '127.%' THEN 'loopback' WHEN {0} LIKE '224.%' THEN 'multicast' WHEN {0} LIKE '10.%' OR {0} LIKE '192.168.%' THEN 'internal-looking' WHEN {0} LIKE '169.254.%' THEN 'other_non_global/unresolved' ELSE 'external-looking' END"
_PK = "upper(trim(object_raw)) IN ('PROCESS','FLOW','FILE','MODULE','THREAD','SHELL')"
_L = "event_time, archive_name, member_name, line_number, raw_event_id"
T9 = (
    f"ob AS (SELECT 'host' AS entity_type, host_raw AS raw_value, '' AS scope, 'host_raw' AS source_field, {_L} FROM ok WHERE trim(host_raw) <> '' "
    f"UNION ALL SELECT 'user_principal', user_raw, host_raw, 'user_raw', {_L} FROM ok WHERE trim(user_raw) <> '' "
    f"UNION ALL SELECT 'process', image_path_raw, host_raw, 'image_path_raw', {_L} FROM ok WHERE {_PK} AND trim(image_path_raw) <> '' "
    f"UNION ALL SELECT 'process', parent_image_path_raw, host_raw, 'parent_image_path_raw', {_L} FROM ok WHERE upper(trim(object_raw)) = 'PROCESS' AND trim(parent_image_path_raw) <> '' "
    f"UNION ALL SELECT 'file_path', file_path_raw, host_raw, 'file_path_raw', {_L} FROM ok WHERE upper(trim(object_raw)) = 'FILE' AND trim(file_path_raw) <> '' "
    f"UNION ALL SELECT 'destination', dest_ip_raw, '', 'dest_ip_raw', {_L} FROM ok WHERE upper(trim(object_raw)) = 'FLOW' AND trim(dest_ip_raw) <> ''), "
    "ok2 AS (SELECT *, row_number() OVER (PARTITION BY entity_type, raw_value, scope ORDER BY event_time, archive_name, member_name, line_number, raw_event_id, source_field) AS k FROM ob), "
    "g9 AS (SELECT entity_type, raw_value, scope, count(*) AS observation_count, count(DISTINCT archive_name || '|' || member_name) AS source_count, min(event_time) AS first_seen, max(event_time) AS last_seen, arg_min(source_field, k) AS source_field, arg_min(raw_event_id, k) AS example_id, arg_min(archive_name, k) AS archive_name, arg_min(member_name, k) AS member_name, arg_min(line_number, k) AS line_number FROM ok2 GROUP BY 1, 2, 3), "
    f"n9 AS (SELECT *, CASE WHEN entity_type IN ('process', 'file_path') AND {_W} THEN replace(raw_value, '/', chr(92)) ELSE raw_value END AS normalized_value, "
    f"CASE entity_type WHEN 'host' THEN 'host_exact_v1' WHEN 'user_principal' THEN 'user_host_scoped_exact_v1' WHEN 'process' THEN CASE WHEN {_W} THEN 'process_path_separator_v1' ELSE 'process_path_literal_unresolved_v1' END WHEN 'file_path' THEN CASE WHEN {_W} THEN 'file_path_separator_v1' ELSE 'file_path_literal_unresolved_v1' END ELSE CASE WHEN {_I} THEN 'destination_ip_v1' ELSE 'destination_literal_unresolved_v1' END END AS normalization_rule_id, "
    f"CASE entity_type WHEN 'host' THEN TRUE WHEN 'user_principal' THEN scope <> '' WHEN 'destination' THEN {_I} ELSE {_W} AND scope <> '' END AS res, CASE WHEN entity_type IN ('host', 'destination') THEN '' WHEN scope <> '' THEN scope ELSE '<MISSING_HOST_SCOPE>' END AS host_if_applicable FROM g9), "
    "t9 AS (SELECT *, 'ent_' || sha256(to_json(['entity_v1', entity_type, CASE WHEN entity_type IN ('host', 'destination') THEN '[\"global\"]' WHEN scope = '' THEN '[\"missing_host_scope\"]' ELSE to_json(['host', scope])::VARCHAR END, normalization_rule_id, normalized_value])::VARCHAR)[1:32] AS canonical_id, CASE WHEN res THEN 'resolved' ELSE 'unresolved' END AS entity_status, CASE WHEN NOT res THEN 'low' WHEN entity_type = 'process' THEN 'medium' ELSE 'high' END AS reliability FROM n9)"
)


@query(f"WITH {EV}, {T9} SELECT canonical_id, entity_type, raw_value, normalized_value, host_if_applicable, first_seen, last_seen, source_count, reliability, normalization_rule_id, observation_count, entity_status, CASE WHEN entity_type = 'destination' THEN {CLASS_SQL.format('raw_value')} ELSE '' END AS structural_category, CAST(0 AS BIGINT) AS alias_mismatches, source_field, example_id, archive_name, member_name, line_number FROM t9")
def entity_dictionary(spark, sf_dir):
    return entities.t9(events(spark, sf_dir))


@query(f"WITH {EV}, {T9} SELECT entity_type, count(*) AS raw_values, count(DISTINCT canonical_id) AS canonical_entities, count(*) FILTER (WHERE entity_status = 'unresolved') AS unresolved, CAST(sum(observation_count) AS BIGINT) AS observations, count(*) - count(DISTINCT canonical_id) AS merged FROM t9 GROUP BY 1")
def entity_summary(spark, sf_dir):
    return entities.t10(entities.t9(events(spark, sf_dir)))


@query(f"WITH {EV}, {T9}, f AS (SELECT entity_type, canonical_id, min(first_seen) AS t FROM t9 GROUP BY 1, 2) SELECT date_trunc('minute', t) AS window_start, entity_type, count(*) AS n_new FROM f GROUP BY 1, 2")
def new_entity_rate(spark, sf_dir):
    return entities.new_entity_rate(entities.t9(events(spark, sf_dir)))


PATH_SQL = "CASE WHEN {0} LIKE '%Temp%' THEN 'temporary' WHEN left({0}, 2) = chr(92) || chr(92) THEN 'network' WHEN {0} LIKE '%Windows%' OR {0} LIKE '/usr/%' THEN 'system' WHEN {0} LIKE '%Users%' THEN 'user' ELSE 'unknown' END"
DEST_SQL = "CASE WHEN {0} = '' THEN 'unknown' WHEN NOT " + IPV4_SQL + " THEN 'hostname_or_other' WHEN {0} LIKE '127.%' THEN 'loopback' WHEN {0} LIKE '169.254.%' THEN 'link_local' WHEN {0} LIKE '224.%' THEN 'multicast' WHEN {0} LIKE '10.%' OR {0} LIKE '192.168.%' THEN 'private' ELSE 'global_syntax' END"


@query(f"WITH {EV} SELECT file_path_raw, {PATH_SQL.format('file_path_raw')} AS category, count(*) AS n FROM ev WHERE file_path_raw <> '' GROUP BY 1, 2")
def path_category(spark, sf_dir):
    return events(spark, sf_dir).where("file_path_raw <> ''").groupBy("file_path_raw").agg(F.count("*").alias("n")).withColumn("category", paths.category(F.col("file_path_raw")))


@query(f"WITH {EV} SELECT dest_ip_raw, {DEST_SQL.format('dest_ip_raw')} AS category, {CLASS_SQL.format('dest_ip_raw')} AS structural_class, count(*) AS n FROM ev WHERE dest_ip_raw <> '' GROUP BY 1, 2, 3")
def destination_category(spark, sf_dir):
    d = events(spark, sf_dir).where("dest_ip_raw <> ''").groupBy("dest_ip_raw").agg(F.count("*").alias("n"))
    return d.withColumns({"category": ip.category(F.col("dest_ip_raw")), "structural_class": ip.structural_class(F.col("dest_ip_raw"))})


COMMAND_SQL = "array_to_string(list_transform(string_split({0}, ' '), lambda t: CASE WHEN regexp_full_match(t, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') THEN '<UUID>' WHEN regexp_full_match(t, '0[xX][0-9a-fA-F]{{8,}}') THEN '<HEX>' WHEN regexp_full_match(t, '[0-9]{{8,}}') THEN '<NUMBER>' ELSE t END), ' ')"


@query(f"WITH {EV}, c AS (SELECT DISTINCT command_line_raw FROM ev WHERE command_line_raw <> '') SELECT command_line_raw, {COMMAND_SQL.format('command_line_raw')} AS command FROM c")
def command_normalize(spark, sf_dir):
    return events(spark, sf_dir).where("command_line_raw <> ''").select("command_line_raw").distinct().withColumn("command", commands.normalized(F.col("command_line_raw")))


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1:5] AS first_orders FROM orders GROUP BY 1".replace("list(", "array_to_string(list(").replace("[1:5]", "[1:5], ',')"))
def evidence_first_k(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return relational.first_k(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 5, "o_orderkey", "v").select("o_custkey", F.array_join(F.col("v").cast("array<string>"), ",").alias("first_orders"))


@query("SELECT o_custkey, arg_min(o_orderkey, (epoch_us(o_orderdate), o_orderkey)) AS first_order FROM orders GROUP BY 1".replace("(epoch_us(o_orderdate), o_orderkey)", "row(o_orderdate, o_orderkey)"))
def evidence_earliest(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy("o_custkey").agg(relational.earliest(["o_orderkey"], ["o_orderdate", "o_orderkey"]).alias("e")).select("o_custkey", F.col("e.o_orderkey").alias("first_order"))


@query("SELECT * FROM (SELECT l_suppkey, l_partkey, n, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS rank_number FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE rank_number <= 3")
def top_n_per_group(spark, sf_dir):
    g = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return relational.top_n(g, ["l_suppkey"], [F.desc("n"), F.col("l_partkey")], 3).withColumn("rank_number", F.col("rank_number").cast("long"))


_sets = {"set_union": ("UNION ALL", "unionByName"), "set_intersect": ("INTERSECT", "intersect"), "set_except": ("EXCEPT", "subtract")}
for _name, (_sql, _method) in _sets.items():
    query(f"SELECT o_custkey AS id FROM orders {_sql} SELECT c_custkey FROM customer", _name)(
        lambda spark, sf_dir, m=_method: getattr(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id")), m)(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id")))
    )


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def set_distinct(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(f"WITH {MEMBERS} SELECT archive_date, source_type, host, count(*) AS n_members, round(sum(size_gib), 6) AS total_gib, count(*) FILTER (WHERE readable = 'yes') AS n_readable FROM inv GROUP BY 1, 2, 3")
def inventory_summary(spark, sf_dir):
    return selection.summary(members(spark, sf_dir)).withColumn("total_gib", F.round("total_gib", 6))


@query(f"WITH {MEMBERS} SELECT archive_filename, member_name, host, size_gib FROM el")
def manifest_eligible(spark, sf_dir):
    return selection.eligible(members(spark, sf_dir)).select("archive_filename", "member_name", "host", "size_gib")


@query(f"WITH {MEMBERS}, g AS (SELECT host, count(DISTINCT archive_date) AS n_dates, sum(CASE WHEN source_type = 'endpoint' THEN size_gib ELSE 0e0 END) AS endpoint_gib, sum(size_gib) AS total_gib FROM el GROUP BY 1) SELECT host, n_dates, endpoint_gib, total_gib, row_number() OVER (ORDER BY n_dates DESC, endpoint_gib DESC, total_gib DESC, md5('42|' || host)) AS rank_number FROM g")
def host_rank(spark, sf_dir):
    return selection.rank_hosts(selection.eligible(members(spark, sf_dir)))


@query(f"WITH {MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY host, archive_date ORDER BY size_gib, member_name) AS k, count(*) OVER (PARTITION BY host, archive_date) AS m FROM el) SELECT host, archive_date, member_name, size_gib FROM r WHERE k = m // 2 + 1")
def manifest_medians(spark, sf_dir):
    return selection.median_members(selection.eligible(members(spark, sf_dir))).select("host", "archive_date", "member_name", "size_gib")


def _chosen(spark, sf_dir):
    return selection.select(selection.eligible(members(spark, sf_dir)), ["h0", "h1", "h2", "h3"], 2.0, 1.5, 2.5)


@query()
def manifest_select(spark, sf_dir):
    return selection.manifest(_chosen(spark, sf_dir))


@query(f"WITH {MEMBERS}, g AS (SELECT host, count(*) AS n_members, string_agg(DISTINCT archive_date, ';' ORDER BY archive_date) AS dates, sum(size_gib) AS total_gib FROM el GROUP BY 1) SELECT host, n_members, dates, total_gib, 100e0 * total_gib / (SELECT sum(total_gib) FROM g) AS share_pct FROM g")
def manifest_by_host(spark, sf_dir):
    return selection.by_host(selection.eligible(members(spark, sf_dir)))


@query(f"WITH {MEMBERS}, g AS (SELECT archive_date, count(*) AS n_members, count(DISTINCT host) AS n_hosts, sum(size_gib) AS total_gib FROM el GROUP BY 1) SELECT archive_date, n_members, n_hosts, total_gib, 100e0 * total_gib / (SELECT sum(total_gib) FROM g) AS share_pct FROM g")
def manifest_by_date(spark, sf_dir):
    return selection.by_date(selection.eligible(members(spark, sf_dir)))


@query()
def manifest_validation(spark, sf_dir):
    return selection.validate(cut(_chosen(spark, sf_dir)), selection.eligible(members(spark, sf_dir)), 1.5, 2.5)


@query("""WITH p AS (SELECT page_id, url, CAST(page_id * 7 % 5 AS BIGINT) AS length FROM pages) SELECT CASE WHEN length = 0 THEN 'no' ELSE 'yes' END AS included, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS total_bytes FROM p GROUP BY 1""")
def intake_ledger(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("raw/x_v1_"), F.col("page_id").cast("string"), F.lit(".json")).alias("path"), (F.col("page_id") * 7 % 5).alias("length"))
    return intake.size_by_source(intake.ledger(found)).groupBy("included").agg(F.sum("n_files").alias("n_files"), F.sum("total_bytes").alias("total_bytes"))


@query("""SELECT concat(substr(CAST(ts AS VARCHAR), 1, 10), '.tar') AS archive_name, event_id + 1 AS line_number, CASE WHEN event_id % 50 = 0 THEN 'json_parse_error' ELSE 'ok' END AS parse_status, CASE WHEN event_id % 50 = 0 THEN 'gen_' || md5(concat(substr(CAST(ts AS VARCHAR), 1, 10), '.tar:ecar/h.json.gz:', event_id + 1))[1:12] ELSE concat('e', event_id) END AS raw_event_id,
CASE WHEN event_id % 50 = 0 THEN '' ELSE event_type END AS action_raw, CASE WHEN event_id % 50 = 0 THEN '' ELSE '2024-01-01T00:00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') END AS timestamp_parsed, CASE WHEN event_id % 50 = 0 THEN '' ELSE concat('10.0.0.', event_id % 9, ':443') END AS object_value_raw, CASE WHEN event_id % 50 = 0 THEN '' ELSE 'dest_ip,dest_port,zz' END AS properties_keys_raw, CASE WHEN event_id % 50 = 0 THEN '' ELSE 'zz' END AS unmapped_property_keys_raw,
row_number() OVER (PARTITION BY substr(CAST(ts AS VARCHAR), 1, 10) ORDER BY event_id) AS file_id FROM events""")
def normalize_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    good = F.format_string('{"id":"e%d","hostname":" h1 ","action":"%s","object":"flow","timestamp":"2024-01-01T02:00:%02d+02:00","properties":{"dest_ip":"10.0.0.%d","dest_port":443,"zz":true}}', "event_id", "event_type", F.col("event_id") % 60, F.col("event_id") % 9)
    lines = e.select(F.concat(F.substring(F.col("ts").cast("string"), 1, 10), F.lit(".tar")).alias("archive_name"), F.lit("ecar/h.json.gz").alias("member_name"), (F.col("event_id") + 1).alias("line_number"), F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(good).alias("line"))
    return normalize(lines).select("archive_name", "line_number", "parse_status", "raw_event_id", "action_raw", "timestamp_parsed", "object_value_raw", "properties_keys_raw", "unmapped_property_keys_raw", "file_id")


MANIFEST_SQL = "SELECT archive_filename, member_name, host, readable, sample_status, CAST(valid_lines AS BIGINT) AS valid_lines, CAST(invalid_lines AS BIGINT) AS invalid_lines, first_time, last_time"


@query(f"WITH {MEMBERS} {MANIFEST_SQL} FROM el WHERE source_type = 'network'")
def manifest_quality(spark, sf_dir):
    """The network members as a manifest, with the inventory's columns on their samples."""
    rows = selection.eligible(members(spark, sf_dir))
    out = selection.with_quality(rows.where("source_type = 'network'").select("archive_filename", "member_name", "host"), rows)
    return out.withColumns({"valid_lines": F.col("valid_lines").cast("long"), "invalid_lines": F.col("invalid_lines").cast("long")})


@query(f"""WITH {EV}, m AS (SELECT coalesce(member_name, '') AS name, count(*) AS n FROM ev GROUP BY 1), a AS (SELECT coalesce(archive_name, '') AS name FROM ev GROUP BY 1),
t AS (SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS r FROM m)
SELECT 'events' AS item, '' AS name, count(*) AS n FROM ev UNION ALL SELECT 'ok', '', count(*) FILTER (WHERE parse_status = 'ok') FROM ev UNION ALL SELECT 'not_ok', '', count(*) FILTER (WHERE parse_status IS DISTINCT FROM 'ok') FROM ev
UNION ALL SELECT 'members', '', count(*) FROM m UNION ALL SELECT 'archives', '', count(*) FROM a
UNION ALL SELECT 'source_type', coalesce(source_type, 'unknown'), count(*) FROM ev WHERE parse_status = 'ok' GROUP BY 2 UNION ALL SELECT 'top_member', name, n FROM t WHERE r <= 10""")
def collection_summary(spark, sf_dir):
    return intake.collection_summary(events(spark, sf_dir))
