"""Queries over behaviour: baselines, deviations, lineage and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline, entities, lineage
from ..state import cut
from .adapter import EV, HOUR, PERIODS, events
from .common import Registry
from .structure import COMMAND_SQL, DEST_SQL, GROUP_SQL, PATH_SQL, T9, WINDOWS_SQL

_r = Registry()
query, QUERIES, ORACLES = _r.query, _r.queries, _r.oracles

# DuckDB: b has the timed events with ids, c the core aggregate.
_D = "(SELECT raw_value, canonical_id, entity_status, host_if_applicable FROM t9 WHERE entity_type = '{0}')"
B = (
    f"b AS (SELECT pe.*, {GROUP_SQL.format('object_raw')} AS semantic_group, h.canonical_id AS host_id, u.canonical_id AS user_id FROM pe LEFT JOIN {_D.format('host')} h ON h.raw_value = pe.host_raw "
    f"LEFT JOIN {_D.format('user_principal')} u ON u.raw_value = pe.user_raw AND u.host_if_applicable = coalesce(nullif(pe.host_raw, ''), '<MISSING_HOST_SCOPE>')), "
    "c AS (SELECT period_role, window_start, archive_date, hour, host_id, user_id, semantic_group, count(*) AS n, count(*) FILTER (WHERE host_id IS NULL) AS unmapped_hosts, count(*) FILTER (WHERE user_id IS NULL) AS unmapped_users FROM b GROUP BY ALL)"
)
_PN = "CASE WHEN " + WINDOWS_SQL.format("parent_image_path_raw") + " THEN replace(parent_image_path_raw, '/', chr(92)) ELSE parent_image_path_raw END"
_FRAME = "length({0})::VARCHAR || ':' || {0}"
P = (
    f"p0 AS (SELECT b.*, q.canonical_id AS process_id, {_PN} AS parent_normalized, CASE WHEN parent_image_path_raw = '' THEN 'missing' WHEN {WINDOWS_SQL.format('parent_image_path_raw')} THEN 'normalized' ELSE 'literal' END AS parent_status FROM b LEFT JOIN {_D.format('process')} q ON q.raw_value = b.image_path_raw AND q.host_if_applicable = coalesce(nullif(b.host_raw, ''), '<MISSING_HOST_SCOPE>') WHERE upper(trim(object_raw)) = 'PROCESS'), "
    f"p1 AS (SELECT *, CASE WHEN parent_image_path_raw <> '' AND process_id IS NOT NULL AND host_id IS NOT NULL THEN 'chain_' || sha256({_FRAME.format('host_id')} || {_FRAME.format(chr(40) + repr('parent_normalized:') + ' || parent_normalized' + chr(41))} || {_FRAME.format('process_id')})[1:32] END AS chain_key, row_number() OVER (ORDER BY event_time, archive_name, member_name, line_number, raw_event_id) AS k FROM p0), "
    "p AS (SELECT period_role, window_start, host_id, user_id, process_id, parent_normalized, parent_status, chain_key, count(*) AS n, arg_min(raw_event_id, k) AS example_id FROM p1 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8)"
)
FD = (
    f"f AS (SELECT period_role, window_start, host_id, {PATH_SQL.format('file_path_raw')} AS path_category, count(*) AS n FROM b WHERE upper(trim(object_raw)) = 'FILE' GROUP BY 1, 2, 3, 4), "
    f"d AS (SELECT period_role, window_start, host_id, q.canonical_id AS destination_id, {DEST_SQL.format('dest_ip_raw')} AS destination_category, count(*) AS n FROM b LEFT JOIN {_D.format('destination')} q ON q.raw_value = b.dest_ip_raw WHERE upper(trim(object_raw)) = 'FLOW' GROUP BY 1, 2, 3, 4, 5)"
)
WITH = f"WITH {EV}, {T9}, {B}, {P}, {FD}"


def _all(spark: SparkSession, sf_dir: str):
    """Prepared events and the dictionary, which is written once as all stages join it."""
    e = events(spark, sf_dir)
    d = cut(entities.t9(e))
    return baseline.prepared(e, d, PERIODS, HOUR), d


def _core(spark, sf_dir) -> DataFrame:
    return cut(baseline.core(_all(spark, sf_dir)[0]))


def _processes(spark, sf_dir) -> DataFrame:
    return cut(baseline.processes(*_all(spark, sf_dir)))


def _aggregates(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four compact aggregates that profiles and deviations are made from."""
    e, d = _all(spark, sf_dir)
    e = cut(e.select(baseline.READ))  # joined with the dictionary once
    return cut(baseline.core(e)), cut(baseline.processes(e, d)), cut(baseline.files(e)), cut(baseline.destinations(e, d))


@query(f"{WITH} SELECT * FROM c")
def core_agg(spark, sf_dir):
    return _core(spark, sf_dir)


@query(f"{WITH} SELECT * FROM p")
def process_agg(spark, sf_dir):
    return _processes(spark, sf_dir).withColumn("example_id", F.col("evidence.raw_event_id")).drop("evidence")


@query(f"{WITH} SELECT * FROM f")
def file_agg(spark, sf_dir):
    return baseline.files(_all(spark, sf_dir)[0])


@query(f"{WITH} SELECT * FROM d")
def destination_agg(spark, sf_dir):
    return baseline.destinations(*_all(spark, sf_dir))


@query(f"{WITH} SELECT window_start, host_id, array_to_string(list(raw_event_id ORDER BY event_time, archive_name, member_name, line_number, raw_event_id)[1:20], ',') AS evidence_ids FROM b WHERE period_role = 'evaluation' GROUP BY 1, 2")
def evaluation_evidence(spark, sf_dir):
    return baseline.evidence(_all(spark, sf_dir)[0]).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


def _top_sql(rows: str, entity: str, item: str, n: int) -> str:
    return f"{WITH}, g AS (SELECT {entity}, {item}, CAST(sum(n) AS BIGINT) AS n FROM {rows} WHERE period_role = 'verified_benign' AND {entity} IS NOT NULL AND {item} IS NOT NULL GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {entity} ORDER BY n DESC, {item}) AS rank_number FROM g) WHERE rank_number <= {n}"


@query(_top_sql("p", "host_id", "process_id", 10))
def host_top_processes(spark, sf_dir):
    return baseline.top_benign(_processes(spark, sf_dir), "host_id", "process_id", 10)


@query(_top_sql("p", "host_id", "chain_key", 10))
def host_top_chains(spark, sf_dir):
    return baseline.top_benign(_processes(spark, sf_dir), "host_id", "chain_key", 10)


@query(_top_sql("c", "host_id", "semantic_group", 5))
def host_top_semantic(spark, sf_dir):
    return baseline.top_benign(_core(spark, sf_dir), "host_id", "semantic_group", 5)


@query(_top_sql("f", "host_id", "path_category", 5))
def host_top_paths(spark, sf_dir):
    return baseline.top_benign(baseline.files(_all(spark, sf_dir)[0]), "host_id", "path_category", 5)


@query(_top_sql("p", "user_id", "process_id", 10))
def user_top_processes(spark, sf_dir):
    return baseline.top_benign(_processes(spark, sf_dir), "user_id", "process_id", 10)


HOURS = "hr AS (SELECT host_id, hour, count(DISTINCT archive_date) AS n_dates FROM c WHERE period_role = 'verified_benign' AND host_id IS NOT NULL GROUP BY 1, 2), hd AS (SELECT host_id, count(DISTINCT archive_date) AS all_dates FROM c WHERE period_role = 'verified_benign' AND host_id IS NOT NULL GROUP BY 1), ah AS (SELECT host_id, hour, n_dates FROM hr JOIN hd USING (host_id) WHERE n_dates >= ceil(all_dates / 2e0))"


@query(f"{WITH}, {HOURS} SELECT * FROM ah")
def active_hours(spark, sf_dir):
    return baseline.active_hours(_core(spark, sf_dir), "host_id")


@query(f"{WITH}, a AS (SELECT host_id, count(DISTINCT archive_date) AS n_dates, count(DISTINCT window_start) AS n_windows, CAST(sum(n) AS BIGINT) AS n_events FROM c WHERE period_role = 'verified_benign' AND host_id IS NOT NULL GROUP BY 1) SELECT *, CASE WHEN n_dates >= 5 AND n_windows / 552e0 >= 0.5e0 THEN 'high' WHEN n_dates >= 3 AND n_windows / 552e0 >= 0.2e0 THEN 'medium' ELSE 'low' END AS confidence FROM a")
def baseline_confidence(spark, sf_dir):
    return baseline.activity(_core(spark, sf_dir), "host_id", baseline.possible_windows(PERIODS, HOUR))


@query(f"{WITH} SELECT DISTINCT user_id, host_id FROM c WHERE period_role = 'evaluation' AND user_id IS NOT NULL AND host_id IS NOT NULL AND (user_id, host_id) NOT IN (SELECT (user_id, host_id) FROM c WHERE period_role = 'verified_benign' AND user_id IS NOT NULL AND host_id IS NOT NULL)".replace("NOT IN (SELECT (user_id, host_id)", "NOT IN (SELECT row(user_id, host_id)").replace("AND (user_id, host_id) NOT", "AND row(user_id, host_id) NOT"))
def new_hosts_per_user(spark, sf_dir):
    return baseline.new_hosts(_core(spark, sf_dir))


def _new_sql(rows: str, item: str, name: str) -> str:
    return f"{name} AS (SELECT window_start, host_id, count(DISTINCT {item}) AS {name} FROM {rows} x WHERE period_role = 'evaluation' AND host_id IS NOT NULL AND {item} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {rows} y WHERE y.period_role = 'verified_benign' AND y.host_id = x.host_id AND y.{item} = x.{item}) GROUP BY 1, 2)"


NEW = ", ".join(_new_sql(*x) for x in (("p", "process_id", "new_processes"), ("p", "chain_key", "new_chains"), ("d", "destination_id", "new_destinations"), ("f", "path_category", "new_path_categories")))


@query(f"{WITH}, {NEW} SELECT window_start, host_id, new_destinations AS n_new FROM new_destinations")
def new_entities_by_window(spark, sf_dir):
    return baseline.new_by_window(baseline.destinations(*_all(spark, sf_dir)), "destination_id")


JSD = """ce AS (SELECT window_start, host_id, semantic_group, sum(n) AS x FROM c WHERE period_role = 'evaluation' AND host_id IS NOT NULL GROUP BY 1, 2, 3), cb AS (SELECT host_id, semantic_group, sum(n) AS y FROM c WHERE period_role = 'verified_benign' AND host_id IS NOT NULL GROUP BY 1, 2),
un AS (SELECT window_start, host_id, semantic_group, x, 0 AS y FROM ce UNION ALL SELECT w.window_start, cb.host_id, semantic_group, 0, y FROM (SELECT DISTINCT window_start, host_id FROM ce) w JOIN cb USING (host_id)),
ag AS (SELECT window_start, host_id, semantic_group, sum(x) AS x, sum(y) AS y FROM un GROUP BY 1, 2, 3), sh AS (SELECT *, CAST(x AS DOUBLE) / sum(x) OVER w AS p, CASE WHEN sum(y) OVER w > 0 THEN CAST(y AS DOUBLE) / sum(y) OVER w END AS q FROM ag WINDOW w AS (PARTITION BY window_start, host_id)),
js AS (SELECT window_start, host_id, CASE WHEN count(q) = 0 THEN 1e0 ELSE least(1e0, greatest(0e0, sum(CASE WHEN p > 0 THEN 0.5e0 * p * log2(p / ((p + q) / 2)) ELSE 0e0 END + CASE WHEN q > 0 THEN 0.5e0 * q * log2(q / ((p + q) / 2)) ELSE 0e0 END))) END AS jsd FROM sh GROUP BY 1, 2)"""


@query(f"{WITH}, {JSD} SELECT window_start, host_id, round(jsd, 9) AS jsd FROM js")
def jsd_by_window(spark, sf_dir):
    return baseline.semantic_divergence(_core(spark, sf_dir)).withColumn("jsd", F.round("jsd", 9))


@query(f"""{WITH}, {HOURS}, {NEW}, {JSD}, w AS (SELECT window_start, host_id, CAST(sum(n) AS BIGINT) AS n_events, min(hour) AS hour FROM c WHERE period_role = 'evaluation' AND host_id IS NOT NULL GROUP BY 1, 2),
j AS (SELECT window_start, host_id, n_events, coalesce(new_processes, 0) AS new_processes, coalesce(new_chains, 0) AS new_chains, coalesce(new_destinations, 0) AS new_destinations, coalesce(new_path_categories, 0) AS new_path_categories, ah.hour IS NULL AS unusual_hour, jsd FROM w LEFT JOIN new_processes USING (window_start, host_id) LEFT JOIN new_chains USING (window_start, host_id) LEFT JOIN new_destinations USING (window_start, host_id) LEFT JOIN new_path_categories USING (window_start, host_id) LEFT JOIN ah ON ah.host_id = w.host_id AND ah.hour = w.hour LEFT JOIN js USING (window_start, host_id))
SELECT window_start, host_id, n_events, new_processes, new_chains, new_destinations, new_path_categories, unusual_hour, round(jsd, 9) AS jsd, round(((new_processes > 0)::INT + (new_chains > 0)::INT + (new_destinations > 0)::INT + (new_path_categories > 0)::INT + unusual_hour::INT + jsd) / 6, 9) AS deviation_score FROM j""")
def deviation_t13(spark, sf_dir):
    out = baseline.t13(*_aggregates(spark, sf_dir))
    return out.withColumns({"jsd": F.round("jsd", 9), "deviation_score": F.round("deviation_score", 9)})


@query()
def host_profile_t11(spark, sf_dir):
    return baseline.t11(*_aggregates(spark, sf_dir), baseline.possible_windows(PERIODS, HOUR))


@query()
def user_profile_t12(spark, sf_dir):
    c, p, _, _ = _aggregates(spark, sf_dir)
    return baseline.t12(c, p, baseline.possible_windows(PERIODS, HOUR))


def _cmp(x: str) -> str:
    return f"CASE WHEN {WINDOWS_SQL.format(x)} THEN lower(replace({x}, '/', chr(92))) ELSE {x} END"


LINEAGE = (
    f"s AS (SELECT b.*, {_cmp('image_path_raw')} AS child_cmp, {_cmp('parent_image_path_raw')} AS parent_cmp, cq.canonical_id AS child_id, pq.canonical_id AS parent_id, CASE WHEN cq.entity_status = 'resolved' AND pq.entity_status = 'resolved' THEN 'resolved' ELSE 'unresolved' END AS mapping FROM b "
    f"LEFT JOIN {_D.format('process')} cq ON cq.raw_value = b.image_path_raw AND cq.host_if_applicable = coalesce(nullif(b.host_raw, ''), '<MISSING_HOST_SCOPE>') LEFT JOIN {_D.format('process')} pq ON pq.raw_value = b.parent_image_path_raw AND pq.host_if_applicable = coalesce(nullif(b.host_raw, ''), '<MISSING_HOST_SCOPE>') WHERE upper(trim(object_raw)) = 'PROCESS'), "
    "sk AS (SELECT *, row_number() OVER (ORDER BY event_time, archive_name, member_name, line_number, raw_event_id) AS k FROM s), "
    "eg AS (SELECT period_role, window_start, host_id, parent_cmp, child_cmp, count(*) AS n, min(event_time) AS first_time, max(event_time) AS last_time, min(k) AS k, arg_min(mapping, k) AS mapping, arg_min(raw_event_id, k) AS example_id FROM sk WHERE host_id IS NOT NULL AND parent_cmp <> '' AND child_cmp <> '' GROUP BY 1, 2, 3, 4, 5), "
    "dg AS (SELECT period_role, window_start, host_id, parent_cmp, count(*) - 1 AS more FROM eg GROUP BY 1, 2, 3, 4), re AS (SELECT eg.*, more FROM eg JOIN dg USING (period_role, window_start, host_id, parent_cmp) WHERE parent_cmp <> child_cmp), "
)
_J = "JOIN re {1} ON {1}.period_role = {0}.period_role AND {1}.window_start = {0}.window_start AND {1}.host_id = {0}.host_id AND {1}.parent_cmp = {0}.child_cmp"
CHAINS = LINEAGE + (
    "ch AS (SELECT period_role, window_start, host_id, [parent_cmp, child_cmp] AS nodes, n, more AS ambiguity, mapping, first_time, last_time FROM re "
    f"UNION ALL SELECT a.period_role, a.window_start, a.host_id, [a.parent_cmp, a.child_cmp, x.child_cmp], 1, a.more + x.more, CASE WHEN a.mapping = 'resolved' AND x.mapping = 'resolved' THEN 'resolved' ELSE 'unresolved' END, least(a.first_time, x.first_time), greatest(a.last_time, x.last_time) FROM re a {_J.format('a', 'x')} WHERE x.child_cmp <> a.parent_cmp "
    f"UNION ALL SELECT a.period_role, a.window_start, a.host_id, [a.parent_cmp, a.child_cmp, x.child_cmp, y.child_cmp], 1, a.more + x.more + y.more, CASE WHEN a.mapping = 'resolved' AND x.mapping = 'resolved' AND y.mapping = 'resolved' THEN 'resolved' ELSE 'unresolved' END, least(a.first_time, x.first_time, y.first_time), greatest(a.last_time, x.last_time, y.last_time) FROM re a {_J.format('a', 'x')} {_J.format('x', 'y')} WHERE x.child_cmp <> a.parent_cmp AND y.child_cmp NOT IN (a.parent_cmp, a.child_cmp) "
    f"UNION ALL SELECT a.period_role, a.window_start, a.host_id, [a.parent_cmp, a.child_cmp, x.child_cmp, y.child_cmp, z.child_cmp], 1, a.more + x.more + y.more + z.more, CASE WHEN a.mapping = 'resolved' AND x.mapping = 'resolved' AND y.mapping = 'resolved' AND z.mapping = 'resolved' THEN 'resolved' ELSE 'unresolved' END, least(a.first_time, x.first_time, y.first_time, z.first_time), greatest(a.last_time, x.last_time, y.last_time, z.last_time) FROM re a {_J.format('a', 'x')} {_J.format('x', 'y')} {_J.format('y', 'z')} WHERE x.child_cmp <> a.parent_cmp AND y.child_cmp NOT IN (a.parent_cmp, a.child_cmp) AND z.child_cmp NOT IN (a.parent_cmp, a.child_cmp, x.child_cmp)), "
    "cw AS (SELECT *, CAST(len(nodes) AS BIGINT) AS length, CASE WHEN len(nodes) = 2 THEN 'observed_same_event' ELSE 'inferred_path_composition' END AS construction, array_to_string(nodes, ' -> ') AS chain, 'pch_' || sha256(rtrim(to_json(['chain_v1', host_id, CASE WHEN len(nodes) = 2 THEN 'observed_same_event' ELSE 'inferred_path_composition' END])::VARCHAR, ']') || ',' || to_json(nodes)::VARCHAR || ']')[1:32] AS chain_id FROM ch), "
    "bo AS (SELECT host_id, chain_id, CAST(coalesce(sum(n) FILTER (WHERE period_role = 'verified_benign'), 0) AS BIGINT) AS benign_count, CAST(coalesce(sum(n) FILTER (WHERE period_role = 'evaluation'), 0) AS BIGINT) AS evaluation_count FROM cw GROUP BY 1, 2)"
)
LW = f"WITH {EV}, {T9}, {B}, "


def _scan(spark, sf_dir) -> DataFrame:
    return lineage.process_scan(*_all(spark, sf_dir))


def _chains(spark, sf_dir) -> DataFrame:
    return cut(lineage.chains(cut(lineage.edges(_scan(spark, sf_dir)))))


@query(f"{LW}{LINEAGE.rstrip(', ')} SELECT period_role, window_start, host_id, parent_cmp, child_cmp, n, first_time, last_time, mapping, example_id FROM eg")
def observed_edges(spark, sf_dir):
    return lineage.edges(_scan(spark, sf_dir)).select("period_role", "window_start", "host_id", "parent_cmp", "child_cmp", "n", "first_time", "last_time", "e.mapping", F.col("e.raw_event_id").alias("example_id"))


@query(f"{LW}{LINEAGE.rstrip(', ')} SELECT period_role, window_start, host_id, parent_cmp, child_cmp, array_to_string(list(raw_event_id ORDER BY k)[1:20], ',') AS evidence_ids FROM sk WHERE host_id IS NOT NULL AND parent_cmp <> '' AND child_cmp <> '' GROUP BY 1, 2, 3, 4, 5")
def edge_evidence(spark, sf_dir):
    return lineage.edge_evidence(_scan(spark, sf_dir)).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query(f"{LW}{LINEAGE.rstrip(', ')} SELECT count(*) AS n_process_events, count(*) FILTER (WHERE host_id IS NULL) AS unmapped_host, count(*) FILTER (WHERE parent_image_path_raw = '') AS missing_parent, count(*) FILTER (WHERE image_path_raw = '') AS missing_child, count(*) FILTER (WHERE image_path_raw = '' AND parent_image_path_raw = '') AS missing_both, count(*) FILTER (WHERE image_path_raw <> '' AND child_id IS NULL) AS unmapped_child, count(*) FILTER (WHERE parent_image_path_raw <> '' AND parent_id IS NULL) AS unmapped_parent, count(*) FILTER (WHERE parent_cmp = child_cmp AND image_path_raw <> '') AS self_loops FROM s")
def missing_links(spark, sf_dir):
    return lineage.missing_links(_scan(spark, sf_dir))


@query(f"{LW.rstrip(', ')} SELECT period_role, count(*) AS n_events, count(*) FILTER (WHERE upper(trim(object_raw)) = 'PROCESS') AS n_process_events FROM b GROUP BY 1")
def period_counts(spark, sf_dir):
    return lineage.period_counts(_all(spark, sf_dir)[0])


@query(f"{LW}{CHAINS} SELECT period_role, window_start, host_id, chain, chain_id, length, construction, n, ambiguity, mapping, first_time, last_time FROM cw")
def process_chains(spark, sf_dir):
    return _chains(spark, sf_dir).select("period_role", "window_start", "host_id", "chain", "chain_id", "length", "construction", "n", "ambiguity", "mapping", "first_time", "last_time")


NEXT = "sp AS (SELECT host_id, nodes[1] AS parent_cmp, nodes[2] AS next_process, CAST(sum(n) AS BIGINT) AS support FROM cw WHERE period_role = 'verified_benign' AND length = 2 GROUP BY 1, 2, 3), np AS (SELECT host_id, parent_cmp, next_process, support, CAST(support AS DOUBLE) / total AS next_share FROM (SELECT *, sum(support) OVER (PARTITION BY host_id, parent_cmp) AS total, row_number() OVER (PARTITION BY host_id, parent_cmp ORDER BY support DESC, next_process) AS k FROM sp) WHERE k = 1)"


@query(f"{LW}{CHAINS}, {NEXT} SELECT * FROM np")
def next_process(spark, sf_dir):
    return lineage.next_process(_chains(spark, sf_dir))


@query(f"{LW}{CHAINS} SELECT host_id, chain_id, row_number() OVER (ORDER BY benign_count DESC, chain_id, host_id) AS benign_rank FROM bo WHERE benign_count > 0")
def benign_rank(spark, sf_dir):
    c = _chains(spark, sf_dir).groupBy("host_id", "chain_id").agg(F.sum(F.when(F.col("period_role") == "verified_benign", F.col("n")).otherwise(0)).alias("benign_count"))
    return lineage.benign_rank(c)


T14 = f"""{CHAINS}, {NEXT}, a AS (SELECT period_role, host_id, chain_id, CAST(sum(n) AS BIGINT) AS n, min(first_time) AS first_time, max(last_time) AS last_time, max(ambiguity) AS max_ambiguity, count(*) AS n_windows, arg_min(chain, window_start) AS chain, arg_min(nodes, window_start) AS nodes, arg_min(length, window_start) AS length, arg_min(construction, window_start) AS construction, arg_min(mapping, window_start) AS mapping FROM cw GROUP BY 1, 2, 3),
t14 AS (SELECT a.*, benign_count, evaluation_count, next_process, support, next_share, CASE WHEN mapping = 'unresolved' THEN 'unresolved_mapping' WHEN construction = 'inferred_path_composition' AND benign_count = 0 THEN 'inferred_chain_only' WHEN benign_count = 0 THEN 'unseen_in_verified_benign' WHEN benign_count <= 5 THEN 'rare_in_verified_benign' ELSE 'common_in_verified_benign' END AS novelty FROM a JOIN bo USING (host_id, chain_id) LEFT JOIN np ON np.host_id = a.host_id AND np.parent_cmp = a.nodes[-1])"""


@query(f"{LW}{T14} SELECT period_role, host_id, chain_id, chain, length, construction, mapping, n, first_time, last_time, max_ambiguity, n_windows, benign_count, evaluation_count, next_process, support, next_share, novelty FROM t14")
def chain_frequency_t14(spark, sf_dir):
    return lineage.t14(_chains(spark, sf_dir)).select("period_role", "host_id", "chain_id", "chain", "length", "construction", "mapping", "n", "first_time", "last_time", "max_ambiguity", "n_windows", "benign_count", "evaluation_count", "next_process", "support", "next_share", "novelty")


@query(f"{LW}{T14}, z AS (SELECT host_id, chain_id, novelty FROM t14 WHERE period_role = 'evaluation' AND novelty NOT IN ('unresolved_mapping', 'common_in_verified_benign')) SELECT window_start, cw.host_id, novelty, count(*) AS n_chains FROM cw JOIN z ON z.host_id = cw.host_id AND z.chain_id = cw.chain_id WHERE period_role = 'evaluation' GROUP BY 1, 2, 3")
def chain_novelty_f8(spark, sf_dir):
    w = _chains(spark, sf_dir)
    return lineage.chain_novelty(lineage.t14(w), w)


COMMANDS = f"{LINEAGE}cc AS (SELECT {COMMAND_SQL.format('command_line_raw')} AS command, CASE WHEN command_line_raw = '' THEN 'insufficient_or_missing_command' ELSE 'normalized_v1' END AS status, count(*) FILTER (WHERE period_role = 'verified_benign') AS benign_count, count(*) FILTER (WHERE period_role = 'evaluation') AS evaluation_count FROM s GROUP BY 1, 2)"
KNOWN = f"{COMMANDS}, kb AS (SELECT command, CAST(sum(CASE WHEN command <> '' THEN benign_count ELSE 0 END) AS BIGINT) AS benign_count, CAST(sum(CASE WHEN command <> '' THEN evaluation_count ELSE 0 END) AS BIGINT) AS evaluation_count FROM cc GROUP BY 1), v AS (SELECT *, {COMMAND_SQL.format('command_line_raw')} AS command FROM s WHERE period_role = 'evaluation')"


@query(f"{LW}{COMMANDS} SELECT *, CASE WHEN command = '' THEN 'insufficient_or_missing_command' WHEN benign_count = 0 THEN 'unseen_in_verified_benign' WHEN benign_count <= 5 THEN 'rare_in_verified_benign' ELSE 'common_in_verified_benign' END AS novelty FROM cc")
def command_novelty(spark, sf_dir):
    return lineage.command_novelty(lineage.command_counts(_scan(spark, sf_dir)))


@query(f"{LW}{COMMANDS} SELECT status, CAST(sum(benign_count + evaluation_count) AS BIGINT) AS n FROM cc GROUP BY 1")
def command_status(spark, sf_dir):
    return lineage.command_status(lineage.command_counts(_scan(spark, sf_dir)))


@query(f"{LW}{KNOWN} SELECT event_time, archive_name, member_name, line_number, raw_event_id, v.host_id, v.command, benign_count AS benign_command_count, evaluation_count AS evaluation_command_count FROM v JOIN kb USING (command) WHERE v.command = '' OR benign_count <= 5 ORDER BY event_time, archive_name, member_name, line_number, raw_event_id LIMIT 200")
def unusual_commands(spark, sf_dir):
    found = lineage.unusual_commands(cut(_scan(spark, sf_dir)), limit=200)
    return found.select("event_time", "archive_name", "member_name", "line_number", "raw_event_id", "host_id", "command", "benign_command_count", "evaluation_command_count")


@query(f"{LW}{KNOWN} SELECT v.host_id, window_start, count(*) AS command_novelty_count FROM v JOIN kb USING (command) WHERE v.command <> '' AND benign_count <= 5 GROUP BY 1, 2")
def command_novelty_f8(spark, sf_dir):
    return lineage.command_windows(cut(_scan(spark, sf_dir)))


@query()
def evidence_t15(spark, sf_dir):
    s = cut(_scan(spark, sf_dir))
    return lineage.t15(cut(lineage.chains(cut(lineage.edges(s)))), s)


@query(f"{LW}{T14} SELECT period_role, construction, novelty, count(*) AS n_chains, CAST(sum(n) AS BIGINT) AS n FROM t14 GROUP BY 1, 2, 3")
def chain_summary(spark, sf_dir):
    return lineage.chain_summary(lineage.t14(_chains(spark, sf_dir)))


@query()
def rulebook_d2(spark, sf_dir):
    return lineage.rulebook(spark)
