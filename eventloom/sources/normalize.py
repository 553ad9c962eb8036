"""From lines of nested JSON to flat events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import event_id, first_filled, let, source_type, strip
from ..functions.times import parse
from ..schema import COLUMNS, MAPPED_KEYS, PROPERTIES

# Keys tried in order for each field.
ALTERNATIVES = {
    "raw_event_id": "id event_id eventId uuid".split(), "timestamp_raw": "timestamp time ts event_time @timestamp".split(), "host_raw": "hostname host host_name computer".split(),
    "action_raw": "action event_type operation".split(), "object_raw": "object object_type objectType".split(),
}


def _text(x: Column) -> Column:
    """A scalar as text: booleans with a capital, null as empty, others as JSON has them."""
    return strip(F.when(x.isNull(), "").when(x == "true", "True").when(x == "false", "False").otherwise(x))


def _value(m: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(""))


def _present(m: Column, keys: list[str]) -> Column:
    """The value of the first key that is there, whatever it is."""
    out = F.lit("")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(m, F.lit(k)), _value(m, k)).otherwise(out)
    return out


def _prefer(m: Column, key: str, keys: list[str]) -> Column:
    """The exact key if it has text, else the first that is there."""
    return let(_value(m, key), lambda x: F.when(x != "", x).otherwise(_present(m, keys)))


def object_value(kind: Column, p: dict[str, Column], fallback: Column) -> Column:
    ip, port = p["dest_ip_raw"], p["dest_port_raw"]
    flow = F.when((ip != "") & (port != ""), F.concat(ip, F.lit(":"), port)).otherwise(first_filled(ip, port))
    of = {
        "FLOW": flow, "FILE": p["file_path_raw"], "MODULE": p["module_path_raw"], "REGISTRY": p["registry_key_raw"], "PROCESS": first_filled(p["command_line_raw"], p["image_path_raw"]),
        "TASK": first_filled(p["task_name_raw"], p["generic_path_raw"]), "SERVICE": p["property_name_raw"], "USER_SESSION": first_filled(p["property_user_raw"], p["logon_id_raw"]), "SHELL": p["shell_payload_raw"],
    }
    out = F.lit("")
    for k, v in of.items():
        out = F.when(kind == k, v).otherwise(out)
    return first_filled(out, fallback)


def normalize(lines: DataFrame) -> DataFrame:
    """Events of lines (archive_name, member_name, line_number, line). Lines that are no JSON give a row with status
    json_parse_error; JSON that is no object and blank lines give none. file_id numbers the rows of an archive."""
    body = F.trim("line")
    rows = lines.where(body != "").withColumn("v", F.try_parse_json(body))
    kind = F.schema_of_variant(F.col("v"))
    rows = rows.withColumn("ok", F.col("v").isNotNull()).where(F.col("v").isNull() | kind.startswith("OBJECT"))
    rows = rows.withColumn("m", F.coalesce(F.try_variant_get("v", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    # texts of both maps are trimmed once, before any of them is looked up
    top = F.transform_values("m", lambda k, x: _text(F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))))
    inner = F.transform_values(F.try_variant_get(F.try_element_at("m", F.lit("properties")), "$", "map<string,string>"), lambda k, x: _text(x))
    rows = rows.withColumns({"t": top, "p": F.coalesce(inner, F.create_map().cast("map<string,string>"))}).withColumn("x", F.explode(F.array(F.struct("t", "p"))))
    m, p = F.col("x.t"), F.col("x.p")
    own = {k: _value(m, key) for k, key in (("actor_id_raw", "actorID"), ("object_id_raw", "objectID"), ("pid_raw", "pid"), ("ppid_raw", "ppid"), ("tid_raw", "tid"), ("principal_raw", "principal"))}
    promoted = {c: _value(p, k) for c, (k, _) in PROPERTIES.items()}
    named = {c: _prefer(m, {"host_raw": "hostname", "action_raw": "action", "object_raw": "object"}[c], ALTERNATIVES[c]) for c in ("host_raw", "action_raw", "object_raw")}
    rows = rows.withColumn("kind", F.upper(named["object_raw"]))
    upper = F.col("kind")
    promoted["service_name_raw"] = F.when(upper == "SERVICE", promoted["property_name_raw"]).otherwise("")
    stamp, given = _present(m, ALTERNATIVES["timestamp_raw"]), _present(m, ALTERNATIVES["raw_event_id"])
    shown = lambda t: F.when(F.date_format(t, "SSSSSS") == "000000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    iso = let(let(stamp, parse), shown)
    keys = F.array_sort(F.map_keys(p))
    values = {
        "raw_event_id": first_filled(given, event_id(F.col("archive_name"), F.col("member_name"), F.col("line_number"))),
        "parse_status": F.when(F.col("ok"), "ok").otherwise("json_parse_error"), "parse_error": F.when(F.col("ok"), "").otherwise("malformed JSON"),
        "timestamp_raw": stamp, "timestamp_parsed": F.coalesce(iso, F.lit("")), **named, "source_type": source_type(F.col("member_name")),
        "user_raw": first_filled(own["principal_raw"], promoted["property_user_raw"]), "process_raw": promoted["image_path_raw"], "parent_process_raw": promoted["parent_image_path_raw"],
        "destination_raw": promoted["dest_ip_raw"], "object_value_raw": object_value(upper, promoted, own["object_id_raw"]), **own, **promoted,
        "properties_keys_raw": F.array_join(keys, ","), "unmapped_property_keys_raw": F.array_join(F.array_except(keys, F.array(*[F.lit(k) for k in MAPPED_KEYS])), ","),
    }
    # numbered within a member, after the rows of the archive's members before it, so that no task sorts a whole archive
    sizes = rows.groupBy("archive_name", "member_name").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("archive_name").orderBy("member_name").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(sizes.select("archive_name", "member_name", F.coalesce(before, F.lit(0)).alias("_before")), ["archive_name", "member_name"])
    order = Window.partitionBy("archive_name", "member_name").orderBy("line_number")
    flat = rows.select((F.row_number().over(order) + F.col("_before")).cast("long").alias("file_id"), "archive_name", "member_name", F.col("line_number").cast("long").alias("line_number"), *[v.alias(c) for c, v in values.items()], F.when(~F.col("ok"), F.substring("line", 1, 300)).alias("error_snippet"))
    return flat.select(*COLUMNS, "error_snippet")
