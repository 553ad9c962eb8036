"""Strings: trimming, missing values, canonical JSON and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "<MISSING>"
MISSING_SCOPE = "<MISSING_HOST_SCOPE>"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    """All white space at both ends, line ends too."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def filled(x: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(x, F.lit(""))


def label(x: Column) -> Column:
    """Upper case without blanks at the ends; MISSING if empty."""
    return F.coalesce(filled(F.upper(F.trim(x))), F.lit(MISSING))


def first_filled(*xs: Column) -> Column:
    return F.coalesce(*[filled(x) for x in xs], F.lit(""))


def json_array(*xs: Column) -> Column:
    """Compact JSON list of strings, the form that ids are hashed from."""
    return F.to_json(F.array(*xs))


def hashed_id(prefix: str, size: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(json_array(*parts), 256), 1, size))


def pattern_id(host: Column, pair: Column) -> Column:
    return hashed_id("pattern_", 24, host, pair)


def scope_token(kind: Column, scope: Column) -> Column:
    """Where a value is unique: everywhere for hosts and destinations, else on a host."""
    return (
        F.when(kind.isin("host", "destination"), json_array(F.lit("global")))
        .when(F.coalesce(scope, F.lit("")).isin("", MISSING_SCOPE), json_array(F.lit("missing_host_scope")))
        .otherwise(json_array(F.lit("host"), scope))
    )


def entity_id(kind: Column, scope: Column, rule: Column, value: Column, version: str = "entity_v1") -> Column:
    return hashed_id("ent_", 32, F.lit(version), kind, scope_token(kind, scope), rule, value)


def event_id(archive: Column, member: Column, line: Column) -> Column:
    return F.concat(F.lit("gen_"), F.substring(F.md5(F.concat_ws(":", archive, member, line.cast("string"))), 1, 12))


def framed(*parts: Column) -> Column:
    """Each part after its length, so that no two lists of parts agree."""
    return F.concat(*[y for p in parts for y in (F.length(p).cast("string"), F.lit(":"), p)])


def observed_chain_key(host: Column, parent: Column, child: Column) -> Column:
    return F.concat(F.lit("chain_"), F.substring(F.sha2(framed(host, F.concat(F.lit("parent_normalized:"), parent), child), 256), 1, 32))


def chain_id(host: Column, kind: Column, nodes: Column, rule: str = "chain_v1") -> Column:
    """Of the JSON list [rule, host, kind, [nodes]]."""
    head = F.to_json(F.array(F.lit(rule), host, kind))
    text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), F.to_json(nodes), F.lit("]"))
    return F.concat(F.lit("pch_"), F.substring(F.sha2(text, 256), 1, 32))


def cell(**fields: Column) -> Column:
    """A compact JSON object with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


# Words of a member's name that tell its kind, in the order tried.
SOURCES = (("ground_truth", r"ground.?truth|label"), ("network", r"flow|network|zeek|bro|net"), ("endpoint", r"ecar|host|process|endpoint"))


def source_type(name: Column) -> Column:
    out = F.lit("unknown")
    for kind, pattern in reversed(SOURCES):
        out = F.when(F.lower(name).rlike(pattern), kind).otherwise(out)
    return out


def host_token(name: Column) -> Column:
    return F.coalesce(filled(F.regexp_extract(name, r"(?i)(sysclient\d+|host[\w-]*|client[\w-]*|dc\d+)", 1)), F.lit("unknown"))


def date_token(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)


def storage_priority(gigabytes: Column) -> Column:
    return F.when(gigabytes < 70, "high").when(gigabytes <= 100, "medium").otherwise("low")
