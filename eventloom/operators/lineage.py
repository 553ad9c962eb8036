"""Process lineage: observed edges, chains of two to five processes, next processes and command lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import commands, paths
from ..functions.text import chain_id, first_filled
from ..schema import LOCATOR
from .entities import attach
from .relational import BENIGN, EVALUATION, earliest, first_k, global_rank

LONGEST, RARE, EXAMPLES, UNUSUAL, EVIDENCE = 5, 5, 10, 1000, 20
# How a chain is known, and how its links are.
OBSERVED, INFERRED = "observed_same_event", "inferred_path_composition"
LINKS = {OBSERVED: "observed", INFERRED: "inferred_not_causal"}
GROUND_TRUTH = "not_evaluated_eda10"
#: Attributes of the event that stands for an edge.
SHOWN = ["parent_show", "child_show", "mapping", "command_line_raw", "actor_id_raw", "object_id_raw", "pid_raw", "ppid_raw"]


def process_scan(e: DataFrame, dictionary: DataFrame) -> DataFrame:
    """PROCESS events with parent and child: raw, comparison form, canonical id and whether both ends resolve."""
    p = e.where(F.upper(F.trim("object_raw")) == "PROCESS")
    p = p.withColumns({"child": first_filled(F.col("image_path_raw"), F.col("process_raw")), "parent": first_filled(F.col("parent_image_path_raw"), F.col("parent_process_raw"))})
    p = p.withColumns({"child_cmp": paths.comparison(F.col("child")), "parent_cmp": paths.comparison(F.col("parent")), "child_show": paths.display(F.col("child")), "parent_show": paths.display(F.col("parent"))})
    p = attach(attach(p, dictionary, "process", F.col("child"), "child_id"), dictionary, "process", F.col("parent"), "parent_id")
    both = (F.col("child_id_status") == "resolved") & (F.col("parent_id_status") == "resolved")
    return p.withColumn("mapping", F.when(F.coalesce(both, F.lit(False)), "resolved").otherwise("unresolved"))


def edges(scan: DataFrame) -> DataFrame:
    """Of each role, window and host, the parents and children seen: count, span, first attributes."""
    some = scan.where(F.col("host_id").isNotNull() & (F.col("parent_cmp") != "") & (F.col("child_cmp") != ""))
    return some.groupBy("period_role", "window_start", "host_id", "parent_cmp", "child_cmp").agg(
        F.count("*").alias("n"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"),
        earliest([*LOCATOR, *[c for c in SHOWN if c in scan.columns]], LOCATOR).alias("e"),
    )


def edge_evidence(scan: DataFrame, k: int = 20) -> DataFrame:
    some = scan.where(F.col("host_id").isNotNull() & (F.col("parent_cmp") != "") & (F.col("child_cmp") != ""))
    return first_k(some, ["period_role", "window_start", "host_id", "parent_cmp", "child_cmp"], LOCATOR, k, "raw_event_id", "evidence_ids")


def missing_links(scan: DataFrame) -> DataFrame:
    """Eight counts of what keeps events out of the edges."""
    c = F.col
    return scan.agg(
        F.count("*").alias("n_process_events"), F.count_if(c("host_id").isNull()).alias("unmapped_host"), F.count_if(c("parent") == "").alias("missing_parent"), F.count_if(c("child") == "").alias("missing_child"),
        F.count_if((c("parent") == "") & (c("child") == "")).alias("missing_both"), F.count_if((c("child") != "") & c("child_id").isNull()).alias("unmapped_child"),
        F.count_if((c("parent") != "") & c("parent_id").isNull()).alias("unmapped_parent"), F.count_if((c("parent_cmp") == c("child_cmp")) & (c("child") != "")).alias("self_loops"),
    )


def period_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("period_role").agg(F.count("*").alias("n_events"), F.count_if(F.upper(F.trim("object_raw")) == "PROCESS").alias("n_process_events"))


def chains(found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Simple paths of 2 to `longest` nodes within a role, window and host: nodes, n (events of an edge; 1 for a longer path), ambiguity, mapping, e.

    Each step is an equi-join of the paths' last node with edges, so it shuffles by (role, window, host, node)."""
    keys = ["period_role", "window_start", "host_id"]
    real = found.where("parent_cmp <> child_cmp")
    out_degree = found.groupBy(*keys, "parent_cmp").agg((F.count("*") - 1).alias("more"))
    real = real.join(out_degree, [*keys, "parent_cmp"])
    step = real.select(*keys, F.col("parent_cmp").alias("last"), F.col("child_cmp").alias("next"), F.col("more").alias("next_more"), F.col("e.mapping").alias("next_mapping"), F.col("e").alias("next_e"), F.col("first_time").alias("next_first"), F.col("last_time").alias("next_last"))
    path = real.select(*keys, F.array("parent_cmp", "child_cmp").alias("nodes"), F.col("child_cmp").alias("last"), F.col("n").alias("n"), F.col("more").alias("ambiguity"), F.col("e.mapping").alias("mapping"), "e", "first_time", "last_time")
    made = [path]
    for _ in range(longest - 2):
        path = path.join(step, [*keys, "last"]).where(~F.array_contains("nodes", F.col("next"))).select(
            *keys, F.concat("nodes", F.array("next")).alias("nodes"), F.col("next").alias("last"), F.lit(1).cast("long").alias("n"), (F.col("ambiguity") + F.col("next_more")).alias("ambiguity"),
            F.when((F.col("mapping") == "resolved") & (F.col("next_mapping") == "resolved"), "resolved").otherwise("unresolved").alias("mapping"),
            F.when(_before("next_e", "e"), F.col("next_e")).otherwise(F.col("e")).alias("e"),
            F.least("first_time", "next_first").alias("first_time"), F.greatest("last_time", "next_last").alias("last_time"),
        )
        made.append(path)
    out = reduce(DataFrame.unionByName, made).drop("last")
    kind = F.when(F.size("nodes") == 2, OBSERVED).otherwise(INFERRED)
    return out.withColumns({"length": F.size("nodes").cast("long"), "construction": kind, "chain": F.array_join("nodes", " -> "), "chain_id": chain_id(F.col("host_id"), kind, F.col("nodes"))})


def _before(a: str, b: str) -> Column:
    """Whether the locator of struct a sorts before that of b."""
    at = lambda s: F.struct(*[y for c in LOCATOR for y in (F.col(f"{s}.{c}").isNull().alias(f"_{c}"), F.col(f"{s}.{c}").alias(c))])
    return at(a) < at(b)


def novelty(mapping: Column, construction: Column, benign: Column, rare: int = RARE) -> Column:
    return (
        F.when(mapping == "unresolved", "unresolved_mapping").when((construction == INFERRED) & (benign == 0), "inferred_chain_only")
        .when(benign == 0, "unseen_in_verified_benign").when(benign <= rare, "rare_in_verified_benign").otherwise("common_in_verified_benign")
    )


def t14(windows: DataFrame, rare: int = RARE, order: list[str] | None = None) -> DataFrame:
    """Chains of each role and host: counts, span, largest ambiguity, benign and evaluation counts, rank, novelty and next process."""
    keys = ["period_role", "host_id", "chain_id"]
    a = windows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), F.max("ambiguity").alias("max_ambiguity"), F.count("*").alias("n_windows"),
        F.min_by(F.struct("chain", "nodes", "length", "construction", "mapping", "e"), F.col("window_start")).alias("x"),
    ).select(*keys, "n", "first_time", "last_time", "max_ambiguity", "n_windows", "x.*")
    both = windows.groupBy("host_id", "chain_id").agg(
        F.sum(F.when(F.col("period_role") == BENIGN, F.col("n")).otherwise(0)).alias("benign_count"), F.sum(F.when(F.col("period_role") == EVALUATION, F.col("n")).otherwise(0)).alias("evaluation_count"),
        F.min_by("period_role", F.struct("first_time", "period_role")).alias("first_seen_role"),
    )
    out = a.join(both, ["host_id", "chain_id"])
    best = next_process(windows)
    out = out.withColumn("last_node", F.element_at("nodes", -1)).join(best.withColumnRenamed("parent_cmp", "last_node"), ["host_id", "last_node"], "left")
    ranks = benign_rank(both)
    out = out.join(ranks, ["host_id", "chain_id"], "left")
    return out.withColumn("novelty", novelty(F.col("mapping"), F.col("construction"), F.col("benign_count"), rare)).drop("last_node")


def benign_rank(both: DataFrame) -> DataFrame:
    """1..n over all benign chains by falling count, then id."""
    some = both.where("benign_count > 0").select("host_id", "chain_id", "benign_count")
    return global_rank(some, [F.desc("benign_count"), F.col("chain_id"), F.col("host_id")], "benign_rank").drop("benign_count")


def next_process(windows: DataFrame) -> DataFrame:
    """The most frequent benign child of each parent of a host, its support and share."""
    e = windows.where((F.col("period_role") == BENIGN) & (F.col("length") == 2)).select("host_id", F.get("nodes", F.lit(0)).alias("parent_cmp"), F.get("nodes", F.lit(1)).alias("next_process"), "n")
    support = e.groupBy("host_id", "parent_cmp", "next_process").agg(F.sum("n").alias("support"))
    w = Window.partitionBy("host_id", "parent_cmp")
    ranked = support.withColumns({"total": F.sum("support").over(w), "k": F.row_number().over(w.orderBy(F.desc("support"), "next_process"))})
    return ranked.where("k = 1").select("host_id", "parent_cmp", "next_process", "support", (F.col("support") / F.col("total")).alias("next_share"))


def chain_novelty(t14_rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Chains of evaluation windows that are new to their host, by novelty."""
    names = t14_rows.where((F.col("period_role") == EVALUATION) & ~F.col("novelty").isin("unresolved_mapping", "common_in_verified_benign")).select("host_id", "chain_id", "novelty")
    return windows.where(F.col("period_role") == EVALUATION).join(names, ["host_id", "chain_id"]).groupBy("window_start", "host_id", "novelty").agg(F.count("*").alias("n_chains"))


def command_counts(scan: DataFrame) -> DataFrame:
    """Normalized commands over all hosts with benign and evaluation counts; a line is normalized once for each distinct text."""
    return _texts(scan).groupBy("command", "status").agg(F.sum("b").alias("benign_count"), F.sum("v").alias("evaluation_count"))


def _texts(scan: DataFrame) -> DataFrame:
    """Distinct texts with their command, its status and their events of each role."""
    d = scan.groupBy(F.coalesce("command_line_raw", F.lit("")).alias("raw")).agg(F.count_if(F.col("period_role") == BENIGN).alias("b"), F.count_if(F.col("period_role") == EVALUATION).alias("v"))
    return d.withColumns({"command": commands.normalized(F.col("raw")), "status": commands.status(F.col("raw"))})


def command_status(counts: DataFrame) -> DataFrame:
    """Events of each normalization status."""
    return counts.groupBy("status").agg(F.sum(F.col("benign_count") + F.col("evaluation_count")).alias("n"))


def _is_missing(command: Column) -> Column:
    return F.coalesce(command, F.lit("")) == ""


def command_novelty(counts: DataFrame, rare: int = RARE) -> DataFrame:
    said = F.when(_is_missing(F.col("command")), commands.MISSING).when(F.col("benign_count") == 0, "unseen_in_verified_benign").when(F.col("benign_count") <= rare, "rare_in_verified_benign").otherwise("common_in_verified_benign")
    return counts.withColumn("novelty", said)


def _known(scan: DataFrame) -> DataFrame:
    """raw, command, status and the command's counts over all its texts, blank commands with none."""
    t = _texts(scan)
    total = t.groupBy("command").agg(F.sum("b").alias("benign_command_count"), F.sum("v").alias("evaluation_command_count"))
    counted = lambda c: F.when(F.col("command") == "", 0).otherwise(F.col(c)).cast("long").alias(c)
    return t.join(total, "command").select("raw", "command", F.col("status").alias("normalization_status"), counted("benign_command_count"), counted("evaluation_command_count"))


def _with_known(rows: DataFrame, scan: DataFrame) -> DataFrame:
    return rows.withColumn("raw", F.coalesce("command_line_raw", F.lit(""))).join(_known(scan), "raw", "left").drop("raw")


def unusual_commands(scan: DataFrame, rare: int = RARE, limit: int = UNUSUAL) -> DataFrame:
    """The first `limit` evaluation events, by locator, whose command is blank or has at most `rare` benign uses."""
    j = _with_known(scan.where(F.col("period_role") == EVALUATION), scan).where(_is_missing(F.col("command")) | (F.col("benign_command_count") <= rare))
    return j.orderBy(*[F.col(c).asc_nulls_last() for c in LOCATOR]).limit(limit)


def command_windows(scan: DataFrame, rare: int = RARE) -> DataFrame:
    """Evaluation events of each host and window with a command that is new or rare in benign ones."""
    j = _with_known(scan.where(F.col("period_role") == EVALUATION), scan).where(~_is_missing(F.col("command")) & (F.col("benign_command_count") <= rare))
    return j.groupBy("host_id", "window_start").agg(F.count("*").alias("command_novelty_count"))


def chain_counts(windows: DataFrame) -> DataFrame:
    """Benign and evaluation counts of each chain."""
    of = lambda role: F.sum(F.when(F.col("period_role") == role, F.col("n")).otherwise(0))
    return windows.groupBy("chain_id").agg(of(BENIGN).alias("benign_chain_count"), of(EVALUATION).alias("evaluation_chain_count"))


def _observed(windows: DataFrame, role: str) -> DataFrame:
    seen = windows.where((F.col("period_role") == role) & (F.col("construction") == OBSERVED))
    return seen.join(chain_counts(windows), "chain_id")


def unusual_chains(windows: DataFrame, rare: int = RARE, limit: int = UNUSUAL) -> DataFrame:
    """The first `limit` observed chains of evaluation windows, by their first event, with at most `rare` benign events."""
    c = _observed(windows, EVALUATION).where(F.col("benign_chain_count") <= rare)
    return c.orderBy(*[F.col(f"e.{x}").asc_nulls_last() for x in LOCATOR], "host_id", "chain_id").limit(limit)


def common_chains(windows: DataFrame, rare: int = RARE, limit: int = EXAMPLES) -> DataFrame:
    """The most frequent observed benign chains, each by its first window."""
    c = _observed(windows, BENIGN).where((F.col("benign_chain_count") > rare) & (F.coalesce("e.raw_event_id", F.lit("")) != ""))
    one = c.withColumn("k", F.row_number().over(Window.partitionBy("chain_id").orderBy("first_time", *[F.col(f"e.{x}") for x in LOCATOR]))).where("k = 1").drop("k")
    return one.orderBy(F.desc("benign_chain_count"), "first_time", "chain_id").limit(limit)


# Reasons by (chain unusual, command unusual, command missing).
def reason(chain: Column, command: Column, missing: Column) -> Column:
    return (
        F.when(missing & chain, "unusual_chain_insufficient_command").when(missing, "insufficient_or_missing_command")
        .when(chain & command, "unusual_chain_unusual_command").when(chain, "unusual_chain_common_command")
        .when(command, "common_chain_unusual_command").otherwise("common_in_verified_benign")
    )


def t15(windows: DataFrame, scan: DataFrame, rare: int = RARE, examples: int = EXAMPLES, limit: int = UNUSUAL) -> DataFrame:
    """Common benign chains, then unusual evaluation events, found by their chain or by their command, one row an event.

    Counts of an event's command are looked up for every row, whichever way it was found."""
    shown = [c for c in SHOWN if c in scan.columns]
    plain = ["chain_id", "construction", "benign_chain_count", "evaluation_chain_count"]
    of_chain = ["period_role", "window_start", "host_id", "nodes", *plain]
    both = common_chains(windows, rare, examples).select(*of_chain, "e.*").unionByName(unusual_chains(windows, rare, limit).select(*of_chain, "e.*"))
    evidence = edge_evidence(scan, EVIDENCE).withColumn("nodes", F.array("parent_cmp", "child_cmp")).drop("parent_cmp", "child_cmp")
    both = _with_known(both.join(evidence, ["period_role", "window_start", "host_id", "nodes"], "left").withColumn("source", F.lit(0)), scan)

    found = unusual_commands(scan, rare, limit).withColumns({"source": F.lit(1), "evidence_ids": F.array("raw_event_id"), "construction": F.lit(OBSERVED), "nodes": F.array("parent_cmp", "child_cmp")})
    found = found.withColumn("chain_id", chain_id(F.col("host_id"), F.lit(OBSERVED), F.col("nodes"))).join(chain_counts(windows), "chain_id", "left")
    said = ["command", "normalization_status", "benign_command_count", "evaluation_command_count"]
    columns = ["source", "period_role", "host_id", *plain, *LOCATOR, *shown, *said, "evidence_ids"]
    rows = both.select(columns).unionByName(found.select(columns)).fillna(0, ["benign_chain_count", "evaluation_chain_count"])

    # an event found both ways has one row, that of its chain
    w = Window.partitionBy("period_role", "raw_event_id").orderBy("source", *LOCATOR[:-1])
    rows = rows.withColumn("k", F.row_number().over(w)).where((F.col("period_role") == BENIGN) | (F.col("k") == 1))
    common = rows.where(F.col("period_role") == BENIGN).withColumn("k", F.row_number().over(Window.orderBy(F.desc("benign_chain_count"), LOCATOR[0], "chain_id")))
    unusual = rows.where(F.col("period_role") == EVALUATION).withColumn("k", F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_last() for c in LOCATOR]))).where(F.col("k") <= limit)
    out = common.withColumn("part", F.lit(0)).unionByName(unusual.withColumn("part", F.lit(1)))
    place = F.row_number().over(Window.orderBy("part", "k")) - 1  # at most examples + limit rows

    missing = F.trim(F.coalesce("command_line_raw", F.lit(""))) == ""
    why = reason(F.col("benign_chain_count") <= rare, ~missing & (F.col("benign_command_count") <= rare), missing)
    text = lambda c: (F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")).alias(c)
    return out.withColumn("place", place).select(
        F.format_string("t15_%04d_%s", "place", "raw_event_id").alias("evidence_id"), F.col("event_time").alias("timestamp"), "host_id",
        F.col("parent_show").alias("parent_process"), F.col("child_show").alias("child_process"), text("command_line_raw"), F.coalesce("command", F.lit("")).alias("command_line_normalized"),
        F.when(F.col("part") == 0, "common_in_verified_benign").otherwise(why).alias("novelty_reason"),
        F.to_json(F.coalesce("evidence_ids", F.array("raw_event_id"))).alias("raw_event_ids"), F.lit(GROUND_TRUTH).alias("ground_truth_overlap_yes_no"),
        "archive_name", "member_name", "line_number", F.col("period_role").alias("period"), "chain_id", F.col("construction").alias("construction_type"), F.lit(LINKS[OBSERVED]).alias("link_status"),
        *[text(c) for c in ("actor_id_raw", "object_id_raw", "pid_raw", "ppid_raw")], "normalization_status",
        "benign_chain_count", "benign_command_count", "evaluation_chain_count", "evaluation_command_count",
        F.when(F.col("part") == 0, "common_verified_benign_example").otherwise("unusual_evaluation_example").alias("evidence_selection_reason"),
    )


def chain_summary(t14_rows: DataFrame) -> DataFrame:
    """Chains and their events by role, construction and novelty."""
    return t14_rows.groupBy("period_role", "construction", "novelty").agg(F.count("*").alias("n_chains"), F.sum("n").alias("n"))


# Ids of the rules of commands.normalized; each with what it does, an example, what stays, and the risk.
RULES = [
    ("cmd_outer_whitespace_v1", "white space around the line goes", "  tool.exe /flag value  ", "all tokens and their order", "low"),
    ("cmd_full_token_uuid_v1", "a token that is a whole UUID becomes <UUID>", "tool.exe /id 123e4567-e89b-12d3-a456-426614174000 /x", "all other tokens", "medium: different ids become one"),
    ("cmd_full_token_long_hex_v1", "a token of 0x and 8 hex digits or more becomes <HEX>", "tool.exe /h 0xdeadbeefcafebabe /v 0x1", "all other tokens, short hex numbers too", "medium: different numbers become one"),
    ("cmd_full_token_long_decimal_v1", "a token of 8 decimal digits or more becomes <NUMBER>", "tool.exe /pid 12345678 /port 445", "all other tokens, short numbers too", "medium: different numbers become one"),
    ("cmd_quoted_ephemeral_token_v1", "a quoted token changes only if all between its quotes has one of these forms", 'tool.exe --guid "123e4567-e89b-12d3-a456-426614174000"', "quotes and all other tokens", "medium: different ids become one"),
    ("cmd_fallback_preserved_v1", "a line whose quotes don't pair stays as it is, trimmed", 'tool.exe "unterminated', "the whole line", "low: ids may remain"),
]


def rulebook(spark: SparkSession) -> DataFrame:
    """The rules of command normalization, each applied to its example."""
    rows = spark.createDataFrame(RULES, "rule_id string, transformation string, example_before string, preserved_tokens string, risk string")
    return rows.select("rule_id", "transformation", "example_before", commands.normalized(F.col("example_before")).alias("example_after"), "preserved_tokens", "risk")
