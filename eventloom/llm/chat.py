r"""Chat formatting: turns of a conversation joined under role headings, with a loss mask, by Spark expressions only.

A run of adjacent turns of one role gets one heading, and each of its turns ends with `</turn>`:

    ### user: first</turn>second</turn>
    ### assistant: answer</turn>

Inside texts and roles `\` becomes `\\`, `##` becomes `#\#` and `</turn>` becomes `<\/turn>` (and `:` in a role `\:`),
so neither mark can come from a text, and dropping each backslash that escapes gives the text back.

Cases: null roles and texts are empty; rows sort by turn (null first), then role, then text, and repeated rows all stay;
null conv_id is a conversation of its own; an empty table gives none; more columns are ignored. One output row holds a
whole conversation, whose rows therefore meet in one task; prefix sums are taken by blocks, so its cost is near linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLOCK, blocks, let, starts

END, HEAD = "</turn>", "### "


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("##"), F.lit("#\\#")), F.lit(END), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and end, code points, end exclusive, of assistant texts)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def pieces(t: Column) -> Column:
        # the places where the role changes cut the turns into runs
        firsts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        runs = lambda f: F.transform(f, lambda at, k: F.slice(t, at + 1, F.coalesce(F.get(f, k + 1), F.size(t)) - at))
        piece = lambda x, i, k: F.struct(
            F.when(i == 0, F.concat(F.when(k > 0, F.lit("\n")).otherwise(F.lit("")), F.lit(HEAD), escape(x["role"], True), F.lit(": "))).otherwise(F.lit("")).alias("head"),
            escape(x["text"]).alias("body"),
            (x["role"] == "assistant").alias("loss"),
        )
        return let(firsts, lambda f: F.flatten(F.transform(runs(f), lambda run, k: F.transform(run, lambda x, i: piece(x, i, k)))))

    made = chats.withColumn("p", let(F.col("turns"), pieces))
    sizes = F.transform("p", lambda x: (F.length(x["head"]) + F.length(x["body"]) + len(END)).cast("long"))
    spans = F.zip_with("p", starts(sizes), lambda x, at: F.struct((at + F.length(x["head"])).alias("start"), (at + F.length(x["head"]) + F.length(x["body"])).alias("end"), x["loss"].alias("loss")))
    return made.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"])).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted chat."""
    parts = F.slice(F.split(formatted, END, -1), 1, F.size(F.split(formatted, END, -1)) - 1)
    head = r"(?s)^\n?### ((?:[^\\:]++|\\.)*+): "

    def runs(p: Column) -> Column:
        # a part without a heading has the role of the last part that has one
        cut = F.transform(p, lambda x, i: F.struct(F.when((i == 0) | x.startswith("\n" + HEAD), F.regexp_extract(x, head, 1)).alias("role"), x.alias("x"), i.alias("i")))
        heads = lambda c: F.filter(c, lambda x: x["role"].isNotNull())
        turn = lambda h, x, k: F.struct(unescape(h["role"]).alias("role"), unescape(F.when(k == 0, F.regexp_replace(x, head, "")).otherwise(x)).alias("text"))
        of = lambda h: F.flatten(F.transform(h, lambda v, k: F.transform(F.slice(p, v["i"] + 1, F.coalesce(F.get(h, k + 1)["i"], F.size(p)) - v["i"]), lambda x, j: turn(v, x, j))))
        return let(heads(cut), of)

    return let(parts, runs)


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them."""
    back = formatted.withColumn("t", read_back(F.col("formatted")))
    part = lambda text, a, z: F.substring(text, (a + 1).cast("int"), (z - a).cast("int"))

    def of_block(b: Column) -> Column:
        # a block's stretch of the text first, so that no span is counted out from the start of the whole
        first, last = F.get(b, F.lit(0))["start"], F.element_at(b, -1)["end"]
        return let(part(F.col("formatted"), first, last), lambda t: F.array_join(F.transform(b, lambda s: unescape(part(t, s["start"] - first, s["end"] - first))), ""))

    masked = F.when(F.size("loss_spans") == 0, "").otherwise(F.array_join(F.transform(blocks(F.col("loss_spans"), BLOCK), of_block), ""))
    return back.withColumn("masked", masked).select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
