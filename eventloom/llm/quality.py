"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Cases: null or empty text has no words, counts of zero and fails the base rule; very long texts are
measured whole; repeated rows are judged each on its own; an empty table gives an empty result; other
columns of the input stay as they are, except that a column with the name of a result is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free, let, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from or an not have but "
    "der die und den von zu das mit sich des auf für ist im dem nicht eine ein als auch es "
    "de la le et les un du une que pour est dans qui par au sur pas avec ne "
    "el y los se las del por con no su para al lo una"
).split()
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


class Rule(NamedTuple):
    """Holds while 100 * part <= most * whole and 100 * part >= least * whole; whole 0 passes."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: The table: mean word length 3 to 10, symbols, stop words, and repeated lines, in hundredths.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=300, most=1000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=6),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=40),
)
BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def repeat_words(w: Column) -> Column:
    """Words inside five-word windows that occur twice or more, by 64-bit hashes of the windows."""

    def covered(h: Column) -> Column:
        # (hash, place) sorted: a place whose neighbour has its hash is in a repeated window
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, d: (k + d >= 0) & (F.get(s, k + d)["h"] == F.get(s, k)["h"])
        places = let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(same(s, k, -1), F.lit(False)) | F.coalesce(same(s, k, 1), F.lit(False))).alias("twice"))), lambda x: x["twice"]),
            lambda x: x["i"])))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, zero, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"].cast("long"))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))


def measures(text: Column) -> Column:
    """All counts of a text as one struct."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    of_lines = lambda v: F.struct(F.size(v).cast("long").alias("n_lines"), (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"))
    return F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that fail."""
    def fails(r: Rule) -> Column:
        part, whole = F.col(r.part) * 100, F.col(r.whole)
        low = part < whole * r.least if r.least is not None else F.lit(False)
        high = part > whole * r.most if r.most is not None else F.lit(False)
        return F.when((whole > 0) & (low | high), F.lit(r.name))

    return F.array_compact(F.array(*[fails(r) for r in rules]))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, base_failed,
    failed_rules (array of names) and kept."""
    own = free(docs, "_m")
    m = docs.withColumn(own, let(F.col(text), measures))
    names = {"n_words": "w", "word_chars": "w", "n_symbols": "", "n_dup_lines": "l", "n_repeat_words": "w", "n_stop_words": "w", "n_lines": "l"}
    m = m.withColumns({k: F.col(own)[v][k] if v else F.col(own)[k] for k, v in names.items()})
    m = m.withColumn("base_failed", F.expr(BASE)).withColumn("failed_rules", compile_rules(rules))
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(own)


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    fails = " OR ".join(f"({r.whole} > 0 AND ({' OR '.join([f'100 * {r.part} < {r.least} * {r.whole}'] * (r.least is not None) + [f'100 * {r.part} > {r.most} * {r.whole}'] * (r.most is not None))}))" for r in RULES)
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
s AS (SELECT r, k, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS k FROM w)),
c AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, s) AS n FROM s) WHERE n > 1),
v AS (SELECT r, count(DISTINCT k + j) AS n FROM c, (SELECT unnest(range(0, 5)) AS j) GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words, CAST(len(l) AS BIGINT) AS n_lines FROM w LEFT JOIN v USING (r)),
b AS (SELECT *, {BASE} AS base_failed FROM m) SELECT *, NOT base_failed AND NOT ({fails}) AS kept FROM b"""


#: The same rules in SQL.
ORACLE = _oracle()
