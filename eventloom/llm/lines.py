"""Line dedup: an exact set-similarity join of lines, by built-in expressions only.

A line's set is its distinct words. Two lines match if their sets' Jaccard similarity is PERCENT hundredths or
more; a line is removed if a line before it, by doc_id and place, matches it. Lines with fewer than `least` distinct words
are no candidates and stay; `least` = 1 makes every line with a word one. At PERCENT sets that match and differ have six
words or more, so shorter sets match only equal ones.

1. Words are counted in COUNTERS hash counters over all lines; a word's key holds the counter's level (rare first) above
   the last 56 bits of its hash, so sorted keys order words by rarity, the same everywhere. The levels are one row, which
   the plan reads as a scalar subquery.
2. Lines of one set (named by 64 bits) are one entry: the first stays, the later ones go.
3. Each entry gives a row for each word of its prefix, n - ceil(t n) + 1 words: two sets that match share a word of their
   prefixes. Rows that meet at a word pass the length filter, the positional filter (with the words left in both, the
   overlap can still be reached) and bounds from maps of 128 bits of the prefixes and of 64 of the sets: sets that match
   share so many words that few bits of one are missing in the other. The prefixes' map is the wider one, since prefixes
   of long lines would fill 64 bits and let nearly all pass.
4. Pairs are verified on the whole sets, whose lines alone are cut into words again: first, of HEADS words, those of an entry
   with the earliest one and with its neighbours in order of the maps; then, by words of 2 ** MANY lines or more, those of the
   entries left with one in SAMPLED of the earlier ones, which tells most of the later ones of a large family of like lines;
   then the entries that are still without an earlier match with all that are earlier.

A word in a third of all lines comes last in every order, so it is in the prefix of few entries: those of frequent words
alone, which are few as sets are distinct. Words of a counter above SALT are spread over several tasks in the first
comparison; the second is a join, whose skewed partitions adaptive execution splits.

Cases: null or empty text has no lines that match; null doc_id sorts first; rows of one doc_id
are told apart, and ordered, by a hash of their text, and repeated rows lose the same lines; blank lines stay; very long lines are sets like others; an empty table gives an empty
result; other columns stay whatever their names, but a column with the name of a result is replaced.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BROADCAST_IDS, cut, free, let, numbered, release

#: COUNTERS = 2 ** BITS; a counter above 2 ** SALT lines is spread.
PERCENT, LEAST, BITS, SALT = 85, 1, 20, 20
#: Words of a prefix by which entries first meet; one in SAMPLED earlier entries is met before all are.
HEADS, SAMPLED = 3, 16
#: Binary logarithms of a counter's lines: heads are such words if there are any, and only such words meet sampled entries;
#: of a rarer word all pairs are few for each line.
FEW, MANY = 7, 8
COUNTERS = 1 << BITS
#: White space within a line but the blank.
WHITE = "\t\x0b\x0c\r"
#: Maps of an entry: of its prefix, in two halves, and of its whole set.
MAPS = ("bits", "more", "whole")
#: Marks, in a place within a prefix, entries that have an earlier match.
GONE = 1 << 30


def flat(text: Column) -> Column:
    """Text with blanks for white space but line ends."""
    text, out = F.coalesce(text, F.lit("")), F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(" "))
    # a search is many times cheaper than a replacement that finds nothing
    return F.when(functools.reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in WHITE]), out).otherwise(text)


def hashes(line: Column) -> Column:
    """Distinct hashes of the words of a flat line."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _counter(h: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, F.lit(64 - BITS)).cast("int")


def levels(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row, one array: for each counter, what turns the first 8 bits of a hash into the counter's level, 0 to 127: its
    count over all lines, on a logarithmic scale."""
    word = docs.select(F.explode(F.split(F.replace(flat(F.col(text)), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counted = word.select(_counter(F.xxhash64("w")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    level = F.coalesce(F.least(F.lit(127), F.floor(F.log2(F.col("n").cast("double")) * 4)).cast("long"), F.lit(0).cast("long"))
    c = F.col("c").cast("long")
    first = F.call_function("shiftright", F.when(c < COUNTERS // 2, c).otherwise(c - COUNTERS), F.lit(BITS - 8))
    every = docs.sparkSession.range(COUNTERS).select(F.col("id").cast("int").alias("c")).join(counted, "c", "left")
    every = every.select("c", F.call_function("shiftleft", level.bitwiseXOR(first), F.lit(56)).alias("turn"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "turn"))), lambda x: x["turn"]).alias("turns"))


def keyed(line: Column, turns: Column) -> Column:
    """The set of a flat line as sorted keys, rare words first."""
    # no key is null, and Spark sorts longs that can't be null without boxing them
    key = lambda h: F.coalesce(F.get(turns, _counter(h)), F.lit(0).cast("long")).bitwiseXOR(h)
    return F.sort_array(F.transform(hashes(line), key))


def bitmap(keys: Column) -> Column:
    """A 64-bit map of the keys' last six bits."""
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(one(x.bitwiseAND(F.lit(63)))))


def bitmaps(keys: Column) -> list[Column]:
    """A 128-bit map of the keys' last seven bits, in two halves."""
    side = lambda half: F.filter(keys, lambda x: x.bitwiseAND(F.lit(64)) == half)
    return [bitmap(side(0)), bitmap(side(64))]


def prefix_size(n: Column, percent: int) -> Column:
    """Words of a prefix; a set too short for any match but an equal one, which its id finds, has none."""
    return F.when(n * (100 - percent) < percent, 0).otherwise(n - F.ceil(n * percent / 100).cast("int") + 1)


def fits(x, y, percent: int) -> Column:
    """Whether two entries' rows of one word can be of a match; x and y give the columns n, at, bits, more and whole of each."""
    need = F.ceil((x("n") + y("n")) * percent / (100 + percent))
    left = F.least(x("n") - x("at"), y("n") - y("at")).cast("long")
    # of a match's overlap at most the larger rest behind a prefix lies outside both prefixes
    shared = need - F.greatest(x("n") - prefix_size(x("n"), percent), y("n") - prefix_size(y("n"), percent))
    missing = lambda c, p, q: F.bit_count(p(c).bitwiseAND(F.bitwise_not(q(c))))
    spare = lambda p, q: (missing("bits", p, q) + missing("more", p, q) <= prefix_size(p("n"), percent) - shared) & (missing("whole", p, q) <= p("n") - need)
    reached = (100 + percent) * left >= percent * (x("n") + y("n"))
    return (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))) & reached & spare(x, y) & spare(y, x)


def often(key: Column, power: int) -> Column:
    """Whether a key's counter has 2 ** power lines or more."""
    return key >= F.lit(4 * power << 56)


def heads(prefix: Column) -> Column:
    """HEADS keys of a prefix, frequent ones first, by hash: sorted as longs, whose sign tells frequent ones, with the hash
    above the level."""
    low, top = F.lit((1 << 63) - 1), F.lit(-(2**63))

    def turned(key: Column) -> Column:
        out = F.call_function("shiftleft", key, F.lit(7)).bitwiseAND(low).bitwiseOR(F.call_function("shiftright", key, F.lit(56)))
        return F.when(often(key, FEW), out.bitwiseOR(top)).otherwise(out)

    back = lambda x: F.call_function("shiftleft", x.bitwiseAND(F.lit(127)), F.lit(56)).bitwiseOR(F.call_function("shiftright", x.bitwiseAND(low), F.lit(7)))
    return F.transform(F.slice(F.sort_array(F.transform(prefix, turned)), 1, HEADS), back)


def entries_of(docs: DataFrame, text: str, percent: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The entries (id, first, n, bits, more, whole, prefix) and the places (doc_id, row, line_no) of their later copies."""
    turns = cut(levels(docs, text))
    lines = docs.select("doc_id", "row", F.posexplode(F.split(flat(F.col(text)), "\n")).alias("line_no", "line")).withColumn("turns", turns.scalar())

    def made(v: Column) -> Column:
        head = F.slice(v, 1, prefix_size(F.size(v), percent))
        return F.struct(F.xxhash64(v).alias("id"), F.size(v).alias("n"), bitmap(v).alias("whole"), head.alias("prefix"))

    # the projection takes the levels in, so that no row carries them; the generator keeps filters from making sets twice
    lines = lines.select("doc_id", "row", "line_no", keyed(F.col("line"), F.col("turns")).alias("v"))
    each = F.when(F.size("v") >= least, F.array(made(F.col("v"))))
    lines = cut(lines.select("doc_id", "row", "line_no", F.explode(each).alias("x")).select("doc_id", "row", "line_no", "x.*"))
    entries = lines.groupBy("id").agg(F.min(F.struct("doc_id", "row", "line_no", "n", "whole", "prefix")).alias("x"), F.count("*").alias("copies"))
    # copies need no maps of their prefixes
    maps = [m.alias(c) for m, c in zip(bitmaps(F.col("x.prefix")), ("bits", "more"))]
    entries = cut(entries.select("id", F.struct("x.doc_id", "x.row", "x.line_no").alias("first"), "x.n", *maps, "x.whole", "x.prefix", "copies"))
    place = F.struct("doc_id", "row", "line_no")
    copies = cut(lines.join(entries.where("copies > 1").select("id", "first"), "id").where(place != F.col("first")).select("doc_id", "row", "line_no"))
    release(lines, turns)
    return entries, copies


def removed_lines(docs: DataFrame, text: str = "text", percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """doc_id, row, removed (sorted places of the lines that go), for the numbered docs that lose lines."""
    entries, copies = entries_of(docs, text, percent, least)

    def later_of(pairs: DataFrame) -> DataFrame:
        """id and p, the place, of the later entry of each pair (id_a, id_b) that matches."""
        met = cut(pairs.distinct())
        ids = met.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
        told = cut(entries.select("id", "first").join(ids, "id"))
        places = told.groupBy(F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_row")).agg(F.collect_list(F.struct("id", "first")).alias("found"))
        places = F.broadcast(places) if told.count() <= BROADCAST_IDS // 4 else places
        of = docs.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
        one = lambda v: F.transform("found", lambda p: F.struct(p["id"].alias("id"), p["first"].alias("first"), hashes(F.get(v, p["first"]["line_no"])).alias("s")))
        sets = of.select(F.explode(let(F.split(flat(F.col(text)), "\n"), one)).alias("x")).select("x.*")
        sets = cut(sets.dropDuplicates(["id"]))
        side = lambda x: sets.select(F.col("id").alias(f"id_{x}"), F.struct("first", "id").alias(f"p_{x}"), F.col("s").alias(f"s_{x}"))
        both = F.size(F.array_intersect("s_a", "s_b"))
        matched = met.join(side("a"), "id_a").join(side("b"), "id_b").where(100 * both >= percent * (F.size("s_a") + F.size("s_b") - both))
        later = cut(matched.select(F.greatest("p_a", "p_b").alias("x")).distinct().select("x.id", F.col("x.first").alias("p")))
        release(met, told, sets)
        return later

    def rows_of(found: DataFrame) -> DataFrame:
        """A row for each word of an entry's prefix; d is the doc_id, null lowest."""
        d = F.coalesce(F.col("first.doc_id").cast("long"), F.lit(-(2**63)))
        return found.select("id", "n", *MAPS, d.alias("d"), "gone", F.posexplode("prefix").alias("at", "key")).withColumn("at", F.col("at") + F.col("gone")).drop("gone")

    # most lines of a family match the earliest of those that share one of HEADS words, or a neighbour in order of the maps
    level = F.call_function("shiftrightunsigned", "key", F.lit(56))
    rows = entries.select("id", F.col("first.doc_id").alias("d"), "n", *MAPS, "prefix", F.explode(heads(F.col("prefix"))).alias("key"))
    rows = rows.withColumn("at", (F.array_position("prefix", F.col("key")) - 1).cast("int")).drop("prefix")
    rows = rows.withColumn("salt", F.pmod("id", F.ceil(F.pow(F.lit(2.0), level / 4 - SALT))))
    w = Window.partitionBy("key", "salt").orderBy("bits", "id")
    told = ["id", "n", "at", *MAPS]
    head = F.min(F.struct("d", *told)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = rows.withColumns({"h": head, "l": F.lag(F.struct(*told)).over(w)})
    other = lambda x: F.when((F.col(x)["id"] != F.col("id")) & fits(F.col, lambda c: F.col(x)[c], percent), F.col(x)["id"])
    found = met.select("id", other("h").alias("h"), other("l").alias("l")).where("h is not null or l is not null")
    found = found.select("id", F.explode(F.array("h", "l")).alias("o")).where("o is not null")
    some = later_of(found.select(F.least("id", "o").alias("id_a"), F.greatest("id", "o").alias("id_b")))

    def compared(late: DataFrame, early: DataFrame) -> DataFrame:
        """later_of the pairs of a late row and an early one, which share a word and whose places may be so ordered."""
        side = lambda r, x: r.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "at", *MAPS, "d")])
        a = lambda c: F.col("at_a").bitwiseAND(F.lit(GONE - 1)) if c == "at" else F.col(f"{c}_a")
        met = side(early, "a").join(side(late, "b"), "key").where((F.col("id_a") != F.col("id_b")) & (F.col("d_a") <= F.col("d_b")) & fits(a, lambda c: F.col(f"{c}_b"), percent))
        return later_of(met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")))

    # of a family that shares words, a part of the earlier ones tells most of the later ones; then those left meet all that
    # are earlier; both sides have the same columns, so that one shuffle serves both
    known = F.broadcast(some) if some.count() <= BROADCAST_IDS else some
    fresh = entries.withColumn("gone", F.lit(0))
    hot = lambda found: rows_of(found).where(often(F.col("key"), MANY))
    many = compared(hot(fresh.join(known, "id", "left_anti")), hot(fresh.where(F.pmod("id", F.lit(SAMPLED)) == 0)))
    gone = some.union(many).select("id", F.lit(GONE).alias("gone")).distinct()
    gone = F.broadcast(gone) if some.count() + many.count() <= BROADCAST_IDS else gone
    rows = rows_of(entries.join(gone, "id", "left").withColumn("gone", F.coalesce("gone", F.lit(0))))
    rest = compared(rows, rows)
    later = some.union(many).union(rest).select("p.*").distinct()
    removed = cut(later.union(copies).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("removed")))
    release(entries, copies, some, many, rest)
    return removed


def _with_removed(docs: DataFrame, row: str, text: str, percent: int, least: int) -> DataFrame:
    """docs, numbered in the column `row`, with removed (null: none); the list travels to the docs if it is small."""
    gone = removed_lines(docs.select("doc_id", F.col(row).alias("row"), text), text, percent, least).toDF("_id_", "_row_", "removed")
    small = gone.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()[0] <= BROADCAST_IDS
    names = {"_id_": free(docs, "_id_"), "_row_": free(docs, "_row_")}
    gone = gone.withColumnsRenamed(names)
    on = docs["doc_id"].eqNullSafe(gone[names["_id_"]]) & (docs[row] == gone[names["_row_"]])
    return docs.join(F.broadcast(gone) if small else gone, on, "left").drop(*names.values())


def dedup_lines(docs: DataFrame, text: str = "text", percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """docs whose texts have lost the removed lines, with n_lines and removed (array of places)."""
    docs = docs.drop("n_lines", "removed")
    row = free(docs, "row")
    out = _with_removed(numbered(docs, text, row), row, text, percent, least).drop(row)
    parts = F.split(F.col(text), "\n")
    keep = lambda v: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(v) - 1), "removed"), lambda i: F.get(v, i)), "\n")
    return out.withColumns({
        "n_lines": F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).cast("long"),
        text: F.when(F.col("removed").isNull(), F.col(text)).otherwise(let(parts, keep)),
        "removed": F.coalesce("removed", F.array().cast("array<int>")),
    })


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and removed of each row, without moving texts."""
    docs = numbered(docs.select("doc_id", text), text)
    gone = removed_lines(docs, text).toDF("_id", "_row", "removed")
    small = gone.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()[0] <= BROADCAST_IDS
    counts = docs.select("doc_id", "row", F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).cast("long").alias("n_lines"))
    out = counts.join(F.broadcast(gone) if small else gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))
