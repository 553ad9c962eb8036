"""Secret scans: base patterns, and tokens that a Markov model of random strings explains better than one of identifiers.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from labelled
samples (`samples`, made here by rule, or a frame of the caller). A candidate is a run of key characters, or what base
spans leave of it, of LEAST characters or more. It is a span of kind `random` where the log-likelihood ratio of its
transitions, a character, exceeds `THRESHOLD`; of any other candidate its segments of LEAST characters or more that do are:
with the threshold taken from each ratio, a segment starts where the running sum leaves 0 and ends at its maximum, once the
sum is back at 0 or DROP below that. So a key name or a path beside a secret doesn't hide it. The table of ratios has a
fixed size, so it travels inside the expression.

Cases: null text is empty and has no spans; long texts are scanned whole; equal rows give equal spans; an empty table
gives an empty result; other columns stay, a column with the name of a result is replaced.
"""

from __future__ import annotations

import hashlib
import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, let, starts

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: kind: pattern, group whose length counts, least length
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f]+ that are long enough
}
KINDS = (*BASE, "random")
LEAST = 20
#: Runs whose base spans are looked for at once.
RUNS = 64
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Natural-log units a transition, and of the sum that ends a segment.
THRESHOLD, DROP = 0.25, 8.0
SPAN = "array<struct<start:long,rank:int,kind:string,end:long>>"

#: Parts of ordinary identifiers, paths and file names.
PARTS = (
    "get set is has new old add remove update delete create find load save read write open close start stop run init parse build make check test "
    "user name value key item list map table index count size length type kind state status error message event handler listener manager service "
    "client server request response session config option setting default path file folder source target input output buffer stream reader writer "
    "data model view controller factory adapter helper util common base core main page node tree graph edge link image color width height left right "
    "top bottom first last next previous current total max min average time date year month day hour minute second version number string array object "
    "www http https com org net html index php static assets content article archive image photo download upload search login account profile "
    "und der die das ein nicht für mit les des une pour dans avec los las para con sobre entre"
).split()


def samples(n: int = 3000) -> list[tuple[str, int]]:
    """2 * n labelled strings by rule: 1 random (hex, base 64, letters and digits), 0 identifiers."""
    import base64

    out = []
    for i in range(n):
        raw = b"".join(hashlib.sha256(f"random {i} {k}".encode()).digest() for k in range(2))
        size = 20 + raw[0] % 24
        alnum = "".join(ALPHABET[b % 62] for b in raw)
        out.append(((raw.hex(), base64.b64encode(raw).decode(), alnum, base64.urlsafe_b64encode(raw).decode(), alnum)[i % 5][:size], 1))
        pick = [PARTS[(raw[k] * 256 + raw[k + 1]) % len(PARTS)] for k in range(2, 2 + 2 * (3 + raw[1] % 3), 2)]
        style = raw[20] % 7
        text = (
            "_".join(pick), "-".join(pick), "/".join(pick), pick[0] + "".join(x.title() for x in pick[1:]), "".join(x.title() for x in pick),
            "_".join(pick).upper(), "".join(pick),
        )[style]
        out.append((text + (f"{'_-/'[raw[21] % 3]}{raw[22] * 8}" if raw[23] % 4 == 0 else ""), 0))
    return out


def train(labelled: list[tuple[str, int]], smooth: float = 0.5) -> list[float]:
    """log P(b | a, random) - log P(b | a, identifier) at place(a) * len(ALPHABET) + place(b)."""
    place, n = {c: i for i, c in enumerate(ALPHABET)}, len(ALPHABET)
    counts = [[[smooth] * n for _ in range(n)] for _ in range(2)]
    for text, label in labelled:
        for a, b in zip(text, text[1:], strict=False):
            if a in place and b in place:
                counts[label][place[a]][place[b]] += 1
    logs = [[[math.log(x / sum(row)) for x in row] for row in m] for m in counts]
    return [round(logs[1][a][b] - logs[0][a][b], 5) for a, b in product(range(n), repeat=2)]


def train_frame(labelled: DataFrame, limit: int = 20_000) -> list[float]:
    """The table from columns text and label (1 random), of which the first `limit` by hash are taken."""
    rows = labelled.where("text is not null and label is not null").orderBy(F.xxhash64("text"), "label").limit(limit).collect()
    return train([(r["text"], int(r["label"])) for r in rows])


def _placed(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Matches of a pattern with their places: between matches stand the parts that split() gives."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)

    def spans(m: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long")), 1, F.size(m))
        steps = F.arrays_zip(F.transform(m, F.length).alias("size"), sizes.alias("counts"), gaps.alias("gap"))
        one = lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (at + x["gap"] + x["size"]).alias("end"), x["counts"].alias("counts"))
        placed = let(steps, lambda v: F.zip_with(v, starts(F.transform(v, lambda x: x["gap"] + x["size"])), one))
        return F.transform(F.filter(placed, lambda x: x["counts"] >= least), lambda x: F.struct(x["start"], x["rank"], x["kind"], x["end"])).cast(SPAN)

    return let(whole, lambda m: F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(spans(m)))


def log_ratios(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of each transition of a token of ALPHABET."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    marks = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    return let(marks, lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.get(table, F.get(p, i - 1) * len(ALPHABET) + F.get(p, i))))


def _one(start: Column, end: Column) -> Column:
    return F.array(F.struct(start.cast("long").alias("start"), F.lit(KINDS.index("random")).alias("rank"), F.lit("random").alias("kind"), end.cast("long").alias("end"))).cast(SPAN)


def _left(run: Column, base: Column) -> Column:
    """The parts of a run outside sorted base spans that are long enough."""
    zero = F.struct(run["start"].alias("at"), F.array().cast(SPAN).alias("out"))
    met = F.filter(base, lambda x: (x["start"] < run["end"]) & (run["start"] < x["end"]))
    step = lambda a, x: F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], _one(a["at"], x["start"])).alias("out"))
    parts = F.aggregate(met, zero, step, lambda a: F.concat(a["out"], _one(a["at"], run["end"])))
    return F.filter(parts, lambda x: x["end"] - x["start"] >= LEAST)


def _random(part: Column, ratio: Column, threshold: float) -> Column:
    """The part as a span if its mean ratio exceeds the threshold, else its segments that do."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0.0).alias("best"), F.lit(0).alias("last"), F.array().cast(SPAN).alias("out"))
    # transitions first to last - 1 join the characters first to last
    ended = lambda a: F.when(a["last"] - a["first"] + 1 >= LEAST, F.concat(a["out"], _one(part["start"] + a["first"], part["start"] + a["last"] + 1))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        total, after = a["sum"] + (x - threshold), a["i"] + 1
        over = (total <= 0) | (total < a["best"] - DROP)
        grown = total > a["best"]
        return F.struct(
            after.alias("i"), F.when(over, 0.0).otherwise(total).alias("sum"), F.when(over, after).otherwise(a["first"]).alias("first"),
            F.when(over, 0.0).when(grown, total).otherwise(a["best"]).alias("best"), F.when(over | grown, after).otherwise(a["last"]).alias("last"),
            F.when(over, ended(a)).otherwise(a["out"]).alias("out"),
        )

    mean = F.aggregate(ratio, F.lit(0.0), lambda a, x: a + x) / F.size(ratio)
    return F.when(mean > threshold, _one(part["start"], part["end"])).otherwise(F.aggregate(ratio, zero, step, ended))


def scan(docs: DataFrame, text: str = "text", ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with found: array<struct<start, rank, kind, end>>, sorted, of code points, end exclusive."""
    ratios = ratios or train(samples())
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*[_placed(body, *BASE[k], k) for k in BASE]))
    runs = _placed(body, CANDIDATE, 0, LEAST, "random")
    part = lambda t, a, z: F.substring(t, (a + 1).cast("int"), (z - a).cast("int"))

    def of_block(b: Column, some: Column) -> Column:
        # a block of runs has its stretch of the text, and the base spans there
        first, last = F.get(some, F.lit(0))["start"], F.element_at(some, -1)["end"]
        near = F.filter(b, lambda x: (x["start"] < last) & (first < x["end"]))
        free = let(near, lambda n: F.flatten(F.transform(some, lambda s: _left(s, n))))
        score = lambda t, s: let(log_ratios(part(t, s["start"] - first, s["end"] - first), ratios), lambda v: _random(s, v, threshold))
        return let(part(body, first, last), lambda t: F.flatten(F.transform(free, lambda s: score(t, s))))

    none = F.array().cast(SPAN)
    scored = lambda b: let(runs, lambda r: F.when(F.size(r) == 0, none).otherwise(F.flatten(F.transform(blocks(r, RUNS), lambda some: of_block(b, some)))))
    return docs.withColumn("found", let(base, lambda b: F.array_sort(F.concat(b, scored(b)))))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("found", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def default_ratios(_: SparkSession | None = None) -> list[float]:
    return train(samples())
