"""Language identification in two levels: the family, then one-versus-one linear support vector machines within it.

Features of a text are the shares of its byte n-grams (2, 3 and 4 bytes, hashed to BUCKETS; A-Z as a-z, runs of other
ASCII as one space). Family machines and those of each pair of languages of a family are linear, trained by averaged
sub-gradient steps on the hinge loss, on at most SAMPLE labelled texts of each language, chosen by a hash of their id;
texts are read whole. A family that has one language needs no second level. The score is the product of the logistic
values of the deciding margins.

Cases: null text, or text without a letter, is `und` with score 0; long texts are read whole; ties go to the name that
sorts first; without labelled rows every text with a letter is `und`; with one language, all are of it; repeated rows are
judged each; an empty table gives an empty result; a column with the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches

BUCKETS, SAMPLE, ROUNDS, SIZES = 8192, 250, 150, (2, 3, 4)
UNKNOWN = "und"
#: Languages by family; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_LETTER = regex.compile(r"\p{L}")
_MAP = np.full(256, 32, np.uint8)
_MAP[65:91] = _MAP[97:123] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_MUL = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, f"other {lang}")


def grams(text: str) -> list[np.ndarray]:
    """Buckets of the n-grams, by size."""
    raw = _MAP[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    blank = raw == 32
    raw = raw[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    out = []
    for n in SIZES:
        if len(raw) >= n:
            h = raw[: len(raw) - n + 1].copy()
            for k in range(1, n):
                h = (h << np.uint32(8)) + raw[k : len(raw) - n + 1 + k]
            out.append((h * np.uint32(_MUL[n])) >> np.uint32(32 - 13))
    return out


def features(text: str) -> np.ndarray:
    x = np.zeros(BUCKETS, np.float32)
    for g in grams(text):
        x += np.bincount(g, minlength=BUCKETS).astype(np.float32) / len(g)
    return x


class Machine(NamedTuple):
    """Positive margin: a, else b."""

    a: str
    b: str
    w: np.ndarray
    bias: float


def fit(x: np.ndarray, y: np.ndarray, a: str, b: str, cost: float = 50.0) -> Machine:
    """Averaged sub-gradient steps; y is 1 for a, -1 for b; both classes weigh the same."""
    scale = (1.0 / np.maximum(x.std(axis=0), 1e-4)).astype(np.float32)
    xs = x * scale
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, bias, mean, mean_bias, l2 = np.zeros(x.shape[1], np.float64), 0.0, np.zeros(x.shape[1]), 0.0, 1.0 / cost
    for t in range(1, ROUNDS + 1):
        pull = np.where(y * (xs @ w.astype(np.float32) + bias) < 1, y * share, 0.0)
        step = 1.0 / (l2 * (t + 100 * cost))
        w -= step * (l2 * w - pull.astype(np.float32) @ xs)
        bias += step * pull.sum()
        mean += w
        mean_bias += bias
    return Machine(a, b, (mean / ROUNDS * scale).astype(np.float32), float(mean_bias / ROUNDS))


class Model(NamedTuple):
    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]


def train(rows: list[tuple[str, str]]) -> Model:
    """From (text, lang); family machines are one-versus-one too."""
    rows = sorted(rows)
    x = np.stack([features(t) for t, _ in rows]) if rows else np.zeros((0, BUCKETS), np.float32)
    lang = np.array([v for _, v in rows], object)
    families: dict[str, list[str]] = {}
    for v in sorted(set(lang)):
        families.setdefault(family_of(v), []).append(v)

    def machines(names: np.ndarray, of: list[str]) -> list[Machine]:
        out = []
        for a, b in combinations(of, 2):
            pick = (names == a) | (names == b)
            out.append(fit(x[pick], np.where(names[pick] == a, 1.0, -1.0), a, b))
        return out

    of_family = np.array([family_of(v) for v in lang], object)
    return Model(families, machines(of_family, sorted(families)), {f: machines(lang, v) for f, v in families.items()})


def _winner(gs: list[np.ndarray], machines: list[Machine], names: list[str]) -> tuple[str, float]:
    """Most votes, then largest sum of margins; the logistic value of the smallest margin of the winner."""
    if len(names) == 1:
        return names[0], 1.0
    votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
    for m in machines:
        margin = m.bias + sum(float(m.w[g].mean(dtype=np.float64)) for g in gs)
        for name, v in ((m.a, margin), (m.b, -margin)):
            votes[name] += v > 0
            sums[name] += v
            least[name] = min(least[name], v)
    best = min(names, key=lambda k: (-votes[k], -sums[k], k))
    return best, float(1 / (1 + np.exp(-np.clip(2 * least[best], -30, 30))))


def judge(model: Model, text: str | None) -> tuple[str, float]:
    if not text or not model.families or not _LETTER.search(text):
        return UNKNOWN, 0.0
    gs = grams(text)
    family, p = _winner(gs, model.between, sorted(model.families))
    lang, q = _winner(gs, model.within[family], model.families[family])
    return lang, p * q


def held_out(key: Column) -> Column:
    """Rows of a remainder of 1, from which nothing is learnt."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From text and lang of the rows that aren't held out: about `sample` of each language, by a hash of the id.

    One fraction a language follows from its count; the count covers all rows, the texts only those taken."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([])
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    limits = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1_000_000, max(1, 1_000_000 * sample // n)))])
    taken = known.where((place < limits[F.col("lang")]) & F.col("text").isNotNull()).select("text", "lang")
    return train([(r["text"], r["lang"]) for r in taken.collect() if _LETTER.search(r["text"])])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    modest_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(shared.value, v.as_py()) for v in b.column(text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v for v, _ in found], pa.string()), pa.array([v for _, v in found], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)
