"""MinHash near-dedup by a multi-index Hamming join.

A text's set is its distinct five-word shingles (64-bit hashes). Texts with one set are one node, so exact copies are
never compared. A node's signature has POSITIONS min-hashes of 16 bits; the distance of two is the number of positions
that differ. The positions are cut into chunks of CHUNK, and by the pigeonhole principle a pair at a distance of at most
LIMIT = chunks * (ERRORS + 1) - 1 has a chunk with at most ERRORS differing positions: each chunk is indexed once for
each choice of ERRORS positions left out, so every pair within LIMIT meets under a key. At a similarity of exactly 0.75
a pair is beyond LIMIT (31 of 64) with a probability of about 1e-5, and less above.

Pairs within LIMIT join nodes to families: a bucket's members first with its smallest, then, in buckets whose members are
still in different families, all with all, in tiles of bounded size that return one edge for each union. Links are
confirmed on the full sets: each node with the nearest of its buckets' smallest members, one pair a node; then, in families
that this leaves in several parts, all pairs across parts, in such tiles too. So all pairs within LIMIT are linked or
refuted. A family in one part costs a row a node; one of n nodes in several parts costs n * n / TILE rows.

Cases: null or empty text, or text without words, has an empty set, is linked with nothing and is its own component; fewer
than five words make one shingle; ids that are null take no part and return a null component_id and kept true; repeated
rows return one row each; an id with several texts is one document that any of them links; ties: the smallest id is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, modest_batches, of_ids, release

WORDS, PERCENT = 5, 75
POSITIONS, CHUNK, ERRORS = 64, 4, 1
LIMIT = POSITIONS // CHUNK * (ERRORS + 1) - 1
#: Rows of a part of a tile, and shingles.
TILE, SHINGLES = 512, 1_000_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MUL = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse, grown as needed."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, A-Z as a-z."""
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(w: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the windows of `words` words; of the whole sequence if there are fewer."""
    if not len(w):
        return np.empty(0, np.uint64)
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _STEP + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(h))


def text_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    for t in texts:
        yield shingles(word_hashes(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))) if t else np.empty(0, np.uint64)


def signature(s: np.ndarray) -> bytes:
    best = np.full(POSITIONS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 1024):
        best = np.minimum(best, (s[at : at + 1024, None] * _MUL + _ADD).min(axis=0))
    return _mix(best).astype(np.uint16).tobytes()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            n, key, sig = [], [], []
            for s in text_sets(part.column(1).to_pylist()):
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "set_key", "sig"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = [(c, left) for c in range(POSITIONS // CHUNK) for left in combinations(range(CHUNK), CHUNK - ERRORS)]
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            sigs = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, POSITIONS).astype(np.uint64)
            out = np.empty((len(sigs), len(keep)), np.uint64)
            for k, (c, left) in enumerate(keep):
                h = np.full(len(sigs), k + 1, np.uint64)
                for i in left:
                    h = h * np.uint64(65536) + sigs[:, c * CHUNK + i]
                out[:, k] = _mix(h * _STEP)
            rows = np.repeat(np.arange(len(sigs)), len(keep))
            yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))], ["key", "node", "n"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v and distance of rows u, v, su, sv that are within LIMIT."""
    for b in batches:
        if not b.num_rows:
            continue
        a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, POSITIONS) for k in (2, 3))
        d = (a != c).sum(axis=1)
        ok = np.flatnonzero(d <= LIMIT)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(d[ok], pa.int64())], ["u", "v", "d"])


def _by_tile(width: int, close):
    """A function of Arrow batches sorted by their first `width` columns: calls close on the whole tiles of those so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            if held and any(held[-1].column(k)[0] != b.column(k)[0] for k in range(width)):
                yield from close(pa.Table.from_batches(held))
                held = []
            # the last tile of a batch may go on in the next one
            same = np.ones(b.num_rows, bool)
            for k in range(width):
                v = b.column(k).to_numpy()
                same &= v == v[-1]
            last = 0 if same.all() else b.num_rows - int(np.argmin(same[::-1]))
            if last:
                yield from close(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from close(pa.Table.from_batches(held))

    return run


def _cuts(t: pa.Table, width: int) -> Iterator[tuple[int, int]]:
    keys = np.stack([t.column(k).to_numpy() for k in range(width)])
    cuts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [t.num_rows]))
    yield from zip(cuts, cuts[1:], strict=False)


class _Forest:
    """Union of labels, and one edge for each union."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((max(a, b), min(a, b)))


def _met(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edges that join components by pairs within LIMIT, from tiles: key, i, j, side, node, n, comp, sig."""
    tile = (t.column(1).to_numpy(), t.column(2).to_numpy())
    side, n, comp = (t.column(k).to_numpy() for k in (3, 5, 6))
    sig = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint16).reshape(-1, POSITIONS)
    out: set[tuple[int, int]] = set()
    for a, z in _cuts(t, 3):
        rows = np.arange(a, z)
        left, right = (rows, rows) if tile[0][a] == tile[1][a] else (rows[side[a:z] == 0], rows[side[a:z] == 1])
        forest = _Forest()
        for x in left:
            y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= PERCENT * np.maximum(n[right], n[x]))]
            if len(y):
                y = y[(sig[y] != sig[x]).sum(axis=1) <= LIMIT]
                for c in set(comp[y].tolist()):
                    forest.join(int(comp[x]), c)
        out.update(forest.edges)
    u, v = zip(*sorted(out), strict=True) if out else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _confirm(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edges of similar sets that aren't known to be linked, one for each union in a tile: family, i, j, side, node, s, known."""
    us, vs = [], []
    for a, z in _cuts(t, 3):
        part = t.slice(a, z - a)
        side, node = part.column(3).to_numpy(), part.column(4).to_numpy().tolist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in part.column(5).chunks for x in c]
        size, known = np.array([len(x) for x in sets]), part.column(6).to_numpy()
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        names, place = np.unique(np.concatenate(sets), return_inverse=True)
        whole = part.column(1)[0] == part.column(2)[0]
        held, forest = np.zeros(len(names), bool), _Forest()
        for x in range(len(sets)) if whole else np.flatnonzero(side == 0):
            own = place[starts[x] : starts[x] + size[x]]
            held[own] = True
            both = np.add.reduceat(held[place], starts, dtype=np.int64)
            held[own] = False
            ok = (100 * both >= PERCENT * (size + size[x] - both)) & (known != known[x])
            if whole:
                ok[: x + 1] = False
            else:
                ok &= side == 1
            for y in np.flatnonzero(ok):
                forest.join(node[x], node[y])
        us += [e[0] for e in forest.edges]
        vs += [e[1] for e in forest.edges]
    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v of rows u, v, su, sv whose sets are similar."""
    for b in batches:
        ok = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in text_sets(part.column(1).to_pylist())], pa.binary())], ["node", "s"])


def tiles(rows: DataFrame, key: str, parts: Column) -> DataFrame:
    """rows with i, j, side: a key's rows in `parts` parts, each pair of parts (and each part itself) a tile."""
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other"), "side": F.when(F.col("part") <= F.col("other"), 0).otherwise(1)})
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node on an edge u, v.

    Each round contracts: a node moves to the first of its neighbours and itself, by id in every other round, which ends a star
    around its smallest node at once, and by a new hash in those between, which shrinks any graph by a share that doesn't
    depend on its shape, so that a chain takes logarithmically many rounds."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        rank = lambda c: F.struct((F.xxhash64(F.lit(len(steps)), F.col(c)) if len(steps) % 2 else F.lit(0).cast("long")).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        ends = edges.select("u", "v").union(edges.select("v", "u")).toDF("node", "to")
        least = ends.groupBy("node").agg(F.min(rank("to")).alias("to"))
        to = cut(least.select("node", F.least("to", rank("node"))["x"].alias("to")))
        steps.append(to)
        moved = edges.join(to.toDF("u", "a"), "u").join(to.toDF("v", "b"), "v").where("a <> b")
        used, edges = edges, cut(moved.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        release(used)
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out = steps[0].toDF("node", "comp")
    for k, to in enumerate(steps[1:]):
        # nodes of a later graph are targets of the one before
        out = out.join(to.toDF("comp", f"to{k}"), "comp", "left").select("node", F.coalesce(f"to{k}", "comp").alias("comp"))
    named = cut(out)
    smallest = named.groupBy("comp").agg(F.min("node").alias("least"))
    out = cut(named.join(smallest, "comp").select("node", F.col("least").alias("comp")))
    release(named, *steps)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    modest_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = cut(docs.mapInArrow(_describe, "doc_id long, n long, set_key binary, sig binary"))
    nodes = cut(
        base.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "sig")).alias("x"))
        .select("set_key", F.col("x.doc_id").alias("node"), "x.n", "x.sig")
    )
    w = Window.partitionBy("key")
    keyed = nodes.select("node", "n", "sig").mapInArrow(_keys, "key long, node long, n long")
    met = keyed.withColumns({"first": F.min(F.struct("node", "n")).over(w), "size": F.count("*").over(w)}).where("size > 1")
    met = cut(met.select("key", "node", "n", F.col("first.node").alias("v"), F.col("first.n").alias("vn"), "size"))
    sigs = nodes.select("node", "sig")

    # families: nodes joined by pairs within LIMIT, first by those with a bucket's smallest member
    fit = f"100 * least(n, vn) >= {PERCENT} * greatest(n, vn)"
    stars = met.where("node <> v").where(fit).select(F.col("node").alias("u"), "v").distinct()
    stars = stars.join(sigs.toDF("u", "su"), "u").join(sigs.toDF("v", "sv"), "v").select("u", "v", "su", "sv")
    near = cut(stars.mapInArrow(_distances, "u long, v long, d long"))
    comps = components(near.select("u", "v"))
    large = met.where("size > 2").select("key", "node", "n", "size").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = large.withColumns({"lo": F.min("comp").over(w), "hi": F.max("comp").over(w)}).where("lo <> hi").join(sigs, "node")
    joined = tiles(mixed, "key", F.ceil(F.col("size") / TILE).cast("int")).select("key", "i", "j", "side", "node", "n", "comp", "sig")
    families = components(near.select("u", "v").union(joined.mapInArrow(_by_tile(3, _met), "u long, v long")))

    # links: first each node of a family with the nearest of its buckets' smallest; families that this makes one are done
    member = families.join(nodes.select("node", "n"), "node")
    sets = cut(of_ids(docs, member.select("node")).select("doc_id", "text").mapInArrow(_sets, "node long, s binary").distinct())
    nearest = near.groupBy("u").agg(F.min(F.struct("d", "v")).alias("x")).select("u", "x.v")
    pairs = nearest.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v").select("u", "v", "su", "sv")
    stars = cut(pairs.mapInArrow(_similar, "u long, v long"))
    known = components(stars).toDF("node", "known")
    member = cut(member.join(known, "node", "left").withColumn("known", F.coalesce("known", "node")))
    open_ = member.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo <> hi")

    # then all pairs of nodes of the others that aren't linked yet
    parts = F.ceil(F.greatest(F.col("size") / TILE, F.col("total") / SHINGLES)).cast("int")
    members = cut(member.join(open_.select("comp", parts.alias("parts")), "comp").select("node", "comp", "known", "parts"))
    dealt = tiles(sets.join(members, "node"), "comp", F.col("parts")).select("comp", "i", "j", "side", "node", "s", "known")
    final = components(stars.union(dealt.mapInArrow(_by_tile(3, _confirm), "u long, v long")))

    member = nodes.select("set_key", "node").join(final, "node", "left").select("set_key", F.coalesce("comp", "node").alias("component_id"))
    found = base.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(member, "set_key", "left")
    # an id with several texts has the smallest of their components
    named_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", named_id.alias("component_id"), F.coalesce(named_id == F.col("doc_id"), F.lit(True)).alias("kept"))
