"""Byte-level BPE encoding and decoding in padded numpy matrices.

A text is cut by the pattern of the vocabulary; distinct pieces that are no token themselves are put, by length, as rows
of byte tokens into padded matrices. Each round every row merges its leftmost pair of minimum rank, looked up in a hash
table of pairs, and closes the gap; rows without a pair that merges are done. Pieces are kept for later texts in a store
of bounded size, which is emptied when full.

Cases: null or empty text has no tokens and decodes to no bytes; whole texts and pieces of any length are encoded (a long
piece has its own matrix, so memory follows its length); control strings of a vocabulary are ordinary text; repeated rows
are encoded each; an empty table gives an empty result; a column with the name of a result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches

#: Pieces kept in a worker, bytes of text handled at once, and rows x width of a matrix.
STORE, SLICE, CELLS = 80_000, 1_000_000, 1 << 18
NONE = np.int32(2**31 - 1)


class Pairs:
    """Ids of merged pairs (left, right), by open addressing; NONE where a pair doesn't merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(len(merged) * 4 + 1))))
        keys = self._key(left, right)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, NONE, np.int32)
        self.probes, todo, at = 0, np.arange(len(keys)), self._slot(keys)
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] == 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at[todo], return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[at[put]], self.ids[at[put]] = keys[put], merged[put]
            todo = todo[~(free & first)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) + right.astype(np.uint64) + np.uint64(1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        at, out = self._slot(keys), np.full(keys.shape, NONE, np.int32)
        open_ = np.arange(keys.size)
        at, keys, flat = at.ravel(), keys.ravel(), out.reshape(-1)
        for _ in range(self.probes):
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            flat[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (seen != 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out


class Codec:
    """Ranks of a vocabulary as (bytes, id), ids being the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = Pairs(*np.array(splits, np.int64).T.reshape(3, -1))
        top = max(ranks.values()) + 1
        self.size = np.zeros(top, np.int64)
        for t, r in ranks.items():
            self.size[r] = len(t)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.zeros(int(self.size.sum()), np.uint8)
        for t, r in ranks.items():
            self.bytes[self.start[r] : self.start[r] + len(t)] = np.frombuffer(t, np.uint8)
        self.store: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, file: bytes, pattern: str) -> Codec:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}, pattern)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            # a bucket of pieces at most a quarter longer than its shortest, in matrices of bounded size
            least = sizes[order[at]]
            end = int(np.searchsorted(sizes[order], max(least, least * 5 // 4), side="right"))
            end = min(end, at + max(1, CELLS // max(1, int(sizes[order[end - 1]]))))
            rows = order[at:end]
            for k, ids in zip(rows, self._rounds([pieces[k] for k in rows]), strict=True):
                out[k] = ids
            at = end
        return out

    def _rounds(self, pieces: list[bytes]) -> list[np.ndarray]:
        n = np.array([len(p) for p in pieces])
        width = int(n.max())
        ids = np.full((len(pieces), width + 1), -1, np.int64)
        ids[:, :width][np.arange(width) < n[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width + 1), NONE, np.int32)
        both = ids[:, 1:] >= 0
        rank[:, :-1][both] = self.pairs.find(ids[:, :-1][both], ids[:, 1:][both])
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        live = np.arange(len(pieces))
        while len(live):
            at = rank.argmin(axis=1)
            row = np.arange(len(live))
            best = rank[row, at]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[live[k]] = ids[k, : n[k]].astype(np.int32)
                go = ~done
                live, ids, rank, n, at, best = live[go], ids[go], rank[go], n[go], at[go], best[go]
                if not len(live):
                    break
                width = int(n.max()) + 1
                ids, rank, row = ids[:, :width].copy(), rank[:, :width].copy(), np.arange(len(live))
            ids[row, at] = best
            # close the gap: what is right of the pair moves one to the left
            right = np.arange(ids.shape[1] - 1) > at[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=right)
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=right)
            ids[:, -1], rank[:, -1] = -1, NONE
            n = n - 1
            for where in (at, at - 1):
                ok = np.flatnonzero((where >= 0) & (where + 1 < n))
                rank[row[ok], where[ok]] = self.pairs.find(ids[row[ok], where[ok]], ids[row[ok], where[ok] + 1])
            ends = np.flatnonzero(at + 1 >= n)
            rank[ends, at[ends]] = NONE
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.store) > STORE:
            self.store = {}
        new = list({p for pieces in cut for p in pieces}.difference(self.store))
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        whole = [self.ranks.get(b) for b in raw]
        self.store.update((p, np.array([r], np.int32)) for p, r in zip(new, whole, strict=True) if r is not None)
        rest = [k for k, r in enumerate(whole) if r is None]
        self.store.update(zip((new[k] for k in rest), self.merge([raw[k] for k in rest]), strict=True))
        store, none = self.store, np.empty(0, np.int32)
        return [np.concatenate([store[p] for p in pieces]) if pieces else none for pieces in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + size, size)].tobytes()


_codecs: dict[str, Codec] = {}


def _codec(file: bytes, pattern: str) -> Codec:
    key = hashlib.blake2b(file + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec.of(file, pattern)
    return _codecs[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes."""
    sizes = np.array(texts.to_pandas().str.len().fillna(0), np.int64) if len(texts) else np.empty(0, np.int64)
    block = np.cumsum(sizes) // SLICE
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(sizes)]))
    yield from ((int(a), int(z)) for a, z in zip(cuts, cuts[1:], strict=False) if z > a)


def _vocabulary(df: DataFrame, path: str):
    modest_batches(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", exact: str | None = None) -> DataFrame:
    """docs with the token ids of their texts, array<int>; `exact` names a column that tells whether the decoded ids are the text."""
    file = _vocabulary(docs, path)
    docs = docs.drop(ids, *[exact] * (exact is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in _slices(b.column(text)):
                part = b.slice(a, z - a)
                found = _codec(file.value, pattern).encode(part.column(text).to_pylist())
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))]
                if exact is not None:
                    texts = part.column(text).to_pylist()
                    made.append(pa.array([_codec(file.value, pattern).decode(x) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(found, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, ids, *[exact] * (exact is not None)])

    out = docs.withColumn(ids, F.array().cast("array<int>"))
    return docs.mapInArrow(run, (out if exact is None else out.withColumn(exact, F.lit(True))).schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for."""
    file = _vocabulary(df, path)
    df = df.drop(decoded) if decoded in df.columns else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codec, rows = _codec(file.value, pattern), b.column(ids)
            out = [codec.decode(np.asarray(rows[k].values)) if rows[k].is_valid else None for k in range(len(rows))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, decoded])

    return df.mapInArrow(run, df.withColumn(decoded, F.lit(None).cast("binary")).schema)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded from the ids, without sending either back."""
    file = _vocabulary(docs, path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in _slices(b.column(1)):
                part, codec = b.slice(a, z - a), _codec(file.value, pattern)
                found = codec.encode(part.column(1).to_pylist())
                n = [len(x) for x in found]
                spelled = [hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in found]
                decoded = [hashlib.sha256(codec.decode(x)).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(spelled), pa.array(decoded)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
