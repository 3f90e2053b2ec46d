"""Byte-level BPE encoding and decoding with two tiers of lookup.

A minimal perfect hash of the vocabulary resolves pre-tokens that are whole vocabulary entries; a miss is merged
by a heap of candidate pairs over linked bytes. Results are remembered in bounded caches.
"""

from __future__ import annotations

import base64
import gc
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import id_text, map_arrow, slices, texts_of

RANKS = "byte_bpe_multi_50k.tiktoken"
PRETOKENS, CHUNKS = 400_000, 400_000  # entries of the caches in a worker
SIZE = 24 << 20  # characters in either cache, and of what is looked up at once
GOLD = 0x9E3779B97F4A7C15


class PerfectHash:
    """Minimal perfect hash by displacement: as many slots as keys; a bucket of keys shares one displacement.

    Buckets are placed from large to small; a bucket of one key stores its slot itself, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.n, self.buckets = n, max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slots: list[bytes | None] = [None] * n
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        taken = np.zeros(n, bool)
        tries = np.arange(1, 257, dtype=np.uint64)
        single = []
        for rows in sorted(np.split(order, cut), key=len, reverse=True):
            if len(rows) < 2:
                single += rows.tolist()
                continue
            begin = np.uint64(0)
            while True:
                at = self._slot(hashes[rows][None, :], (tries + begin)[:, None])
                free = ~taken[at].any(axis=1)
                if free.any():
                    for k in np.flatnonzero(free):
                        if len(set(at[k].tolist())) == len(rows):
                            break
                    else:
                        begin += np.uint64(256)
                        continue
                    self.shift[bucket[rows[0]]] = int(tries[k] + begin)
                    taken[at[k]] = True
                    for r, s in zip(rows.tolist(), at[k].tolist()):
                        self.slots[s] = keys[r]
                    break
                begin += np.uint64(256)
        for r, s in zip(single, np.flatnonzero(~taken).tolist()):
            self.shift[bucket[r]] = -s - 1
            self.slots[s] = keys[r]

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(GOLD))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """The slots of keys, all at once; -1 for what is no key."""
        if not keys:
            return []
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        at = np.where(d < 0, -d - 1, self._slot(h, d.astype(np.uint64)))
        slots = self.slots
        return [s if slots[s] == k else -1 for s, k in zip(at.tolist(), keys)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairEncoder:
    """pattern splits a text into pre-tokens; ranks are both merge order and ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.vocabulary[i] = token
        # White space as Rust's engines have it: Python's \s has four control characters more.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.spaces = frozenset(regex.findall(r"\p{White_Space}", "".join(map(chr, range(0x3001)))))
        self.hash = PerfectHash(list(ranks))
        self.ids_at = [ranks[t] for t in self.hash.slots]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.young_size = self.chunks_size = 0

    def merge(self, word: bytes) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left: a heap over linked parts."""
        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if j >= n or not part[i] or rank(part[i] + part[j]) != r:
                continue  # one of the two has been merged since
            part[i] += part[j]
            part[j] = b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank(part[i] + part[k])) is not None:
                    heappush(heap, (x, i))
            if (b := before[i]) >= 0 and (x := rank(part[b] + part[i])) is not None:
                heappush(heap, (x, b))
        return [self.ranks[p] for p in part if p]

    def _learn(self, pretokens: set[str]) -> None:
        if len(self.young) > PRETOKENS or self.young_size > SIZE:
            self.old, self.young, self.young_size = self.young, {}, 0
        missing = []
        for p in pretokens:
            if p not in self.young:
                if (known := self.old.get(p)) is not None:
                    self.young[p] = known
                    self.young_size += len(p)
                else:
                    missing.append(p)
        raw = [p.encode("utf-8") for p in missing]
        for p, b, slot in zip(missing, raw, self.hash.find(raw)):
            self.young[p] = array("I", [self.ids_at[slot]] if slot >= 0 else self.merge(b)).tobytes()
            self.young_size += len(p)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text.

        A text whose pieces between single spaces have no white space at either end is put together from them: a
        pre-token takes one leading space and never crosses another. Other texts are split as a whole.
        """
        plain = [t.split(" ") for t in texts]
        new: dict[str, list[str]] = {}
        whole: dict[int, list[str]] = {}
        if len(self.chunks) > CHUNKS or self.chunks_size > SIZE:
            self.chunks.clear()
            self.chunks_size = 0
        findall, spaces, chunks = self.pattern.findall, self.spaces, self.chunks
        for k, parts in enumerate(plain):
            for c in set(parts).difference(chunks):
                if c not in new:
                    if not c or c[0] in spaces or c[-1] in spaces:
                        whole[k] = findall(texts[k])
                        break
                    new[c] = findall(" " + c)
            if k not in whole and parts[0]:
                whole.setdefault(-k - 1, findall(parts[0]))  # nothing stands before the first piece
        wanted = {p for ps in new.values() for p in ps}
        for ps in whole.values():
            wanted.update(ps)
        self._learn(wanted)
        for c, ps in new.items():
            chunks[c] = b"".join([self.young[p] for p in ps])
            self.chunks_size += len(c)
        out = []
        for k, parts in enumerate(plain):
            if k in whole:
                out.append(b"".join([self.young[p] for p in whole[k]]))
            elif not texts[k]:
                out.append(b"")
            else:
                first = b"".join([self.young[p] for p in whole[-k - 1]])
                out.append(first + b"".join(map(chunks.__getitem__, parts[1:])))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    return _encoders.get((path, pattern)) or _encoders.setdefault((path, pattern), BytePairEncoder(load_ranks(path), pattern))


def _encode(path: str, pattern: str):
    def run(batches):
        collecting = gc.isenabled()
        gc.disable()  # the caches are many small objects without cycles
        try:
            enc = encoder(path, pattern)
            for batch in batches:
                for part in slices(batch, 1 << 17):
                    ids = enc.encode_all(texts_of(part))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        finally:
            if collecting:
                gc.enable()

    return run


def _decode(path: str, pattern: str):
    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, 4 << 20, "ids"):
                ids = part.column(part.schema.get_field_index("ids")).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([enc.decode(i or b"") for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, ids (little-endian unsigned 32-bit). Null text counts as empty: no ids."""
    return map_arrow(id_text(docs), _encode(path, pattern), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, ids, decoded: the bytes the ids stand for."""
    return map_arrow(encoded.select("doc_id", "ids"), _decode(path, pattern), "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded of every row, by encode and decode one after the other in the same worker."""
    first, then = _encode(path, pattern), _decode(path, pattern)
    return map_arrow(id_text(docs), lambda batches: then(first(batches)), "doc_id long, ids binary, decoded binary")
