"""SimHash near-duplicates, compared bit-sliced.

Fingerprints are made of XXH64 shingle hashes. Distinct fingerprints meet in buckets that share all but four of
their bit blocks: four differing bits leave the others intact, so no link is lost. Larger corpora take more blocks,
for longer keys. A hot bucket is bucketed again by blocks of the bits it does not share. Inside a bucket the
fingerprints are stored as vertical bit planes; carry-save counters add up many distances at once, and blocks of
comparisons are abandoned as soon as all of them exceed the radius. Buckets that are still over `chunk` fingerprints
are dealt out as pairs of chunks, so no task holds a whole hot bucket.

Near copies by similarity (`similar`): sets of five-word shingles with a Jaccard similarity of 0.8 or more lie about ten
bits apart, too far for shared blocks. Their fingerprints meet in buckets of equal least hashes instead, are compared
bit-sliced with a wide radius, and each bucket's spanning forest of least distances is checked on the whole shingle sets.
Where links of that forest fail, the members of the loose component outside its largest sure part are compared with all
of it, so no link within the radius is lost. Whole texts stay in the table they came in: a broadcast filter of bounded
size leaves those of nodes that met another to be shuffled, and the rows that may have to go.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, id_text, map_arrow, settle, texts_of
from .graph import connected_components

SEED, SHINGLE, RADIUS, CHUNK = 42, 4, 4, 1024
SPLIT = 16  # buckets of more chunks are bucketed again
SMALL = 64  # buckets up to this size are compared by shifting the planes of many buckets at once
WORDS, SIMILARITY = 5, 0.8  # of near copies
REACH = 20  # bits; sets of a similarity of 0.8 differ in 10 on average, small ones in 12
PART_BYTES = 16 << 20  # of texts compared in one task; twice that at most, but for single longer texts
BANDS, ROWS = 16, 4  # least hashes: 1 - (1 - 0.8 ** 4) ** 16 = 0.9998 of pairs at 0.8 share a bucket
SIEVE = 20  # 2 ** 20 words at most are broadcast, whatever the number of keys; 64 bits each, one for each key


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it has fewer words; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[s:e], SEED) for s, e in zip(start[: 1 - shingle].tolist(), end[shingle - 1 :].tolist())], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text; 0 if it has no word."""
    return _majority(shingle_hashes(text, shingle))


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        fps = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; null text counts as empty."""
    return map_arrow(id_text(docs), _fingerprints, "doc_id long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes over the fingerprints, packed into 64-bit words: planes[j] holds bit j of each."""
    n = len(fps)
    words = (n + 63) // 64
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


class _Counter:
    """Distances of many comparisons as vertical counters, as wide as the radius, with a sticky overflow, updated carry-save."""

    def __init__(self, over: np.ndarray, radius: int):
        self.over, self.radius = over, radius
        self.planes = [np.zeros_like(over) for _ in range(max(2, radius.bit_length()))]

    def add(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        half = a ^ b
        one, two = half ^ c, (a & b) | (half & c)
        ones, twos = self.planes[:2]
        carry = ones & one
        ones ^= one
        high = (twos & two) | (carry & (twos ^ two))
        twos ^= two ^ carry
        for plane in self.planes[2:]:
            carry = plane & high
            plane ^= high
            high = carry
        self.over |= high

    def beyond(self) -> np.ndarray:
        """Bits of the comparisons over the radius: counter bits compared with the radius from the top."""
        more, same = self.over.copy(), ~self.over
        for at in range(len(self.planes) - 1, -1, -1):
            if self.radius >> at & 1:
                same &= self.planes[at]
            else:
                more |= same & self.planes[at]
                same &= ~self.planes[at]
        return more

    def keep(self, rows: np.ndarray) -> None:
        self.over, self.planes = self.over[rows], [plane[rows] for plane in self.planes]


FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _within(diff, over: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """diff(j, rows): bit j's differences for the blocks `rows`. -> the blocks that last, their hit bits."""
    rows, counter = np.flatnonzero((over != FULL).reshape(len(over), -1).any(axis=1)), _Counter(over, radius)
    counter.keep(rows)
    nothing = None
    for j in range(0, 64, 3):
        a = diff(j, rows)
        if nothing is None or nothing.shape != a.shape:
            nothing = np.zeros_like(a)
        counter.add(a, diff(j + 1, rows) if j + 1 < 64 else nothing, diff(j + 2, rows) if j + 2 < 64 else nothing)
        if j % 9 == 6 or j == 63:
            live = np.flatnonzero((counter.beyond() != FULL).reshape(len(rows), -1).any(axis=1))
            if len(live) < len(rows):
                rows = rows[live]
                counter.keep(live)
            if not len(rows):
                break
    return rows, ~counter.beyond()


def _small_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row i against row i + s for every shift s inside a group; many groups at once."""
    n, planes, a, b = len(fps), _planes(fps), [], []
    words = planes.shape[1]
    wide = np.concatenate([planes, np.zeros((64, 2), np.uint64)], axis=1)
    for s in range(1, SMALL):
        same = np.zeros(words * 64, np.uint8)
        same[: n - s] = group[s:] == group[: n - s]
        if not same.any():
            break
        over = ~np.packbits(same, bitorder="little").view(np.uint64)
        skip, bits = divmod(s, 64)

        def diff(j, rows, skip=skip, bits=bits):
            ahead = wide[j, rows + skip] >> np.uint64(bits)
            if bits:
                ahead |= wide[j, rows + skip + 1] << np.uint64(64 - bits)
            return planes[j, rows] ^ ahead

        rows, hits = _within(diff, over, radius)
        if len(rows):
            at = np.flatnonzero(np.unpackbits(hits.view(np.uint8).reshape(len(rows), 8), axis=1, bitorder="little"))
            i = rows[at // 64] * 64 + at % 64
            a.append(i)
            b.append(i + s)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _least_of(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (i, j) those of a spanning forest of least distances (Kruskal)."""
    up: dict[int, int] = {}
    taken = []
    for at in np.argsort(np.bitwise_count(fps[i] ^ fps[j]), kind="stable").tolist():
        ends = []
        for node in (int(i[at]), int(j[at])):
            while (above := up.get(node, node)) != node:
                up[node] = up.get(above, above)
                node = up[node]
            ends.append(node)
        if ends[0] != ends[1]:
            up[ends[0]] = ends[1]
            taken.append(at)
    return i[taken], j[taken]


def _grown(fps: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of least distances over the links of `near` (Prim)."""
    n, far = len(fps), 255
    best, via, wait = np.full(n, far, np.uint8), np.full(n, -1), np.ones(n, bool)
    i = 0
    for _ in range(n):
        wait[i] = False
        d = np.where(near[i] & wait, np.bitwise_count(fps ^ fps[i]), far)
        closer = d < best
        best[closer], via[closer] = d[closer], i
        left = np.flatnonzero(wait)
        if len(left):
            i = left[np.argmin(best[left])]
    linked = np.flatnonzero(via >= 0)
    return via[linked], linked


def _near(fps: np.ndarray, asks: np.ndarray, radius: int) -> np.ndarray:
    """asks x fps: whether they lie within the radius."""
    n, planes = len(fps), _planes(fps)
    valid = np.zeros(planes.shape[1] * 64, np.uint8)
    valid[:n] = 1
    dead = ~np.packbits(valid, bitorder="little").view(np.uint64)
    near = np.zeros((len(asks), planes.shape[1]), np.uint64)
    for q in range(0, len(asks), 256):
        ask = asks[q : q + 256]
        masks = (np.uint64(0) - ((ask[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)))[:, :, None]
        rows, hits = _within(lambda j, rows, m=masks: planes[j][None, :] ^ m[j, rows], np.broadcast_to(dead, (len(ask), len(dead))).copy(), radius)
        near[q + rows] = hits
    return np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def _large_links(fps: np.ndarray, radius: int, least: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one large group: each query against all planes, 64 at a time."""
    n = len(fps)
    near = _near(fps, fps, radius)
    if least:
        return _grown(fps, near)
    unseen, a, b = np.ones(n, bool), [], []
    for root in range(n):
        if not unseen[root]:
            continue
        unseen[root], stack = False, [root]
        while stack:
            found = np.flatnonzero(near[(i := stack.pop())] & unseen)
            unseen[found] = False
            stack += found.tolist()
            a.append(np.full(len(found), i))
            b.append(found)
    return np.concatenate(a), np.concatenate(b)


def _compare(radius: int, least: bool = False):
    """Rows (four keys, part, fp) -> links of fingerprints; with an id after fp, links of ids, forests of least distances if `least`."""

    def run(batches):
        kept: list[tuple] = []

        def links(*cols):
            *keys, fps = cols[:6]
            ids = cols[-1]
            new = np.flatnonzero(np.any([np.diff(key) != 0 for key in keys], axis=0)) + 1
            bounds = np.concatenate([[0], new, [len(fps)]])
            size = np.diff(bounds)
            group = np.repeat(np.arange(len(size)), size)
            out = []
            if len(small := np.flatnonzero(((size > 1) & (size <= SMALL))[group])):
                i, j = _small_links(fps[small], group[small], radius)
                if least:
                    i, j = _least_of(fps[small], i, j)
                out.append((ids[small][i], ids[small][j]))
            for g in np.flatnonzero(size > SMALL):
                own = fps[bounds[g] : bounds[g + 1]]
                i, j = _large_links(own, radius, least)
                own = ids[bounds[g] : bounds[g + 1]]
                out.append((own[i], own[j]))
            a = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.uint64)
            b = np.concatenate([x for _, x in out]) if out else np.empty(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            cols[5:] = [c.view(np.uint64) for c in cols[5:]]
            if kept:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            other = np.flatnonzero(np.any([key != key[-1] for key in cols[:5]], axis=0)) if len(cols[5]) else []
            cut = other[-1] + 1 if len(other) else 0  # the last group may go on in the next batch
            if cut:
                yield links(*(c[:cut] for c in cols))
            kept = [c[cut:] for c in cols]
        if kept and len(kept[0]):
            yield links(*kept)

    return run


def _block_masks(blocks: int) -> list[int]:
    edge = np.linspace(0, 64, blocks + 1).round().astype(int)
    return [((1 << int(hi)) - 1) ^ ((1 << int(lo)) - 1) for lo, hi in zip(edge, edge[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_for(count: int, radius: int = RADIUS) -> int:
    """The least number of blocks whose keys leave about SMALL of `count` random fingerprints to a bucket."""
    return next(b for b in range(radius + 2, 2 * radius + 1) if b == 2 * radius or 2 ** (64 * (b - radius) // b) * SMALL >= count)


def _dealt(rows: DataFrame, hot: DataFrame, keys: list[str], unit: str = "fp") -> DataFrame:
    """rows(keys, fp[, unit]) with `part`: 0 in a bucket of one chunk, else one row for each pair of chunks that the unit takes part in."""
    mine = F.pmod(F.xxhash64(unit), F.col("n")).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("c", mine)
    others = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: (j != F.col("c")) | (F.col("n") == 1))
    part = F.transform(others, lambda j: F.least(j, F.col("c")).cast("long") * F.lit(1 << 31) + F.greatest(j, F.col("c")))
    return dealt.select(*keys, *dict.fromkeys(("fp", unit)), F.explode(part).alias("part"))


def _hot(rows: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    return settle(rows.groupBy(*keys).count().where(F.col("count") > chunk).select(*keys, F.ceil(F.col("count") / chunk).cast("int").alias("n")), "hot")


def _inner_masks(shared: int, blocks: int) -> list[int]:
    """The bits outside `shared` in `blocks` blocks of about equal size."""
    free = [1 << b for b in range(64) if not shared >> b & 1]
    edge = np.linspace(0, len(free), blocks + 1).round().astype(int)
    return [sum(free[lo:hi]) for lo, hi in zip(edge, edge[1:])]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK, split: int = SPLIT) -> DataFrame:
    """fps(fp long, distinct) -> (a, b): links that span every component of fingerprints at most radius bits apart.

    blocks > radius, by default from the number of fingerprints; each of the C(blocks, blocks - radius) tables buckets
    on blocks - radius equal blocks (6: 21 bits in 15 tables, 7: 27 bits in 35, 8: 32 bits in 70). Buckets of over
    `split` chunks are bucketed again by the bits they do not share, 2 of radius + 2 blocks each.
    """
    blocks = blocks or blocks_for(fps.count(), radius)
    shared = [sum(chosen) for chosen in combinations(_block_masks(blocks), blocks - radius)]
    tables: list[Column] = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("k")) for t, mask in enumerate(shared)]
    rows = fps.select("fp", F.explode(F.array(*tables)).alias("s")).select("s.t", "s.k", "fp")
    keys, hot = ["t", "k", "u", "j"], _hot(rows, ["t", "k"], chunk)
    largest = hot.agg(F.max("n")).first()[0] or 0
    dealt = _dealt(rows, hot, ["t", "k"]) if largest <= split else _dealt(rows.join(hot.where(F.col("n") > split), ["t", "k"], "left_anti"), hot, ["t", "k"])
    ready = dealt.select("t", "k", F.lit(0).alias("u"), F.lit(0).cast("long").alias("j"), "part", "fp")
    if largest > split:
        inner = [(t, u, _signed(sum(two))) for t, mask in enumerate(shared) for u, two in enumerate(combinations(_inner_masks(mask, radius + 2), 2), 1)]
        masks = fps.sparkSession.createDataFrame(inner, "t int, u int, m long")  # C(blocks, radius) * C(radius + 2, 2) rows
        again = rows.join(hot.where(F.col("n") > split).select("t", "k"), ["t", "k"]).join(F.broadcast(masks), "t").select("t", "k", "u", F.col("fp").bitwiseAND(F.col("m")).alias("j"), "fp")
        again = settle(again, "again")
        ready = ready.unionByName(_dealt(again, _hot(again, keys, chunk), keys).select(*keys, "part", "fp"))
    return map_arrow(ready.repartition(*keys, "part").sortWithinPartitions(*keys, "part"), _compare(radius), "a long, b long")


def _labels(distinct: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """distinct(node, rep), roots(node, root) -> settled (node, component_id); the roots' table goes."""
    placed = settle(distinct.join(roots.withColumnRenamed("node", node), node, "left").select(node, "rep", F.coalesce("root", node).alias("root")), "placed")
    forget(roots)
    lowest = settle(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "lowest")
    labels = settle(placed.join(lowest, "root").select(node, "component_id"), "labels")
    forget(placed)
    forget(lowest)
    return labels


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK, split: int = SPLIT) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null text counts as empty; texts without words share fingerprint zero and are linked like any other. Rows
    that repeat keep a row each. An empty table gives an empty result. A null doc_id never becomes a
    component_id unless the whole component has none.
    """
    mine = settle(fingerprints(docs), "fingerprints")
    distinct = settle(mine.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius, blocks, chunk, split))
    labels = _labels(distinct, roots, "fp")
    forget(distinct)
    return mine.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sifted(rows: DataFrame, key: list, keys: DataFrame, sieve: int = SIEVE) -> DataFrame:
    """rows with `__sift_may`: false only where the columns `key` equal no row of `keys`.

    A hash of the key names a bit of a word; the words that have one are broadcast. So rows that cannot be meant need no
    shuffle, however many the keys are: more keys let more others through, and an exact join must follow.
    """
    at = lambda h: F.shiftrightunsigned(h, 64 - sieve).alias("__sift_word")
    bit = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    h = F.xxhash64(*keys.columns)
    words = keys.groupBy(at(h)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(h))).alias("__sift_bits"))
    mine = F.xxhash64(*key)
    found = rows.withColumn("__sift_word", at(mine)).join(F.broadcast(words), "__sift_word", "left")
    return found.withColumn("__sift_may", F.coalesce(F.getbit("__sift_bits", bit(mine)) == 1, F.lit(False)))


def _without(docs: DataFrame, gone: DataFrame, sieve: int = SIEVE) -> DataFrame:
    """The rows of docs whose doc_id is none of gone(doc_id long, settled); only rows that may be are shuffled."""
    rows = _sifted(docs, [F.col("doc_id").cast("long")], gone, sieve)
    stay, rest = rows.where("not __sift_may"), rows.where("__sift_may")
    return stay.select(docs.columns).unionByName(rest.join(gone, "doc_id", "left_anti").select(docs.columns))


def _marked(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with `at`, by which a row is found again: its doc_id, and a hash of its text where that repeats."""
    return docs.withColumn("at", F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")))


def _signatures(shingle: int, bands: int, rows: int):
    draw = np.random.default_rng(SEED)
    mix = draw.integers(0, 1 << 63, (2, bands * rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in batches:
            nodes, fps, keys = [], [], []
            for text in texts_of(batch):
                own = np.unique(shingle_hashes(text, shingle))
                least = np.full(bands * rows, FULL, np.uint64)
                for at in range(0, len(own), 4096):
                    np.minimum(least, ((own[at : at + 4096, None] ^ mix[0]) * mix[1]).min(axis=0), out=least)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                fps.append(_majority(own))
                keys.append([xxhash.xxh64_intdigest(band.tobytes(), SEED) for band in least.reshape(bands, rows)])
            longs = lambda xs: pa.array(np.array(xs, np.uint64).reshape(-1).view(np.int64))
            offsets = pa.array(np.arange(0, bands * len(nodes) + 1, bands, dtype=np.int32))
            cols = [batch.column("doc_id"), batch.column("mark"), longs(nodes), longs(fps), pa.ListArray.from_arrays(offsets, longs(keys))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "node", "fp", "bands"])

    return run


def _alike(shingle: int, similarity: float):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in range(2))
            yes, last, own = [], None, None
            for at, (left, right) in enumerate(zip(texts_of(batch, "ta"), texts_of(batch, "tb"))):
                if a[at] != last:
                    last, own = a[at], np.unique(shingle_hashes(left, shingle))
                other = np.unique(shingle_hashes(right, shingle))
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both / max(1, len(own) + len(other) - both) >= similarity:
                    yes.append(at)
            out = batch.select(["a", "b"]).take(pa.array(yes, pa.int64()))
            yield out

    return run


def _across(shingle: int, similarity: float, radius: int):
    """Rows (node, root, fp, text, asks) of one part -> links of alike nodes of different roots, asking rows against all."""

    def run(part: pa.Table) -> pa.Table:
        node, root, fps, asks = (part.column(c).to_numpy() for c in ("node", "root", "fp", "asks"))
        order = np.lexsort((~asks, node))
        order = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])]
        node, root, fps, asks = node[order], root[order], fps[order].view(np.uint64), asks[order]
        texts, sets = part.column("text"), {}

        def own(i):
            if i not in sets:
                sets[i] = np.unique(shingle_hashes(texts[int(order[i])].as_py() or "", shingle))
            return sets[i]

        up: dict[int, int] = {}

        def top(r):
            while (above := up.get(r, r)) != r:
                up[r] = up.get(above, above)
                r = up[r]
            return r

        who = np.flatnonzero(asks)
        i, j = np.nonzero(_near(fps, fps[who], radius))
        i = who[i]
        apart = root[i] != root[j]
        i, j, a, b = i[apart], j[apart], [], []
        for at in np.argsort(np.bitwise_count(fps[i] ^ fps[j]), kind="stable").tolist():
            x, y = int(i[at]), int(j[at])
            if (left := top(int(root[x]))) != (right := top(int(root[y]))):
                both = len(np.intersect1d(own(x), own(y), assume_unique=True))
                if both / max(1, len(own(x)) + len(own(y)) - both) >= similarity:
                    up[left] = right
                    a.append(node[x])
                    b.append(node[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _met(distinct: DataFrame, radius: int, chunk: int) -> DataFrame:
    """distinct(node, fp, bands) -> settled (a, b): for each bucket a spanning forest of least distances within the radius."""
    rows = distinct.select("node", "fp", F.posexplode("bands").alias("t", "k"))
    dealt = _dealt(rows, _hot(rows, ["t", "k"], chunk), ["t", "k"], "node")
    keys = ["t", "k", "u", "j", "part"]
    ready = dealt.select("t", "k", F.lit(0).alias("u"), F.lit(0).cast("long").alias("j"), "part", "fp", "node")
    met = map_arrow(ready.repartition("t", "k", "part").sortWithinPartitions(*keys), _compare(radius, True), "a long, b long")
    return settle(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "met")


def _parts(placed: DataFrame, chunk: int, part_bytes: int) -> DataFrame:
    """placed(node, loose, root, size, ...) -> its rows as parts (loose, i, j) need them, with `asks`.

    In a loose component of several roots the members outside the largest are dealt to pieces i, all members to chunks
    j; every piece meets every chunk. A component of one root needs nothing.
    """
    roots = placed.groupBy("loose", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    shape = roots.groupBy("loose").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("main"))
    pieces = lambda n, size: F.greatest(F.ceil(n / chunk), F.ceil(size / part_bytes), F.lit(1)).cast("int")
    shape = shape.where("roots > 1").select(
        "loose", F.col("main.root").alias("main"), pieces(F.col("n"), F.col("size")).alias("js"),
        pieces(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("is"),
    )
    rows = placed.join(shape, "loose").withColumn("rest", F.col("root") != F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(11)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = ["loose", "node", "root"]
    asked = rows.where("not rest or js > 1 or `is` > 1").select(*own, every(F.col("is")).alias("i"), place(F.col("js")).alias("j"), F.lit(False).alias("asks"))
    return asked.unionByName(rows.where("rest").select(*own, place(F.col("is")).alias("i"), every(F.col("js")).alias("j"), F.lit(True).alias("asks")))


def _texts_at(docs: DataFrame, ends: DataFrame, sieve: int = SIEVE) -> DataFrame:
    """docs(doc_id, text), ends(node, at, settled) -> (node, text): the text of one row of each node, the others are not shuffled."""
    found = _sifted(_marked(docs), ["at.doc_id", "at.mark"], ends.select("at.doc_id", "at.mark"), sieve).where("__sift_may")
    return found.groupBy("at").agg(F.any_value("text").alias("text")).join(ends, "at").select("node", "text")


def similar_roots(distinct: DataFrame, docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY, radius: int = REACH, chunk: int = CHUNK, part_bytes: int = PART_BYTES) -> DataFrame:
    """distinct(node, at, fp, bands), docs(doc_id, text) -> settled (node, root) of the components of alike nodes.

    Two sets are compared if one of their bands of least hashes is equal and their fingerprints lie within the radius,
    or if links of such pairs join them: whole sets decide. Nodes that met no other do not appear.
    """
    links = _met(distinct, radius, chunk)
    ends = settle(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(distinct.select("node", "at"), "node"), "ends")
    own = settle(_texts_at(docs, ends).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))), "texts")
    forget(ends)
    side = lambda end: own.select(F.col("node").alias(end), F.col("text").alias(f"t{end}"))
    pairs = links.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
    alike = settle(map_arrow(pairs, _alike(shingle, similarity), "a long, b long"), "alike")
    loose, sure = connected_components(links), connected_components(alike)
    forget(links)
    placed = loose.withColumnRenamed("root", "loose").join(sure, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = settle(placed.join(own.select("node", "size"), "node"), "members")
    forget(loose)
    parts = _parts(placed, chunk, part_bytes).join(distinct.select("node", "fp"), "node").join(own.select("node", "text"), "node")
    more = settle(parts.groupBy("loose", "i", "j").applyInArrow(_across(shingle, similarity, radius), "a long, b long"), "across")
    for table in (placed, own):
        forget(table)
    if not more.isEmpty():
        forget(sure)
        sure = connected_components(alike.unionByName(more))
    forget(alike)
    forget(more)
    return sure


def similar(docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY, radius: int = REACH, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, component_id (smallest doc_id reachable by links of such similarity).

    Null text counts as empty; texts without words share the empty set and one component, as do all texts of one
    shingle set. Rows that repeat keep a row each; very long texts are read whole. An empty table gives an empty
    result; other columns are not read. A null doc_id never becomes a component_id unless the whole component has none.
    docs is read twice and must give the same rows; those that share a doc_id are told apart by a 64-bit hash of the text.
    """
    marked = _marked(id_text(docs)).select("doc_id", "text", "at.mark")
    mine = settle(map_arrow(marked, _signatures(shingle, bands, rows), "doc_id long, mark long, node long, fp long, bands array<long>"), "signatures")
    own = [F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "mark")).alias("at"), F.first("fp").alias("fp"), F.first("bands").alias("bands")]
    distinct = settle(mine.groupBy("node").agg(*own), "distinct")
    roots = similar_roots(distinct.select("node", "at", "fp", "bands"), id_text(docs), shingle, similarity, radius, chunk)
    labels = _labels(distinct.select("node", "rep"), roots, "node")
    forget(distinct)
    return mine.join(labels, "node").select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id names their component of `similar`; null and repeated doc_ids as in `keep_one`."""
    return _without(docs, settle(similar(docs, **options).where("doc_id <> component_id").select("doc_id").distinct(), "gone"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id names their component: one document of each near-duplicate group.

    A null doc_id stays. Rows that share a doc_id (which should be unique) stay or go together.
    """
    gone = near_duplicates(docs, **options).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
