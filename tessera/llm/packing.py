"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so the packing needs only the histogram of piece lengths, whose size
does not grow with the corpus. Patterns are built on it: a bin is filled greedily with the largest pieces that
fit; then its smallest piece is replaced by two unpacked ones if they fill the expanded gap more tightly; the
pattern is used as often as the histogram allows. Pieces then find their place by their rank within their length:
rank = pieces of that length in earlier partitions (a join) + rank within the partition (counted while
tokenising). No length class is gathered in one task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_text, map_arrow, settle, texts_of

CAPACITY, END = 4096, 1
TOKENIZER = "word_bpe_49k.json"
BASES = 300_000  # rows (of three numbers) of the table of bases that may be broadcast
SPACES = "\t\n\r\x0b\x0c\x85\xa0"  # what the tokenizer drops below U+0100, besides the space
# Below U+0100: single numbers, runs of what is neither letter, number nor white space, and both with contractions before.
NUMBERS = "[0-9\xb2\xb3\xb9\xbc-\xbe]"
RUNS = "[\x00-\x08\x0e-\x1f!-/:-@\\[-`{-\x84\x86-\x9f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7]+"
PARTS = re.compile(f"('(?:s|t|re|ve|m|ll|d)|{NUMBERS}|{RUNS})")
NUMBERS, RUNS = re.compile(f"({NUMBERS})"), re.compile(f"({RUNS})")
WIDE, BREAK = re.compile("[^\x00-\xff]"), re.compile("[ \n]")
LONGEST = 512  # bytes of a word


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them, most of it done by the faster tiktoken.

    A token never crosses white space and the vocabulary marks the end of a word. So a text is lower-cased, every
    word, number and run of punctuation gets one space behind it, and that space plays the end mark: the
    vocabulary becomes byte strings, ranked by its own merge order with "byte + end" first. Two parts can only
    join into a string by the merge that made it, because every entry encodes to itself (tested), so both
    libraries give the same ids. That reading holds for characters below U+0100; chunks between white space with
    others, and texts with words over LONGEST bytes, whose time grows with the square there, are left to the
    tokenizers library.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        byte_of = _byte_alphabet()

        def raw(token: str) -> bytes:
            end = token.endswith(mark)
            return bytes(byte_of[c] for c in (token[: -len(mark)] if end else token)) + b" " * end

        order = [c for c in byte_of] + [c + mark for c in byte_of] + [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        ranks: dict[bytes, int] = {}
        for token in order:
            ranks.setdefault(raw(token), len(ranks))
        ids = {raw(token): i for token, i in vocab.items() if not token.startswith("Ġ")}
        self.id_of = np.array([ids.get(token, 0) for token in ranks], "<u4")
        stop = len(ranks)  # a special token no text may use; without one the library searches for an empty string
        self.core = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={"<\x00>": stop})._core_bpe

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _narrow(self, text: str) -> bytes:
        """Ids of a text of characters below U+0100."""
        text = text.lower()
        for space in SPACES:
            text = text.replace(space, " ")
        for parts in (PARTS,) if "'" in text else (NUMBERS, RUNS):
            text = " ".join(parts.split(text))
        ready = text + " "
        at = np.flatnonzero(np.frombuffer(ready.encode(), np.uint8) == 32)
        if np.diff(at, prepend=-1).max() > LONGEST:
            return self._library([text])[0]
        return self.id_of[np.frombuffer(self.core.encode_to_tiktoken_buffer(ready, set()), np.uint32)].tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not WIDE.search(text):
            return self._narrow(text)
        runs, wide, at = [], [], 0
        while m := WIDE.search(text, at):
            begin = max(at, *(text.rfind(space, at, m.start()) + 1 for space in " \n"))
            stop = BREAK.search(text, m.start())
            stop = stop.start() if stop else len(text)
            runs.append(text[at:begin])
            wide.append(text[begin:stop])
            at = stop
        pairs = zip(map(self._narrow, runs), self._library(wide))
        return b"".join([part for pair in pairs for part in pair] + [self._narrow(text[at:])])


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: themselves if visible, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


_encoders: dict[str, WordEncoder] = {}


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        part, ranks = TaskContext.get().partitionId(), defaultdict(int)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, texts_of(batch)):
                blob = encoder.encode(text) + last
                for k in range(0, len(blob), 4 * capacity):
                    piece = blob[k : k + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((doc_id, k // (4 * capacity), k // 4, n, zlib.crc32(piece), part, ranks[n]))
                    ranks[n] += 1
            cols = list(zip(*rows)) if rows else [()] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "own_rank"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenised documents cut into pieces; only documents over the capacity are cut."""
    return map_arrow(id_text(docs), _pieces(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long, part long, own_rank long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Histogram of lengths -> [(times, [(length, copies in a bin), largest first])] by best-two-fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    patterns = []
    while (open_ := np.flatnonzero(left)).size:
        take: dict[int, int] = {}
        gap, free = capacity, left.copy()
        while gap and (fits := open_[: np.searchsorted(open_, gap, "right")]).size:
            fits = fits[free[fits] > 0]
            if not fits.size:
                break
            best = int(fits[-1])
            n = int(min(free[best], gap // best))
            take[best] = take.get(best, 0) + n
            free[best] -= n
            gap -= n * best
        if gap:
            small = min(take)
            wide = gap + small
            idx = np.arange(wide + 1)
            pred = np.maximum.accumulate(np.where(free[: wide + 1] > 0, idx, 0))
            a = np.flatnonzero(free[: wide + 1] > 0)
            if a.size:
                b = pred[wide - a]
                twin = (b == a) & (free[a] < 2)
                b[twin] = pred[np.maximum(a[twin] - 1, 0)]
                total = np.where(b > 0, a + b, 0)
                k = int(total.argmax())
                if total[k] > small:
                    take[small] -= 1
                    for x in (int(a[k]), int(b[k])):
                        take[x] = take.get(x, 0) + 1
        take = {length: n for length, n in take.items() if n}
        times = int(min(left[length] // n for length, n in take.items()))
        for length, n in take.items():
            left[length] -= times * n
        patterns.append((times, sorted(take.items(), reverse=True)))
    return patterns


def _slots(patterns) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> arrays by first rank: (first rank, first sequence, copies in a bin, first offset)."""
    out, used, sequence = defaultdict(list), defaultdict(int), 0
    for times, items in patterns:
        offset = 0
        for length, n in items:
            out[length].append((used[length], sequence, n, offset))
            used[length] += times * n
            offset += n * length
        sequence += times
    return {length: tuple(map(np.array, zip(*rows))) for length, rows in out.items()}


def _place(slots):
    def run(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, begins = np.unique(length[order], return_index=True)
            for value, rows in zip(values, np.split(order, begins[1:])):
                first, sequence, n, offset = slots[int(value)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                r = rank[rows] - first[k]
                seq[rows] = sequence[k] + r // n[k]
                off[rows] = offset[k] + r % n[k] * value
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(5)] + [pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty; an empty text is one piece, the end id. Repeated rows are packed one by one; pieces
    of equal length take places in the order of partitions. An empty table gives an empty result.
    """
    cut = settle(pieces(docs, tokenizer, capacity, end), "pieces")
    counts = settle(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = settle(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    base = F.broadcast(base) if base.count() <= BASES else base.hint("merge")
    ranked = cut.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own_rank")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(ranked, _place(_slots(plan(histogram, capacity))), schema)
