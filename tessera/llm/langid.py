"""Language identification by n-gram filters with a bitmask of languages.

Each language has a Bloom filter of its characteristic n-grams; the filters are bit-sliced: slot by slot, one word
holds the bits of all languages, so the and of an n-gram's slots is the mask of the languages that contain it.
A text's hits are counted for each language, corrected by the filter's false-positive rate, and compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, texts_of

FOLDS, ORDERS, SLOT_BITS, HASHES = 5, (2, 3, 4), 20, 2
SAMPLE_DOCS = 800  # about so many documents of each language are learnt from, chosen by a hash of doc_id
MIN_COUNT, SHARE, PLANE, CHUNK = 3, 0.3, 64, 1 << 20  # PLANE languages share a 64-bit mask
UNKNOWN = "und"


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or a space if it is no letter (beyond U+FFFF: decided in _letters)."""
    table = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_fold: list[np.ndarray] = []


def _letters(text: str) -> np.ndarray:
    """Folded code points, other characters as single spaces, with a space at either end."""
    if not _fold:
        _fold.append(_fold_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(points) + 2, 32, np.uint32)
    low = points < 0x10000
    if low.all():
        out[1:-1] = _fold[0][points]
    else:
        out[1:-1][low] = _fold[0][points[low]]
        for i in np.flatnonzero(~low):
            if chr(points[i]).isalpha():
                out[i + 1] = points[i]
    return out[(out != 32) | np.concatenate([[True], out[:-1] != 32])]


MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def _grams(letters: np.ndarray):
    """64-bit ids of all n-grams of every order, a chunk of the text at a time."""
    for begin in range(0, max(1, len(letters)), CHUNK):
        part = letters[begin : begin + CHUNK + max(ORDERS) - 1].astype(np.uint64)
        for n in ORDERS:
            size = min(CHUNK, len(part) - n + 1)
            if size <= 0:
                continue
            h = np.full(size, np.uint64(n) * STEP)
            for k in range(n):
                h ^= part[k : k + size]
                h *= MIX
                h ^= h >> np.uint64(29)
            yield h * STEP


def _slots(ids: np.ndarray) -> list[np.ndarray]:
    return [((ids >> np.uint64(64 - SLOT_BITS * (k + 1))) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """languages, most frequent first, and their bit-sliced filters."""

    def __init__(self, languages: list[str], members: list[np.ndarray]):
        self.languages = languages
        self.tables, fill = [], []
        for begin in range(0, len(languages), PLANE):
            own = members[begin : begin + PLANE]
            width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= len(own))
            table = np.zeros(1 << SLOT_BITS, width)
            for bit, ids in enumerate(own):
                for at in _slots(ids):
                    table[at] |= width(1 << bit)
            fill += [((table >> width(b)) & width(1)).mean() for b in range(len(own))]
            self.tables.append(table)
        self.false_positive = np.array(fill) ** HASHES

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        letters, count, total = _letters(text), np.zeros(len(self.languages)), 0
        for ids in _grams(letters):
            first, *rest = _slots(ids)
            for plane, table in enumerate(self.tables):
                mask = table[first]
                for at in rest:
                    mask &= table[at]
                own = count[plane * PLANE : (plane + 1) * PLANE]
                bits = np.arange(len(own), dtype=np.uint64)
                values, n = (np.arange(256), np.bincount(mask, minlength=256)) if mask.dtype == np.uint8 else np.unique(mask, return_counts=True)
                own += n @ ((values[:, None].astype(np.uint64) >> bits) & np.uint64(1)).astype(np.float64)
            total += len(ids)
        return count, total

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not any(map(str.isalpha, text[:200])) and not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        count, total = self.hits(text)
        true = np.clip((count - total * self.false_positive) / (1 - np.minimum(self.false_positive, 0.999)), 0, None)
        best = int(true.argmax())
        rest = np.delete(true, best).max(initial=0.0)
        return self.languages[best], float(true[best] / (true[best] + rest)) if true[best] > 0 else 0.0


def fold_of(folds: int = FOLDS):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def _count_grams(batches):
    for batch in batches:
        langs, grams, counts = [], [], []
        texts = texts_of(batch)
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(2).to_pylist(), texts):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            parts = [ids for text in own for ids in _grams(_letters(text))]
            if parts:
                ids, n = np.unique(np.concatenate(parts), return_counts=True)
                langs += [lang] * len(ids)
                grams.append(ids)
                counts.append(n)
        ids = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        n = np.concatenate(counts) if counts else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def learn(docs: DataFrame, lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Filters from the documents outside the held-out fold that have a text and a language.

    An n-gram belongs to a language if its share of that language's n-grams is at least SHARE of its largest share
    in any. Bound: about sample_docs documents of each language.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    base = base.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold_of() != 0))
    sizes = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not sizes:
        return Filters([], [])
    scale = 1 << 30
    bounds = base.sparkSession.createDataFrame([(lang, min(scale, sample_docs * scale // n)) for lang, n in sizes.items()], "lang string, bound long")
    bound = F.col("bound")
    sample = base.join(F.broadcast(bounds), "lang").select("doc_id", "text", "lang", "bound").where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < bound)
    counted = map_arrow(sample, _count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    rows = counted.toArrow()
    lang, gram, n = (rows.column(k).to_numpy() for k in range(3))
    languages = [x for x in sizes]
    number = {x: k for k, x in enumerate(languages)}
    code = np.array([number[x] for x in lang], np.int64) if len(lang) else np.empty(0, np.int64)
    ids, at = np.unique(gram.astype(np.int64), return_inverse=True)
    share = np.zeros((len(languages), len(ids)))
    share[code, at] = n
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1)
    top = share.max(axis=0, initial=0)
    return Filters(languages, [ids[(share[b] > 0) & (share[b] >= SHARE * top)].astype(np.int64).view(np.uint64) for b in range(len(languages))])


def _predict(filters: Filters):
    def run(batches):
        for batch in batches:
            found = [filters.predict(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    `und` with score 0 for a null text, one without letters, or if nothing was learnt. Ties go to the language with
    more documents, then by name; a text none of whose n-grams is known gets the first language with score 0.
    """
    rows = id_text(docs).withColumn("held_out", F.coalesce(fold_of() == 0, F.lit(False)))
    return map_arrow(rows, _predict(filters), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep(filters: Filters):
    def run(batches):
        for batch in batches:
            mask = pa.array([filters.predict(t)[1] > 0 for t in texts_of(batch)], pa.bool_())
            yield batch.filter(mask)

    return run


def keep_identified(docs: DataFrame, filters: Filters) -> DataFrame:
    """The rows of docs, all columns, whose language can be told; the others (`und`, or no n-gram known) go."""
    return map_arrow(docs, _keep(filters), docs.schema)
