"""Log-bilinear language model over a tree of words, trained with noise-contrastive estimation.

Counts of all training tokens are made on the cluster. Every word of the vocabulary (the HEAD most frequent ones)
belongs to a class of neighbours in frequency, and every class to a branch; one more class holds all other words.
P(word) is P(branch) times P(class | branch) times P(word | class), each log-bilinear in the two words before, with
a vector for every branch, class and word; in the last class a word has its smoothed share. All training tokens are
gone through once, in the tasks, with noise-contrastive estimation in numpy. Documents are dealt to rounds by a
hash; after a round the tasks' changes are averaged and the next one goes on from there, so the steps grow with the
corpus. Scores are batched matrix products, normalised on each of the three levels.

Counts of frequent words go to the tasks as a bounded table; tokens outside it meet their counts in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle, texts_of

FOLDS, BRANCHES, DIM = 10, 32, 16
CLASSES = BRANCHES * 32
HEAD = 1 << 17  # at most so many counted words are sent to the tasks
END = b" "  # the end token; no word has a space
FLUSH = 300_000
PORTION, STRETCH = 1 << 19, 1 << 17  # characters and tokens at a time
ROUNDS = (1, 3)  # parts of the training documents that the rounds take
BATCH, NOISE, RATE, SEED = 16384, 2, 0.15, 5  # noise outcomes a token and level
BLOCK, SPREAD = 512, 64  # rows of a table that travel together; tasks that add them up


def words_of(text: str) -> list[bytes]:
    """bytes.lower() lower-cases A-Z only, and bytes.split() splits at space and 09-0D only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def prepared(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held)


def _count_words(batches):
    counts: Counter = Counter()

    def out():
        rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return rows

    for batch in batches:
        for text in texts_of(batch):
            counts.update(words_of(text))
            if len(counts) > FLUSH:
                yield out()
        counts[END] += batch.num_rows
    if counts:
        yield out()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n, bin) of all training tokens, ends included; bin rises with n, four to an octave."""
    counts = map_arrow(train.select("text"), _count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return settle(counts.where("n > 0").withColumn("bin", F.floor(F.log2("n") * 4).cast("int")), "word-counts")


class Vocabulary:
    """The frequent words with their counts, and the totals."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, distinct: int):
        order = sorted(range(len(words)), key=lambda i: (words[i] != END, -counts[i], words[i]))  # the end is class 0
        self.tokens, self.distinct = tokens, distinct
        self.rank = {words[i]: k for k, i in enumerate(order)}
        self.counts = counts[order].astype(np.float64) if len(order) else np.empty(0)
        if not order or words[order[0]] != END:
            self.rank = {END: 0, **{w: k + 1 for w, k in self.rank.items()}}
            self.counts = np.concatenate([[0.0], self.counts])
        self.log_count = np.log10(self.counts + 0.1)
        weight = np.sqrt(self.counts + 0.1)  # classes are runs of ranks with equal sums of these
        before = (np.cumsum(weight) - weight) / weight.sum()
        self.class_of = np.append((before * (CLASSES - 1)).astype(np.int64), CLASSES - 1)  # the last entry: any other word
        self.edge = np.searchsorted(self.class_of[:-1], np.arange(CLASSES))  # class k has the ranks edge[k] to edge[k + 1] - 1
        self.rest_tokens = tokens - int(self.counts.sum())
        self.rest_distinct = distinct - int((self.counts > 0).sum())
        mass = np.bincount(self.class_of[:-1], self.counts + 0.1, CLASSES) + 0.1
        mass[-1] += max(0, self.rest_tokens)
        size = CLASSES // BRANCHES
        #: level -> (first member of each group, mass of each member): branches, classes by branch, words by class
        self.levels = {
            "qs": (np.array([0, BRANCHES]), mass.reshape(BRANCHES, size).sum(axis=1)),
            "qc": (np.arange(BRANCHES + 1) * size, mass),
            "q": (np.append(self.edge[:-1], [len(self.counts)] * 2), self.counts + 0.1),
        }

    @property
    def log_total(self) -> float:
        return math.log10(self.tokens + 0.1 * (self.distinct + 1))

    @property
    def log_rest(self) -> float:
        return math.log10(self.rest_tokens + 0.1 * (self.rest_distinct + 1))

    def codes(self, texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """Words of each text with the end, ranks of all tokens (-1: not here), index of each text's first token."""
        words = [[*words_of(t), END] for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        ranks = np.fromiter(map(self.rank.get, flat, repeat(-1)), np.int64, len(flat))
        return words, ranks, np.cumsum(sizes) - sizes

    def share(self, level: str) -> np.ndarray:
        """Share of each member in its group's mass."""
        edge, mass = self.levels[level]
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        return mass / np.bincount(group, mass, len(edge) - 1)[group]

    def paths(self, ranks: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """level -> (group, member) of tokens sorted by class; the words of the last class, at the end, have no third level."""
        cls = self.class_of[ranks]
        branch, inner = cls // (CLASSES // BRANCHES), int(np.searchsorted(cls, CLASSES - 1))
        return {"qs": (np.zeros_like(branch), branch), "qc": (branch, cls), "q": (cls[:inner], ranks[:inner])}

    def before(self, ranks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the last and second last token before each (-1: not here); before a text stand two ends."""
        one, two = np.zeros_like(ranks), np.zeros_like(ranks)
        one[1:] = ranks[:-1]
        two[2:] = ranks[:-2]
        one[first] = 0
        two[first] = 0
        second = first[first + 1 < len(ranks)] + 1
        two[second] = 0
        return one, two


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary with its lowest bin: the most frequent words, HEAD at most."""
    bins = {r["bin"]: (r["words"], r["tokens"]) for r in counts.groupBy("bin").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect()}
    lowest, words = 1 << 20, 0
    for b in sorted(bins, reverse=True):
        words += bins[b][0]
        if words > HEAD:
            break
        lowest = b
    head = counts.where(F.col("bin") >= lowest).select("word", "n").toArrow()
    return Vocabulary(head.column(0).to_pylist(), head.column(1).to_numpy(), sum(t for _, t in bins.values()), sum(w for w, _ in bins.values())), lowest


def _portions(texts: list[str]):
    begin = used = 0
    for i, t in enumerate(texts):
        used += len(t)
        if used > PORTION:
            yield texts[begin : i + 1]
            begin, used = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def _log_softmax_at(ahead: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log of the softmax of each row of ahead @ table.T at one column."""
    score = ahead @ table.T
    own = score.reshape(-1).take(np.arange(0, score.size, len(table)) + at).astype(np.float64)
    np.exp(score, out=score)
    total = score @ np.ones(len(table), np.float32)
    if not (total.min() > 0 and total.max() < np.inf):  # beyond the range of float32
        score = ahead @ table.T
        most = score.max(axis=1, keepdims=True)
        total, own = np.exp(score - most).sum(axis=1), own - most[:, 0]
    return own - np.log(total)


class LogBilinear:
    """Tables r (context; the last row is any other word), q (word in its class), qc (class in its branch), qs (branch), m1 and m2 (one and two words before).

    The score of a member of a group is (r[one] @ m1 + r[two] @ m2) . q plus a bias, q's last column.
    """

    NAMES = ("r", "q", "qc", "qs", "m1", "m2")

    def __init__(self, vocab: Vocabulary):
        rng = np.random.default_rng(SEED)
        tables = {"r": rng.normal(0, 0.3, (len(vocab.counts) + 1, DIM)), "m1": np.eye(DIM), "m2": np.eye(DIM) / 2}
        for name, (_, mass) in vocab.levels.items():
            tables[name] = np.concatenate([rng.normal(0, 0.02, (len(mass), DIM)), np.log(vocab.share(name))[:, None]], axis=1)
        self.p = {k: v.astype(np.float32) for k, v in tables.items()}

    def copy(self) -> "LogBilinear":
        out = LogBilinear.__new__(LogBilinear)
        out.p = {k: v.copy() for k, v in self.p.items()}
        return out

    def ahead(self, r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
        """What the contexts expect, with a one for the bias."""
        out = np.ones((len(r1), DIM + 1), np.float32)
        out[:, :DIM] = r1 @ self.p["m1"] + r2 @ self.p["m2"]
        return out

    def log_probabilities(self, vocab: Vocabulary, ranks: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 P(word | context), of the class alone for words not here; sums to one over the tree."""
        order = np.argsort(vocab.class_of[ranks].astype(np.uint16), kind="stable")
        ranks = ranks[order]
        ahead = self.ahead(self.p["r"].take(one[order], axis=0), self.p["r"].take(two[order], axis=0))
        logs = np.zeros(len(order))
        for name, (group, member) in vocab.paths(ranks).items():
            edge, table = vocab.levels[name][0], self.p[name]
            begin = np.flatnonzero(np.diff(group, prepend=-1))
            for s, e, lo, hi in zip(*(x.tolist() for x in (begin, np.append(begin[1:], len(group)), edge[group[begin]], edge[group[begin] + 1]))):
                for s in range(s, e if hi - lo > 1 else s, 4096):
                    own = slice(s, min(s + 4096, e))
                    logs[own] += _log_softmax_at(ahead[own], table[lo:hi], member[own] - lo)
        out = np.empty(len(order))
        out[order] = logs / math.log(10)
        return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Pass:
    """One task's way through its tokens: AdaGrad from the given model."""

    def __init__(self, vocab: Vocabulary, model: LogBilinear, seed: int):
        self.vocab, self.model, self.rng = vocab, model.copy(), np.random.default_rng([SEED, seed])
        self.square = {k: np.ones(len(v), np.float32) for k, v in model.p.items()}
        self.used = {k: np.zeros(len(v), np.float32) for k, v in model.p.items()}
        self.cumulated = {k: np.concatenate([[0.0], np.cumsum(mass)]) for k, (_, mass) in vocab.levels.items()}
        self.offset = {k: np.log(NOISE * vocab.share(k)).astype(np.float32) for k in vocab.levels}
        self.seen, self.place = np.zeros(len(model.p["r"]), bool), np.zeros(len(model.p["r"]), np.int64)

    def _move(self, name: str, own, total: np.ndarray, times) -> None:
        """One step of the rows own; total has a column for each."""
        square = self.square[name][own] + np.einsum("dn,dn->n", total, total) / len(total)
        self.square[name][own] = square
        table = self.model.p[name]
        table[own] = (table.take(own, axis=0) if isinstance(own, np.ndarray) else table) + (total * (RATE / np.sqrt(square))).T
        self.used[name][own] += times

    def _distinct(self, *at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Distinct indices of all, and the places of each among them."""
        for a in at:
            self.seen[a] = True
        own = np.flatnonzero(self.seen)
        self.seen[own] = False
        self.place[own] = np.arange(len(own))
        return own, [self.place.take(a) for a in at]

    def learn(self, ranks: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        for s in range(0, len(ranks), BATCH):
            order = s + self.rng.permutation(min(BATCH, len(ranks) - s))
            order = order[np.argsort(self.vocab.class_of[ranks[order]].astype(np.uint16), kind="stable")]
            self._step(ranks[order], one[order], two[order])

    def _step(self, ranks, one, two) -> None:
        """One step on tokens sorted by class, so that every level's groups are runs."""
        p, n, paths, moves = self.model.p, len(ranks), self.vocab.paths(ranks), []
        r1, r2 = p["r"].take(one, axis=0), p["r"].take(two, axis=0)
        ahead = self.model.ahead(r1, r2)
        back = np.ascontiguousarray((self._contrast_few("qs", ahead, *paths["qs"], moves) + self._contrast_few("qc", ahead, *paths["qc"], moves)).T)
        if inner := len(paths["q"][0]):
            back[:, :inner] += self._contrast("q", np.ascontiguousarray(ahead[:inner].T), *paths["q"], moves)
        back = back[:DIM]
        own, at = self._distinct(one % len(p["r"]), two % len(p["r"]))
        moves.append(("r", own, p["m1"] @ _sum_columns(back, at[0], len(own)) + p["m2"] @ _sum_columns(back, at[1], len(own)), sum(np.bincount(a, minlength=len(own)) for a in at)))
        moves += [(name, slice(None), back @ rows, n) for name, rows in (("m1", r1), ("m2", r2))]
        for move in moves:
            self._move(*move)

    def _outcomes(self, name, group, member, begin, last) -> list[np.ndarray]:
        """The member and NOISE noise members for each token.

        Each token draws one member of its group by its share and meets those of the NOISE - 1 tokens after it as
        well, in a circle inside the group, so noise costs one look-up a token.
        """
        edge, cumulated, n = self.vocab.levels[name][0], self.cumulated[name], len(group)
        lo, hi = edge[group], edge[group + 1]
        draw = cumulated[lo] + self.rng.random(n) * (cumulated[hi] - cumulated[lo])
        fakes = [np.clip(np.searchsorted(cumulated, draw, "right") - 1, lo, hi - 1)]
        for _ in range(1, NOISE):
            fakes.append(_turned(fakes[-1], begin, last))
        return [member, *fakes]

    def _contrast_few(self, name, ahead, group, member, moves) -> np.ndarray:
        """Members against noise of their group, for groups of few members: products with whole groups need no row of its own for each token.

        Adds the table's gradient to moves, returns the one of ahead.
        """
        edge, table, offset, n = self.vocab.levels[name][0], self.model.p[name], self.offset[name], len(group)
        (begin, last), width = _runs(group), int(edge[1])
        outcomes = self._outcomes(name, group, member, begin, last)
        runs = [(slice(s, e + 1), slice(edge[group[s]], edge[group[s] + 1])) for s, e in zip(begin, last)]
        score, weight = np.empty((n, width), np.float32), np.zeros((n, width), np.float32)
        for own, here in runs:
            np.matmul(ahead[own], table[here].T, out=score[own])
        first = np.arange(n) * width - edge[group]
        for k, at in enumerate(outcomes):
            cell = first + at
            weight.reshape(-1)[cell] += (k == 0) - _logistic(score.reshape(-1).take(cell) - offset[at])
        back, total = np.empty_like(ahead), np.zeros_like(table)
        for own, here in runs:
            np.matmul(weight[own], table[here], out=back[own])
            np.matmul(weight[own].T, ahead[own], out=total[here])
        moves.append((name, slice(None), total.T, np.bincount(outcomes[0], minlength=len(table)) + np.bincount(outcomes[1], minlength=len(table))))
        return back

    def _contrast(self, name, ahead, group, member, moves) -> np.ndarray:
        """The same for groups of any size, by the rows drawn; ahead and the result have a column for each token."""
        table, offset = self.model.p[name], self.offset[name]
        begin, last = _runs(group)
        member, *fakes = self._outcomes(name, group, member, begin, last)
        rows = lambda at: np.ascontiguousarray(table.take(at, axis=0).T)
        good, bad, met = rows(member), rows(fakes[0]), []
        pull = 1 - _logistic(np.einsum("dn,dn->n", ahead, good) - offset[member])
        back = pull * good
        for fake in fakes:
            push = -_logistic(np.einsum("dn,dn->n", ahead, bad) - offset[fake])
            back += push * bad
            met.append(push * ahead)
            bad = _turned(bad, begin, last) if len(met) < NOISE else None
        grad = met.pop()
        while met:
            grad = met.pop() + _turned(grad, last, begin, -1)  # back to the token that drew
        own, (m, f) = self._distinct(member, fakes[0])
        total = _sum_columns(pull * ahead, m, len(own)) + _sum_columns(grad, f, len(own))
        moves.append((name, own, total, np.bincount(m, minlength=len(own)) + np.bincount(f, minlength=len(own))))
        return back


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run."""
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    return begin, np.append(begin[1:], len(group)) - 1


def _turned(columns: np.ndarray, first: np.ndarray, last: np.ndarray, step: int = 1) -> np.ndarray:
    """Every column replaced by the one after it (step -1: before it), in a circle inside its run."""
    out = np.empty_like(columns)
    if step > 0:
        out[..., :-1] = columns[..., 1:]
    else:
        out[..., 1:] = columns[..., :-1]
    out[..., last] = columns[..., first]
    return out


def _sum_columns(columns: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the columns with equal at, which is below n."""
    out = np.empty((len(columns), n), np.float32)
    for own, values in zip(out, columns):
        own[:] = np.bincount(at, values, n)
    return out


def _go_through(vocab, model):
    """Changes of each table by block in half precision, with how often a row was used."""

    def run(batches):
        vocab_, model_ = vocab.value, model.value
        own = None
        for batch in batches:
            for texts in _portions(texts_of(batch)):
                own = own or Pass(vocab_, model_, TaskContext.get().partitionId())
                _, ranks, first = vocab_.codes(texts)
                own.learn(ranks, *vocab_.before(ranks, first))
        if own:
            for name in LogBilinear.NAMES:
                rows, table = np.flatnonzero(own.used[name]), own.model.p[name]
                block = rows // BLOCK * BLOCK
                first = np.flatnonzero(np.diff(block, prepend=-1))
                change = (table[rows] - model_.p[name][rows]).astype(np.float16)
                parts = [np.split(x, first[1:]) for x in (rows.astype("<i8"), change, own.used[name][rows])] if len(rows) else [[], [], []]
                cols = [pa.array([x.tobytes() for x in part], pa.binary()) for part in parts]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(first), pa.string()), pa.array(block[first]), *cols], ["name", "block", "rows", "change", "used"])

    return run


PARTS = "name string, block long, rows binary, change binary, used binary"


def _add_up(shapes):
    def run(batches):
        sums: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                width = shapes[r["name"]][1]
                change, used = sums.setdefault((r["name"], r["block"]), (np.zeros((BLOCK, width), np.float32), np.zeros(BLOCK, np.float32)))
                rows = np.frombuffer(r["rows"], "<i8") - r["block"]
                times = np.frombuffer(r["used"], np.float32)
                change[rows] += np.frombuffer(r["change"], np.float16).reshape(-1, width) * times[:, None]
                used[rows] += times
        for (name, block), (change, used) in sums.items():
            rows = np.flatnonzero(used)
            yield pa.RecordBatch.from_pydict({"name": [name], "block": [block], "rows": [(rows + block).astype("<i8").tobytes()], "change": [(change[rows] / used[rows][:, None]).tobytes()], "used": [b""]})

    return run


def trained(train: DataFrame, vocab, vocab_: Vocabulary) -> LogBilinear:
    """The model after all training tokens; in a round, a row's change is the mean of the tasks', by how often they used it."""
    spark, model, done = train.sparkSession, LogBilinear(vocab_), 0
    deal = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(sum(ROUNDS)))
    for parts in ROUNDS:
        own = train.where((deal >= done) & (deal < done + parts)).select("text")
        done += parts
        changes = map_arrow(own, _go_through(vocab, sent := spark.sparkContext.broadcast(model)), PARTS)
        summed = map_arrow(changes.repartition(SPREAD, "name", "block"), _add_up({k: v.shape for k, v in model.p.items()}), PARTS)
        model = model.copy()
        for r in summed.toArrow().to_pylist():
            table = model.p[r["name"]]
            table[np.frombuffer(r["rows"], "<i8")] += np.frombuffer(r["change"], np.float32).reshape(-1, table.shape[1])
        sent.unpersist()
    return model


def _score(vocab, words_model):
    def run(batches):
        vocab_, model_ = vocab.value, words_model.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            per_doc, tail_words, tail_counts, tail_sizes = [], [], [], []
            for texts in _portions(texts_of(batch)):
                words, ranks, first = vocab_.codes(texts)
                one, two = vocab_.before(ranks, first)
                own = np.concatenate([model_.log_probabilities(vocab_, *(x[s : s + STRETCH] for x in (ranks, one, two))) for s in range(0, len(ranks), STRETCH)])
                here = ranks >= 0
                logs = np.where(here, vocab_.log_count[ranks], 0.0)
                other = ~here
                known = here & (vocab_.counts[ranks] > 0)
                sums = [np.add.reduceat(x, first) for x in (logs, np.where(other, logs, 0.0), own, known.astype(np.int64), other.astype(np.int64))]
                per_doc.append(np.array([*sums, np.diff(np.append(first, len(ranks)))]))
                missing = np.split(np.flatnonzero(~here), np.searchsorted(np.flatnonzero(~here), first[1:]))
                for k, at in enumerate(missing):
                    tail = Counter(map(words[k].__getitem__, (at - first[k]).tolist()))
                    tail_sizes.append(len(tail))
                    tail_words += tail.keys()
                    tail_counts += tail.values()
            logs, other_logs, model, known, other, n = np.concatenate(per_doc, axis=1) if per_doc else np.empty((6, 0))
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            tail = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(tail_sizes, dtype=np.int64)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(tail_words, pa.binary()), pa.array(tail_counts, pa.int64())], ["word", "m"]),
            )
            base = logs - n * vocab_.log_total
            score = model + other_logs - other * vocab_.log_rest
            cols = [pa.array(rows), batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), tail]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "held_out", "n_tokens", "own_known", "own_base", "own_score", "tail"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty: one token, the end. A null doc_id is not held out. With nothing to learn from,
    train_tokens is 0 and every token has the share of an unknown one.
    """
    rows, spark = prepared(docs), docs.sparkSession
    train = rows.where(~F.col("held_out"))
    counts = word_counts(train)
    vocab, lowest = vocabulary(counts)
    sent = spark.sparkContext.broadcast(vocab)
    model = trained(train, sent, vocab)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, own_known long, own_base double, own_score double, tail array<struct<word:binary,m:long>>"
    scored = settle(map_arrow(rows, _score(sent, spark.sparkContext.broadcast(model)), schema), "scored", "zstd")
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.m")
    rare = counts.where(F.col("bin") < lowest).select("word", "n")
    found = tail.join(rare, "word", "left").groupBy("row").agg(
        F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("tail_log"),
        F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("tail_known"),
    )
    logs, known = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    return scored.drop("tail").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("own_known") + known).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("own_base") + logs).alias("base_score"),
        (F.col("own_score") + logs).alias("score"),
    )
