"""Personal data: exact base patterns, and further spans by a semi-Markov conditional random field.

The field reads islands: runs of digits with their separators, addresses with a spelt "at" and "dot", and long runs of
letters and digits with the words before them. Outside islands no segment can be an entity, so decoding the islands
decodes the whole text. An island's tokens are segmented jointly: whole-span features score each candidate segment
of at most MOST tokens (the method's bound on an entity) as a kind or as other text, and dynamic programming picks
boundaries and kinds together. Besides the four kinds the field knows identity and bank numbers ("id") and keys and
tokens ("secret"). Weights are learnt in numpy by the exact conditional likelihood (semi-Markov forward-backward) on
generated examples. Base spans are fixed and stay.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            last = m.end()
        at = text.find("@", at + 1) if last <= at else text.find("@", last)


def _addresses(text: str):
    """Fours of a chain of numbers, from its left: what a scan for four dotted numbers finds, in linear time."""
    for m in CHAIN.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in four):
                yield at, end
            at = end + 1


HAS_DIGITS = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the base patterns, by start, then kind."""
    out = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if HAS_DIGITS.search(text):
        if "." in text:
            out += [(s, e, "ip") for s, e in _addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- the field -------------------------------------------------------------------------------------------------

ALL_KINDS = (*KINDS, "id", "secret")
LABELS = ("other", *ALL_KINDS)
MOST = 24  # tokens in a segment
LEAST_DIGITS = 7  # of an entity that has no "at" and is no key
LEAST_KEY = 16  # letters and digits in one run of a key
NUMBERS = re.compile(r"[+(\[]{0,2}[0-9](?:[()\[\]+./: -]{0,3}[0-9])*")
SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({]?\bat\b[\])}]? ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({]?\bdot\b[\])}]?) ?[A-Za-z0-9-]+)+")
KEYS = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]*?[A-Za-z0-9]{16}[A-Za-z0-9+/_-]*+")
BANK = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
BANK_START = re.compile(r"[A-Z]{2}[0-9]{2}")
BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9\n]{0,4}\Z")
TOKEN = re.compile(r"[A-Za-z0-9]+|.", re.S)


NEUTRAL = "the of and on with le der las see it was".split()
#: kind -> words that often stand before it; those of "other" are before look-alikes.
WORDS = {
    "phone": "call phone tel ring fax mobile".split(), "card": "card visa paid".split(), "email": "mail write contact reach".split(), "id": "ssn iban account passport tax identity".split(),
    "secret": "token secret key password passwd auth bearer apikey pwd credential".split(), "other": "order isbn version commit sha revision digest checksum invoice serial ticket".split(),
}
GROUP = {word: kind for kind, words in WORDS.items() for word in words}


def _bucket(n: int) -> str:
    return str(n) if n < 20 else "20+"


@lru_cache(maxsize=1 << 14)
def _features(span: str) -> tuple[str, ...]:
    """Features of a whole segment: its shape, digit groups, checks."""
    digits = NOT_DIGIT.sub("", span)
    groups = re.findall(r"[0-9]+", span)
    marks = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", span))))
    out = [f"d{_bucket(len(digits))}", f"m{marks}", "g" + ".".join(str(min(len(g), 9)) for g in groups[:7]), f"n{min(len(groups), 8)}"]
    if span[0] in "+(" or span.startswith("00"):
        out.append(f"s{span[0]}")
    if 14 <= len(digits) <= 19 and len(groups) > 1:
        out.append(f"luhn{luhn(digits)}")
    if len(groups) >= 4 and "." in span:
        out.append(f"octets{all(len(g) < 4 and int(g) < 256 for g in groups[:4])}")
    if re.search(r"\bat\b", span):
        out.append("at")
        out.append("dot" if re.search(r"\bdot\b|\.", span.split("at", 1)[1]) else "nodot")
        out += [f"marked{bool(re.search(r'[([{]at', span))}", f"local{bool(re.match(r'[A-Za-z0-9].*?[^A-Za-z0-9]at', span))}"]
        out.append("end" + re.split(r"[^A-Za-z]+", span)[-1].lower()[:6])
    if (run := max(map(len, re.findall(r"[A-Za-z0-9]+", span)), default=0)) >= LEAST_KEY and not span.isdigit():
        letters = re.sub(r"[^A-Za-z]", "", span)
        out += [f"run{min(run // 8, 6)}", f"hex{bool(re.fullmatch('[0-9a-f]+|[0-9A-F]+', span))}", f"case{letters.islower()}{letters.isupper()}", "start" + (re.match(r"[A-Za-z]{0,4}", span).group() if not span[0].isdigit() else "9")]
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,40}", span):
        bare = span.replace(" ", "")
        out.append(f"bank{int(''.join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1}")
    return tuple(out)


def _segments(tokens: list[str], before: str = ""):
    """(i, j, feature names, labels) of all candidate segments; other text goes token by token.

    A candidate ends in words or digits, starts with them or an opening mark, and has an "at", LEAST_DIGITS, a key's
    run or the start of a bank number. before: the word ahead of the island; a segment knows the nearest word ahead.
    """
    start = [0, *np.cumsum([len(t) for t in tokens]).tolist()]
    text, word, n = "".join(tokens), before.lower(), len(tokens)
    kind = [(t.isalnum(), len(t) if t.isdigit() else 0, t == "at" or len(t) >= LEAST_KEY and t.isalnum()) for t in tokens]
    for i in range(n):
        yield i, i + 1, None, (0,)
        first = tokens[i]
        if kind[i][0] or first in "+(":
            digits, enough = 0, BANK_START.match(first) is not None
            ahead, open_ = (tokens[i - 1] if i else "^") in ".-/:", "open" if i and kind[i - 1][0] else ""
            for j in range(i, min(n, i + MOST)):
                word_like, more, telling = kind[j]
                digits += more
                enough = enough or telling
                if word_like and (enough or digits >= LEAST_DIGITS):
                    after = tokens[j + 1] if j + 1 < n else "$"
                    edge = f"edge{ahead}{after in '.-/:'}{open_}{'cut' if after[0].isdigit() else ''}"
                    yield i, j + 1, (*_features(text[start[i] : start[j + 1]]), edge, f"word{word}", f"group{GROUP.get(word)}"), range(1, len(LABELS))
        if first.isalpha():
            word = first.lower()
        elif kind[i][0]:
            word = ""


class SemiCRF:
    """weights[label, feature]; label to label transitions; exact inference over segmentations."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((len(LABELS), 4096))
        self.move = np.zeros((len(LABELS), len(LABELS)))
        self.rows: list[list[float]] = []

    def _ids(self, names) -> list[int]:
        return [k for k in map(self.index.get, names) if k is not None]

    def _spans(self, tokens, before="", grow=False):
        """(i, j, labels, feature ids) of all candidate segments, by i; one at a time, as an island may be long."""
        for i, j, names, labels in _segments(tokens, before):
            if names is None:
                t = tokens[i]
                names = ("tok" + ("9" * min(len(t), 9) if t.isdigit() else "a" if t.isalpha() else f"x{min(len(t) // 8, 5)}" if t.isalnum() else t),)
            if grow:
                for x in names:
                    if len(self.index) < self.weights.shape[1]:
                        self.index.setdefault(x, len(self.index))
            yield i, j, labels, self._ids(names)

    def _lattice(self, tokens, before="", grow=False):
        return [(i, j, y, ids) for i, j, labels, ids in self._spans(tokens, before, grow) for y in labels]

    def fit(self, examples, rounds: int = 12, rate: float = 0.5, decay: float = 1e-3) -> "SemiCRF":
        """examples: [(tokens, word before, [(i, j, label)])], a full segmentation each."""
        made = []
        for tokens, before, gold in examples:
            lattice = self._lattice(tokens, before, grow=True)
            at = {(i, j, y): ids for i, j, y, ids in lattice}
            made.append((len(tokens), lattice, [(i, j, y, at[i, j, y]) for i, j, y in gold]))
        square, square_move = np.full_like(self.weights, 1e-6), np.full_like(self.move, 1e-6)
        for _ in range(rounds):
            for n, lattice, gold in made:
                grad, grad_move = self._gradient(n, lattice, gold)
                g = -decay * self.weights
                for (y, k), v in grad.items():
                    g[y, k] += v
                square += g * g
                self.weights += rate * g / np.sqrt(square)
                square_move += grad_move**2
                self.move += rate * grad_move / np.sqrt(square_move)
        self.rows = self.weights.tolist()
        return self

    def _gradient(self, n, lattice, gold):
        """Observed minus expected counts, by forward-backward over segments; lattice is sorted by start."""
        L, move, weights = len(LABELS), self.move, self.weights.tolist()
        score = [sum(map(weights[y].__getitem__, ids)) for _, _, y, ids in lattice]
        none = -1e30  # a score of nothing
        ahead, into = np.full((n + 1, L), none), np.full((n + 1, L), none)
        ahead[0, 0] = 0.0
        gather: list = [{} for _ in range(n + 1)]  # position -> label -> scores of the segments that end there
        at = -1
        for (i, j, y, _), s in zip(lattice, score):
            if i != at:
                at = i
                for label, found in gather[i].items():
                    ahead[i, label] = np.logaddexp.reduce(found)
                into[i] = np.logaddexp.reduce(ahead[i][:, None] + move, axis=0)
                now = into[i].tolist()
            gather[j].setdefault(y, []).append(now[y] + s)
        for label, found in gather[n].items():
            ahead[n, label] = np.logaddexp.reduce(found)
        z = np.logaddexp.reduce(ahead[n])
        back, rows = np.full((n + 1, L), none), [None] * n + [[0.0] * L]
        back[n] = 0.0
        gather, end = [{} for _ in range(n)], len(lattice)
        for i in range(n - 1, -1, -1):
            begin = end
            while begin and lattice[begin - 1][0] == i:
                begin -= 1
            out = np.full(L, none)
            for (_, j, y, _), s in zip(lattice[begin:end], score[begin:end]):
                gather[i].setdefault(y, []).append(s + rows[j][y])
            for label, found in gather[i].items():
                out[label] = np.logaddexp.reduce(found)
            back[i] = np.logaddexp.reduce(move + out, axis=1)
            rows[i], end = back[i].tolist(), begin
        grad, mass, sources = {}, np.zeros((n + 1, L)), into.tolist()
        for (i, j, y, ids), s in zip(lattice, score):
            p = math.exp(min(0.0, sources[i][y] + s + rows[j][y] - z))
            mass[i, y] += p
            for k in ids:
                grad[y, k] = grad.get((y, k), 0.0) - p
        share = np.exp(np.clip(ahead[:, :, None] + move - into[:, None, :], -700, 0))
        grad_move = -(mass[:, None, :] * share).sum(axis=0)
        before = 0
        for i, j, y, ids in gold:
            grad_move[before, y] += 1
            before = y
            for k in ids:
                grad[y, k] = grad.get((y, k), 0.0) + 1
        return grad, grad_move

    def decode(self, tokens: list[str], before: str = "") -> list[tuple[int, int, int]]:
        """The best segmentation: [(i, j, label)] of its entities."""
        n, L, columns = len(tokens), len(LABELS), self.move.T.tolist()
        best: list = [[0.0] + [-math.inf] * (L - 1), *[None] * n]  # rows ahead of i only
        back = [b""] * (n + 1)  # for each label: the last segment's length, the label before it
        at, into, source = -1, [], []
        for i, j, labels, ids in self._spans(tokens, before):
            if i != at:
                if at >= 0:
                    best[at] = None
                at, own = i, best[i]
                pairs = [max((own[x] + c[x], x) for x in range(L)) for c in columns]
                into, source = [v for v, _ in pairs], [x for _, x in pairs]
            if best[j] is None:
                best[j], back[j] = [-math.inf] * L, bytearray(2 * L)
            row, places = best[j], back[j]
            for y in labels:
                value = into[y] + sum(map(self.rows[y].__getitem__, ids))
                if value > row[y]:
                    row[y], places[2 * y], places[2 * y + 1] = value, j - i, source[y]
        y = max(range(L), key=lambda x: best[n][x]) if n else 0
        out, j = [], n
        while j > 0:
            size, frm = back[j][2 * y], back[j][2 * y + 1]
            if y:
                out.append((j - size, j, y))
            j, y = j - size, frm
        return out[::-1]


def _bank(r: random.Random) -> str:
    country, body = r.choice(("DE", "FR", "GB", "ES")), "".join(r.choice("0123456789") for _ in range(r.choice((16, 18, 20))))
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    return f"{country}{check:02}{body}"


def _examples(count: int = 500, seed: int = 11):
    """Generated islands with the word before and their segmentation: entities in several notations, and look-alikes."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))
    top = lambda: r.choice(("com", "org", "net", "de", "fr", "io"))
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    small, mixed = "abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card(lens, sep):
        digits = "4" + num(sum(lens) - 2)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        cut = np.cumsum([0, *lens])
        return sep.join(digits[a:b] for a, b in zip(cut, cut[1:]))

    def fours(text):
        return " ".join(text[k : k + 4] for k in range(0, len(text), 4))

    makers = [
        ("phone", lambda: f"({num(3)}) {num(3)}-{num(4)}"), ("phone", lambda: f"{num(3)}-{num(3)}-{num(4)}"), ("phone", lambda: f"{num(3)}.{num(3)}.{num(4)}"),
        ("phone", lambda: f"00{r.choice('1346')}{num(1)} {num(3)} {num(3)} {num(4)}"), ("phone", lambda: f"({num(3)}){num(3)}-{num(4)}"), ("phone", lambda: f"{num(3)} {num(3)} {num(4)}"),
        ("card", lambda: card((4, 4, 4, 4), ".")), ("card", lambda: card((4, 6, 5), ".")), ("card", lambda: card((4, 4, 4, 4), "/")),
        ("email", lambda: f"{name()} (at) {name()} (dot) {top()}"), ("email", lambda: f"{name()}[at]{name()}.{top()}"), ("email", lambda: f"{name()} [at] {name()} [dot] {top()}"),
        ("email", lambda: f"{name()} at {name()} dot {top()}"), ("email", lambda: f"{name()} at {name()} dot {top()}"),
        ("id", lambda: f"{num(3)}-{num(2)}-{num(4)}"), ("id", lambda: f"{num(3)} {num(2)} {num(4)}"), ("id", lambda: _bank(r)), ("id", lambda: fours(_bank(r))),
        ("secret", lambda: some(small, 40)), ("secret", lambda: some(small, 40)), ("secret", lambda: some(small, r.randint(24, 64))), ("secret", lambda: some(small, 32)), ("secret", lambda: some(mixed, r.randint(20, 44))), ("secret", lambda: some(small.upper(), 40)),
        ("secret", lambda: f"sk-{some(mixed, 40)}"), ("secret", lambda: f"ghp_{some(mixed, 36)}"), ("secret", lambda: "AKIA" + some(mixed.upper(), 16)),
        *[("other", f) for f in (
            lambda: num(4), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(1)}.{num(6)}", lambda: num(7), lambda: num(9), lambda: num(10), lambda: num(12), lambda: num(16),
            lambda: f"{num(2)}:{num(2)}:{num(2)}.{num(3)}", lambda: f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(2)}.{num(3)}.{num(3)}", lambda: f"{num(4)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}",
            lambda: f"{num(3)} {num(3)}", lambda: f"{num(3)}-{num(4)}", lambda: " ".join(num(r.randint(1, 3)) for _ in range(r.randint(2, 9))), lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}", lambda: f"{num(8)}-{num(4)}", lambda: f"{num(4)}-{num(4)}", lambda: f"{num(5)}.{num(5)}", lambda: f"{num(20)}",
            lambda: f"{num(4)}.{num(4)}.{num(4)}.{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(3)}.{num(3)}.{num(3)}", lambda: f"{num(2)}.{num(2)}.{num(2)}.{num(2)}.{num(4)}",
            lambda: f"{some(small, 8)}-{some(small, 4)}-{some(small, 4)}-{some(small, 4)}-{some(small, 12)}", lambda: some(small, 40), lambda: some(small, 40), lambda: some(small, 40), lambda: some(small, 64), lambda: some(small, 32), lambda: f"{name()} at {name()} {name()}", lambda: f"{name()} at {name()}. {name()}", lambda: f"{name()} at {name()} dot {r.choice(NEUTRAL)}", lambda: f"{name()} at {name()} dot {name()}",
            lambda: f"{name()}/{name()}/{some(small, 20)}", lambda: name() + name() + name() + num(2), lambda: f"AB{num(2)} {num(4)} {num(4)} {num(4)}",
        )],
    ]
    out = []
    for k in range(count):
        kind, make = makers[k % len(makers)]
        text = make()
        key = kind in ("email", "secret") or not text[0] in "0123456789(+"
        gap = r.choice(("", " ", " ", " / "))
        front = num(r.randint(1, 4)) + (gap or " ") if r.random() < 0.15 and not key else ""
        parts = [("other", front)] * bool(front) + [(kind, text)]
        if not key and (more := r.random()) < 0.3:  # islands go on: a number after, or further ones of the kind
            between = r.choice((" ", " ", " / "))
            for _ in range(1 if more < 0.1 else r.randint(1, 3)):
                parts += [("other", between), ("other", num(r.randint(1, 4))) if more < 0.1 else (kind, make())]
        telling = kind == "secret" and text[:2] not in ("sk", "gh", "AK") or kind == "other" and len(text) > 19 and key or r.random() < 0.4
        before = r.choice(WORDS[kind]) if telling and not front else r.choice(NEUTRAL) if r.random() < 0.5 else ""
        tokens, gold = [], []
        for label, part in parts:
            own = TOKEN.findall(part)
            if label == "other":
                gold += [(len(tokens) + i, len(tokens) + i + 1, 0) for i in range(len(own))]
            else:
                gold.append((len(tokens), len(tokens) + len(own), LABELS.index(label)))
            tokens += own
        out.append((tokens, before, gold))
    return out


@lru_cache(maxsize=1)
def trained() -> SemiCRF:
    """The field with its default training; some seconds of numpy on the driver."""
    return SemiCRF().fit(_examples(), rounds=7)


AT = re.compile(r" ?[\[({]?\bat\b[\])}]?")


def _whole_tokens(text: str, begin: int, end: int) -> tuple[int, int]:
    """[begin, end) without the token at either end that goes on outside, and without the marks this bares."""
    if begin and begin < end and text[begin].isalnum() and text[begin - 1].isalnum():
        begin = TOKEN.match(text, begin, end).end()
        if m := AT.match(text, begin, end):
            begin = m.end()
    if end < len(text) and begin < end and text[end - 1].isalnum() and text[end].isalnum():
        while end > begin and text[end - 1].isascii() and text[end - 1].isalnum():
            end -= 1
    while begin < end and not (text[begin].isalnum() or text[begin] in "+(["):
        begin += 1
    while end > begin and not text[end - 1].isalnum():
        end -= 1
    return begin, end


def _islands(text: str) -> list[tuple[int, int]]:
    """Places that can hold an entity, by start; those that overlap are one."""
    out, last = [], 0
    if digits := HAS_DIGITS.search(text):
        out += [m.span() for m in NUMBERS.finditer(text, max(0, digits.start() - 2)) if m.end() - m.start() >= LEAST_DIGITS]
        out += [m.span() for m in KEYS.finditer(text)]
        out += [m.span() for m in BANK.finditer(text)]
    if "at" in text and ("dot" in text or "at)" in text or "at]" in text or "at}" in text):
        for m in SPELT.finditer(text):
            begin = m.start()
            while begin > last and text[begin - 1] in LOCAL:  # the whole name, however long
                begin -= 1
            last = m.end()
            out.append((begin, last))
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(out):
        if merged and begin < merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((begin, end))
    return merged


def extra_spans(text: str, field: SemiCRF, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that the field adds: they do not touch base spans nor each other.

    Base spans are fixed segments of an island; what lies between them is decoded. A token that touches a letter
    outside is part of a code or word and is left out, the rest of its island is read.
    """
    out: list[tuple[int, int, str]] = []
    taken, k = sorted((s, e) for s, e, _ in base), 0
    for begin, end in _islands(text):
        while k < len(taken) and taken[k][1] <= begin:
            k += 1
        gaps, at, n = [], begin, k
        while n < len(taken) and taken[n][0] < end:
            gaps.append((at, taken[n][0]))
            at = max(at, taken[n][1])
            n += 1
        for begin, end in (*gaps, (at, end)):
            if end - begin < LEAST_DIGITS:
                continue
            begin, end = _whole_tokens(text, begin, end)
            part = text[begin:end]
            if sum(map(str.isdigit, part)) < LEAST_DIGITS and "at" not in part and max(map(len, TOKEN.findall(part)), default=0) < LEAST_KEY:
                continue
            before = BEFORE.search(text, max(0, begin - 40), begin)
            tokens = TOKEN.findall(part)
            edges = np.cumsum([begin, *map(len, tokens)]).tolist()
            out += [(edges[a], edges[b], LABELS[y]) for a, b, y in field.decode(tokens, before.group(1) if before else "")]
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(text: str, field: SemiCRF) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    extra = extra_spans(text, field, base)
    return base, sorted(base + extra, key=lambda s: (s[0], ALL_KINDS.index(s[2]), s[1])) if extra else base


def _report(field: SemiCRF):
    def run(batches):
        for batch in batches:
            found = [find(t, field) for t in texts_of(batch)]
            counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            both = [pa.array([joined(f[x]) for f in found], pa.string()) for x in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *both], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return run


def find_pii(docs: DataFrame, field: SemiCRF | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base, spans.

    The counts and `base` are of the base patterns; `spans` has those and the field's, of the four kinds, "id" and
    "secret". Null text counts as empty; repeated rows keep a row each; very long texts take time in proportion. An
    empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _report(field or trained()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redacted(text: str, spans) -> str:
    """The text with a placeholder for each run of overlapping spans, named for its first kind."""
    out, last = [], 0
    for s, e, kind in spans:
        if s >= last:
            out += [text[last:s], f"<{kind.upper()}>"]
            last = e
        elif e > last:
            last = e
    return "".join([*out, text[last:]])


def _redact(field: SemiCRF):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            old = batch.column(at).to_pylist()
            new = [t if t is None or not (spans := find(t, field)[1]) else redacted(t, spans) for t in old]
            cols = [pa.array(new, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return run


def redact(docs: DataFrame, field: SemiCRF | None = None) -> DataFrame:
    """docs with placeholders for all spans; a null text stays null, and n_chars follows where there is one."""
    out = map_arrow(docs.withColumn("text", F.col("text").cast("string")), _redact(field or trained()), docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
