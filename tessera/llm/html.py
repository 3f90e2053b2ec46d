"""Main text of web pages by templates deduced from equivalence classes.

Pages of a host share a template. Its tokens are elements, told apart by their path, and whole text blocks, told
apart by path and text (single words are no tokens: a sentence must not lose the words it shares with others).
Every token has an occurrence vector: how often it stands in each page of the host. Tokens with equal vectors form
a class; vectors are kept as sums of hashes over pages, which add up on the cluster, so no host's pages are ever
gathered. A class is valid if it is frequent, has an element, and its members nest: each stands inside another
member, or all stand inside the same element of another class. Nested valid classes make the template. A text block
in a valid class is constant and belongs to the template; other text fills slots. The slots under the host's content
element are the main text, without those of template elements that are menus, adverts and the like by name.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, namedtuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, settle, texts_of

SUPPORT = 0.2  # share of a host's pages that a template token stands in at least
USUAL = 0.5  # the same for the content element
LEAST_PAGES = 5  # of a host with a template
DENSE = 0.6  # share of the slots' text that a content element holds, where no element is named as one
SENT = 1 << 21  # numbers of all templates that may be broadcast

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "canvas", "object")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag of the key closes an open element of these, up to the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements that never hold main text.
DROPPED = frozenset("nav footer aside form script style head noscript template button select iframe menu dialog textarea title svg math canvas object audio video".split())
#: Whole names (class, id or role) of template elements that are not main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert newsletter subscribe popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments respond replies related share sharing social widget pagination pager search login complementary contentinfo form".split()
)
CONTENT = ("article", "main")
ROOT, ARTICLE, MAIN, BODY, SITE_HEADER = 1, 2, 4, 8, 16

#: Quotes count only after "=", as browsers have it.
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:script|style|textarea|title|noscript|iframe|template|svg|math|canvas|object)\b|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CLOSING = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def _names(attributes: str) -> str:
    """Names of an element that are the same on many pages: those without digits, in order."""
    words = {w for a in ATTRIBUTE.finditer(attributes) for w in (a.group(2) or a.group(3) or a.group(4) or "").lower().split()}
    return " ".join(sorted(w for w in words if not any(map(str.isdigit, w))))


def _events(page: str):
    """("open", tag, names), ("close", tag, ""), ("text", string, ""): whole elements without text are left out."""
    at = 0
    for m in iter(lambda: PIECE.search(page, at), None):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m.group(2):
            tag = m.group(2).lower()
            if m.group(1):
                yield "close", tag, ""
            else:
                yield "open", tag, _names(m.group(3)) if "=" in m.group(3) else ""
                if m.group(3).endswith("/") and tag not in VOID:
                    yield "close", tag, ""
        elif m.group()[:2] not in ("<!", "<?"):
            end = CLOSING[m.group()[1:].lower()].search(page, at)
            at = end.end() if end else len(page)
    if at < len(page):
        yield "text", page[at:], ""


class Node:
    """An open element: the number of its path, what holds for the text in it, and the element around it."""

    __slots__ = ("tag", "names", "path", "up", "gone", "flags")

    def __init__(self, tag: str, names: str, path: int, up: "Node | None"):
        self.tag, self.names, self.path, self.up = tag, names, path, up
        self.gone = (up.gone if up else False) or tag in DROPPED
        self.flags = up.flags if up else 0


def _number(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _walk(page: str, opened=lambda node: None):
    """(node, text) of the page's blocks in order; opened is called with every node. Unclosed elements end as browsers have it.

    The path of a node goes by tags and names of its block elements; inline ones do not tell tokens apart. Time and
    memory are linear in the page, however deep it nests.
    """
    numbers: dict[tuple[int, str, str], int] = {}
    stack, count, pieces, at = [Node("", "", 0, None)], defaultdict(int), [], None
    opened(stack[0])

    def shut(tags, until) -> bool:
        if any(count[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    for node in stack[k:]:
                        count[node.tag] -= 1
                    del stack[k:]
                    return True
                if stack[k].tag in until:
                    return False
        return False

    for kind, what, names in _events(page):
        if kind == "text":
            if not stack[-1].gone:
                at = at or stack[-1]
                pieces.append(what)
            continue
        if what in BLOCKS and pieces:
            if text := " ".join(html.unescape("".join(pieces)).split()):
                yield at, text
            pieces, at = [], None
        if kind == "open":
            if what in BLOCKS:
                shut(("p",), ("td", "th", "table", "button", "object"))
            if what in CLOSES:
                while shut(*CLOSES[what]):
                    pass
            up = stack[-1]
            if what in VOID:
                if what == "br" and pieces:
                    pieces.append(" ")
                continue
            path = up.path
            if what in BLOCKS:
                key = (up.path, what, names)
                if (path := numbers.get(key)) is None:
                    path = numbers[key] = _number(f"{what} {names}", up.path)
            stack.append(node := Node(what, names, path, up))
            count[what] += 1
            opened(node)
        else:
            shut((what,), ("td", "th") if what not in BLOCKS else ())
    if pieces and (text := " ".join(html.unescape("".join(pieces)).split())):
        yield at, text


def tokens_of(page: str) -> tuple[dict[int, list], int]:
    """token -> [occurrences, parent, key (None: a text block), place, characters], and a number for the page's content.

    An element's characters are those directly inside. Token 0 stands for the page.
    """
    out: dict[int, list] = {}
    longest = ""

    def opened(node: Node) -> None:
        if not node.up or node.tag in BLOCKS:
            row = out.setdefault(node.path, [0, node.up.path if node.up else 0, f"{node.tag} {node.names}", len(out), 0])
            row[0] += 1

    for node, text in _walk(page, opened):
        row = out.setdefault(_number(text, node.path), [0, node.path, None, len(out), 0])
        row[0] += 1
        row[4] += len(text)
        out[node.path][4] += len(text)
        longest = max(longest, text, key=len)
    return out, _number(longest, 1)


COLUMNS = ("pages", "times", "v1", "v2", "place", "chars")
Token = namedtuple("Token", ("token", "parent", "key", *COLUMNS, "kinds"))
SUMS = "host long, token long, parent long, key string, " + ", ".join(f"{c} long" for c in COLUMNS) + ", kinds long"


def _vectors(batches):
    for batch in batches:
        sums: dict[tuple[int, int], list] = {}
        for k, (host, page) in enumerate(zip(batch.column(1).to_pylist(), texts_of(batch, "html"))):
            mark = _number(page, _number(str(batch.column(0)[k].as_py()), 0))
            tokens, content = tokens_of(page)
            for token, (n, parent, key, place, chars) in tokens.items():
                both = xxhash.xxh64_intdigest(f"{mark}:{n}")
                row = sums.setdefault((host, token), [parent, key, 0, 0, 0, 0, 0, 0, 0])
                for i, v in enumerate((1, n, both & 0x7FFFFFFF, both >> 33, place, chars), 2):
                    row[i] += v
                row[8] |= 1 << (content & 63)
        cols = [pa.array([x[i] for x in sums], pa.int64()) for i in (0, 1)]
        cols += [pa.array([r[0] for r in sums.values()], pa.int64()), pa.array([r[1] for r in sums.values()], pa.string())]
        cols += [pa.array([r[i] for r in sums.values()], pa.int64()) for i in range(2, 8)]
        cols.append(pa.array(np.array([r[8] for r in sums.values()], np.uint64).view(np.int64)))
        yield pa.RecordBatch.from_arrays(cols, ["host", "token", "parent", "key", *COLUMNS, "kinds"])


def deduce(tokens: list[Token], pages: int) -> tuple[list[list[int]], int | None, list[int], list[int]]:
    """A host's frequent tokens -> (its valid classes, path of the content element, paths left out, constant text blocks).

    Equal (v1, v2) are equal occurrence vectors. kinds has a bit for each content of the token's pages: blocks that only copies of one page share are
    no template.
    """
    info = {t.token: t for t in tokens}
    element = lambda t: t.key is not None
    members = defaultdict(list)
    for t in info.values():
        if element(t) or bin(t.kinds & 0xFFFFFFFFFFFFFFFF).count("1") >= min(16, t.pages / 2):
            members[t.v1, t.v2, t.pages, t.times].append(t)

    def within(t, own) -> int | None:
        """The nearest member of the class around t."""
        seen = set()
        while t.token != 0 and t.parent in info and t.token not in seen:
            seen.add(t.token)
            t = info[t.parent]
            if t.token in own:
                return t.token
        return None

    classes: list[list] = []
    for group in members.values():
        own = {t.token for t in group if element(t)}
        parts: dict[int, list] = defaultdict(list)  # a class that stands in several elements of others is several classes
        top: dict[int, int] = {}
        for t in sorted(group, key=lambda t: (not element(t), t.place / t.pages)):
            around = within(t, own)
            top[t.token] = top.get(around, t.parent) if around is not None else t.parent
            if element(t) or around is not None:
                parts[top[t.token]].append(t)
        classes += [c for c in parts.values() if any(map(element, c))]
    classes.sort(key=lambda c: min(t.place / t.pages for t in c))
    valid = {t.token: t for c in classes for t in c}
    constant = [t.token for t in valid.values() if not element(t)]

    paths = {p: t for p, t in valid.items() if element(t)}
    slots = defaultdict(int, {p: t.chars for p, t in paths.items()})
    for k in constant:
        slots[info[k].parent] -= info[k].chars
    out = [p for p, t in paths.items() if _left_out(t.key)]
    up = {p: t.parent if p != 0 and t.parent in paths and t.parent != p else None for p, t in paths.items()}
    depth: dict = {None: -1}
    for p in paths:
        line = []
        while p not in depth and p not in line[-1:]:
            line.append(p)
            p = up[p]
        for q in reversed(line):
            depth[q] = depth.get(up[q], -1) + 1
    order, gone, below, inside = sorted(paths, key=depth.get), set(out), defaultdict(int), set()
    clean = []
    for p in order:
        if p in gone or up[p] in gone:
            gone.add(p)
        else:
            clean.append(p)
        if up[p] is not None and (up[p] in inside or _content(paths[up[p]].key)):
            inside.add(p)
    for p in reversed(clean):
        below[p] += slots[p]
        if up[p] is not None:
            below[up[p]] += below[p]
    usual = [p for p in clean if p and paths[p].pages >= USUAL * pages]
    named = [p for p in usual if _content(paths[p].key)]
    if named:
        inner = [p for p in named if paths[p].key.startswith("article ")]
        root = max(inner or [p for p in named if p not in inside] or named, key=lambda p: (below[p], -depth[p]))
    else:
        single = [p for p in usual if paths[p].times == paths[p].pages and below[p] >= DENSE * below[0] > 0]
        root = max(single, key=lambda p: (depth[p], p), default=None)
    return [[t.token for t in c] for c in classes], root, out, constant


def _left_out(key: str) -> bool:
    tag, _, names = key.partition(" ")
    return tag in DROPPED or any(n in MARKS for n in names.split())


def _content(key: str) -> bool:
    return any(n in CONTENT for n in key.split())


def _deduce(table: pa.Table) -> pa.Table:
    tokens = [Token(*row) for row in zip(*(table.column(n).to_pylist() for n in Token._fields))]
    classes, root, out, constant = deduce(tokens, table.column("total")[0].as_py())
    one = {"host": [table.column("host")[0].as_py()], "classes": [classes], "root": [root], "out": [out], "constant": [constant]}
    return pa.table(one, schema=pa.schema([("host", pa.int64()), ("classes", pa.list_(pa.list_(pa.int64()))), ("root", pa.int64()), ("out", pa.list_(pa.int64())), ("constant", pa.list_(pa.int64()))]))


def templates(pages: DataFrame) -> DataFrame:
    """pages(host long, page_id, html) -> settled (host, classes, root, out, constant), one row per host with a template.

    What a host sends to one task are its tokens in at least SUPPORT of its pages: at most 1 / SUPPORT times the
    tokens of a page of average length.
    """
    found = map_arrow(pages.select("page_id", "host", "html"), _vectors, SUMS)
    sums = found.groupBy("host", "token").agg(F.min("parent").alias("parent"), F.min("key").alias("key"), *[F.sum(c).alias(c) for c in COLUMNS], F.bit_or("kinds").alias("kinds"))
    sums = settle(sums.where(F.col("pages") >= LEAST_PAGES), "vectors")
    hosts = sums.where("token = 0").select("host", F.col("pages").alias("total"))
    frequent = sums.join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("total"))
    out = settle(frequent.groupBy("host").applyInArrow(_deduce, "host long, classes array<array<long>>, root long, out array<long>, constant array<long>"), "templates")
    forget(sums)
    return out


def main_text(page: str, root: int | None = None, out: frozenset = frozenset(), constant: frozenset = frozenset(), template: bool = False) -> str:
    """The text of the slots under the template's content element.

    If the page lacks that element, its own content element (article, else main, else the body without the site's
    header) takes its place. Without a template the names of its elements decide what is left out.
    """
    seen = 0

    def opened(node: Node) -> None:
        nonlocal seen
        if template:
            node.gone |= node.path in out and node.tag in BLOCKS
        elif node.names:
            node.gone |= any(n in MARKS for n in node.names.split())
        if root is not None and node.path == root and node.tag in BLOCKS:
            node.gone = False
            node.flags |= ROOT
        if not node.gone:
            names = (node.tag, *node.names.split()) if node.names else (node.tag,)
            node.flags |= (ARTICLE if "article" in names else 0) | (MAIN if "main" in names else 0) | (BODY if node.tag == "body" else 0)
            if node.tag == "header" and not node.flags & (ARTICLE | MAIN):
                node.flags |= SITE_HEADER
            seen |= node.flags

    blocks = [(node.flags, text) for node, text in _walk(page, opened) if not constant or _number(text, node.path) not in constant]
    for flag in (ROOT, ARTICLE, MAIN):
        if seen & flag:
            return "\n".join(text for flags, text in blocks if flags & flag)
    return "\n".join(text for flags, text in blocks if not flags & SITE_HEADER and (flags & BODY or not seen & BODY))


def _extract(batches):
    for batch in batches:
        col = lambda name: batch.column(batch.schema.get_field_index(name))
        texts, last, known = [], None, ()
        for page, host, at in zip(texts_of(batch, "html"), col("host").to_pylist(), range(batch.num_rows)):
            if host != last or not known:
                root, out, constant = (col(n)[at].as_py() for n in ("root", "out", "constant"))
                last, known = host, (root, frozenset(out or ()), frozenset(constant or ()), out is not None)
            texts.append(main_text(page, *known))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars. Null html counts as empty and gives an empty text.

    The host is the url's authority in lower case; pages without one share a template. Repeated pages keep a row
    each; blocks that only copies share are no template. Very long or deep pages take time in proportion. An empty
    table gives an empty result. Other columns, whatever their names, are not read.
    """
    authority = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.xxhash64(authority).alias("host")
    )
    known = templates(rows).select("host", "root", "out", "constant")
    numbers = known.agg(F.sum(F.size("out") + F.size("constant") + 8)).first()[0] or 0
    known = F.broadcast(known) if numbers <= SENT else known.hint("merge")
    return map_arrow(rows.join(known, "host", "left").select("page_id", "url", "html", "host", "root", "out", "constant"), _extract, "page_id long, url string, text string, n_chars long")
