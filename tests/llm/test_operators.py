"""Each operator against a plain version, on the small tables and on odd rows."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from tessera.llm import bpe, chat, dedup, html, jpeg, langid, lm, packing, pii, simhash
from tessera.llm.graph import connected_components

LONG = "wörd and more of it " * 20000
ROWS = [(1, "Hello world, this is a text of mine"), (2, None), (3, ""), (4, "Hello world, this is a text of mine"), (4, "Hello world, this is a text of mine"), (5, " \t "), (6, LONG), (7, "call +1 (578) 555-6437 or a@b.com"), (8, "日本 語 \x1c x  y"), (None, "no id")]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in ROWS], "doc_id long, text string, fingerprint string, length long, kept string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def plain_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=4):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, i in enumerate(ids):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(i), find(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_base_spans_equal_the_patterns():
    for text in ("a@b.c@d.e f@g", "a@@b.c", "1.2.3.4.5.6.7.8", "+1 +1 (578) 555-6437", "4111 1111 1111 1111 1", "x" * 99 + "@", "999.1.1.1.2.3", "a.b@c-d.e..f@g.h"):
        want = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m.group().split("."))]
        digits = lambda m: re.sub(r"\D", "", m.group())
        want += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
        assert sorted(pii.base_spans(text)) == sorted(want)


def test_field_decodes_the_best_segmentation():
    """Dynamic programming against all segmentations of short islands."""
    field = pii.trained()
    for island in ("12-345-6789", "(578) 555-64", "0049 171 55"):
        tokens = pii.TOKEN.findall(island)
        lattice = field._lattice(tokens)
        best = (-1e9, None)

        def walk(i, y, score, path):
            nonlocal best
            if i == len(tokens):
                best = max(best, (score, path), key=lambda b: b[0])
            for a, b, label, ids in lattice:
                if a == i:
                    walk(b, label, score + field.move[y, label] + sum(field.rows[label][k] for k in ids), path + [(a, b, label)] * bool(label))

        walk(0, 0, 0.0, [])
        assert field.decode(tokens) == best[1]
    assert [k for _, _, k in pii.find("ring (578) 555-6437 soon", field)[1]] == ["phone"]
    assert not pii.find("on 2020-01-31 at 12:30:45, 1234567", field)[1]


def test_field_reads_whole_islands():
    """Beside base spans, before a token that touches a letter, and however long the island is."""
    field = pii.trained()
    found = lambda text: [(text[s:e], k) for s, e, k in pii.find(text, field)[1]]
    phone, card = ("(212) 555-0199", "phone"), ("4111 1111 1111 1111", "card")
    assert found("4111 1111 1111 1111 (212) 555-0199") == [card, phone]
    assert found("10.0.0.1 212-555-0199") == [("10.0.0.1", "ip"), ("212-555-0199", "phone")]
    assert found("(212) 555-0199 2nd floor") == found("(212) 555-0199 5pm") == found("A12 (212) 555-0199") == [phone]
    assert found("x12345678901y 2020-01-31") == []
    assert found("b" * 80 + " (at) mail (dot) com") == [("b" * 80 + " (at) mail (dot) com", "email")]
    many = " ".join(["212-555-0199"] * 400)
    assert found(many) == [("212-555-0199", "phone")] * 400


def test_long_runs_take_time_in_proportion():
    """Runs of digits and dots that make a pattern search quadratic or overflow the conversion of numbers."""
    field = pii.trained()
    begin = time.time()
    for text, n in (("0" * 5000 + "1.1.1.1", 1), ("1" * 1_000_000 + ".", 0), ("1." * 500_000, 125_000), ("a1" * 300_000, 0), ("+1" + " " * 500_000, 0), ("AB12" * 100_000, 0)):
        assert len(pii.find(text, field)[0]) == n
    assert time.time() - begin < 20
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("0125.. +-@ax") for _ in range(rng.randrange(40)))
        want = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m.group().split("."))]
        assert [s[:2] for s in pii.base_spans(text) if s[2] == "ip"] == want


def test_no_entity_is_lost_at_any_offset():
    field = pii.trained()
    for k in (*range(0, 30), *range(240, 270), *range(505, 520)):
        text = "1 " * k + "(578) 555-6437"
        assert [s for s in pii.find(text, field)[1] if text[s[0] : s[1]].endswith("555-6437")], k


def test_field_on_examples_it_has_not_seen(spark):
    """Held-out islands, and the middle table: every planted key is found and nothing in texts without any personal data."""
    field, right, found, there = pii.trained(), 0, 0, 0
    for tokens, before, gold in pii._examples(600, seed=77):
        want, got = {g for g in gold if g[2]}, set(field.decode(tokens, before))
        right, found, there = right + len(want & got), found + len(got), there + len(want)
    assert right >= 0.97 * found and right >= 0.9 * there
    keys = 0
    for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.coalesce("text", F.lit(""))).collect():
        base, both = pii.find(text, field)
        secrets = [m.span(1) for m in re.finditer('(?i)token = "([0-9a-f]{40})"', text)]
        assert set(secrets) == {s[:2] for s in both if s[2] == "secret"}
        keys += len(secrets)
        assert all(s[2] in ("secret", "phone") for s in set(both) - set(base))
    assert keys
    found = lambda text: [(text[s:e], k) for s, e, k in pii.find(text, field)[1]]
    assert found("write to mike at mail dot com now") == [("mike at mail dot com", "email")]
    assert found("her ssn 078-05-1120 is out") == [("078-05-1120", "id")] and found("iban DE89370400440532013000.") == [("DE89370400440532013000", "id")]
    assert found("in commit 9fceb02d0ae598e95dc970b74767f19372d61af8 of") == [] and found("we met at noon. dot com was") == []


def test_pii_rows(odd):
    got = pii.find_pii(odd).collect()
    assert len(got) == len(ROWS)
    assert next((r["n_phone"], r["n_email"]) for r in got if r["doc_id"] == 7) == (1, 1)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(odd).collect()}
    assert clean[7] == "call <PHONE> or <EMAIL>" and clean[2] is None and pii.find_pii(odd.limit(0)).count() == 0
    assert pii.redact(odd.limit(0)).count() == 0 and sum(r["text"] == clean[4] for r in pii.redact(odd).collect()) == 3


def check_packing(rows, texts, tokenizer):
    tok = Tokenizer.from_file(tokenizer)
    tok.encode_special_tokens = True
    want = []
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(i), k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), sum(w[3] for w in want)


def test_word_encoder_equals_the_library():
    """Every entry of the vocabulary encodes to itself, with and without the end mark, and odd texts get the library's ids."""
    path = P.path(packing.TOKENIZER)
    encoder, rng = packing.WordEncoder(path), random.Random(3)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ended, inner = encoder.tokenizer.model, BPE(model["vocab"], [tuple(m) for m in model["merges"]])
    for token in model["vocab"]:
        mark = token.endswith("</w>")
        assert [t.value for t in (ended if mark else inner).tokenize(token.removesuffix("</w>"))] == [token]
    pool = [chr(c) for c in range(256)] + list("'''stremvld  \n\n..,,!!") * 6 + list("бвΣς中文́’😀İ<|>")
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(8000)]
    texts += ["".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(1, 60))) for _ in range(8000)]
    texts += ["ab" * n for n in range(0, 400, 7)] + ["<|endoftext|> x <\x00>", "don't 'st ,'s", "a b " * 500 + "b" * 3000]
    assert [encoder.encode(t) for t in texts] == encoder._library(texts)


def test_packing(odd, docs, texts):
    path = P.path(packing.TOKENIZER)
    check_packing(packing.pack(odd, path).collect(), ROWS, path)
    used, total = check_packing(packing.pack(docs.repartition(3), path).collect(), list(texts.items()), path)
    assert used <= 1.03 * -(-total // 4096) and packing.pack(odd.limit(0), path).count() == 0


def test_best_two_fit_replaces_the_smallest():
    patterns = packing.plan({6: 1, 2: 1, 3: 1, 1: 1}, 10)
    assert patterns[0][1] == [(6, 1), (3, 1), (1, 1)]


def test_simhash(odd, docs, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    assert all(int(got[i]["fingerprint"], 16) == f for i, f in zip(ids, fps))
    want = plain_components(ids, fps)
    assert {i: got[i]["component_id"] for i in ids} == want
    assert simhash.near_duplicates(odd).count() == len(ROWS) and simhash.near_duplicates(odd.limit(0)).count() == 0
    assert simhash.keep_one(docs).count() == len(set(want.values()))
    assert {r["component_id"] for r in simhash.near_duplicates(odd).where("doc_id in (2, 3, 5)").collect()} == {2}


@pytest.mark.parametrize("options", [{}, {"chunk": 40}, {"chunk": 20, "split": 2}, {"blocks": 7}])
def test_dense_fingerprints_lose_no_link(spark, options):
    rng = np.random.default_rng(1)
    fps = set()
    for base in rng.integers(0, 2**63, 4).tolist():
        for _ in range(150):
            y = base
            for k in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                y ^= 1 << k
            fps.add(y)
            base = y if rng.random() < 0.2 else base
    signed = sorted(simhash._signed(x) for x in fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), **options)
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = plain_components(signed, [x % 2**64 for x in signed])
    least = {}
    for x in signed:
        least.setdefault(got.get(x, x), x)  # in order: the smallest of each component
    assert {x: least[got.get(x, x)] for x in signed} == want


def plain_similar(rows, similarity=0.8):
    """Components of equal or similar sets of five-word shingles, all pairs compared."""
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) / len(a | b) >= similarity):
                up[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [(doc, least.get(top(i))) for i, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize("chunk", [1024, 90])
def test_similar(spark, chunk):
    rng, rows = random.Random(3), []
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [word() for _ in range(70)]
    for size, length in ((200, 300), (90, 60), (20, 25), (3, 9), (2, 6)):
        base = [word() for _ in range(length)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(1 + length // 60)):
                own[rng.randrange(length)] = word()
            if rng.random() < 0.1:
                base = own  # chains
            rows.append(" ".join(own))
    rows += [" ".join(shared + [word() for _ in range(rng.randrange(40, 200))]) for _ in range(100)]  # one passage, different documents
    rows += [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(60)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash.similar(df, chunk=chunk).collect()))
    assert got == plain_similar(rows)
    assert simhash.keep_one_similar(df, chunk=chunk).count() == len({c for _, c in got})


def test_similar_odd(spark, odd):
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or 0)
    assert sorted(map(tuple, simhash.similar(odd).collect()), key=key) == sorted(plain_similar(ROWS), key=key)
    assert simhash.similar(odd.limit(0)).count() == 0
    kept = simhash.keep_one_similar(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 6, 7, 8, None}


def test_similar_moves_no_whole_table(spark):
    """Texts without near copies are neither shuffled nor written, whatever the plan's thresholds."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(4000))) for i in range(200)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(2)]
    df = simhash.settle(spark.createDataFrame(rows, "doc_id long, text string"), "rows")
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def moved(after=-1):
        """Of the stages after the given one: the last one's number, bytes shuffled, bytes written."""
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        new = [s for s in (found.apply(k) for k in range(found.size())) if s.stageId() > after]
        return max((s.stageId() for s in new), default=after), sum(s.shuffleWriteBytes() for s in new), sum(s.outputBytes() for s in new)

    last, whole = moved()[0], sum(len(x) for _, x in rows)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one_similar(df)
        assert sorted(r[0] for r in kept.collect()) == list(range(200))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    _, shuffled, written = moved(last)
    assert 0 < shuffled < whole / 4 and 0 < written < whole / 4


@pytest.mark.parametrize("sieve", [1, 20])
def test_sifted_rows(spark, sieve):
    """A full filter lets rows through that the exact joins drop; null and repeated ids find their own texts."""
    docs = spark.createDataFrame([(i if i % 7 else None, f"{i}") for i in range(600)] + [(5, "x"), (5, None)], "doc_id int, text string")
    gone = simhash.settle(spark.createDataFrame([(i,) for i in range(0, 600, 2)], "doc_id long"), "gone")
    kept = simhash._without(docs, gone, sieve)
    odd = {r["text"] for r in docs.collect() if r["doc_id"] is None or r["doc_id"] % 2}
    assert kept.schema == docs.schema and {r["text"] for r in kept.collect()} == odd and kept.count() == len(odd)
    rows = simhash._marked(simhash.id_text(docs))
    ends = simhash.settle(rows.where("text in ('7', '14', '5', 'x', '8') or text is null").select(F.coalesce(F.hash("text"), F.lit(0)).cast("long").alias("node"), "at"), "ends")
    want = {r["node"]: r["text"] for r in rows.join(ends, "at").select("node", "text").collect()}
    got = simhash._texts_at(simhash.id_text(docs), ends, sieve).collect()
    assert len(got) == 6 and {r["node"]: r["text"] for r in got} == want and set(want.values()) == {"7", "14", "5", "x", "8", None}


def test_components_in_few_rounds(spark):
    rounds, chain = [], spark.range(1024).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(chain, rounds).collect()
    assert len(got) == 1025 and len({r["root"] for r in got}) == 1 and len(rounds) <= 15
    assert connected_components(chain.limit(0)).count() == 0 and [simhash.blocks_for(n) for n in (1, 10**8, 10**9, 10**12)] == [6, 6, 7, 8]


def test_html(spark):
    page = "<html><body><header><h1>Site</h1></header><div class='content'><p>Text %d &amp; more<p>Second</div><div class=sidebar>links</div><div id='comments'><p>nice</div></body></html>"
    rows = [(i, f"http://A.b/{i}", page % i) for i in range(4)] + [(9, None, None), (10, "", ""), (11, "http://q/", "<body><main>a<aside>b</aside>c<script>x<p></script></main>d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got == {**{i: f"Text {i} & more\nSecond" for i in range(4)}, 9: "", 10: "", 11: "a\nc"}
    assert html.extract(df.limit(0)).count() == 0


TEMPLATE = """<html><body><div class=top>Welcome to the site</div><div class=c><h1>Title %d</h1><p>Story %d tells of %s.</p>%s<p>Subscribe to our list today, friends</p><div class=ad>Buy %d</div>
<div class="comments"><p>I like %d</div></div><div>All rights</div></body></html>"""


def template_pages(host, more=lambda k: ""):
    return [(k, f"http://{host}/{k}", TEMPLATE % (k, k, "many long things " * (k + 3), more(k), k, k)) for k in range(12)]


def test_constant_text_goes_and_single_blocks_stay(spark):
    """The template decides: constant blocks without a telling name go, blocks of one page stay whatever their name."""
    single = lambda k: "<div class='related-work'>Others found %d</div><div class=notice>Mind the gap</div>" % k if k == 3 else "<p>Seen by all, often</p>" * (k % 3)
    df = spark.createDataFrame(template_pages("a.b", single), "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in html.extract(df).collect()}
    for k, blocks in got.items():
        own = ["Others found 3", "Mind the gap"] if k == 3 else ["Seen by all, often"] * (k % 3)
        assert blocks == [f"Title {k}", " ".join(f"Story {k} tells of {'many long things ' * (k + 3)}.".split()), *own]


def test_shared_text_of_copies_is_no_template(spark):
    """Pages of a host that hold one and the same article keep it."""
    page = "<body><nav>%d</nav><article><h1>One</h1><p>the same long article on every page</p></article></body>"
    df = spark.createDataFrame([(k, "http://a.b/", page % k) for k in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in html.extract(df).collect()} == {"One\nthe same long article on every page"}


def test_classes_against_plain_vectors(spark):
    """Classes of equal occurrence vectors, made by hashes on the cluster, equal those of plain vectors."""
    rows = template_pages("a.b", lambda k: "<ul>" + "<li>x<b>y</b>" * (k % 4) + "</ul>" if k % 2 else "")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(7).cast("long"))
    (found,) = html.templates(df).collect()
    vectors = {}
    for k, (_, _, page) in enumerate(rows):
        for token, row in html.tokens_of(page)[0].items():
            vectors.setdefault(token, [0] * len(rows))[k] = row[0]
    assert found["classes"] and all(len({tuple(vectors[t]) for t in c}) == 1 for c in found["classes"])
    assert {t for t, v in vectors.items() if v == [1] * 12} == set(found["classes"][0])


def test_html_odd_pages():
    """Quotes as browsers have them, unclosed elements, and nesting in linear time."""
    assert html.main_text("<p title=it's>Hello</p><a href=\"x>y\" title='>'>b</a>") == "Hello\nb"
    assert html.main_text("<div>" * 100_000 + "x") == "x" and html.main_text("<ul><li>a<li>b<table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    assert len(html.main_text("<body><p>" + "word &amp; " * 200_000)) == len("word & " * 200_000) - 1
    assert html.deduce([html.Token(k, max(0, k - 1), "div ", 9, 9, 1, 1, 9 * k, 0, -1) for k in range(50_000)], 9)[1] is None


def test_html_pages(spark):
    import html as escaping

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S).group(1)
        blocks = [" ".join(escaping.unescape(re.sub("<br>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in re.split("</?(?:h1|p)>", article)]
        assert r["text"] == "\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("digest", [dedup._whole, lambda s: F.substring(s, 1, 1)])
def test_exact_dedup(odd, digest):
    d = dedup.ExactDedup(odd.repartition(3), digest=digest, bytes_per_trigger=1)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in ROWS:
        groups.setdefault(norm(t), []).append(i)
    rows = d.report().collect()
    assert len(rows) == len(ROWS) and sum(r["kept"] for r in rows) == len(groups) == d.kept().count()
    for t, ids in groups.items():
        own = [r for r in rows if r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()]
        assert {r["keep_id"] for r in own} == {min((i for i in ids if i is not None), default=None)} and {r["group_size"] for r in own} == {len(ids)}
    assert d.kept().columns == odd.columns


def test_exact_dedup_of_nothing(odd):
    d = dedup.ExactDedup(odd.limit(0))
    assert d.report().count() == d.kept().count() == 0


def test_bpe(odd, texts):
    ranks = bpe.load_ranks(P.path(bpe.RANKS))
    own, lib = bpe.BytePairEncoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sample = [*list(texts.values())[:60], *(t or "" for _, t in ROWS), "  a", "a\n\n b", "\x1c a", "it's 'S we'll", "x" * 300, "a 's b"]
    for t, ids in zip(sample, own.encode_all(sample)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t) and own.decode(ids) == t.encode()
    assert bpe.round_trip(odd, P.path(bpe.RANKS), P.PATTERN).count() == len(ROWS)
    assert all(own.hash.slots[s] == k for k, s in zip(list(ranks)[:500], own.hash.find(list(ranks)[:500]))) and own.hash.find([b"\x00no key"]) == [-1]


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "a: b:", "\\b</turn"), (2, 1, "assistant", "</turn>\n### user: hi\\"), (3, None, None, None), (4, 1, "assistant", "x"), (4, 1, "assistant", "x"), (None, 0, "user", "\\### ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(df).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("spans")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("a: b:", "\\b</turn"), ("assistant", "</turn>\n### user: hi\\")]
    assert got[2]["loss"] == "</turn>\n### user: hi\\" and got[4]["loss"] == "xx" and got[3]["turns"][0]["text"] == ""
    assert got[1]["formatted"] == "#0\n### user: hi</turn>\n### assistant: yo</turn>\n" and chat.format_chats(df.limit(0)).count() == 0


def test_jpeg(odd, monkeypatch):
    rng = np.random.default_rng(0)
    for n in (1, 5, 6, 13, 1600):
        payload = rng.integers(0, 256, 64 * n).astype(np.uint8).tobytes()
        frame = jpeg.decode(media := jpeg.encode(payload))
        assert jpeg.payload_of(frame) == payload and jpeg.rgb_of(frame).shape[2] == 3
        if n < 50:
            with monkeypatch.context() as m:
                m.setattr(jpeg, "_read_scan", jpeg._read_any)
                assert all((a == b).all() for a, b in zip(frame.coefficients, jpeg.decode(media).coefficients))
    rows = jpeg.load_media(jpeg.store_texts(odd)).collect()
    by = {(r["doc_id"], r["n_bytes"]): bytes(r["payload"]) for r in rows}
    for i, t in ROWS:
        raw = (t or "").encode()
        assert by[i, len(raw)] == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    assert jpeg.store_texts(odd.limit(0)).count() == 0


def test_langid(docs, odd, spark):
    filters = langid.learn(docs)
    rows = langid.identify(docs, filters).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, filters).collect()}
    assert got[2] == got[3] == got[5] == ("und", 0.0) and got[1][0] == "en" and len(got) == 9
    assert langid.keep_identified(odd, filters).count() == len(ROWS) - 3 and langid.identify(odd, langid.Filters([], [])).where("lang_pred = 'und'").count() == len(ROWS)


def test_language_decides_who_stays(docs, spark):
    filters = langid.learn(docs)
    rows = spark.createDataFrame([(1, "the text of the house"), (2, "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺᚾ"), (3, "12 + 5")], "doc_id long, text string")
    assert [r["doc_id"] for r in langid.keep_identified(rows, filters).collect()] == [1]
    assert langid.keep_identified(rows, langid.Filters([], [])).count() == 0


def test_langid_has_any_number_of_languages(spark):
    rng = random.Random(2)
    own = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(4)] for _ in range(70)]
    rows = [(70 * j + k, " ".join(rng.choice(own[k]) for _ in range(30)), f"l{k:02}") for k in range(70) for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.learn(df)
    assert len(filters.languages) == 70 and len(filters.tables) == 2
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, filters).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


@pytest.mark.parametrize("head", [1 << 17, 200])
def test_lm(docs, texts, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = lm.score(docs).collect()
    counts, tokens = Counter(), {i: [*words(t), None] for i, t in texts.items()}
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(t)
    total = sum(counts.values())
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_scores_every_word_after_every_word(spark):
    """600 equally frequent words: all are scored by the model, it sums to one, and it knows which word follows which."""
    rng = random.Random(4)
    text = lambda: " ".join(f"w{x} v{x}" for x in (rng.randrange(300) for _ in range(2000)))
    rows = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string").repartition(2)
    vocab, _ = lm.vocabulary(lm.word_counts(rows))
    start, model = lm.LogBilinear(vocab), lm.trained(rows, spark.sparkContext.broadcast(vocab), vocab)
    assert len(vocab.rank) == 601 and set(vocab.class_of[:-1]) <= set(range(lm.CLASSES - 1))
    after = lambda m, w: m.log_probabilities(vocab, np.append(np.arange(601), -1), np.full(602, vocab.rank[w]), np.full(602, 0))
    empty = [k for k in range(lm.CLASSES - 1) if vocab.edge[k] == vocab.edge[k + 1]]
    for w in (b"w3", b"w250"):
        spare = sum(class_probability(vocab, model, k, vocab.rank[w], 0) for k in empty)  # of classes without words
        assert abs((10.0 ** after(model, w)).sum() + spare - 1) < 1e-3
    gain = [after(model, b"w%d" % x)[vocab.rank[b"v%d" % x]] - after(start, b"w%d" % x)[vocab.rank[b"v%d" % x]] for x in range(0, 300, 10)]
    assert np.mean(gain) > 0.3


def class_probability(vocab, model, k, one, two):
    """By a plain loop: the share of class k among all, through its branch."""
    p, size = {n: t.astype(float) for n, t in model.p.items()}, lm.CLASSES // lm.BRANCHES
    ahead = p["r"][one] @ p["m1"] + p["r"][two] @ p["m2"]
    part = lambda rows, at: math.exp(rows[at, :-1] @ ahead + rows[at, -1]) / sum(math.exp(x[:-1] @ ahead + x[-1]) for x in rows)
    return part(p["qs"], k // size) * part(p["qc"][k // size * size :][:size], k % size)


def test_lm_scores_equal_a_plain_loop(docs, texts, spark):
    """The score column against a loop over tokens with the same trained tables."""
    rows = lm.prepared(docs)
    vocab, _ = lm.vocabulary(lm.word_counts(rows.where("not held_out")))
    model = lm.trained(rows.where("not held_out"), spark.sparkContext.broadcast(vocab), vocab)
    sample = sorted(texts, key=lambda i: len(texts[i]))[40:60]
    for i in sample:
        ranks = [vocab.rank.get(w.encode(), -1) for w in words(texts[i])] + [0]
        want, p = 0.0, {n: t.astype(float) for n, t in model.p.items()}
        for at, rank in enumerate(ranks):
            one, two = (ranks[at - 1] if at else 0), (ranks[at - 2] if at > 1 else 0)
            k = vocab.class_of[rank]
            want += math.log10(class_probability(vocab, model, k, one, two))
            if rank >= 0:
                own = p["q"][vocab.edge[k] : vocab.edge[k + 1]]
                ahead = p["r"][one] @ p["m1"] + p["r"][two] @ p["m2"]
                s = own[:, :-1] @ ahead + own[:, -1]
                want += (s[rank - vocab.edge[k]] - math.log(np.exp(s).sum())) / math.log(10)
            else:
                want += math.log10(0.1) - vocab.log_rest
        got, *_ = [sum(model.log_probabilities(vocab, r, *vocab.before(r, f))) + (r < 0).sum() * (math.log10(0.1) - vocab.log_rest) for _, r, f in [vocab.codes([texts[i]])]]
        assert math.isclose(got, want, rel_tol=1e-4)


class Gathered(lm.Pass):
    """The same step with a row of its own for every token and outcome on all levels, and sorted sums."""

    def _step(self, ranks, one, two):
        p, moves, back = self.model.p, [], np.zeros((len(ranks), lm.DIM + 1), np.float32)
        r1, r2 = p["r"].take(one, axis=0), p["r"].take(two, axis=0)
        whole = self.model.ahead(r1, r2)
        for name, (group, member) in self.vocab.paths(ranks).items():
            n, edge, table, cumulated = len(group), self.vocab.levels[name][0], p[name], self.cumulated[name]
            lo, hi, ahead = edge[group], edge[group + 1], whole[: len(group)]
            draw = cumulated[lo] + self.rng.random(n) * (cumulated[hi] - cumulated[lo])
            fake = np.clip(np.searchsorted(cumulated, draw, "right") - 1, lo, hi - 1)
            first, last, at = np.searchsorted(group, group), np.searchsorted(group, group, "right"), np.arange(n)
            grads = [np.zeros((n, lm.DIM + 1), np.float32) for _ in range(2)]
            for k in range(lm.NOISE + 1):
                who = member if k == 0 else fake[at]
                rows = table.take(who, axis=0)
                pull = ((k == 0) - lm._logistic(np.einsum("nd,nd->n", ahead, rows) - self.offset[name][who]))[:, None]
                back[:n] += pull * rows
                grads[k > 0][at] += pull * ahead
                at = np.where(at + 1 == last, first, at + 1) if k else at
            moves.append((name, np.concatenate([member, fake]), np.concatenate(grads)))
        back = back[:, : lm.DIM]
        moves.append(("r", np.concatenate([one, two]) % len(p["r"]), np.concatenate([back @ p["m1"].T, back @ p["m2"].T])))
        moves += [(name, np.arange(lm.DIM), rows.T @ back) for name, rows in (("m1", r1), ("m2", r2))]
        for name, at, grad in moves:
            order = np.argsort(at)
            own, begin = np.unique(at[order], return_index=True)
            total, square = np.add.reduceat(grad.take(order, axis=0), begin, axis=0), self.square[name].reshape(-1)
            square[own] += np.square(total).mean(axis=1)
            p[name][own] = p[name].take(own, axis=0) + total * (lm.RATE / np.sqrt(square[own]))[:, None]
            self.used[name][own] += len(ranks) if name in ("m1", "m2") else np.diff(np.append(begin, len(at)))


def zipf_tokens(words, n):
    rng = np.random.default_rng(1)
    counts = 1 + 10**7 // np.arange(5, 5 + words)
    vocab = lm.Vocabulary([lm.END, *(b"w%d" % i for i in range(1, words))], counts, int(counts.sum() * 1.1), 2 * words)
    ranks = rng.choice(words + 1, n, p=np.append(counts, counts.sum() / 10) / (counts.sum() * 1.1))
    ranks[ranks == words] = -1
    return vocab, ranks, *vocab.before(ranks, np.arange(0, n, 300))


@pytest.mark.parametrize("noise, words, n", [(2, 5000, 2 * lm.BATCH + 77), (3, 3000, lm.BATCH), (1, 3000, 500), (2, 1, 40), (2, 300, 1)])
def test_lm_step_equals_one_with_a_row_for_every_token(monkeypatch, noise, words, n):
    """Same draws, same tables but for rounding, which grows over many steps."""
    monkeypatch.setattr(lm, "NOISE", noise)
    vocab, *tokens = zipf_tokens(words, n)
    model = lm.LogBilinear(vocab)
    own, plain = lm.Pass(vocab, model, 1), Gathered(vocab, model, 1)
    for x in (own, plain):
        x.learn(*tokens)
    for k in lm.LogBilinear.NAMES:
        assert np.allclose(own.model.p[k], plain.model.p[k], atol=1e-4) and np.array_equal(own.used[k], plain.used[k])
        assert np.allclose(own.square[k].reshape(-1), plain.square[k].reshape(-1), rtol=1e-3)
    assert max(np.abs(own.model.p[k] - model.p[k]).max() for k in ("r", "qs", "m1")) > 1e-3


def test_lm_step_takes_less_time_than_one_with_a_row_for_every_token():
    """It was the larger part of the CPU seconds; the best of several turns, as other work disturbs them."""
    vocab, *tokens = zipf_tokens(100000, 4 * lm.BATCH)
    model, took = lm.LogBilinear(vocab), {}
    for _ in range(5):
        for kind in (lm.Pass, Gathered):
            own, begin = kind(vocab, model, 1), time.thread_time()
            own.learn(*tokens)
            took.setdefault(kind, []).append(time.thread_time() - begin)
    assert min(took[lm.Pass]) < 0.75 * min(took[Gathered]), took


def test_log_softmax_survives_large_scores():
    ahead, table = np.array([[100.0, 1.0]], np.float32), np.array([[2.0, 0.0], [1.0, 0.0], [-3.0, 0.0]], np.float32)
    assert np.allclose([lm._log_softmax_at(ahead, table, np.array([k]))[0] for k in range(3)], [0, -100, -500])


def test_lm_odd(odd):
    """Empty table, nothing to learn from, repeats, nulls and a very long text."""
    assert lm.score(odd).count() == len(ROWS) and lm.score(odd.limit(0)).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = lm.score(odd.sparkSession.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in rows} == {(0, 0)} and all(math.isclose(r["base_score"], 0, abs_tol=1e-9) for r in rows)


def test_pipeline(spark, docs, texts):
    import corpus_pipeline as c

    frame, seen = docs, {}
    for name, stage in c.STAGES:
        frame = c.settle(stage(spark, frame, SMALL), name)
        seen[name] = frame
        if name != "packing":
            assert sorted(frame.columns) == sorted(docs.columns)
    ids = lambda name: sorted(r[0] for r in seen[name].select("doc_id").collect())
    first = [i for i, t in texts.items() if any(map(str.isalpha, t))]
    assert ids("language_id") == sorted(first)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    unique = {}
    for i in sorted(first):
        unique.setdefault(norm(texts[i]), i)
    second = sorted(unique.values())
    assert ids("exact_dedup") == second
    parts = plain_similar([(i, texts[i]) for i in second])
    assert ids("near_dedup") == ids("pii") == sorted({c for _, c in parts})
    assert not any(pii.base_spans(r[0]) for r in seen["pii"].select("text").collect())
    check_packing(frame.collect(), [(r["doc_id"], r["text"]) for r in seen["pii"].collect()], P.path(packing.TOKENIZER))
