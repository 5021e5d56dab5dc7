"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evoframe.llm import chat_format, decontaminate, embedding_dedup, html_extract, induced_sort, language_id, lm_score, ngram_join, packing, queries, sharding, suffix_dedup
from evoframe.llm.common import Scratch, connected_components

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_bytes string, score string"


def documents(seed=5, n=60):
    """Prose with exact and near copies, shared passages, junk, and odd texts; two columns have the names of results."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "é", "on", "Ñ", "st"]) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage = prose(60)
    texts = []
    for i in range(n):
        t = prose(r.randint(1, 90))
        if i % 5 == 0:
            t = f"{t} {passage} {prose(5)}"
        if texts and i % 7 == 0:
            t = r.choice(texts)
        if texts and i % 6 == 0:
            words = r.choice(texts).split(" ")
            words[r.randrange(len(words))] = word()
            t = " ".join(words)
        texts.append(t)
    texts += [None, "", " \n\t", "a", "aa" * 400, "Hetible th.\n" * 60, "thsh " * 50, prose(3000), texts[0], texts[0].upper()]
    return [(i, t, "en" if i % 2 else "fr", "s", None, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = documents()
    return rows, spark.createDataFrame(rows, DOCS).repartition(3).persist()


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7)]
    s = Sets(range(400))
    for a, b in edges:
        s.join(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {x.id: x.component for x in got} == {i: s.find(i) for a, b in edges for i in (a, b) if s.find(i) != i}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# 1
def test_vectors(spark):
    g = np.random.default_rng(2)
    base = g.normal(size=(40, 8))
    rows = [(i, base[i % 40] + g.normal(size=8) * g.choice([0.02, 0.08, 0.2])) for i in range(300)]
    rows = [(i, v.tolist(), 1) for i, v in rows]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] + [1.0] * 7, 1), (1003, [None] + [1.0] * 7, 1), (1004, [], 2), (1005, rows[0][1], 2), (1006, [x * 1e200 for x in rows[0][1]], 2)]
    rows.append(rows[3])  # a repeated row
    named = [(*r, r[0], "v", 1) for r in rows] + [(None, rows[0][1], 1, None, "v", 1)]  # a null id, and names of the operator's own
    table = spark.createDataFrame(named, "vec_id long, embedding array<double>, label int, id long, v string, n int")
    x = {i: np.array(v) for i, v, _ in rows if i < 1000 or i == 1005}
    x[1006] = x[0]
    unit = {i: v / np.sqrt(v @ v) for i, v in x.items()}
    s, n = Sets([r[0] for r in rows]), Counter()
    for i in unit:
        for j in unit:
            if i < j and unit[i] @ unit[j] >= 0.95:
                n.update((i, j)), s.join(i, j)
    want = {i: (n[i], s.find(i), s.find(i) == i) for i in s.up} | {None: (0, None, True)}
    assert sum(n.values()) > 500
    for options in ({}, {"cell_rows": 16}, {"cell_rows": 50, "max_pivots": 2}):
        got = embedding_dedup.near_duplicate_vectors(table, **options).collect()
        assert len(got) == len(want) and {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    assert embedding_dedup.near_duplicate_vectors(table.limit(0)).count() == 0
    assert embedding_dedup.near_duplicate_vectors(table.where("vec_id = 1000")).first().n_links == 0
    # of rows that repeat an id the least vector counts, wherever they stand; rows without an id all stay
    twice = [(1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0]), (4, None), (4, [2.0, 0.0]), (None, None), (None, [1.0, 0.0])]
    for order in (twice, twice[::-1]):
        got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)).collect()
        assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (0, 0, 0, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]
    alone = embedding_dedup.near_duplicate_vectors(spark.createDataFrame([(None, None), (5, None)], "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id or 0, r.kept) for r in alone.collect()) == [(0, True), (5, True)]


# 2
def test_suffix_sort():
    r = random.Random(3)
    for _ in range(300):
        n, a, cap = r.randint(1, 70), r.choice([1, 2, 3, 6]), r.choice([3, 8, 100])
        t = [r.randint(1, a) for _ in range(n)]
        order, common = induced_sort.SuffixSort(np.array(t), cap, r.choice([induced_sort.BUDGET, 200])).sort()  # the small budget spills
        s = [(*t[i:], 0) for i in range(n + 1)]
        assert sorted(order.tolist()) == list(range(n + 1))
        for i in range(1, n + 1):
            x, y = s[order[i - 1]], s[order[i]]
            k = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert x[:cap] <= y[:cap] and common[i] == min(k, cap)


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                hit[k : k + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for k, h in enumerate(hit) if h and (not k or not hit[k - 1]))
        out[i] = (len(b), sum(hit), spans, hashlib.sha256(bytes(c for c, h in zip(b, hit) if not h)).hexdigest())
    return out


@pytest.mark.parametrize("length,gram,shard", [(100, 24, 4 << 20), (30, 8, 2000)])
def test_repeats(spark, docs, length, gram, shard):
    rows, df = docs
    want = brute_repeats([r[:2] for r in rows], length)
    got = suffix_dedup.remove_repeats(df, length=length, gram=gram, shard_bytes=shard, digest=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    full = suffix_dedup.remove_repeats(df, length=length, gram=gram)
    assert full.columns == [c for c in df.columns if c != "n_bytes"] + ["n_bytes", "n_removed", "n_spans"]
    assert full.where("doc_id = 60").first().text is None
    assert suffix_dedup.remove_repeats(df.limit(0), digest=True).count() == 0
    odd = df.select("doc_id", "text", F.lit(1).alias("ranges"), F.lit("a").alias("doc"), F.lit("b").alias("kept"), F.lit(2).alias("__doc"), F.lit(3).alias("__text"))
    got = suffix_dedup.remove_repeats(odd, length=length, gram=gram)
    assert got.columns == [*odd.columns, "n_bytes", "n_removed", "n_spans"]
    assert {(r.doc_id, r.n_removed, r.ranges, r.doc, r.kept, r["__doc"]) for r in got.collect()} == {(i, w[1], 1, "a", "b", 2) for i, w in want.items()}
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, length=256)


def test_an_anchor_beyond_a_shard():
    import tracemalloc

    r = random.Random(2)
    line, shard = b"x" * 5 + b"the licence of this page" + b"y" * 5, 1 << 15
    near = lambda: b"".join(r.choice([b"ab", b"cd"]) for _ in range(4))

    def rows(n, hot):
        made = [(5, d, 7, near() + bytes(r.choices(b"pq", k=2)) + line + near()) for d in range(n if hot else 40)]
        return [(1, d, 0, b"z" * 45) for d in range(5)] + made + [(9, d, 90, near() * 5) for d in range(60)]

    def brute(given, length):
        first, out = {}, set()
        for anchor, d, s, raw in sorted(given, key=lambda x: (x[1], x[2])):
            for k in range(len(raw) - length + 1):
                w = raw[k : k + length]
                if first.setdefault((anchor, w), (d, s + k)) != (d, s + k):
                    out |= {(d, s + j) for j in range(k, k + length)}
        return out

    covered = lambda found: {(d, j) for part in found for d, s, e in zip(*(x.tolist() for x in part)) for j in range(s, e)}
    for n, size in ((400, 300), (400, 2000), (3000, 900)):
        given = rows(n, True)
        assert covered(suffix_dedup.sort_shards(iter(given), 30, size)) == brute(given, 30)
    settled = suffix_dedup.Strings(30, 64)  # files that are dealt again
    assert covered([settled.add(*(np.array([x[i] for x in given]) for i in (1, 2)), [x[3] for x in given]), *settled.settle()]) >= brute(given, 30)
    peak = {}
    for times in (2, 16):  # the memory does not grow with the anchor
        data = ((5, d, 7, r.randbytes(70) + line + r.randbytes(70)) for d in range(times * shard // 170))
        tracemalloc.start()
        for _ in suffix_dedup.sort_shards(data, 100, shard):
            pass
        peak[times] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak[16] < 1.5 * peak[2], peak


# 3
def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, "a: b\n", None), (2, None, None, "é\\"), (None, 0, "assistant", " </turn>\n### user: x"), (3, 0, "assistant", "long " * 5000), (3, 1, "assistant", ""), (3, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.digest_conversations(made).collect()}
    assert len(got) == 4
    for c in (1, 2, 3, None):
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[c].n_turns == len(own)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert made.where("conv_id = 1").first().formatted.count(" </turn>\n") == 2
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_in_parts(spark):
    r = random.Random(3)
    rows = [(c, r.choice([None, *range(40)]), r.choice(["user", "assistant", None]), "".join(r.choice("aé\\#<: \n") for _ in range(r.randint(0, 90)))) for c in (None, 7, 8) for _ in range(150)]
    rows += [(7, 3, "assistant", "same é")] * 60 + [(9, 0, "user", "short"), (10, 0, "assistant", "x" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    whole = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    made = chat_format.format_conversations(df, part_bytes=700)
    parts = {}
    for r in made.collect():
        parts.setdefault(r.conv_id, []).append(r)
    assert len(whole) == 5 and len(parts) == 5 and len(parts[9]) == 1 and all(len(parts[c]) > 8 for c in (None, 7, 8))
    assert all(len(r.formatted.encode()) < 5000 for c in (None, 7, 8) for r in parts[c])  # bounded, however long the conversation
    for c, own in parts.items():
        own.sort(key=lambda r: r.part)
        assert [r.part for r in own] == list(range(own[0].parts)) and sum(r.n_turns for r in own) == whole[c].n_turns
        assert "".join(r.formatted for r in own) == whole[c].formatted and [s for r in own for s in r.loss_spans] == whole[c].loss_spans
        assert all(whole[c].formatted[r.start :].startswith(r.formatted) for r in own)
    key = lambda d: sorted(map(str, chat_format.digest_conversations(d).collect()))
    assert key(made) == key(chat_format.format_conversations(df))


# 4
PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href=x>{a}</a></ul></nav>
<div class="ad">{b}</div><article><header><h1>{t}</h1><span>by me</span></header><p>One &amp; {t}<br>two<p>  {b}  <b>bold</b> text
<script>var x = "<p>no</p>";</script><div class="comments"><p>reader</p></div><form>send</form><blockquote>q{t}</blockquote></article>
<div id="cookie-notice">ok?</div><footer>&copy; host</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(a=f"menu{i}", b=f"body {i}", t=f"title {i}")) for i in range(12)]
    rows += [(50, None, None), (51, "x", ""), (52, "http://p.example.com", "plain &lt;text&gt;  here"), (53, "http://q.example.com/1", "<div><p>cut <b"), rows[0]]
    # a host without article elements: the wrapper tells what varies
    rows += [(60 + i, "http://n.example.com/", f"<body><div><span>Same words here</span></div><div><p>Some long text number {i} of the page.</p><p>More of {i}</p></div></body>") for i in range(8)]
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    want = {i: f"title {i}\nOne & title {i} two\nbody {i} bold text\nqtitle {i}" for i in range(12)}
    want |= {50: "", 51: "", 52: "plain <text> here", 53: "cut"} | {60 + i: f"Some long text number {i} of the page.\nMore of {i}" for i in range(8)}
    assert len(got) == len(rows) and all(want[i] == t and n == len(t) for i, t, n in got)
    assert html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_bytes=0).where("n_chars > 0").count() == 12 + 1 + 2 + 8
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_one_host_with_mixed_layouts(spark):
    says = lambda i: f"<p>Long text number {i} of this page.</p><p>More of {i} follows.</p>"
    want = lambda i: f"Long text number {i} of this page.\nMore of {i} follows."
    menu = "<div class=links><a href=x>Home</a></div>"
    layouts = ["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<article></article><div id=text>{}</div>", "<div><div><section><article>{}</article></section></div></div>"]
    for url in ("http://mixed.example.com/", None, "odd"):
        rows = [(i, url, f"<body>{menu}{layouts[i % 5].format(says(i))}</body>") for i in range(40)]
        rows += [(40, url, "plain text &amp; no markup"), (41, url, "<p>only a paragraph"), (42, url, f"<body>{menu}<div id=other><h2>Head</h2>{says(42)}</div>")]
        got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: want(i) for i in range(40)} | {40: "plain text & no markup", 41: "only a paragraph", 42: "Head\n" + want(42)}


def test_pages_keep_what_only_sounds_like_other_parts():
    kept = [
        "<section id='related-work'>{}</section>", "<h2 class='section-header'>{}</h2>", "<div class='side-by-side'>{}</div>", "<table><tr><td class='share-price'>{}</table>", "<p class=notice>{}</p>",
        "<p><a href='/hidden-valley'>{}</a></p>", "<p title='a hidden gem'>{}</p>", "<p data-hidden=no>{}</p>", "<p data-class='ad'>{}</p>", "<p title='x class=ad'>{}</p>", "<p><a href=/a/hidden>{}</a></p>", "<div class='no-sidebar'>{}</div>",
    ]
    gone = ["<p hidden>{}</p>", "<p class=x hidden=''>{}</p>", "<div class='big sidebar'>{}</div>", "<div ID=Comments>{}</div>", "<div aria-hidden=true>{}</div>", "<div role=navigation>{}</div>", "<div class=ad>{}</div>", "<p style='display: none'>{}</p>"]
    for part in kept + gone:
        page = html_extract.blocks(html_extract.parse(f"<article><p>before</p>{part.format('these words')}<p>after</p></article>"))
        text = html_extract.extract(page, html_extract.fold(page))
        assert text.split("\n") == ["before", *["these words"] * (part in kept), "after"], part


PAGES = "page_id long, url string, html string, wrapper string, host string, n string"


def texts_of(spark, rows, **options):
    df = spark.createDataFrame([(*r, "w", "h", "n") for r in rows], PAGES).repartition(3)
    return [(r.page_id, r.text) for r in html_extract.extract_main_text(df, **options).collect()]


def test_what_all_pages_of_a_host_say_is_template(spark):
    said = lambda i: f"Own paragraph number {i} of this page, {7 * i} words."
    page = lambda i: f"<body><div class=links><a href=x>Home</a></div><div id=content><h1>The site</h1><p>Please enable cookies</p><ul><li><a href=a>One</a><li>Two</ul><p>{said(i)}</p><p>Subscribe <b>now</b></p></div></body>"
    for n, left in ((10, True), (2, False)):  # two pages cannot tell
        rows = [(i, "http://a.example.com/x", page(i)) for i in range(n)]
        for options in ({}, {"broadcast_bytes": 0, "salts": 3}):
            got = dict(texts_of(spark, rows, **options))
            assert all((t == said(i)) == left for i, t in got.items()) and len(got) == n
    # copies weigh one page: a host of two pages, one of them many times, has no template
    rows = [(0, "http://b.example.com/", page(0))] * 30 + [(1, "http://b.example.com/", page(1))]
    got = texts_of(spark, rows)
    assert len(got) == 31 and all("The site" in t and said(i) in t for i, t in got)
    # near copies lose nothing
    long = [f"<p>{w} " + "words of the same article " * 5 + "</p>" for w in "abcdefghijklmn"]
    rows = [(i, "http://c.example.com/", "<article>" + "".join([*long[:i], f"<p>edit {i}</p>", *long[i:]]) + "</article>") for i in range(8)]
    assert all(t.count("\n") == 14 and f"edit {i}" in t for i, t in texts_of(spark, rows))


def test_forms_around_pages_and_labels(spark):
    """A form around the page is no form of the page; a label in a sentence is text, one of a control is not."""
    prose = "<p>A <label>kept word</label> b</p><p><label for=q>Your name</label> <input id=q> after</p><p><label>Mail <input></label> end</p>"
    want = "A kept word b\nafter\nend"
    shells = ["<body><form id=aspnetForm><input type=hidden><div><h1>Head {i}</h1>PROSE<p>Own words {i}</p></div></form></body>", "<body><form><article><h2>Head {i}</h2>PROSE<p>Own words {i}</p></article></form></body>"]
    for shell in shells:
        got = dict(texts_of(spark, [(i, "http://f.example.com/", shell.replace("PROSE", prose).format(i=i)) for i in range(2)]))
        assert got == {i: f"Head {i}\n{want}\nOwn words {i}" for i in range(2)}
    only = "<body><div class=menu><a href=x>Home</a></div><form>" + prose + "<p>Nothing else</p><button>Send</button></form></body>"
    assert dict(texts_of(spark, [(1, "http://g.example.com/", only)])) == {1: want + "\nNothing else"}
    search = "<body><div><h1>Title</h1><p>Text of the page</p><form><h3>Subscribe</h3><p>to our letter</p><label>Mail</label><input></form></div></body>"
    assert dict(texts_of(spark, [(1, "http://h.example.com/", search)])) == {1: "Title\nText of the page"}


def test_boilerplate_of_short_pages_goes(spark):
    block = "<div><p>" + "boilerplate words of the site " * 28 + "</p></div>"
    for own in ("short own text {i}", "a much longer text of its own, number {i}, " * 40):
        got = dict(texts_of(spark, [(i, "http://s.example.com/", f"<body><div>{block}<p>{own.format(i=i)}</p></div></body>") for i in range(10)]))
        assert got == {i: own.format(i=i).strip() for i in range(10)}


def test_long_lists_of_unlike_siblings(spark):
    r = random.Random(6)
    began = time.perf_counter()
    for kinds in (26, 10**9):  # few classes in any order, or a class of its own for nearly every row
        name = lambda: "".join(chr(97 + int(c)) for c in str(r.randrange(kinds)))  # noqa: B023, E731
        rows = [(i, "http://u.example.com/", "<body><div id=list>" + "".join(f"<div class=k{name()}><p>{i} {k}</p></div>" for k in range(20_000)) + "</div></body>") for i in range(3)]
        got = dict(texts_of(spark, rows))
        assert got == {i: "\n".join(f"{i} {k}" for k in range(20_000)) for i in range(3)}
    assert time.perf_counter() - began < 120


def plain_align(a, b):
    """The weight of the best order-keeping matching, by the table of all pairs."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + html_extract.matched(p, q))
    return best[-1][-1]


def test_alignment_is_the_heaviest():
    r = random.Random(9)
    leaf = lambda depth=0: html_extract.Slot(r.choice("abcd"), 1.0, {}, 0, 0, [leaf(depth + 1) for _ in range(r.randint(0, 3 - depth))])
    for _ in range(200):
        a, b = [leaf() for _ in range(r.randint(0, 9))], [leaf() for _ in range(r.randint(0, 9))]
        pairs = html_extract.align(a, b)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        low = 0
        while low < min(len(a), len(b)) and a[low].label == b[low].label:
            low += 1
        tail = 0
        while tail < min(len(a), len(b)) - low and a[-1 - tail].label == b[-1 - tail].label:
            tail += 1
        inner = [(i, j) for i, j in pairs if low <= i < len(a) - tail]
        assert sum(html_extract.matched(a[i], b[j]) for i, j in inner) == plain_align(a[low : len(a) - tail], b[low : len(b) - tail])


def test_deep_and_long_pages(spark):
    r = random.Random(4)
    deep = lambda i: "".join(f"<div class={r.choice('abc')}>" for _ in range(3000)) + f"<p>deep {i}</p>" + "</div>" * 2500 + f"<p>after {i}"
    rows = [(i, "http://d.example.com/", deep(i)) for i in range(5)] + [(9, "http://d.example.com/", "<p>" + "<font>" * 1200 + "in fonts")]
    rows += [(20, "http://l.example.com/", "<article>" + "".join(f"<p class=c{chr(97 + k % 26)}>text {k}</p>" for k in range(20_000)) + "</article>"), (21, None, "x" * 1_000_000), (22, None, "a\x00b")]
    got = dict(texts_of(spark, rows))
    assert all(got[i] == f"deep {i}\nafter {i}" for i in range(5)) and got[9] == "in fonts" and got[21] == "x" * 1_000_000 and got[22] == "a\x00b"
    assert got[20].split("\n") == [f"text {k}" for k in range(20_000)]


def test_titles_in_headers():
    for part in ("<header class='entry-header'><h1>Title</h1></header>", "<div class='page-header'><h1>Title</h1></div>", "<div class='side-by-side'>Title</div>"):
        page = html_extract.blocks(html_extract.parse(f"<article>{part}<p>Text</p></article>"))
        assert html_extract.extract(page, html_extract.fold(page)) == "Title\nText"


class Article(HTMLParser):
    """The texts of the blocks of a page's article, read plainly."""

    GONE, LINES = {"script", "style", "form", "nav", "aside", "footer", "header"}, {"p", "h1", "h2", "h3", "li", "ul", "div", "blockquote", "section", "article", "table", "tr", "td"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.gone, self.parts = 0, 0, [""]
        self.feed(page)
        self.close()
        self.text = "\n".join(t for p in self.parts if (t := re.sub(r"\s+", " ", p).strip()))

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.gone += tag in self.GONE
        if tag in self.LINES:
            self.parts.append("")
        elif tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.gone -= tag in self.GONE
        if tag in self.LINES:
            self.parts.append("")

    def handle_data(self, data):
        if self.inside and not self.gone:
            self.parts[-1] += data


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pages_of_the_table(spark):
    larger = DATA.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{larger}/pages.parquet").select("page_id", "url", "html").collect()
    got = {r.page_id: r for r in queries.op4_html_extract(spark, larger).collect()}
    assert len(got) == len(rows) > 100
    plain = [r for r in rows if r.html and r.html.count("<article") == 1 and "<article>" in r.html]
    same = sum(got[r.page_id].text == Article(r.html).text for r in plain)
    assert len(plain) > 0.8 * len(rows) and same >= 0.98 * len(plain), (same, len(plain))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pages_of_the_table_without_names(spark):
    """Pages without their article and main elements, classes, ids and roles: what is left to go by is how pages align."""
    larger = DATA.replace("0.001", "0.01")
    rows = [r for r in spark.read.parquet(f"{larger}/pages.parquet").collect() if r.html and r.html.count("<article") == 1 and "<article>" in r.html]
    bare = lambda page: re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"<(/?)(article|main)\b", r"<\1div", page))
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame([(r.page_id, r.url, bare(r.html)) for r in rows], "page_id long, url string, html string")).collect()}
    both = found = wanted = 0
    for r in rows:
        a, b = Counter(Article(r.html).text.split()), Counter(got[r.page_id].split())
        both, found, wanted = both + sum((a & b).values()), found + sum(b.values()), wanted + sum(a.values())
    assert len(rows) > 100 and both >= 0.95 * found and both >= 0.95 * wanted, (both, found, wanted)


# 5
ODD = ["a b", "x%y", "c", "é", "", None, "p/q", "1+1", "z=1"]


def test_shards_of_odd_arrivals(spark, tmp_path):
    rows = [(i, f"t{i}", "f", i % 4, None, ODD[i % 9]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, folder string, run string, shard_part int, shard_run string, arrival string").repartition(3)
    plain = lambda d: sorted((r.doc_id, r.folder, r.run, r.shard_part, r.shard_run) for r in d.collect())
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s s", target_bytes=1 << 20, least_bytes=1 << 10, fanout=4)
    assert store.read().count() == 0  # a new store
    store.append_arrivals(df.limit(0), "arrival")
    assert store.read().columns == ["doc_id", "folder", "run", "shard_part", "shard_run", "shard_run_", "shard_part_", "shard_tier"] and store.read().count() == 0
    store.append_arrivals(df, "arrival")
    runs = store.manifest()["runs"]
    assert {r["arrival"]: r["rows"] for r in runs} == {a: 10 for a in ODD}
    assert plain(store.read()) == sorted(r[:5] for r in rows)
    assert {r.doc_id % 9: r.shard_run_ for r in store.read().collect()} == {ODD.index(r["arrival"]): r["run"] for r in runs}
    store.compact()
    assert plain(store.read()) == sorted(r[:5] for r in rows) and sum(r["rows"] for r in store.manifest()["runs"]) == 90 and len(store.manifest()["runs"]) < 9
    store.append(df.limit(2).select("doc_id", F.lit("more").alias("extra")))
    assert store.read().where("extra = 'more' and folder is null").count() == 2 and store.read().count() == 92
    with pytest.raises(ValueError):
        store.append(df.select(F.lit("x").alias("doc_id")))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_sharding_query(spark, tmp_path):
    want = sorted((r.doc_id, len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = queries.op5_sharding(spark, DATA).collect()
    assert sorted((r.doc_id, r.n_bytes, r.text_crc32) for r in got) == want and {type(r.shard_run) for r in got} == {int}
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op5_sharding(spark, str(tmp_path)).count() == 0


def test_shards(spark, docs, tmp_path):
    rows, df = docs
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, least_bytes=1 << 10, fanout=3)
    parts = [df.where(f"doc_id % 7 = {i}") for i in range(7)]
    for p in parts:
        store.append(p)
    before = store.version()
    assert before == 7 and len(store.manifest()["runs"]) == 7
    store.compact()
    assert len(store.manifest()["runs"]) < 5 and store.version() > before
    key = lambda d: sorted(map(str, d.select(df.columns).collect()))
    assert key(store.read()) == key(df) and key(store.read(before)) == key(df)
    assert store.manifest(1)["runs"][0]["rows"] == parts[0].count()
    with pytest.raises(Exception):  # another writer has made that version
        store.commit([], before)
    store.vacuum()
    assert key(store.read()) == key(df)
    store.append(df.limit(0))
    assert store.compact() and key(store.read()) == key(df)


# 6
def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    s = Sets(sets)
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                s.join(i, j)
    return {i: (len(sets[i]), s.find(i)) for i in sets}


def test_jaccard(spark, docs):
    rows, df = docs
    got = ngram_join.jaccard_components(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_jaccard([r[:2] for r in rows])
    chain = " ".join(f"w{i}" for i in range(60)).split()
    near = [(i, " ".join([*chain[:i], f"x{i}", *chain[i + 1 :]])) for i in range(0, 60)]  # each near all or few of the others
    got = ngram_join.jaccard_components(spark.createDataFrame(near, "doc_id long, text string"), max_frequent=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_jaccard(near)
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0
    assert ngram_join.jaccard_components(df.where("text is null")).first().n_shingles == 0


# 7
def brute_leaks(docs, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: find.findall((t or "").translate(low))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, met = words(t), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in windows:
                    hit |= set(range(k, k + m))
                    met |= windows[g]
        out[i] = (len(w), len(hit), sorted(met), bool(hit))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_leaks(spark, docs, short):
    rows, df = docs
    texts = {r[0]: r[1] for r in rows}
    items = [(1, " ".join(texts[5].split(" ")[5:40])), (2, texts[5].replace(" ", "-!")), (3, "É é É é É é É é É é é"), (4, None), (5, "thsh " * 30), (6, " ".join(texts[5].split(" ")[5:40]))]
    items += [(7, "thsh"), (8, " ".join(texts[9].split(" ")[1:4])), (9, "!?")] if short else []
    table = spark.createDataFrame(items, "item_id long, text string")
    for most in (100_000, 0):
        got = decontaminate.contamination(df, table, broadcast_rows=most).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got} == brute_leaks([r[:2] for r in rows], items)
    assert decontaminate.contamination(df.limit(0), table).count() == 0
    assert decontaminate.contamination(df, table.limit(0)).where("contaminated").count() == 0


def test_leaks_of_words_with_odd_cases(spark):
    say = lambda w, sep: sep.join([w] * 12)
    docs = [(i, say(w, " ")) for i, w in enumerate(("ΑΣ", "İx", "\u212a1", "k1", "ασ"))] + [(9, say("ΑΣ", ".")), (10, "x " * 30_000 + say("ΑΣ", " "))]
    items = [(1, say("ΑΣ", ".")), (2, say("İX", "-")), (3, say("\u212a1", " "))]
    df = spark.createDataFrame([(*d, "w", "h") for d in docs], "doc_id long, text string, item string, hits string")
    table = spark.createDataFrame([(*i, "p") for i in items], "item_id long, text string, plain string")
    for most in (100_000, 0):
        got = decontaminate.contamination(df, table, broadcast_rows=most).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got} == brute_leaks(docs, items)
    assert {r.doc_id for r in got if r.contaminated} == {0, 1, 2, 9, 10}


# 8
def test_packing(spark, docs):
    from tokenizers import Tokenizer

    rows, df = docs
    own = Tokenizer.from_file(packing.tokenizer_path())
    assert packing.CachedEncoder(packing.tokenizer_path()).ids("x <|endoftext|> y").tolist() == [87, 220, 50256, 331] == own.encode("x <|endoftext|> y", add_special_tokens=False).ids
    got: dict[int, list] = {}
    for r in packing.pack(df, max_length=256).collect():
        got.setdefault(r.doc_id, []).append(r)
        assert r.length & (r.length - 1) == 0 and r.offset == 0
    for i, t in [r[:2] for r in rows]:
        pieces = sorted(got[i], key=lambda r: r.start)
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == ids and all(r.doc_tokens == len(ids) for r in pieces)
    every = [r.sequence_id for p in got.values() for r in p]
    assert sorted(every) == list(range(len(every)))
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in packing.pack(df, digest=True).collect()}
    odd = ["漢字かな" * 3000, "x" * 30_000, "\t\n " * 5000, "a\u0301\u200d" * 2000, "<|endoftext|>" * 50, "a <|endoftext|>" * 9 + "<|endoftext|", "  lead and  double  spaces ", "don't'll 12345678 ½ ﬁ\x00\x7f", "é" * 9 + "\r\n" * 9, None]
    unspaced = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate([*odd, odd[0]])], "doc_id long, text string, task string, row int")
    whole: dict = {}
    for r in sorted(packing.pack(unspaced).collect(), key=lambda r: r.start):
        whole.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate([*odd, odd[0]]):
        ids = np.frombuffer(b"".join(r.ids for r in whole[i if i else None]), "<u4").tolist()
        assert ids == [*own.encode(t or "", add_special_tokens=False).ids, 1] and whole[i if i else None][0].doc_tokens == len(ids)
    assert digests[(60, 0)] == zlib.crc32(b"\1\0\0\0")
    assert packing.pack(df.limit(0)).count() == 0


# 9
def test_language(spark):
    r = random.Random(4)
    parts = {"en": ["the", "ing", "sh", "th"], "fr": ["eau", "é", "ch", "tion"], "de": ["ß", "sch", "ung", "ü"]}
    rows = [(i, " ".join("".join(r.choices(parts[k], k=r.randint(1, 3))) for _ in range(30)), k) for i in range(240) if (k := ("en", "fr", "de")[i % 3])]
    rows += [(900, None, "en"), (901, "123 !", "en"), (902, "", None), (903, "eauéch", None)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, lang string, score string")
    model = language_id.train(df.where(language_id.learnable()))
    assert model.languages == ["de", "en", "fr"]
    got = {x.doc_id: x for x in language_id.predict(df, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows if i < 900) and all(0 <= x.score <= 1 for x in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "fr"]
    assert language_id.WORD.findall("हिन्दी ภาษาไทย é e\u0301x a1b_c \u0301 தமிழ்") == ["हिन्दी", "ภาษาไทย", "é", "e\u0301x", "a", "b", "c", "தமிழ்"]
    hindi = [(i, t, k) for i, (t, k) in enumerate([("यह हिन्दी भाषा है", "hi"), ("मैं किताब पढ़ता हूँ", "hi"), ("İSTANBUL ve İZMİR", "tr"), ("çok güzel İŞ", "tr")] * 9)]
    told = spark.createDataFrame(hindi, "doc_id long, text string, lang string")
    learned = language_id.train(told)
    assert {"हिन्दी", "किताब"} <= set(learned.words) and {x.lower() for x in learned.words} == set(learned.words)
    assert all(x.lang_pred == x.lang for x in language_id.predict(told, learned).collect())
    none = language_id.train(df.limit(0))
    assert language_id.predict(df, none).where("lang_pred <> 'und'").count() == 0


def brute_languages(texts, train, longest=5):
    """(language, share) of texts by plain counting: known words by log frequency, others by their longest known n-grams."""
    find = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    words, grams = {}, {}
    for t, lang in train:
        words.setdefault(lang, Counter()).update(find(t))
    for lang, c in words.items():
        for w, n in c.items():
            m = f"^{w}$"
            for k in range(1, longest + 1):
                for i in range(len(m) - k + 1):
                    grams.setdefault((lang, k), Counter())[m[i : i + k]] += n
    langs = sorted(words)
    log = lambda c, w: math.log((c[w] + 0.1) / (sum(c.values()) + 1.0))

    def scores(w):
        if any(w in words[x] for x in langs):
            return [log(words[x], w) for x in langs]
        m = f"^{w}$"
        for k in range(min(longest, len(m)), 0, -1):
            known = [m[i : i + k] for i in range(len(m) - k + 1) if any(m[i : i + k] in grams.get((x, k), {}) for x in langs)]
            if known:
                return [sum(log(grams.get((x, k), Counter()), g) for g in known) / len(known) for x in langs]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        each = [scores(w) for w in find(t)]
        if not each or not langs:
            out.append(("und", 0.0))
            continue
        mean = [sum(s[i] - sum(s) / len(s) for s in each) / len(each) for i in range(len(langs))]
        best = max(range(len(langs)), key=lambda i: (mean[i], -i))
        out.append((langs[best], 1 / sum(math.exp(x - mean[best]) for x in mean)))
    return out


def test_languages_by_plain_counting(spark):
    r = random.Random(6)
    parts = {"en": ["the", "ing", "sh", "on"], "fr": ["eau", "é", "ch", "on"], "de": ["ß", "sch", "ung", "on"]}
    say = lambda k, n: " ".join("".join(r.choices(parts[k], k=r.randint(1, 3))) for _ in range(n))
    rows = [(i, say(k, r.randint(1, 12)), k) for i in range(90) for k in [("en", "fr", "de")[i % 3]]]
    rows += [(200, "on", None), (201, "on " * 20_000 + "sch", None), (202, "xyzzy 1", None), (203, "Ünıcode ŒUVRE", None), rows[0], (None, "eau", "de"), (None, None, None)]
    df = spark.createDataFrame([(*x, "w", 1, 2.0) for x in rows], "doc_id long, text string, lang string, l string, limit int, lang_pred double").repartition(3)
    model = language_id.train(df.where(language_id.learnable()))
    learned = [(t, k) for i, t, k in rows if i is not None and k is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    want = Counter((i, t, p, round(s, 4)) for (i, t, _), (p, s) in zip(rows, brute_languages([x[1] for x in rows], learned)))
    got = Counter((x.doc_id, x.text, x.lang_pred, round(x.score, 4)) for x in language_id.predict(df, model).collect())
    assert got == want
    # a rare label is learned however common the others are
    many = spark.createDataFrame([(i, say("en" if i else "fr", 8), "en" if i else "fr") for i in range(400)], "doc_id long, text string, lang string")
    assert language_id.train(many, label_rows=20).languages == ["en", "fr"]


# 10
def test_elias_fano():
    g = np.random.default_rng(1)
    for bits, n in ((64, 1000), (20, 5000), (40, 1), (33, 0)):
        values = np.unique(g.integers(0, 1 << min(bits, 63), n).astype(np.uint64))
        e = lm_score.EliasFano.build(values)
        e = lm_score.EliasFano.read(lm_score._unpack(lm_score._pack(e.parts())))
        asked = np.concatenate([values, g.integers(0, 1 << min(bits, 63), 500).astype(np.uint64)])
        place = {int(v): i for i, v in enumerate(values)}
        assert e.find(asked).tolist() == [place.get(int(v), -1) for v in asked]
        assert e.values(np.arange(len(values))).tolist() == values.tolist()
    context = np.sort(g.integers(0, 50, 400))
    assert lm_score.EliasFano.build(context, 0).ends(np.arange(context.max() + 1)).tolist() == np.searchsorted(context, np.arange(context.max() + 1), "right").tolist()


def test_levels():
    g = np.random.default_rng(2)
    pairs = sorted({(int(c), int(h)) for c, h in zip(g.choice([0, 3, 4, 90], 300), g.integers(1, 40, 300))} | {(91, 1), (91, (1 << 32) - 1)})
    level = lm_score.Level.build(np.array([c for c, _ in pairs]), np.array([h for _, h in pairs], np.uint64), np.zeros(len(pairs), np.uint8))
    level = lm_score.Level.read(lm_score._unpack(lm_score._pack(level.parts())))
    asked = [(c, h) for c in (-1, 0, 1, 3, 4, 89, 90, 91, 92, 200) for h in (*range(1, 45), (1 << 32) - 1)]
    place = {x: i for i, x in enumerate(pairs)}
    assert level.find(np.array([c for c, _ in asked]), np.array([h for _, h in asked], np.uint64)).tolist() == [place.get(x, -1) for x in asked]


def test_blocks():
    g = np.random.default_rng(3)
    keys = np.unique(np.stack([g.integers(0, 30, 500), g.integers(0, 1 << 56, 500)], 1).astype(np.uint64), axis=0)
    for k in (keys, keys[keys[:, 0] > 0], keys[:1], keys[-1:]):
        n = g.integers(1, 9, len(k))
        back = lm_score._unblock(lm_score._block(k, n))
        assert back[0].tolist() == k.tolist() and back[1].tolist() == n.tolist()


def brute_scores(texts, train, alpha=0.1, discount=0.75):
    """log10 probabilities of texts by plain counting: probabilities and weights rounded down to steps of 1/24, as stated."""
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    one, two, three = Counter(), Counter(), Counter()
    for t in train:
        w = tok(t)
        one.update(w), two.update(zip(w, w[1:])), three.update(zip(w, w[1:], w[2:]))
    step = lambda p: 10 ** (-min(math.ceil(-log10(p) * 24 - 1e-9), 255) / 24) if -log10(p) * 24 < 255 else 0.0
    after: dict = {}
    for g, n in [*two.items(), *three.items()]:
        after.setdefault(g[:-1], {})[g[-1]] = n
    share, back = {}, {}
    for c, found in after.items():
        total = sum(found.values())
        share[c] = {w: step((n - discount) / total) for w, n in found.items()}
        back[c] = step(min(1, max(1e-9, 1 - sum(share[c].values()))))
    n, v = sum(one.values()), len(one)

    def p(w, before):
        if not before:
            return (one[w] + alpha) / (n + alpha * (v + 1))
        return share.get(before, {}).get(w, 0.0) + back.get(before, 1.0) * p(w, before[1:])

    return [sum(log10(p(w, tuple(t[max(0, i - 2) : i]))) for i, w in enumerate(t)) for t in map(tok, texts)]


def test_scores(spark, docs):
    rows, df = docs
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tok(t))
    n = sum(c.values())
    df = df.select("doc_id", "text", lm_score.held_out().alias("held_out"), F.lit("x").alias("score"))
    base = lambda w: (c[w] + 0.1) / (n + 0.1 * (len(c) + 1))
    want = dict(zip([r[0] for r in rows], brute_scores([r[1] for r in rows], [r[1] for r in rows if not held(r[0])])))
    for options in ({"shards": 5, "flush": 500}, {"shards": 3, "flush": 300, "hold": 2000}, {}):
        model, _ = lm_score.train(df.where(~F.col("held_out")), **options)
        made = lm_score.score(df, model, ["doc_id", "held_out", "score"])
        assert made.columns == ["doc_id", "held_out", *lm_score.ADDED]
        got = {r.doc_id: r for r in made.collect()}
        for i, t, *_ in rows:
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n)
            assert r.base_score == pytest.approx(sum(log10(base(w)) for w in tok(t))) and r.score == pytest.approx(want[i], rel=1e-6)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    lm_score.Model.OPEN, most = 2, lm_score.Model.OPEN
    try:  # few shards at a time
        tokens, starts = lm_score.tokens_of(pa.array([r[1] for r in rows]))
        told = np.add.reduceat(np.log10(model.probabilities(tokens, starts)[2]), starts[:-1])
        assert told == pytest.approx([want[r[0]] for r in rows], rel=1e-6) and len(model._open) <= 2
    finally:
        lm_score.Model.OPEN = most
    # probabilities after a context add up to no more than one
    seen = [tok(r[1]) for r in rows if not held(r[0])]
    for size in (1, 2):
        before = Counter(tuple(w[i : i + size]) for w in seen for i in range(len(w) - size)).most_common(1)[0][0]
        each = [b" ".join([*before, w]).decode() for w in c if w is not None]
        tokens, starts = lm_score.tokens_of(pa.array([*each, b" ".join(before).decode()]))
        p = model.probabilities(tokens, starts)[2]
        total = p[starts[:-2] + size].sum() + p[starts[-2] + size]
        assert 0.5 < total <= 1.0001
    empty, _ = lm_score.train(df.limit(0))
    assert lm_score.score(df, empty, ["doc_id"]).agg(F.sum("train_tokens")).first()[0] == 0
    assert lm_score.score(df.limit(0), model, ["doc_id"]).count() == 0
    ids = df.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert lm_score.train(ids.where(~lm_score.held_out()))[0].tokens == sum(len(tok(r[1])) for r in rows)


def test_set_bits_are_found_by_table():
    """Every set bit of words with one, some and all bits."""
    r = np.random.default_rng(5)
    words = np.concatenate([np.uint64(1) << np.arange(64, dtype=np.uint64), [~np.uint64(0)], r.integers(1, 1 << 63, 300, dtype=np.uint64)])
    places = [[j for j in range(64) if int(w) >> j & 1] for w in words]
    x, left = np.repeat(words, [len(p) for p in places]), np.concatenate([np.arange(len(p)) for p in places])
    assert lm_score.EliasFano._inside(x, left).tolist() == [j for p in places for j in p]
