"""Main text of web pages by wrapper induction.

Each page is parsed to a DOM tree and reduced to its block elements; inline elements are part of the text around them, and
runs of equal siblings fold into one repeated node. The trees of a host's pages are aligned by simple tree matching and
merged into a wrapper that counts, per node, the pages that have it and those that have each text in it. Tasks merge all
pages they hold first, so a host of a third of all pages sends one wrapper per task; copies of a page weigh one page
together. Then each page is aligned to its host's wrapper: a text that nearly all pages have in the same slot is template,
whatever its element; what varies is content. A page most of whose texts, by number as well as by length, would go is a near
copy of the host's other pages and keeps them. With one or two different pages a host has no template.

The content region is each page's own: its `article` or `main` elements that have text, or else its nodes that align to
the host's node of most varying text outside links, or else the page's own part that holds most such text; so pages of one
host may have different layouts. Subtrees that say themselves what they are by element, role, hidden attribute or a whole
class or id (menus, forms, adverts, comments, ...) are left out too, as a hosts' pages may each have menus of their own. A
form around the page is no such part: one that holds a main heading or an article, or without which the page has no text. Nor
is a label that belongs to no control.

Text blocks: character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty
ones dropped, and the rest joined in page order by one newline.

Cases: null or empty html gives an empty text; a page with a null or odd URL belongs to the host ``''``; unclosed,
crossed or cut tags are repaired as browsers do for paragraphs, lists and tables; elements nested deeper than 512 go on
beside the deepest one, as in browsers, so no text is lost; pages without markup are one block; repeated rows and null ids
each get their row; an empty table gives an empty result; other columns, of whatever names, are ignored. Whole pages are
read, whatever their length.
"""

from __future__ import annotations

import html as _html
import pickle
import re
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, returning, sized

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.DOTALL)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACE = re.compile(r"\s+")
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot option optgroup legend".split())
SKIP = frozenset("head nav footer aside form menu dialog script style title template noscript iframe textarea select button input object svg math canvas audio video noembed noframes xmp label datalist".split())
CONTROLS = frozenset("input select textarea button".split())
# What sites call the parts that are not the article, as a whole class or id. Words that articles use of
# themselves (side, share, search, related, notice, alert, header, skip, hidden, login, promo, ...) are not among them.
SKIP_NAMES = frozenset("ad ads advert adverts advertisement advertising ad-slot ad-container ad-banner sponsored menu nav navbar navigation main-nav site-nav nav-menu main-menu breadcrumb breadcrumbs pagination pager masthead site-header footer site-footer page-footer sidebar comments comment-list comments-area disqus_thread cookie-notice cookie-banner cookie-consent share-buttons social-share related-posts newsletter-signup".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p li blockquote pre dd dt figcaption article main".split())
#: Depth of nesting from which elements become siblings, as in browsers.
DEEPEST = 512
#: A text is template where this share of a host's pages, and so many of them at least, have it in the same slot.
SHARE, LEAST_PAGES = 0.8, 3
#: Texts that a slot counts; rarer ones are summed out, which errs by 1 / MOST_TEXTS of the pages at most.
MOST_TEXTS = 64
#: Children of a block from which those of one label are one repeated node, wherever they stand.
MANY = 200
#: A page that would lose more than this share both of its texts and of their characters is a near copy and loses nothing.
COPY = 0.9
#: Characters of html that a task folds before it sends its hosts' wrappers.
FLUSH = 64 << 20
#: Elements that end the reach of a tag that is implied.
SCOPE = frozenset("html body article section div td th table ul ol dl main aside nav header footer form blockquote button".split())
IMPLIED = {"li": ("li", frozenset("ul ol menu".split())), "dt": ("dt dd", frozenset(["dl"])), "dd": ("dt dd", frozenset(["dl"])), "tr": ("tr td th", frozenset("table tbody thead tfoot".split())), "td": ("td th", frozenset(["tr", "table"])), "th": ("td th", frozenset(["tr", "table"])), "option": ("option", frozenset(["select", "datalist", "optgroup"]))}


class Node:
    """An element: its label for matching, whether its own attributes mark it as not content, children and text."""

    __slots__ = ("tag", "label", "skip", "children")

    def __init__(self, tag: str, label: str, skip: bool):
        self.tag, self.label, self.skip, self.children = tag, label, skip, []

    def holds(self, tags: frozenset[str]) -> bool:
        return any(isinstance(c, Node) and (c.tag in tags or c.holds(tags)) for c in self.children)


class Block:
    """A block element of a page: its texts and inner blocks in page order, and how many of its characters are in links."""

    __slots__ = ("tag", "label", "items", "linked")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.items, self.linked = tag, label, [], 0


_labels: dict[tuple[str, str], tuple[str, bool]] = {}


def _label(tag: str, attrs: str) -> tuple[str, bool]:
    """The label of an element and whether it is marked as not content."""
    got = _labels.get((tag, attrs))
    if got is None:
        label, skip = tag, tag in SKIP and tag != "label"
        for name, value in ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "class" or name == "id":
                label += "." + re.sub(r"\d+", "0", value.split(" ")[0] if name == "class" else value)
                skip |= tag not in ("body", "html", "article", "main") and any(n in SKIP_NAMES for n in value.split())
            elif name == "role":
                skip |= value in SKIP_ROLES
            elif name == "for":
                skip |= tag == "label"
            elif name == "style":
                skip |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                skip = True
        got = label, skip
        if len(_labels) > 50_000:
            _labels.clear()
        _labels[(tag, attrs)] = got
    return got


def parse(page: str) -> Node:
    """The DOM of a page; children are nodes and strings (raw text, references not yet decoded)."""
    root = Node("html", "#", False)
    stack = [root]
    at = 0

    def close(names: tuple[str, ...] | frozenset, stop: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while True:
        m = TAG.search(page, at)
        if m is None:
            if at < len(page):
                stack[-1].children.append(page[at:])
            return root
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p":
                close(("p",), SCOPE)
            elif any(x.tag == tag for x in stack[1:]):
                close((tag,), frozenset(("table",)) if tag not in BLOCK else frozenset())
            continue
        if tag in CLOSES_P:
            close(("p",), SCOPE)
        if tag in IMPLIED:
            names, stop = IMPLIED[tag]
            for name in names.split():
                close((name,), stop)
        if tag in ("html", "body"):  # one of each; what stands between them is read in place
            continue
        if len(stack) > DEEPEST:  # what is nested deeper goes on beside the deepest element
            stack.pop()
        node = Node(tag, *_label(tag, m[3]))
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if not m[3].endswith("/") or tag in BLOCK or tag in ("a", "b", "i", "span"):
            stack.append(node)


WHOLE = frozenset(("h1", "article", "main"))


def blocks(root: Node, forms: bool = False) -> Block:
    """The blocks of a page. Inline elements belong to the text around them; of a header only the headings count. With
    `forms` no form is left out, else those that are not around the page; if nothing is left so, forms are read."""
    top = Block(root.tag, root.label)
    part: list[str] = []
    linked = 0

    def flush(to: Block) -> None:
        nonlocal linked
        text = SPACE.sub(" ", _html.unescape("".join(part))).strip()
        if text:
            to.items.append(text)
            to.linked += min(linked, len(text))
        part.clear()
        linked = 0

    def walk(node: Node, into: Block, link: bool) -> None:
        nonlocal linked
        for c in node.children:
            if isinstance(c, str):
                part.append(c)
                linked += len(c.strip()) if link else 0
            elif c.tag == "label" and (c.skip or c.holds(CONTROLS)) or c.tag != "label" and c.skip and not (c.tag == "form" and (forms or c.holds(WHOLE))):
                if c.tag in BLOCK:
                    flush(into)
            elif c.tag == "br":
                part.append(" ")
            elif c.tag in BLOCK:
                flush(into)
                made = Block(c.tag, c.label)
                into.items.append(made)
                if c.tag == "header":
                    for h in headings(c):
                        made.items.append(Block(h.tag, h.label))
                        walk(h, made.items[-1], link)
                        flush(made.items[-1])
                else:
                    walk(c, made, link)
                    flush(made)
            else:
                walk(c, into, link or c.tag == "a")

    walk(root, top, False)
    flush(top)
    return top if top.items and any(_texts(top)) or forms or not root.holds(frozenset(["form"])) else blocks(root, True)


def _texts(block: Block) -> Iterator[str]:
    for x in block.items:
        if isinstance(x, str):
            yield x
        else:
            yield from _texts(x)


def headings(node: Node) -> list[Node]:
    found: list[Node] = []
    for c in node.children:
        if isinstance(c, Node) and not c.skip:
            found += [c] if c.tag in HEADINGS else headings(c)
    return found


class Slot:
    """A wrapper node: label, weight of the pages that have it, weight of each text in it, characters, those in links, children."""

    __slots__ = ("label", "pages", "texts", "chars", "linked", "kids", "members")

    def __init__(self, label: str, pages: float, texts: dict[int, float], chars: int, linked: int, kids: list[Slot], members: list[Block] | None = None):
        self.label, self.pages, self.texts, self.chars, self.linked, self.kids, self.members = label, pages, texts, chars, linked, kids, members

    def __reduce__(self):
        return Slot, (self.label, self.pages, self.texts, self.chars, self.linked, self.kids)


def fold(block: Block, weight: float = 1.0, known: bool = False) -> Slot:
    """The wrapper of one page: neighbours of one label are one repeated node. With `known` it knows its blocks."""
    own = [x for x in block.items if isinstance(x, str)]
    made = Slot(block.label, weight, {key(x): weight for x in own}, sum(map(len, own)), block.linked, [], [block] if known else None)
    for x in block.items:
        if isinstance(x, Block):
            new = fold(x, weight, known)
            if made.kids and made.kids[-1].label == new.label:
                merge(made.kids[-1], new, True)
            else:
                made.kids.append(new)
    made.kids = _gathered(made.kids)
    return made


def _gathered(kids: list[Slot]) -> list[Slot]:
    """Long lists of children with those of one label made one, so that a list has MANY children or no label twice."""
    if len(kids) <= MANY:
        return kids
    first: dict[str, Slot] = {}
    for k in kids:
        if k.label in first:
            merge(first[k.label], k, True)
        else:
            first[k.label] = k
    return list(first.values())


def _deep() -> None:
    """Room for walks over trees of DEEPEST levels."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 16 * DEEPEST))


def key(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) << 32 | len(text)


def align(a: list[Slot], b: list[Slot]) -> list[tuple[int, int]]:
    """Simple tree matching of two lists of children: pairs of an order-keeping matching of the most nodes."""
    n, m = len(a), len(b)
    low = 0
    while low < min(n, m) and a[low].label == b[low].label:
        low += 1
    tail = 0
    while tail < min(n, m) - low and a[n - 1 - tail].label == b[m - 1 - tail].label:
        tail += 1
    ends = [(n - k, m - k) for k in range(tail, 0, -1)]
    x, y = a[low : n - tail], b[low : m - tail]
    if not x or not y:
        return [(i, i) for i in range(low)] + ends
    # the heaviest chain of pairs of one label: by place in x, with a tree of the best chains that end before each place in y
    places: dict[str, list[int]] = {}
    for j, q in enumerate(y):
        places.setdefault(q.label, []).append(j)
    chains: list[tuple[int, int, int, int]] = [(0, -1, -1, -1)]  # weight, pair, the chain before
    tree = [0] * (len(y) + 1)
    for i, p in enumerate(x):
        for j in reversed(places.get(p.label, ())):
            before, at = 0, j
            while at:
                if chains[tree[at]][0] > chains[before][0]:
                    before = tree[at]
                at &= at - 1
            chains.append((chains[before][0] + matched(p, y[j]), i, j, before))
            at = j + 1
            while at <= len(y):
                if chains[-1][0] > chains[tree[at]][0]:
                    tree[at] = len(chains) - 1
                at += at & -at
    now, pairs = max(range(len(chains)), key=lambda c: chains[c][0]), []
    while now:
        _, i, j, now = chains[now]
        pairs.append((low + i, low + j))
    return [(i, i) for i in range(low)] + pairs[::-1] + ends


def matched(a: Slot, b: Slot) -> int:
    """The number of nodes that match in two trees."""
    if a.label != b.label:
        return 0
    n = 1
    for i, j in align(a.kids, b.kids):
        n += matched(a.kids[i], b.kids[j])
    return n


def merge(a: Slot, b: Slot, same_page: bool = False) -> Slot:
    """a with the pages of b added; b is used up. Neighbours of one page count once."""
    kids, i, j = [], 0, 0
    for p, q in [*align(a.kids, b.kids), (len(a.kids), len(b.kids))]:
        kids += a.kids[i:p] + b.kids[j:q]
        if p < len(a.kids) and q < len(b.kids):
            kids.append(merge(a.kids[p], b.kids[q], same_page))
        i, j = p + 1, q + 1
    for text, weight in b.texts.items():
        a.texts[text] = max(a.texts.get(text, 0.0), weight) if same_page else a.texts.get(text, 0.0) + weight
    if not same_page and len(a.texts) > MOST_TEXTS:  # a frequent-items summary: what is on many pages stays
        cut = sorted(a.texts.values(), reverse=True)[MOST_TEXTS]
        a.texts = {t: w - cut for t, w in a.texts.items() if w > cut}
    a.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    a.chars, a.linked, a.kids = a.chars + b.chars, a.linked + b.linked, _gathered(kids)
    if same_page and a.members is not None:
        a.members += b.members
    return a


def constant(slot: Slot | None, text: int, pages: float) -> bool:
    """A text of a slot is on nearly all pages of the host. Two pages cannot tell a template from a copy."""
    return slot is not None and pages > LEAST_PAGES - 0.5 and slot.texts.get(text, 0.0) + pages / MOST_TEXTS >= SHARE * pages


def region(wrapper: Slot) -> Slot:
    """The wrapper node that holds the content where pages do not name it: down while one child holds most varying text."""

    def weigh(x: Slot) -> float:
        total = sum(x.texts.values())
        fixed = sum([w for t, w in x.texts.items() if constant(x, t, wrapper.pages)])
        mass[id(x)] = (x.chars - x.linked) * (1 - fixed / total) if total else 0.0
        for k in x.kids:
            mass[id(x)] += weigh(k)
        return mass[id(x)]

    mass: dict[int, float] = {}
    total, now = weigh(wrapper), wrapper
    while True:
        deeper = [k for k in now.kids if mass[id(k)] >= 0.8 * total > 0 and k.kids]
        if not deeper:
            return now
        now = deeper[0]


def _slots(page: Slot, wrapper: Slot) -> dict[int, Slot]:
    """The wrapper node of each block of a page that has one, by the block's id()."""
    to: dict[int, Slot] = {}

    def put(own: Slot, slot: Slot) -> None:
        for block in own.members:
            to[id(block)] = slot
        for i, j in align(own.kids, slot.kids):
            put(own.kids[i], slot.kids[j])

    put(page, wrapper)
    return to


def _chosen(root: Block, to: dict[int, Slot], wrapper: Slot, best: Slot) -> list[Block]:
    """The blocks of one page that hold its content: its own articles, else its `main`, else what aligns to the host's region, else its own heaviest part."""
    pages = wrapper.pages
    weight: dict[int, int] = {}  # characters outside links that the template does not have
    full: dict[int, bool] = {}  # any text at all
    named: dict[str, list[Block]] = {"article": [], "main": []}
    every: list[Block] = []

    def weigh(block: Block, within: frozenset, header: bool) -> None:
        if block.tag in named and block.tag not in within:  # only the outermost ones
            named[block.tag].append(block)
            within |= {block.tag}
        header = header or block.tag == "header"
        if not header:
            every.append(block)
        slot = to.get(id(block))
        own = [x for x in block.items if isinstance(x, str)]
        n, text = max(0, sum([len(x) for x in own if not constant(slot, key(x), pages)]) - block.linked), bool(own)
        for c in block.items:
            if isinstance(c, Block):
                weigh(c, within, header)
                n, text = n + weight[id(c)], text or full[id(c)]
        weight[id(block)], full[id(block)] = n, text

    weigh(root, frozenset(), False)
    for found in named.values():
        if found := [x for x in found if full[id(x)]]:
            return found
    total = weight[id(root)]
    if not total:
        return [root]
    found = [x for x in every if to.get(id(x)) is best]
    if sum([weight[id(x)] for x in found]) > 0:
        return found
    now = root
    while True:  # down while one part holds most of the text and no text or paragraph stands beside it
        kids = [c for c in now.items if isinstance(c, Block)]
        own = weight[id(now)] - sum([weight[id(c)] for c in kids])
        deeper = [c for c in kids if c.tag in ("div", "section", "center", "table", "tbody", "tr", "td") and weight[id(c)] >= 0.8 * total]
        if not deeper or own or any([c.tag in PROSE and weight[id(c)] for c in kids]):
            return [now]
        now = deeper[0]


def extract(root: Block, wrapper: Slot, best: Slot | None = None) -> str:
    """The text of the content slots of a page, aligned to its host's wrapper; `best` is the wrapper's region()."""
    to = _slots(fold(root, 1.0, True), wrapper)
    told: list[tuple[str, bool]] = []  # a text and whether it is template

    def walk(block: Block) -> None:
        slot = to.get(id(block))
        for c in block.items:
            if isinstance(c, str):
                told.append((c, constant(slot, key(c), wrapper.pages)))
            else:
                walk(c)

    for block in _chosen(root, to, wrapper, best if best is not None else region(wrapper)):
        walk(block)
    own = [t for t, template in told if not template]
    lost = (len(told) - len(own), sum([len(t) for t, template in told if template]))
    if lost[0] > COPY * len(told) and lost[1] > COPY * sum([len(t) for t, _ in told]):
        return "\n".join([t for t, _ in told])
    return "\n".join(own)


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def induce(df: DataFrame, scratch: Scratch, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper binary): the merged tree of all pages of each host. Copies of a page weigh one page together."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        held: dict[str, Slot] = {}
        size = 0
        for b in batches:
            for host, page, n in zip(*(b.column(i) for i in range(3))):
                host, page = host.as_py(), page.as_py()
                new = fold(blocks(parse(page)), 1 / n.as_py())
                held[host] = merge(held[host], new) if host in held else new
                size += len(page)
                if size > FLUSH:
                    yield rows(held)
                    held, size = {}, 0
        yield rows(held)

    def rows(held: dict[str, Slot]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([pickle.dumps(w) for w in held.values()], pa.binary())], ["host", "wrapper"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        host, wrapper = None, None
        for b in batches:
            for h, raw in zip(b.column(0).to_pylist(), b.column(1)):
                new = pickle.loads(raw.as_py())
                if h == host:
                    wrapper = merge(wrapper, new)
                    continue
                if host is not None:
                    yield rows({host: wrapper})
                host, wrapper = h, new
        if host is not None:
            yield rows({host: wrapper})

    pages = df.where(F.col(html_col).isNotNull()).select(host_of(url_col).alias("host"), F.col(html_col).alias("html"), F.xxhash64(F.col(html_col)).alias("h"))
    copies = scratch.save(pages.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    weighed = pages.join(sized(copies), ["host", "h"], "left").select("host", "html", F.coalesce("n", F.lit(1)).alias("n"))
    schema = "host string, wrapper binary"
    return weighed.mapInArrow(returning(partial), schema).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(returning(whole), schema)


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 16 << 20, salts: int = 32) -> DataFrame:
    """id_col, url_col, text, n_chars for every row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "wrappers")
    wrappers = scratch.save(induce(df, scratch, url_col, html_col), "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pages = df.select(host_of(url_col).alias("host"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    sent = None
    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast({r.host: bytes(r.wrapper) for r in wrappers.collect()})
        rows = pages.withColumn("wrapper", F.lit(None).cast("binary"))
    else:  # a host's wrapper goes once to each of as many tasks as there are salts, before the pages dealt to it
        salt = F.pmod(F.xxhash64("id", "url", "html"), F.lit(salts)).cast("int")
        first = wrappers.select("host", *(F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in ("id", "url", "html")), "wrapper", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        rows = pages.withColumns({"wrapper": F.lit(None).cast("binary"), "salt": salt}).unionByName(first)
        rows = rows.repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("wrapper").isNull()).drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        read: dict[str, tuple[Slot, Slot]] = {}  # per host the wrapper and its region
        held = 0
        for b in batches:
            told, texts = [], []
            for i, (host, page, raw) in enumerate(zip(b.column(0), b.column(3), b.column(4))):
                host, page, raw = host.as_py(), page.as_py(), raw.as_py()
                if raw is not None:
                    wrapper = pickle.loads(raw)
                    read = {host: (wrapper, region(wrapper))}
                    continue
                told.append(i)
                if not page:
                    texts.append("")
                    continue
                if host not in read:
                    raw = sent.value[host]
                    held += len(raw)
                    if held > 4 << 20:
                        read, held = {}, len(raw)
                    wrapper = pickle.loads(raw)
                    read[host] = wrapper, region(wrapper)
                texts.append(extract(blocks(parse(page)), *read[host]))
            at = pa.array(told, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.select("host", "id", "url", "html", "wrapper").mapInArrow(returning(run), f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")
