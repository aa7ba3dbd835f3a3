"""Main text of web pages: site templates are found by counting element subtrees per host and removed.

Two passes over the pages.  The first parses each page and hashes the subtree of every block element (tag, sorted
class and id words, text and children); Spark counts on how many different pages of a host each hash outside an
article occurs, and in how many different articles each hash inside.  A subtree is template if it is in at least
MIN_PAGES of them and in MIN_SHARE of its host's (prose, and what stands in articles: MIN_INSIDE).  Equal pages and equal
articles count once, so that copies make no template.  Many sites fill their boxes anew for each page, so what hangs beside a marked
article is counted by its shape too (tags and classes without text).  html, body and the article itself are never template, nor is
prose of articles (paragraphs, items, headings, cells).

The second pass walks each page from its root and drops every subtree that is template.  Only for subtrees that are too rare on
their host to be told by a count a tie is broken by what the page says of itself: outside of its article (where it marks one)
they go, and so do those named by element, class, id or role as menus, headers, footers, sidebars, notices, adverts, forms or
comments by readers.  Scripts, styles and the like are no text at all.  `tallied` says how much went by which rule; without counts
(`extract(html, None)`) nothing but scripts goes.  An article that would lose over half its text to
templates is a near copy of others, and loses none.

Only hashes of small integers are shuffled, pre-aggregated in each task.  Templates are broadcast as one set a host if they are
counted to be few (`common.BROADCAST_ROWS`); beyond that they are joined to the hashes of each page, and pages get just their own.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty
ones left out, and the others joined in page order by one line feed.

Defined results.  A null html is empty: no text.  Rows with equal page_id are separate pages of their host.
A very long or malformed page is read whole, in time linear in its length.  A page of a null or unreadable url has no host, and nothing
is counted for it.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_ROWS, require, stored

MIN_PAGES = 3
#: Shares of a host's pages for a subtree outside of articles, and for prose there and all inside.
MIN_SHARE, MIN_INSIDE = 0.05, 0.2
STEP = 64

# Elements by what they are.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Of those, what is no template by itself: outside of articles, and inside.
WHOLE = frozenset(["html", "body"])
PARTS = WHOLE | frozenset("caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li summary tbody td tfoot th thead tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
NEVER = frozenset("nav header footer aside form button select dialog menu head object canvas audio video map label fieldset".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Rules by name: elements of the first kind end open ones of the second up to the nearest of the third.
RULES = {
    "p": (BLOCKS - set("td th tr tbody thead tfoot body html dd dt li legend summary figcaption".split()), {"p"}, set("td th li div article section main button".split())),
    "li": ({"li"}, {"li"}, {"ul", "ol", "menu", "dir"}),
    "dl": ({"dd", "dt"}, {"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"option"}, {"select"}),
}
SEEN_BY: dict[str, list[str]] = defaultdict(list)
ENDED_BY: dict[str, list[str]] = defaultdict(list)
for _name, (_starts, _ends, _within) in RULES.items():
    for _tag in _starts:
        ENDED_BY[_tag].append(_name)
    for _tag in _ends | _within:
        SEEN_BY[_tag].append(_name)
#: Words of class and id names that mark what is not main text.
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adslot adbox adunit banner banners billboard sponsor sponsored "
    "promo promos promotion promoted nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination toc sidebar sidebars "
    "sidenav rail aside widget widgets header masthead topbar footer foot bottombar copyright colophon cookie cookies consent gdpr notice "
    "notices notification notifications alert popup modal overlay lightbox paywall subscribe subscription newsletter signup login social share "
    "sharing sharebar related recommended recommendations trending popular comment comments commentlist respond disqus replies reply form search "
    "searchbox hidden".split()
)
#: Words that may stand beside one of those in a name and say nothing of what the element holds.
LAYOUT = frozenset(
    "area bar block blocks box button buttons column container col count desktop footer group header holder inner item items left "
    "line link links list main mobile outer page panel post posts primary region right row secondary section site slot sticky style title top "
    "tools unit user users wrap wrapper x y js is has the".split()
)
#: Of those, what an article may hold as its own: its title line.
OWN_HEADER = frozenset(["header"])
#: What is text by its element, whatever its name says.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ol dl li figure".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: A tag that ends at the next >, whatever quotes are open.
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "hash", "parent", "shape", "tag")

    def __init__(self, tag: str, parent: "Node | None", attrs: str = "") -> None:
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list = []
        self.hash = self.shape = 0


class _Open:
    """The open elements, and for each rule of RULES those that it looks for, so that no rule searches them all."""

    def __init__(self, root: Node) -> None:
        self.here, self.root = root, root
        self.count: Counter[str] = Counter()
        self.track: dict[str, list[Node]] = {name: [] for name in RULES}

    def push(self, node: Node) -> None:
        self.here = node
        self.count[node.tag] += 1
        for name in SEEN_BY.get(node.tag, ()):
            self.track[name].append(node)

    def close(self, tag: str) -> None:
        """End the innermost open element of this tag and what is open in it."""
        if self.count[tag]:
            while self.here.tag != tag:
                self._pop()
            self._pop()

    def _pop(self) -> None:
        node = self.here
        self.here = node.parent
        self.count[node.tag] -= 1
        for name in SEEN_BY.get(node.tag, ()):
            self.track[name].pop()

    def make_room(self, tag: str) -> None:
        """End what the start of such an element ends."""
        for name in ENDED_BY.get(tag, ()):
            ends, track = RULES[name][1], self.track[name]
            while track and track[-1].tag in ends:
                last = track[-1]
                while self.here is not last:
                    self._pop()
                self._pop()


def parse(html: str) -> Node:
    """A tree of elements and strings, in time linear in the page; never fails and closes what the page leaves open."""
    root = Node("#root", None)
    tree = _Open(root)
    at, n, tag_at = 0, len(html), _TAG.match
    while at < n:
        start = html.find("<", at)
        if start < 0:
            tree.here.children.append(html[at:])
            break
        m = tag_at(html, start)
        if m is None and html[start + 1 : start + 2] in ("!", "?"):
            comment = html.startswith("<!--", start)
            end = html.find("-->" if comment else ">", start + 2)
            if start > at:
                tree.here.children.append(html[at:start])
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        if m is None and html[start + 1 : start + 2].replace("/", "a").isalpha():
            if html.find(">", start) < 0:  # no tag ends any more
                tree.here.children.append(html[at:])
                break
            m = _BARE_TAG.match(html, start)
            if m is not None:  # a quote stays open from here on: no later tag can be read by its quotes
                tag_at = _BARE_TAG.match
        if m is None:
            tree.here.children.append(html[at : start + 1])
            at = start + 1
            continue
        if start > at:
            tree.here.children.append(html[at:start])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                tree.here.children.append(Node("br", tree.here))
            else:
                tree.close(tag)
            continue
        tree.make_room(tag)
        node = Node(tag, tree.here, m[3])
        tree.here.children.append(node)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(html, at)
            node.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "math")):
            tree.push(node)
    return root


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(node.attrs)}


def _named(name: str, own: frozenset[str]) -> bool:
    """Whether a class or id name says that this is no main text: all its words are of such kinds, one at least unwanted."""
    words = [w for w in map(str.lower, _WORD.findall(name)) if not w.isdigit()]
    return any(w in UNWANTED and w not in own for w in words) and all(w in UNWANTED or w in LAYOUT for w in words)


def _unwanted(node: Node, inside: bool = False) -> bool:
    """Whether an element is never main text; inside an article its own header and named paragraphs are."""
    own = OWN_HEADER if inside else frozenset()
    if node.tag in NEVER - own:
        return True
    if not node.attrs.strip():
        return False
    found = _attributes(node)
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    if node.tag in ("main", "body", "html") or inside and node.tag in PROSE:
        return False
    names = [*found.get("class", "").split(), found.get("id", "")]
    if node.tag == "article":
        own = UNWANTED - {"comment", "comments", "ad", "ads", "advert", "related", "promo", "sponsored"}
    return any(_named(x, own) for x in names)


def _article(root: Node) -> list[Node]:
    """The main elements of a page: its outermost articles, else main, else those of role main; nested ones are part of them."""
    for wanted in (lambda x: x.tag == "article", lambda x: x.tag == "main" or 'role="main"' in x.attrs):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if isinstance(node, str) or node.tag in RAW:
                continue
            if node is not root and _unwanted(node):
                continue
            if node is not root and wanted(node):
                found.append(node)
            else:
                stack.extend(reversed(node.children))
        if found:
            return found
    return []


def hash_subtrees(root: Node, main: list[Node]) -> list[tuple[int, int]]:
    """Sets node.hash below root and returns (tree, holder): hashes of block elements and of the page or article with them.

    Of an element inside an article the tree is its hash inverted.  Each holder has itself a row, of tree 0 or inverted 0.
    What hangs beside an article has a second tree, its shape: tags and classes without text, runs of equal children as one.
    """
    from xxhash import xxh64_intdigest

    mains = {id(x): x for x in main}
    around: set[int] = set()
    order, stack = [], [(root, None)]
    outside, inside = [], []
    while stack:
        node, holder = stack.pop()
        order.append((node, holder))
        holder = holder or mains.get(id(node))
        stack.extend((c, holder) for c in node.children if not isinstance(c, str))
    beside: list[Node] = []
    for node, holder in reversed(order):
        if holder is None and main and id(node) not in mains:
            own = [c.shape for c in node.children if not isinstance(c, str)]
            own = [x for i, x in enumerate(own) if i == 0 or x != own[i - 1]]
            name = f"{node.tag}\x02{_attributes(node).get('class', '') if node.attrs else ''}"
            node.shape = xxh64_intdigest(f"shape\x02{name}\x02{own}") >> 1 | 1
        parts = [node.tag, " ".join(sorted(_attributes(node).get("class", "").split())) if node.attrs else ""]
        for c in node.children:
            text = c if isinstance(c, str) else f"\x01{c.hash:x}"
            parts.append(_SPACE.sub(" ", text) if isinstance(c, str) else text)
        node.hash = xxh64_intdigest("\x02".join(parts)) >> 1 & ~1 | (node.tag in PROSE)  # the lowest bit: is it prose
        if holder is not None:
            if node.tag in BLOCKS and node.tag not in PARTS and node.tag not in PROSE:
                inside.append((node.hash, holder))
        elif id(node) in mains or any(id(x) in around for x in node.children if not isinstance(x, str)):
            around.add(id(node))  # an ancestor of the article is no template either
        elif node.tag in BLOCKS and node.tag not in WHOLE:
            outside.append(node.hash)
            beside.append(node)
    return [(0, root.hash), *((h, root.hash) for h in outside), *((x.shape, root.hash) for x in beside if id(x.parent) in around), *((~0, x.hash) for x in main), *((~h, x.hash) for h, x in inside)]


def extract(html: str, template: frozenset[int] | set[int] | None, tally: Counter | None = None) -> str:
    """A page's main text; template: hashes of its host's templates, None if nothing was counted.  tally gets characters by why they went."""
    root = parse(html)
    if template is None:
        return _text(root, [], None, tally)
    main = _article(root)
    trees = {tree for tree, _ in hash_subtrees(root, main)}
    found = Counter()
    text = _text(root, main, template, found)
    if main and any(tree < 0 and tree in template for tree in trees):
        whole = Counter()
        all_text = _text(root, main, {t for t in template if t >= 0}, whole)
        if 2 * len(text) < len(all_text):
            text, found = all_text, whole
    if tally is not None:
        tally.update(found)
    return text


def _length(node: "Node | str") -> int:
    """Characters of the text below a node, without scripts and the like."""
    total, stack = 0, [node]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            total += len(_SPACE.sub(" ", node).strip())
        elif node.tag not in RAW:
            stack.extend(node.children)
    return total


def _around(main: list[Node]) -> set[int]:
    """The ancestors of the main elements, the root too."""
    found: set[int] = set()
    for node in main:
        up = node.parent
        while up is not None and id(up) not in found:
            found.add(id(up))
            up = up.parent
    return found


def _text(root: Node, main: list[Node], template: frozenset[int] | set[int] | None, tally: Counter | None) -> str:
    mains, around = {id(x) for x in main}, _around(main)
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(text)

    def gone(node: Node | str, inside: bool) -> str | None:
        """Why a node is no main text, or None."""
        if isinstance(node, str):
            return "outside" if main and not inside else None
        if node.tag in RAW:
            return "element"
        if template is None or id(node) in mains or id(node) in around or node is root:
            return None
        if (~node.hash if inside else node.hash) in template or not inside and id(node.parent) in around and node.shape in template:
            return "recurs"
        if main and not inside:
            return "outside"
        return "named" if _unwanted(node, inside) else None

    stack: list = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node is None:
            end()
            continue
        why = gone(node, inside)
        if why:
            if tally is not None and why != "element":
                tally[why] += _length(node)
            if not isinstance(node, str) and node.tag in BLOCKS:
                end()
            continue
        if isinstance(node, str):
            line.append(unescape(node))
            continue
        if node.tag == "br":
            line.append(" ")
        inside = inside or id(node) in mains
        if node.tag in BLOCKS:
            end()
            stack.append((None, inside))
        stack.extend((c, inside) for c in reversed(node.children))
    end()
    return "\n".join(blocks)


def host(url: Column) -> Column:
    """Lower-case host of a url, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of columns host, key, html: host, key, tree, holder."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            rows: list[tuple] = []
            for name, key, html in zip(*(part.column(c).to_pylist() for c in ("host", "key", "html"))):
                root = parse(html)
                rows.extend((name, key, *x) for x in set(hash_subtrees(root, _article(root))))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "key", "tree", "holder"])


_TREES = "host string, key string, tree long, holder long"


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_inside: float = MIN_INSIDE) -> DataFrame:
    """(host, tree): hashes of subtrees that recur on a host's pages or (inverted) in its articles, from columns host and html."""
    rows = pages.filter("html is not null and host <> ''").select("host", F.lit("").alias("key"), "html")
    seen = rows.mapInArrow(_trees, _TREES)
    counted = stored(seen.groupBy("host", "tree").agg(F.count_distinct("holder").alias("n")), "html-trees")
    counted = counted.withColumn("inside", F.col("tree") < 0)
    totals = counted.filter("tree in (0, -1)").select("host", "inside", F.col("n").alias("holders"))
    found = counted.filter(f"tree not in (0, -1) and n >= {min_pages}").join(totals, ["host", "inside"])
    least = F.when(F.col("inside") | (F.col("tree") % 2 == 1), F.lit(min_inside)).otherwise(F.lit(min_share))
    return found.filter(F.col("n") >= least * F.col("holders")).select("host", "tree")


def tallied(pages: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, recurs, outside, named) of all pages: the text, and characters that went as template, or too rare for
    that as outside of the page's article or by name.  few: templates that are broadcast at most."""
    rows = require(pages, "page_id", "url", "html").withColumn("host", host(F.col("url")))
    table = stored(templates(rows), "html-templates")
    if table.limit(few + 1).count() <= few:
        lists: dict[str, set[int]] = defaultdict(set)
        for r in table.collect():
            lists[r["host"]].add(r["tree"])
        shared = pages.sparkSession.sparkContext.broadcast(dict(lists))
        own = rows.withColumn("trees", F.lit(None).cast("array<long>"))
    else:  # the hashes of each page, of which equal pages of a host share one list
        keyed = rows.withColumn("key", F.md5(F.coalesce("html", F.lit(""))))
        seen = keyed.filter("html is not null and host <> ''").select("host", "key", "html").mapInArrow(_trees, _TREES).select("host", "key", "tree").distinct()
        own = stored(seen.join(table, ["host", "tree"]).groupBy("host", "key").agg(F.collect_list("tree").alias("trees")), "html-lists")
        own, shared = keyed.join(own, ["host", "key"], "left"), None

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, none = shared.value if shared else {}, frozenset()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                out, why = [], []
                for name, html, trees in zip(*(part.column(c).to_pylist() for c in ("host", "html", "trees"))):
                    why.append(Counter())
                    out.append(extract(html or "", known.get(name, none) if shared else frozenset(trees or ()), why[-1]))
                counts = [pa.array([w[k] for w in why], pa.int64()) for k in ("recurs", "outside", "named")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), *counts], ["page_id", "url", "text", "recurs", "outside", "named"])

    return own.select("page_id", "url", "host", "html", "trees").mapInArrow(texts, "page_id long, url string, text string, recurs long, outside long, named long")


def main_text(pages: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text) of all pages."""
    return tallied(pages, few).select("page_id", "url", "text")
