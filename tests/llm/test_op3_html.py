import pytest
from pyspark.sql import functions as F

from quern.llm import html_main_text as h


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("just <text & more", "just <text & more"),
        ("<article><h1>T</h1><p>a &amp; b&nbsp;c<p>d<br>e</article><footer>f</footer>", "T\na & b c\nd e"),
        ("<main><p>x<script>if (a<b) '</p>'</script> y</p><aside>z</aside></main><p>no", "x y"),
        ("<body><nav>n</nav><div class='post'><p>keep</p><div class='comments'><p>bad</p></div></div>", "keep"),
        ("<article><header><h1>Own title</h1></header><p>t</p><div id='share-bar'>s</div></article>", "Own title\nt"),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", "one\ntwo\na\nb"),
        ("<p style='display: none'>no</p><p hidden>no</p><p aria-hidden='true'>no</p><p>yes", "yes"),
        ("<div class='cookie-notice'>c</div><div role='banner'>b</div><form><p>f</form><p>t<!-- <p>c</p> -->u", "tu"),
        ("<p>unclosed <b>bold<p>next", "unclosed bold\nnext"),
        ("</div></p>x</article>", "x"),
        ("<p>a" + "<div>" * 3000 + "deep", "a\ndeep"),
    ],
)
def test_extract(html, text):
    assert h.extract(html, frozenset()) == text


def pages(rows, *values):
    return rows("page_id long, url string, html string, host string, trees array<long>, tree long", *((*v, "x", [1], 2) for v in values))


def test_recurring_subtrees_of_a_host_go(rows):
    box = "<div class=x><p>Our site since 1990</p></div>"
    site = [(i, f"http://a.org/{i}", f"<body>{box}<div><p>Text {i}</p></div></body>") for i in range(6)]
    other = [(9, "http://b.org/", f"<body>{box}<div><p>Here it is text</p></div></body>"), (10, None, None), (11, "nonsense", ""), (9, "http://b.org/", "<p>same id</p>")]
    got = {(r["page_id"], r["text"]) for r in h.main_text(pages(rows, *site, *other)).collect()}
    assert got == {*((i, f"Text {i}") for i in range(6)), (9, "Our site since 1990\nHere it is text"), (10, ""), (11, ""), (9, "same id")}


def test_copies_of_an_article_stay(rows):
    got = h.main_text(pages(rows, *((i, "http://a.org/x", "<body><nav>n</nav><article><p>same words</p></article></body>") for i in range(8)))).collect()
    assert [r["text"] for r in got] == ["same words"] * 8


def test_empty_table(rows, spark):
    assert h.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_driver_against_a_plain_reading(spark, tables):
    import re
    from html import unescape

    p = spark.read.parquet(f"{tables}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in p.collect()}
    for r in h.main_text(p).collect():
        inner = re.sub(r"\s+", " ", re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1])
        lines = unescape(re.sub(r"<[a-z/][^>]*>", "", re.sub(r"</?(?:p|h1)>", "\n", inner))).split("\n")
        assert r["text"] == "\n".join(x for x in (re.sub(r"\s+", " ", y).strip() for y in lines) if x)


@pytest.mark.parametrize("tag", ["article", "main"])
def test_recurring_boxes_of_articles_go(rows, tag):
    box = "<div class=x><p>Read also our other pages</p></div>"
    site = [(i, f"http://a.org/{i}", f"<body><{tag}><p>First words of text {i}, and more</p>{box}<p>Text {i} ends</p></{tag}></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in h.main_text(pages(rows, *site)).collect()}
    assert got == {i: f"First words of text {i}, and more\nText {i} ends" for i in range(6)}


def test_near_copies_of_an_article_keep_their_text(rows):
    site = [(i, f"http://a.org/{i}", f"<article><p>The same long words of one article.</p><p>No. {i}</p></article>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in h.main_text(pages(rows, *site)).collect()}
    assert got == {i: f"The same long words of one article.\nNo. {i}" for i in range(6)}


def test_copies_of_an_unmarked_page_stay(rows):
    site = [(i, "http://a.org/x", "<html><body><div><p>same words</p></div></body></html>") for i in range(8)]
    other = [(10 + i, None, f"<body><div><p>page {i // 3} of no url</p></div></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in h.main_text(pages(rows, *site, *other)).collect()}
    assert got == {**{i: "same words" for i in range(8)}, **{10 + i: f"page {i // 3} of no url" for i in range(6)}}


@pytest.mark.parametrize(
    "html,text",
    [
        ("<article><p class='social-policy'>a</p><section class='search-and-rescue'>b</section><div class='related-posts'>c</div></article>", "a\nb"),
        ("<article><p class='notice'>kept</p><div id='comments'><p>gone</div><div class='site-footer'>gone</div></article>", "kept"),
        ("<div class='content-header'>x</div><div class='ad-slot-1'>y</div><div class='hidden gem'>z</div>", "x"),
        ("<table><tr><td>a<tr><td>b</table><ul><li>c<ul><li>d</ul><li>e</ul>", "a\nb\nc\nd\ne"),
        ("<p>1 < 2 and <3</p><p>a</i></b>b", "1 < 2 and <3\nab"),
        ("<p>x<a href=\"y>z</a><p>w", "xz\nw"),
    ],
)
def test_names_and_malformed_markup(html, text):
    assert h.extract(html, frozenset()) == text


@pytest.mark.parametrize(
    "piece", ["<a ", '<a "', "<a href='x>", "<div>", "</div>", "<b><div></i>", "<!-", "<!--", "<ul><li>", "<table><tr><td>", "<", "</", "<p>x", "<script>", "&", "<b "]
)
def test_time_is_linear_in_malformed_pages(piece):
    import time

    began = time.process_time()
    h.extract(piece * (1_000_000 // len(piece)) + ">", {1})
    assert time.process_time() - began < 20


def test_templates_turned_off_change_the_text():
    box = "<div class=x><p>Read also our other pages</p></div>"
    page = f"<article><p>First words of a long text, and more of them</p>{box}</article>"

    def trees(html):
        root = h.parse(html)
        return {t for t, _ in h.hash_subtrees(root, h._article(root)) if t not in (0, ~0)}

    only_box = trees(page) & trees(f"<article>{box}</article>")
    assert only_box and h.extract(page, only_box) == "First words of a long text, and more of them" != h.extract(page, frozenset())


def test_templates_equal_a_count_by_brute_force(rows):
    """Subtrees of divs written out as strings, counted per host over different pages in plain Python."""
    import random
    import re
    from collections import defaultdict

    rng = random.Random(5)
    boxes = [f"<div class=\"b{i}\">box {i}</div>" for i in range(6)]
    site = []
    for i in range(60):
        host = f"h{i % 3}.org"
        own = [b for j, b in enumerate(boxes) if rng.random() < (j + 1) / 12]
        site.append((i, f"http://{host}/{i}", "<body>" + "".join(own) + f"<div>text {i if i % 7 else 0}</div></body>"))
    holders, pages_of = defaultdict(set), defaultdict(set)
    for _, url, html in site:
        host = url.split("/")[2]
        pages_of[host].add(html)
        for div in re.findall("<div.*?</div>", html):
            holders[host, div].add(html)
    want = {k for k, v in holders.items() if len(v) >= 3 and len(v) >= h.MIN_SHARE * len(pages_of[k[0]])}
    got = {r["page_id"]: r["text"] for r in h.main_text(pages(rows, *site)).collect()}
    for i, url, html in site:
        kept = [d for d in re.findall("<div.*?</div>", html) if (url.split("/")[2], d) not in want]
        assert got[i] == "\n".join(re.sub("<[^>]*>", "", d) for d in kept)


def plain_text(html, drop):
    """Lines of a page of divs and one article without the pieces in drop."""
    import re

    for piece in drop:
        html = html.replace(piece, "")
    return "\n".join(x for x in re.sub("<[^>]*>", "\n", html).split("\n") if x.strip())


@pytest.mark.parametrize("few", [1000, 0])
def test_counts_decide_outside_of_articles_and_names_only_ties(rows, few):
    box = [f"<div class=\"k{i}\">box number {i}</div>" for i in range(3)]
    site = [(i, f"http://a.org/{i}", f"<body>{box[i % 3]}<article><p>text {i}</p></article><div class=z{i}>once {i}</div></body>") for i in range(12)]
    bare = [(100 + i, f"http://b.org/{i}", f"<body>{box[i % 2]}<div class=\"menu\">menu {i}</div><div>words {i}</div></body>") for i in range(8)]
    bare.append(bare[0])
    got = h.tallied(pages(rows, *site, *bare), few).collect()
    for r in got:
        html = next(x[2] for x in site + bare if x[0] == r["page_id"])
        if r["page_id"] < 100:
            assert (r["text"], r["recurs"] > 0, r["outside"] > 0, r["named"]) == (plain_text(html, [*box, f"<div class=z{r['page_id']}>once {r['page_id']}</div>"]), True, True, 0)
        else:
            assert (r["text"], r["recurs"] > 0, r["outside"], r["named"] > 0) == (f"words {r['page_id'] - 100}", True, 0, True)
    assert len(got) == 21
    for _, _, html in site + bare:
        assert h.extract(html, None) == plain_text(html, [])


def test_boxes_that_are_filled_anew_go_by_their_shape():
    page = "<body><nav><ul><li>a {0}<li>b {0}</ul></nav><div>one {0}</div><article><nav>own</nav><div><p>x {0}</p></div></article></body>"

    def trees(html):
        root = h.parse(html)
        return {t for t, _ in h.hash_subtrees(root, h._article(root)) if t not in (0, ~0)}

    both = trees(page.format(1)) & trees(page.replace("<li>b {0}", "<li>b<li>c<li>d").format(2))
    tally = h.Counter()
    assert h.extract(page.format(3), both, tally) == "x 3" and tally["recurs"] == len("a 3") + len("b 3") + len("one 3") + len("own") and not tally["outside"]


def test_what_goes_on_the_drivers_pages_goes_by_counts(spark, tables):
    p = spark.read.parquet(f"{tables}/pages.parquet")
    many = p.unionByName(p.withColumn("html", F.regexp_replace("html", "<p>", "<p>again "))).unionByName(p.withColumn("html", F.regexp_replace("html", "<p>", "<p>more ")))
    total = h.tallied(many).agg({"recurs": "sum", "outside": "sum", "named": "sum"}).first()
    assert total["sum(recurs)"] > 9 * (total["sum(outside)"] + total["sum(named)"])
    texts = {(r["page_id"], r["text"]) for r in h.main_text(p).collect()}
    off = {(r["page_id"], h.extract(r["html"] or "", None)) for r in p.collect()}
    assert len(texts & off) < 0.05 * len(texts)
