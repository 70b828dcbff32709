import html
import re

from tracelake.llm import html_text
from tracelake.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="x">
<div class="cookie-notice">We use cookies</div><header><h1>Site</h1><nav><ul><li><a href="/">Home</a></li></ul></nav></header>
<main><article><header><h1>Title&nbsp;&amp; more</h1></header><!-- <p>comment</p> --><p>One   two
three<p>four <b>five</b><br>six</p><ul><li>a<li>b</ul><table><tr><td>x</td><td>y</td></tr></table>
<aside>side</aside><section class="comments"><p>nice</p></section></article></main>
<form><p>mail</p></form><div id="footer">end</div><p title="a>b">late</p><footer>f</footer></body></html>"""


def test_blocks():
    assert html_text.extract(PAGE) == "Title & more\nOne two three\nfour five six\na\nb\nx y"
    assert html_text.extract(None) == html_text.extract("") == ""
    assert html_text.extract("no markup &lt;at&gt; all") == "no markup <at> all"
    assert html_text.extract("a < b and c > d") == "a < b and c > d"
    assert html_text.extract("<p>cut off <b>her") == "cut off her"
    assert html_text.extract("<p>x<script>var a = '<p>'") == "x"
    assert html_text.extract("<p>x<!-- never closed <p>y") == "x"
    assert html_text.extract('<p>x</p><p title="never closed>y</p>') == "x"
    assert html_text.extract("<div>a<div hidden>b</div><div style='display: none'>c</div>d</div>") == "a\nd"
    assert html_text.extract("</p></div><p>x") == "x"


def test_neutral_branches_go_by_entropy(spark):
    notice = '<div class="box"><p>Read our terms before you go on.</p></div>'
    page = lambda k: f"<html><body><div class='box1'>{notice}</div><div class='text'><p>Own words {k} of page {k}.</p></div></body></html>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(12)] + [(100 + k, f"http://b.example/{k}", page(k)) for k in range(2)]
    rows += [(200, None, page(1)), (201, "http://c.example/", None), (202, "", ""), (None, "http://A.example:80/x", page(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "path")
    got = {(r["path"], r["url"]): r["text"] for r in html_text.extract_text(df).collect()}
    assert got[3, "http://a.example/3"] == "Own words 3 of page 3." == got[None, "http://A.example:80/x"]
    assert got[100, "http://b.example/0"].startswith("Read our terms")  # too few pages to tell
    assert got[201, "http://c.example/"] == got[202, ""] == ""
    assert html_text.extract_text(df.limit(0)).count() == 0
    tree = html_text.style_tree(df).collect()
    assert all(0 <= r["importance"] <= 1 + 1e-9 for r in tree)


def test_copies_of_an_article_stay(spark):
    page = "<html><body><script>track({})</script><div class='c'><p>The same article each time.</p></div></body></html>"
    rows = [(k, f"http://a.example/{k}", page.format(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract_text(df).collect()} == {"The same article each time."}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op5_html_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        lines = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inner))
        want = "\n".join(x for x in (" ".join(html.unescape(s).split()) for s in lines) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_names_that_hold_a_furniture_word_stay():
    page = "<body><div class='content has-sidebar'><article><h2 id='search-engines'>Engines</h2><p class='notice'>Mind this.</p><section id='related-work'><h2>Related</h2><p>Others did it.</p></section><div class='comments'><p>nice</p></div></article></div></body>"
    assert html_text.extract(page) == "Engines\nMind this.\nRelated\nOthers did it."


def plain_importance(pages, weight=html_text.CONTENT_WEIGHT):
    """Importance of each path of one host, from the rows of its pages and the definition."""
    import math
    from collections import Counter, defaultdict

    seen = defaultdict(set)
    for x in pages:
        for path, content, presentation, page, _ in html_text.nodes(x):
            seen[path, "content"].add((page, content))
            seen[path, "presentation"].add((page, presentation))

    def entropy(rows):
        n = len(rows)
        counts = Counter(sig for _, sig in rows)
        return 1.0 if n < 2 else -sum(c / n * math.log(c / n, n) for c in counts.values())

    return {path: (len(seen[path, "content"]), weight * entropy(seen[path, "content"]) + (1 - weight) * entropy(seen[path, "presentation"])) for path, kind in seen if kind == "content"}


def site(k, extra=""):
    side = f"<div class='x{k % 3}'><p>{'Old' if k % 3 else 'New'} box</p></div>"
    return f"<html><body><div class='top'><p>Welcome to the site.</p></div>{side}<div class='text'><h1>Title {k}</h1><p>Own words {k} of page {k}.</p><div class='notice'><p>Take care with item {k}.</p></div></div>{extra}</body></html>"


def test_tree_against_its_definition(spark):
    pages = [site(k) for k in range(14)] + [site(3)]
    df = spark.createDataFrame([(k, "http://a.example/", x) for k, x in enumerate(pages)], "page_id long, url string, html string")
    got = {r["path"]: (r["pages"], r["importance"]) for r in html_text.style_tree(df).collect()}
    want = {path: x for path, x in plain_importance(pages).items() if x[0] >= html_text.MIN_PAGES}
    assert got.keys() == want.keys() and len(got) >= 6
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_tree_decides(spark):
    df = spark.createDataFrame([(k, "http://a.example/", site(k)) for k in range(14)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert got[4] == "Title 4\nOwn words 4 of page 4.\nTake care with item 4."  # same on all pages: gone; a notice of its own: kept
    assert html_text.extract(site(4)) == "Welcome to the site.\nOld box\nTitle 4\nOwn words 4 of page 4."  # without the tree
    same = [(k, "http://b.example/", site(k).replace(f"item {k}", "it")) for k in range(14)]
    got = html_text.extract_text(spark.createDataFrame(same, "page_id long, url string, html string")).collect()
    assert not any("Take care" in r["text"] for r in got)


def test_tree_of_the_pages_has_nodes(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert html_text.style_tree(pages).count() > 30


def test_names_inside_an_article():
    page = '<article><h1>T</h1><p class="notice">real paragraph</p><div class="search-results"><p>found text</p></div><p class="form">body</p><p>ok</p><div class="ad">buy</div></article>'
    assert html_text.extract(page) == "T\nreal paragraph\nfound text\nbody\nok"


def test_deep_and_clashing(spark):
    deep = "<div>" * 3000 + "<p>down there</p>" + "</div>" * 3000
    assert html_text.extract(deep) == "down there" and len(html_text.nodes(deep)) == 3001
    df = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "h", 5)], "page_id long, url string, html string, _host string, _low long")
    r = html_text.extract_text(df).first()
    assert (r["text"], r["_host"], r["_low"]) == ("x", "h", 5)
