"""Main text of web pages by site style trees.

The pages of a host share templates.  Merging their element trees gives the site style tree: one
node for each path of element styles (tag, classes, id), with what the pages have there.  A node's
importance is the entropy, over the site's pages, of its presentation (sequence of child styles)
and of its content (text below it), each divided by its largest possible value: menus and notices
say the same on every page and score near 0, articles near 1.  Branches of low importance are
removed from each page.

The tree judges all blocks, paragraphs and list items too.  Elements made for page furniture (nav,
footer, form, script, ...), or named so without doubt (ad, sidebar, comments, ...), have importance 0
a priori.  Names that may as well be those of content (notice, search, related, ...) are a prior only:
such a branch goes unless the tree finds it important.  With an article or main element the text
is what is left inside it, else what is left of the page; paragraphs and headings inside it stay.

Distribution: pages are never grouped by host.  Each page yields a few small rows (host, path,
signature); they are counted by Spark with partial sums, so a hot host is spread over all tasks
until the last sums, which have one row a distinct signature and task.  Copies of an article
count as one page.  Host tables of low branches are joined to the pages, by broadcast only below
a checked number of rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, each, fresh

#: A node is judged if at least this many different pages of the host have it.
MIN_PAGES = 5
#: Share of content in the composite importance; the rest is presentation.
CONTENT_WEIGHT = 0.9
#: Branches below this importance go.
THRESHOLD = 0.2
#: Branches with a doubtful name stay from this importance on.
RESCUE = 0.9
#: Low branches in all, up to which they are broadcast.
BROADCAST_ROWS = 100_000

_RAW = "script|style|textarea|title|noscript|iframe|template"
_MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^"'>]+)*(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^"'>]+)*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
BLOCKS = _words(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul caption"
)
SCOPES = _words("article aside body div fieldset figure footer form header html li main nav ol section table td th ul")
CELLS = _words("br td th")
SAID = _words("p h1 h2 h3 h4 h5 h6 b i em strong span a")
#: Page furniture by element.
FURNITURE = _words("nav footer aside form script style noscript template iframe svg canvas button select option textarea dialog menu head title object audio video")
#: Page furniture by a whole name in class, id or role; the last list only outside an article.
#: Names that only hold such a word say nothing: the tree judges them.
FURNITURE_WORDS = _words(
    "nav navbar navigation menubar breadcrumb breadcrumbs footer contentinfo sidebar complementary ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal newsletter signup login comments disqus pagination pager copyright toolbar"
)
#: Names that are furniture's as a rule, but may be content's.
MAYBE_WORDS = _words("menu widget promo promotion notice notices alert overlay subscribe subscription share sharing social related recommended comment reply replies respond form search skip hidden")
OUTER_WORDS = _words("header banner masthead")
#: Elements that are never furniture by name.
UNNAMED = _words("html body article main p h1 h2 h3 h4 h5 h6")
#: Elements that the tree does not judge: those around all text, and those inside a line.
UNJUDGED = _words("html body article main header")
_NONE: frozenset[str] = frozenset()
_P = _words("p")
CLOSES = {"li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "tr": _words("tr td th"), "td": _words("td th"), "th": _words("td th"), "option": _words("option")}


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Node:
    """``state``: of the branch; ``doubt``: whether its own name is a doubtful one; ``said``: a hash of
    all text below, in order."""

    __slots__ = ("tag", "path", "state", "doubt", "main", "judged", "said", "shape")

    def __init__(self, tag: str, path: int, state: int, doubt: bool, main: bool, judged: bool):
        self.tag, self.path, self.state, self.doubt, self.main, self.judged = tag, path, state, doubt, main, judged
        self.said = 0
        self.shape: list[str] = []

    def add(self, said: int) -> None:
        self.said = (self.said * 0x9E3779B97F4A7C15 + said) & _MASK


_MASK = (1 << 64) - 1
#: States of a branch: kept, furniture by its element or name, or perhaps so by its name.
KEPT, GONE, MAYBE = 0, 1, 2


def _style(tag: str, attrs: str, inside: bool) -> tuple[str, int]:
    """Style of an element, and its state."""
    state = GONE if tag in FURNITURE or tag == "header" and not inside else KEPT
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return tag, state
    names = []
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id", "role"):
            names.append(f"{name}={' '.join(sorted(value.split()))}")
            own = set(value.lower().split())
            if tag not in UNNAMED and (own & FURNITURE_WORDS or not inside and own & OUTER_WORDS) or tag == "article" and own & {"comment", "comments", "reply"}:
                state = GONE
            elif state == KEPT and tag not in UNNAMED and own & MAYBE_WORDS:
                state = MAYBE
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            state = GONE
    return ("|".join([tag, *sorted(names)]) if names else tag), state


def walk(page: str) -> Iterator[tuple[str, Node | None, str]]:
    """Events of a page: ("open" or "close", node, ""), ("text", node, text), ("break", node, "").
    Unclosed elements end with the page; end tags without a start count for nothing."""
    stack = [Node("", 0, KEPT, False, False, False)]
    paths: dict[tuple[int, str], int] = {}

    def close(k: int) -> Iterator[tuple[str, Node | None, str]]:
        while len(stack) > k:
            yield "close", stack.pop(), ""

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        _, end, tag, attrs = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            barrier = _NONE if tag in BLOCKS else BLOCKS
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    yield from close(k)
                    break
                if stack[k].tag in barrier or tag in ("p", "li") and stack[k].tag in SCOPES and stack[k].tag != tag:
                    break
            if tag in BLOCKS:
                yield "break", stack[-1], ""
            continue
        shut = CLOSES.get(tag) or (_P if tag in BLOCKS else None)
        if shut:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut:
                    yield from close(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        top = stack[-1]
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            yield "break" if tag == "hr" else "text", top, " "
            continue
        style, state = _style(tag, attrs, top.main)
        key = (top.path, style)
        if key not in paths:
            paths[key] = _hash(f"{top.path}/{style}")
        gone = GONE if GONE in (state, top.state) else KEPT
        node = Node(tag, paths[key], gone, state == MAYBE, top.main or tag in ("article", "main") or "role=main" in style, tag in BLOCKS and tag not in UNJUDGED)
        top.shape.append(style)
        stack.append(node)
        yield "open", node, ""
    if at < len(page):
        yield "text", stack[-1], page[at:]
    yield from close(1)


def _flat(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def extract(page: str | None, low: frozenset[int] = frozenset(), high: frozenset[int] = frozenset()) -> str:
    """Text of a page without furniture, without the branches in ``low``, and without those that have
    a doubtful name and are not in ``high``."""
    blocks: list[tuple[bool, str]] = []
    parts: list[str] = []
    main = False
    cut = 0  # open branches that are gone

    def flush() -> None:
        if parts:
            line = _flat(parts)
            if line:
                blocks.append((main, line))
            parts.clear()

    for kind, node, text in walk(page or ""):
        if kind == "text":
            if not cut:
                parts.append(text)
            continue
        if cut and kind == "break":
            continue
        gone = kind != "break" and (node.state == GONE or node.path in low and not (node.main and node.tag in UNNAMED) or node.doubt and node.path not in high)
        if kind == "break" or node.tag in BLOCKS:
            if not cut:
                flush()
        elif node.tag in CELLS and not cut:
            parts.append(" ")
        if gone:
            cut += 1 if kind == "open" else -1
        main = node.main if kind == "open" else main
        if kind == "close":
            main = node.main and node.tag not in ("article", "main")
    flush()
    if any(m for m, _ in blocks):
        blocks = [b for b in blocks if b[0]]
    return "\n".join(x for _, x in blocks)


def nodes(page: str | None) -> list[tuple[int, int, int, int, bool]]:
    """Rows of a page for the style tree: (path, content, presentation, page, doubt).  ``page`` is a
    hash of the text in paragraphs and headings, so that copies of an article are the same page;
    nodes of one path are one.  Each text is hashed once, however deep it lies."""
    rows: dict[int, list] = {}
    stack: list[Node] = []  # open ones
    said: list[str] = []
    for kind, node, text in walk(page or ""):
        if kind == "text":
            flat = text.strip() and node.state == KEPT and " ".join(text.split())
            if flat:
                if node.tag in SAID:
                    said.append(flat)
                node.add(_hash(flat) & _MASK)
        elif kind == "open":
            stack.append(node)
        elif kind == "close":
            stack.pop()
            if stack and node.state == KEPT:
                stack[-1].add(node.said)
            if node.judged and node.state == KEPT:
                own = rows.setdefault(node.path, [0, 0, node.doubt])
                own[0] += node.said
                own[1] += _hash(" ".join(dict.fromkeys(node.shape)))
    if not rows:
        return []
    own_page = _hash(" ".join(said) or page or "")
    signed = lambda x: ((x & _MASK) ^ (1 << 63)) - (1 << 63)
    return [(path, signed(a), signed(b), own_page, doubt) for path, (a, b, doubt) in rows.items()]


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; empty for null and other strings."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(df: DataFrame, url: str = "url", page: str = "html", min_pages: int = MIN_PAGES, weight: float = CONTENT_WEIGHT) -> DataFrame:
    """Nodes of all sites' trees that enough pages have: host, path, pages, importance, doubt."""

    def of_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(host, *row) for host, x in zip(pdf["host"], pdf["page"], strict=True) for row in nodes(x)]
        return pd.DataFrame(rows, columns=["host", "path", "content", "presentation", "page", "doubt"])

    seen = df.select(host_of(F.col(url)).alias("host"), F.col(page).alias("page")).mapInPandas(lambda batches: each(of_batch, batches), "host string, path long, content long, presentation long, page long, doubt boolean")
    both = seen.select("host", "path", "page", "doubt", F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("content").alias("sig")), F.struct(F.lit(1).alias("kind"), F.col("presentation").alias("sig")))))
    once = both.distinct()
    counts = once.groupBy("host", "path", "doubt", "kind", "sig").agg(F.count(F.lit(1)).alias("c"))
    by_kind = counts.groupBy("host", "path", "doubt", "kind").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log2("c")).alias("clogc"))
    entropy = F.when(F.col("pages") > 1, 1 - F.col("clogc") / (F.col("pages") * F.log2("pages"))).otherwise(1.0)
    return (
        by_kind.groupBy("host", "path", "doubt")
        .agg(F.max("pages").alias("pages"), F.sum(F.when(F.col("kind") == 0, entropy * weight).otherwise(entropy * (1 - weight))).alias("importance"))
        .where(F.col("pages") >= min_pages)
    )


def extract_text(df: DataFrame, url: str = "url", page: str = "html", out: str = "text", threshold: float = THRESHOLD, rescue: float = RESCUE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``df`` with the main text of each page in ``out`` (a column of that name is replaced).

    Blocks are joined by one newline; white space inside a block is one space.  Null and empty
    pages, and pages without main text, get the empty string.  Repeated rows get equal texts, an
    empty table gives an empty one.  Very long and very deep pages are read whole.
    """
    host, low, high = fresh("_host", df), fresh("_low", df), fresh("_high", df)
    judged = style_tree(df, url, page, min_pages)
    is_low, is_high = F.col("importance") < threshold, F.col("doubt") & (F.col("importance") >= rescue)
    by_host = judged.where(is_low | is_high).groupBy(F.col("host").alias(host)).agg(F.collect_set(F.when(is_low, F.col("path"))).alias(low), F.collect_set(F.when(~is_low, F.col("path"))).alias(high))
    by_host = cut(by_host)
    size = by_host.select(F.sum(F.size(low) + F.size(high) + 1)).first()[0] or 0
    with_host = df.withColumn(host, host_of(F.col(url)))
    paths = lambda x: frozenset() if x is None else frozenset(int(p) for p in x)

    def of_batch(batch: tuple[pd.Series, pd.Series, pd.Series]) -> pd.Series:
        return pd.Series([extract(x, paths(a), paths(b)) for x, a, b in zip(*batch, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def texts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return each(of_batch, batches)

    joined = with_host.join(F.broadcast(by_host) if size <= BROADCAST_ROWS else by_host, host, "left")
    return joined.withColumn(out, texts(F.col(page), F.col(low), F.col(high))).drop(host, low, high)
