"""Main text of web pages by composite text density.

Every DOM node has characters, tags, link characters and link tags below it; its
composite density is characters per tag, damped by the share of links.  The sum of the
densities of a node's children (a run of own text counts as a child) peaks at the node
that holds the article.  The least density on the path from that node to the body, body included, is the
threshold: nodes beside the path that reach it, or the path's least characters outside
links per tag, belong to the article too.  The lowest node that joins such a neighbour
with the peak is given as a whole, without noise and lists of links.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
                    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
#: elements that never belong to an article's text
NOISE = frozenset("head script style noscript template iframe svg math canvas object audio video map nav footer aside form "
                  "button select option input textarea label menu dialog title noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: parts of a class, id or role that mark what is no article, wherever they stand in it
NOISE_PARTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies consent gdpr "
                        "comment comments disqus respond replies sidebar aside nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social "
                        "related recommended newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager complementary contentinfo".split())
#: words that do so alone, or with a word of the site around them (site-header, top-menu)
NOISE_WORDS = frozenset("header menu banner notice notices alert widget search reply skip".split())
SITE_WORDS = frozenset("site page main top bottom global user mobile primary secondary list area box bar wrap wrapper container".split())
_ENDS_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body"}
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class _Node:
    __slots__ = ("tag", "up", "parts", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: _Node | None, noise: bool | None):
        self.tag, self.up, self.noise, self.parts = tag, up, noise, []


def _names_noise(names: str) -> bool | None:
    """Whether a class list, id or role names a part that is no article: None where
    only a word of the second kind does.  ``entry-header`` or ``search-results`` names a part of
    an article."""
    told: bool | None = False
    for name in names.lower().split():
        parts = [p for p in re.split(r"[^a-z]+", name) if p]
        if not NOISE_PARTS.isdisjoint(parts):
            return True
        if not NOISE_WORDS.isdisjoint(parts) and NOISE_WORDS.union(SITE_WORDS).issuperset(parts):
            told = None
    return told


def _is_noise(tag: str, attrs: str, inside: bool) -> bool | None:
    """True by tag, a plain name or because hidden; None where a name may be misread."""
    if tag in NOISE or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attrs):
        return True
    told = {_names_noise(m[1] or m[2] or m[3] or "") for m in _NAMES.finditer(attrs)}
    return True if True in told else None if None in told else False


def _settle_names(root: _Node) -> None:
    """A part that a name of the second kind marks is noise, unless it holds most of the page's
    text outside links: then the name is about the article."""
    order = [root]
    for x in order:
        order.extend(p for p in x.parts if isinstance(p, _Node) and p.noise is not True)
    free: dict[int, int] = {}
    for x in reversed(order):
        n = 0 if x.tag == "a" else sum(len("".join(p.split())) if isinstance(p, str) else free.get(id(p), 0) for p in x.parts)
        free[id(x)] = n
    for x in order:
        if x.noise is None:
            x.noise = 2 * free[id(x)] <= free[id(root)]


def parse(page: str) -> _Node:
    """A tree of elements and text runs; end tags that are left out are put in, those
    without a start are ignored."""
    root = node = _Node("html", None, False)
    at, n, articles = 0, len(page), 0
    match = _TOKEN.match
    while at < n:
        m = match(page, at)
        at = m.end()
        close, tag = m[1], m[2]
        if tag:
            tag = tag.lower()
            if tag in ("html", "body") and (tag == "html" or any(isinstance(x, _Node) and x.tag == "body" for x in root.parts)):
                continue
            if tag in _ENDS_P:
                x = node
                while x.up and x.tag != "p" and (x.tag not in BLOCKS):
                    x = x.up
                if x.tag == "p":
                    node = x.up
            if tag in _SAME:
                same, stop = _SAME[tag]
                x = node
                while x.up and x.tag not in stop and x.tag not in same:
                    x = x.up
                if x.tag in same:
                    node = x.up
                    if tag == "tr" and x.tag in ("td", "th") and node.tag == "tr":
                        node = node.up
            if tag == "body":  # a head without end
                node = root
            attrs = m[3] or ""
            new = _Node(tag, node, _is_noise(tag, attrs, articles > 0))
            node.parts.append(new)
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            elif tag not in VOID and not attrs.rstrip().endswith("/") or tag in BLOCKS and tag != "hr":
                node = new
                articles += tag in ("article", "main")
        elif close:
            close, x = close.lower(), node
            while x.up and x.tag != close:
                # an inline end tag does not reach across blocks
                if close not in BLOCKS and x.tag in BLOCKS:
                    break
                x = x.up
            if x.tag == close and x.up:
                while node is not x.up:
                    articles -= node.tag in ("article", "main")
                    node = node.up
        elif not m[0].startswith(("<!", "<?")):
            node.parts.append(html.unescape(m[0]))
    return root


def _order(root: _Node) -> list[_Node]:
    """Elements that are not noise, parents first."""
    out = [root]
    for x in out:
        out.extend(p for p in x.parts if isinstance(p, _Node) and not p.noise)
    return out


def _measure(nodes: list[_Node], body: _Node) -> None:
    for x in reversed(nodes):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        for p in x.parts:
            if isinstance(p, str):
                x.chars += len("".join(p.split()))
            elif not p.noise:
                x.chars += p.chars
                x.tags += p.tags + 1
                x.link_chars += p.link_chars
                x.link_tags += p.link_tags + (p.tag == "a")
        if x.tag == "a":
            x.link_chars = x.chars
    share = body.link_chars / body.chars if body.chars else 0.0
    for x in reversed(nodes):
        c, tags = x.chars, max(x.tags, 1)
        links, free, link_tags = max(x.link_chars, 1), max(c - x.link_chars, 1), max(x.link_tags, 1)
        base = math.log(max(c, 1) / free * links + share * c + math.e)  # over 1, as links is not 0
        x.density = c / tags * math.log(max(c / links * tags / link_tags, 1.0)) / math.log(base)
        x.total = sum((len("".join(p.split())) if isinstance(p, str) else 0.0 if p.noise else p.density) for p in x.parts)


def _free(x: _Node) -> float:
    """Characters outside links per tag."""
    return (x.chars - x.link_chars) / max(x.tags, 1)


def _is_links(x: _Node) -> bool:
    """A block that is a list of links; a heading may be one."""
    return not x.noise and x.tag in BLOCKS and not re.fullmatch("h[1-6]", x.tag) and 2 * x.link_chars > x.chars


def _blocks(nodes: list[_Node | str | None], out: list[str]) -> None:
    """Texts of blocks in page order; iterative, so that depth is not bounded."""
    run: list[str] = []

    def end() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.noise or x.tag in VOID:
            if x.tag in ("br", "hr", "img", "wbr"):
                run.append("" if x.tag == "wbr" else " ")
                if x.tag == "hr":
                    end()
        elif x.tag in BLOCKS:
            end()
            stack.append(None)
            stack.extend(reversed(x.parts))
        else:
            stack.extend(reversed(x.parts))
    end()


def main_text(page: str) -> str:
    root = parse(page)
    _settle_names(root)
    nodes = _order(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    _measure(nodes, body)
    inside, todo = [], [body]
    while todo:
        x = todo.pop()
        inside.append(x)
        todo.extend(p for p in x.parts if isinstance(p, _Node) and not p.noise and p.tag not in VOID)
    inside = [x for x in inside if x.chars]
    if not inside:
        return ""
    depth = {}
    for x in nodes:
        depth[x] = depth[x.up] + 1 if x.up in depth else 0
    best = max(inside, key=lambda x: (x.total, -depth[x]))
    path = [best]
    while path[-1] is not body and path[-1].up is not None:
        path.append(path[-1].up)
    # an article element around the peak is the article, or else the main element; density
    # tells which of several articles
    whole = next((x for tag in ("article", "main") for x in reversed(path) if x.tag == tag), None)
    out: list[str] = []
    if whole:
        _blocks([whole], out)
        return "\n".join(out)
    # density grows with a node's size, so a short neighbour may also belong by its
    # characters outside links per tag
    least, even = min(x.density for x in path), max(min(map(_free, path)), 1)
    on, picked = set(map(id, path)), []

    def belongs(x: _Node | str) -> bool:
        if isinstance(x, str):
            return len("".join(x.split())) >= even
        return id(x) not in on and not x.noise and x.chars > 0 and (0 < x.density >= least or _free(x) >= even)

    # the lowest node that joins the peak with a neighbour is the article as a whole, with title and short parts
    join = next((x for x in path[1:] if any(map(belongs, x.parts))), best)
    stack = [body]
    while stack:
        x = stack.pop()
        if x is best:
            picked.append(x)
        elif x is join:
            picked.extend([None, *(p for p in x.parts if isinstance(p, str) or not _is_links(p)), None])
        elif isinstance(x, _Node) and id(x) in on:
            stack.extend(reversed(x.parts))
        elif belongs(x):
            picked.extend([None, x, None])
    _blocks(picked, out)
    return "\n".join(out)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    ``text`` joins the blocks of the article by a line feed, white space inside a block is
    one space and character references are decoded; it is empty for a null or empty page
    and for one without text outside menus, forms, scripts and the like.  Repeated rows
    and null ids are kept, other columns are not read, an empty table gives no rows."""
    def run(batches):
        for b in batches:
            texts = [main_text(t.as_py() or "") for t in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")
