"""Main text of web pages by site template removal.

Pass one parses every page, hashes the subtree of each block element (its tag, its own text and
its children's hashes), and Spark counts on how many pages of a host each hash occurs. A subtree
that occurs on at least ``MANY`` pages and on a share ``SHARE`` of the host's pages is template; on a share ``MOST``
it is so even as prose. Pass two parses again and deletes template subtrees, and what is boilerplate by its element (menus,
forms, scripts) or by a class, id or role that is a mark as a whole: ``sidebar`` is one, ``has-sidebar`` isn't. Outside the
story a mark counts also as a part of a name (``google-ads``) of a container with less than half of the page's text.
What holds an article or the main element is never deleted.

The text is that of all articles and main elements, in page order, or of the page if it has neither. Articles with marks of
boilerplate, comments that are articles above all, aren't the story: a page that has no others is taken as a page
without any, and only if nothing is left of it so, such articles count, those of comments never. Inside
an article, blocks of prose (paragraphs, headings, list items, quotes, tables) are content
even where many pages repeat them, as copied articles do; they go where most pages of the host have them, unless they are
half of the story or more. Other containers there can be template as anywhere. The same holds in a main element without articles.

The text of each remaining block: character references decoded once, white space runs one blank,
trimmed; blocks in page order, joined by an empty line.

Cases: null or empty html gives ''; markup that isn't closed is closed as browsers do; a page
without host is of the host ''; pages that repeat a page_id, or have none, are each extracted; pages with equal
subtrees count once each; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import BROADCAST_ROWS, bounded, written

MANY, SHARE, MOST = 5, 0.05, 0.5
#: Elements of HTML by what they do to text and to open elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr table tbody thead tfoot caption figcaption figure ol dl".split())
BLOCK = PROSE | frozenset("html body head div section article main aside nav header footer form fieldset address details summary ul hr dialog menu template search hgroup center legend".split())
DROPPED = frozenset("script style noscript template nav footer aside form button select option textarea iframe svg canvas object embed menu dialog head title audio video map input label fieldset".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body head li dt dd".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main body td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Classes, ids and roles that mark boilerplate as a whole. Fixed values.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements adbox adslot ad-slot ad-container ad-banner sponsor sponsored promo promotion banner nav navbar nav-bar main-nav site-nav navigation menu main-menu site-menu breadcrumb breadcrumbs pagination pager header masthead site-header page-header-bar footer site-footer sidebar side-bar rail widget widgets cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice notices alert popup modal overlay newsletter newsletter-signup subscribe subscription signup sign-up login share sharing share-buttons social social-share social-links follow related related-posts related-articles recommended comment comments comment-list comment-section comments-section comments-area reader-comments user-comments post-comments respond disqus disqus_thread reply replies complementary contentinfo search searchbox search-form toolbar skip skip-link".split()
)
#: Of these, marks of comments; and words that mark boilerplate as parts of a name, unless it begins with a denial. Fixed values.
COMMENTS = frozenset("comment comments comment-list comment-section comments-section comments-area reader-comments user-comments post-comments respond disqus disqus_thread reply replies".split())
PARTS = frozenset("ad ads advert adverts advertisement adbox adslot sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar cookie cookies consent gdpr popup modal newsletter subscribe signup share sharing social related comment comments disqus".split())
DENIALS = frozenset("has with without no not is js".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ROLE = re.compile(r"(?i)\brole\s*=\s*[\"']?main\b")
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: A URL's host; the same pattern for Spark and Python.
HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
_HOST = re.compile(HOST)


class Node:
    __slots__ = ("tag", "attrs", "parts", "parent", "hash")

    def __init__(self, tag: str, attrs: str, parent: Node | None) -> None:
        self.tag, self.attrs, self.parts, self.parent, self.hash = tag, attrs, [], parent, 0


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def parse(html: str) -> Node:
    """The tree of a page. ``parts`` of a node are its texts and child nodes in order."""
    root = at = Node("", "", None)
    pos, end = 0, len(html)
    while pos < end:
        found = TOKEN.search(html, pos)
        if not found:
            at.parts.append(html[pos:])
            break
        if found.start() > pos:
            at.parts.append(html[pos : found.start()])
        pos = found.end()
        tag = found[2] or found[4]
        if tag:
            tag, attrs = tag.lower(), found[3] if found[2] else found[5]
            at = _closed(at, tag)
            node = Node(tag, attrs, at)
            at.parts.append(node)
            if tag in RAW:
                close = re.compile(rf"(?i)</{tag}\b[^>]*>").search(html, pos)
                node.parts.append(html[pos : close.start() if close else end])
                pos = close.end() if close else end
            elif tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
                at = node
        elif found[1]:
            tag, node = found[1].lower(), at
            while node is not root and node.tag != tag and not (tag not in BLOCK and node.tag in BLOCK):
                node = node.parent
            if node is not root and node.tag == tag:
                at = node.parent
    return root


def _closed(at: Node, tag: str) -> Node:
    """Where a new ``tag`` goes: elements that it closes are left."""
    ends = SAME.get(tag, frozenset())
    if tag in CLOSES_P:
        ends = ends | {"p"}
    if tag in HEADINGS:
        ends = ends | HEADINGS
    node, to = at, at
    while node.parent is not None and ends:
        if node.tag in ends:
            to = node.parent
            if node.tag != "td" and node.tag != "th":
                break
        elif node.tag in SCOPE:
            break
        node = node.parent
    return to


def _hash(tag: str, body: bytes) -> int:
    return int.from_bytes(blake2b(tag.encode() + b"\0" + body, digest_size=8).digest(), "little", signed=True)


def hashed(root: Node) -> list[Node]:
    """Hashes all subtrees, without recursion, and returns the nodes in page order."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    for node in reversed(nodes):
        body = b"".join(p.hash.to_bytes(8, "little", signed=True) if isinstance(p, Node) else " ".join(p.split()).encode("utf-8", "replace") + b"\1" for p in node.parts)
        node.hash = _hash(node.tag, body)
    return nodes


def site_key(site: str, value: int) -> int:
    """A subtree's hash on its host."""
    return _hash(site, value.to_bytes(8, "little", signed=True))


def candidates(url: str | None, html: str | None) -> list[int]:
    """The distinct keys of a page's block subtrees that hold any text or element."""
    site = host(url)
    return sorted({site_key(site, n.hash) for n in hashed(parse(html or ""))[1:] if n.tag in BLOCK and n.tag not in ("html", "body", "head") and n.parts})


def _names(node: Node) -> list[str]:
    """The lower-case words of a node's class, id and role."""
    return [w for name, value in ATTRIBUTE.findall(node.attrs) if name.lower() in ("class", "id", "role") for w in value.strip("\"'").lower().split()] if node.attrs else []


def _boilerplate(node: Node, inside: bool) -> bool:
    """Whether a node is boilerplate by itself; ``inside`` an article or main element a header is content."""
    if node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    if not node.attrs or node.tag in ("html", "body", "main"):
        return False
    for name, value in ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return not (node.tag == "header" and inside) and not MARKS.isdisjoint(_names(node))


def _partly_marked(node: Node) -> bool:
    """Whether a part of a container's name marks boilerplate."""
    if node.tag not in BLOCK or node.tag in PROSE or node.tag in ("html", "body", "main", "article"):
        return False
    names = [re.split("[-_]+", w) for w in _names(node)]
    return any(not PARTS.isdisjoint(w) and DENIALS.isdisjoint(w) for w in names)


def _sizes(root: Node) -> dict[Node, int]:
    """The characters of text, white space aside, below each node; what its element drops isn't text."""
    order, stack, out = [], [root], {}
    while stack:
        node = stack.pop()
        if node.tag not in DROPPED:
            order.append(node)
            stack.extend(p for p in node.parts if isinstance(p, Node))
    for node in reversed(order):
        out[node] = sum(out.get(p, 0) if isinstance(p, Node) else sum(map(len, p.split())) for p in node.parts)
    return out


def extract(url: str | None, html: str | None, template: frozenset | set, prose_too: frozenset | set = frozenset()) -> str:
    """The main text of a page, given the keys of its host's template subtrees, and of those that most of its pages have."""
    root = parse(html or "")
    if template:
        hashed(root)
    found = _regions(root)
    text = _text(url, root, [(node, within) for node, mark, within in found if not mark], template, prose_too)
    marked = [(node, within) for node, mark, within in found if mark == 1]
    return text if text or not marked else _text(url, root, marked, template, prose_too)


def _text(url: str | None, root: Node, chosen: list[tuple[Node, bool]], template: frozenset | set, prose_too: frozenset | set) -> str:
    """The text of a page's chosen articles and main elements (with whether another one holds them), or of all of it."""
    regions = [node for node, within in chosen if not within] or [root]
    holders: set[Node] = set()
    for node, _ in chosen:
        up = node.parent
        while up is not None and up not in holders:
            holders.add(up)
            up = up.parent
    site, blocks, line = host(url), [], []
    sizes: dict[Node, int] = {}

    def size(node: Node) -> int:
        if not sizes:
            sizes.update(_sizes(root))
        return sizes.get(node, 0)

    def frequent(node: Node, keys: frozenset | set) -> bool:
        return bool(node.parts) and site_key(site, node.hash) in keys

    def common_prose() -> bool:
        """Whether the prose that most pages have is less than half of the regions' text, so that it can go."""
        if not prose_too or all(r is root for r in regions):
            return False
        gone, stack = 0, list(regions)
        while stack:
            node = stack.pop()
            if node.tag in PROSE and frequent(node, prose_too):
                gone += size(node)
            else:
                stack.extend(p for p in node.parts if isinstance(p, Node) and p.tag not in DROPPED)
        return 0 < gone < sum(map(size, regions)) / 2

    def end() -> None:
        text = " ".join(unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    def goes(part: Node, inside: bool, prose: bool) -> bool:
        if part in holders or part in regions:
            return False
        if _boilerplate(part, inside):
            return True
        if template and part.tag in BLOCK and part.tag not in ("html", "body"):
            if frequent(part, (prose_too if thin else frozenset()) if prose and part.tag in PROSE else template):
                return True
        return not prose and _partly_marked(part) and 2 * size(part) < size(root)

    thin = common_prose()
    # a part, whether it is inside an article or main element, and whether its prose is content though some pages repeat it
    stack: list = [(r, r is not root, r.tag == "article" or r is not root and r not in holders) for r in reversed(regions)]
    while stack:
        part, inside, prose = stack.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            line.append(part)
        elif part.tag == "br":
            line.append(" ")
        elif goes(part, inside, prose):
            if part.tag in BLOCK:
                end()
            else:
                line.append(" ")
        else:
            block = part.tag in BLOCK
            if block:
                end()
                stack.append((None, inside, prose))
            prose = prose or part.tag == "article"
            stack.extend((p, inside or part.tag == "article", prose) for p in reversed(part.parts))
    end()
    return "\n\n".join(blocks)


def _regions(root: Node) -> list[tuple[Node, int, bool]]:
    """The articles and main elements in page order, but for articles in articles: each with 0, or 1 if it has or is inside
    a mark of boilerplate, 2 if that of a comment; and whether another one holds it. Those in menus, asides and the like are left
    out."""
    found, stack = [], [(root, 0, False)]
    while stack:
        node, mark, within = stack.pop()
        if node.tag in DROPPED:
            continue
        article = node.tag == "article"
        if node is not root and _boilerplate(node, True):
            mark = max(mark, 1 if COMMENTS.isdisjoint(_names(node)) else 2)
        if article or node.tag == "main" or ROLE.search(node.attrs):
            found.append((node, mark, within))
            within = True
        if not article:
            stack.extend((p, mark, within) for p in reversed(node.parts) if isinstance(p, Node))
    return found


def keyed(pages: DataFrame) -> DataFrame:
    """site (the host) and keys of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"site": [host(u) for u in b["url"]], "keys": [candidates(u, h) for u, h in zip(b["url"], b["html"])]})

    return bounded(pages).select("url", "html").mapInPandas(run, "site string, keys array<long>")


def templates(found: DataFrame, many: int = MANY, share: float = SHARE, most: float = MOST) -> DataFrame:
    """site, key, prose of each subtree that is template on its host; ``prose``: even as prose, as most pages have it. A host has
    at most 1 / ``share`` times as many as one of its pages has subtrees on average."""
    counts = found.select("site", F.explode("keys").alias("key")).groupBy("site", "key").agg(F.count("*").alias("n")).where(F.col("n") >= many)
    hosts = found.groupBy("site").agg(F.count("*").alias("pages"))
    return counts.join(hosts, "site").where(F.col("n") >= F.col("pages") * share).select("site", "key", (F.col("n") >= F.col("pages") * most).alias("prose"))


def main_text(pages: DataFrame, many: int = MANY, share: float = SHARE, most: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    The template keys, 8 bytes each, go to all executors if there are at most ``most``; else each
    page gets its host's by a join, in which a hot host is one row on the other side.
    """
    found = written(keyed(pages))
    keys = written(templates(found, many, share))
    n = keys.count()
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    rows = pages.select("page_id", "url", "html")
    if n <= most:
        held = keys.select("key", "prose").collect()
        few = pages.sparkSession.sparkContext.broadcast(tuple(np.array([r.key for r in held if r.prose or not only], np.int64) for only in (False, True)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            template, prose = (frozenset(x.tolist()) for x in few.value)
            for b in batches:
                yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [extract(u, h, template, prose) for u, h in zip(b["url"], b["html"])]})

    else:
        own = keys.groupBy(F.col("site").alias("of")).agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("prose"), F.col("key"))).alias("most"))
        site = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
        rows = rows.join(own, site == F.col("of"), "left").drop("of")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                sets = [tuple(frozenset() if k is None else frozenset(k) for k in ks) for ks in zip(b["keys"], b["most"])]
                text = [extract(u, h, *k) for u, h, k in zip(b["url"], b["html"], sets)]
                yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text})

    out = rows.mapInPandas(run, schema)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
