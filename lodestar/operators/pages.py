"""Pages: main text, whole text, links, verdicts. Parsing runs in Arrow batches on the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import web
from lodestar.functions.values import boilerplate

#: Elements that never hold main text, and marks of a class or id that say so.
STRIPPED = frozenset(("nav", "header", "footer", "aside", "form", "script", "style", "noscript", "svg", "iframe"))
CHROME = re.compile(
    r"(?i)nav|menu|breadcrumb|sidebar|side-bar|footer|header|cookie|banner|social|share|tag-cloud|tagcloud|most-read|mostread|latest|related|newsletter|signup|sign-up|search|skip|basket|cart|translate|gtranslate"
)
FRAME = frozenset(("nav", "header", "footer", "aside"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
BREAKS = frozenset(("p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "section", "article", "main", "body"))
LEAST, MOST = 400, 90_000
#: What a link worth following holds, what forbids it, and what needs the word volunteer beside it.
HINT = r"(?i)volunteer|volunteering|befriend|mentor|mentoring|host|hosting|trustee|night shelter|shelter volunteer|peer|lived experience|shop|drop-in|outreach|kitchen|role|opportunit"
BLOCKED = r"(?i)donate|donation|fundrais|marathon|sleep ?out|challenge event|cycle|half.?marathon|10k|legacy|gift.?aid|shop online|privacy|cookie|terms|complaint|sitemap|login|basket|/news|blog"
PAID = r"(?i)job|vacanc|career|recruitment"
VOLUNTEER = "(?i)volunteer"
FILES = r"(?i)\.(?:pdf|doc|docx|zip)$"
THIN = 1200


class _Reader(HTMLParser):
    """Text of the whole page, of each candidate container with and without chrome, and the links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, str | None]] = []
        self.whole: list[str] = []
        self.strict: dict[str, list[str]] = {}
        self.loose: dict[str, list[str]] = {}
        self.links: list[list] = []
        self.scripts = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "script":
            self.scripts += 1
        if tag in BREAKS:
            self._add("\n")
        if tag in VOID:
            return
        a = dict(attrs)
        gone, chrome, _ = self._state()
        mark = f"{a.get('class') or ''} {a.get('id') or ''}"
        place = tag if tag in ("main", "article", "body") else "role" if a.get("role") == "main" else None
        self.stack.append((tag, gone or tag in STRIPPED, chrome or (tag not in ("html", "body", "main") and bool(CHROME.search(mark))), place))
        if tag == "a" and a.get("href") and not any(s[0] in FRAME for s in self.stack):
            self.links.append([a["href"], "", len(self.stack)])

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self._add("\n")
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        self._add(data)
        if self.links and any(s[0] == "a" for s in self.stack) and not any(s[0] in FRAME for s in self.stack):
            self.links[-1][1] += f" {data}"

    def _state(self) -> tuple[bool, bool, str]:
        return (self.stack[-1][1], self.stack[-1][2], self.stack[-1][0]) if self.stack else (False, False, "")

    def _add(self, data: str) -> None:
        gone, chrome, tag = self._state()
        if tag in ("script", "style", "noscript"):
            return
        self.whole.append(data)
        if gone:
            return
        for place in {s[3] for s in self.stack if s[3]} | {"page"}:
            self.loose.setdefault(place, []).append(data)
            if not chrome:
                self.strict.setdefault(place, []).append(data)


def tidy(parts: list[str]) -> str:
    """Blanks within lines as one, empty lines dropped, trimmed."""
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def isolated(html: str | None, most: int | None = None) -> tuple[str, str, int, list[tuple[str, str]]]:
    """(main text, whole text, scripts, links) of a page.

    Main text: the first of main, role=main, article, body that has ``LEAST`` characters without
    chrome, else with it, else the longest of all; at most ``most`` characters, if that is given.
    """
    r = _Reader()
    r.feed(html or "")
    r.close()
    found = []
    for parts in (r.strict, r.loose):
        for place in ("main", "role", "article", "body"):
            text = tidy(parts.get(place, []))
            if len(text) >= LEAST:
                return text[:most], tidy(r.whole), r.scripts, [(h, " ".join(t.split())) for h, t, _ in r.links]
            found.append(text)
        found.append(tidy(parts.get("page", [])))
    return max(found, key=len)[:most], tidy(r.whole), r.scripts, [(h, " ".join(t.split())) for h, t, _ in r.links]


def read_pages(pages: DataFrame, key: str = "page_id", most: int | None = None) -> DataFrame:
    """key, url, main, whole, scripts, links (array of struct href, label) of each page; main text is cut
    to ``most`` characters (``MOST`` where a reader has that budget), whole without it."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [isolated(h, most) for h in b["html"]]
            yield pd.DataFrame({key: b[key], "url": b["url"], "main": [r[0] for r in rows], "whole": [r[1] for r in rows], "scripts": [r[2] for r in rows], "links": [[{"href": h, "label": t} for h, t in r[3]] for r in rows]})

    return pages.select(key, "url", "html").mapInPandas(run, f"{key} {kind}, url string, main string, whole string, scripts int, links array<struct<href:string,label:string>>")


def role_links(links: DataFrame, key: str, most: int = 15) -> DataFrame:
    """key, target, strong, place: the links (key, url, href, label, pos) worth following.

    Same site, a label of 1 to 90 characters, no documents, none of the blocked words, paid work only where
    volunteers are named; below the page, or with a hint in link or label. Strong are those below the page
    and those whose link names volunteers; they come first, then page order; one a target, its first
    occurrence; at most ``most``.
    """
    path = lambda u: F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    label = F.trim(F.regexp_replace("label", r"\s+", " "))
    # The full link, its path and its page's path are made once, by way of a list of one: written out in each condition that asks
    # for them they would make more code than Spark compiles.
    parts = F.struct(web.absolute(F.col("url"), F.col("href")).alias("full"), label.alias("label"), path(F.col("url")).alias("base"))
    df = links.select(key, "url", "pos", F.explode(F.array(parts)).alias("p")).select(key, "url", "pos", "p.*")
    df = df.select("*", F.explode(F.array(path(F.col("full")))).alias("path")).withColumn("target", F.rtrim("full", F.lit("/")))
    df = df.where(F.length("label").between(1, 90) & F.col("full").rlike("(?i)^https?://") & ~F.col("path").rlike(FILES) & web.same_site(F.col("url"), F.col("full")) & (F.col("target") != F.rtrim("url", F.lit("/"))))
    both, base = F.concat_ws(" ", "label", "full"), F.rtrim("base", F.lit("/"))
    under = (base != "") & F.col("path").startswith(F.concat(base, F.lit("/")))
    df = df.where(~both.rlike(BLOCKED) & (~both.rlike(PAID) | both.rlike(VOLUNTEER)) & (under | both.rlike(HINT)))
    first = df.groupBy(key, "target").agg(F.min_by(under | F.col("full").rlike(VOLUNTEER), "pos").alias("strong"), F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("strong"), "pos", "target"))
    return first.withColumn("place", place).where(F.col("place") <= most).select(key, "target", "strong", "place")


def verdict(status: Column, refused: Column, shell: Column, redirected: Column, length: Column, n_links: Column) -> Column:
    """A census verdict. blocked where robots are refused; dead for a status of 400 or more or none at all; a main
    text under ``LEAST`` characters is a script's shell or thin, whatever its links; then redirected; thin is also a
    short page without links to roles; else clean."""
    return (
        F.when(refused, "blocked")
        .when(status.isNull() | (status >= 400), "dead")
        .when(length < LEAST, F.when(shell, "client_rendered").otherwise("thin"))
        .when(redirected, "redirected")
        .when((length < THIN) & (n_links == 0), "thin")
        .otherwise("clean")
    )


def share_of_chrome(df: DataFrame) -> DataFrame:
    return df.withColumn("boilerplate", boilerplate(F.length("main"), F.length("whole")))
