"""Python data sources for paged JSON APIs; ``listings`` reads platforms that only have pages.

``register(spark)`` makes the formats known; a reader's partition is a board, and a board that is
malformed or doesn't end fails its task: a partial listing would look like vanished roles. Pages come from a
folder (``<board>/<page>.json``), which stands for the API where there is no network, or by
HTTP from ``url``; filters that the server can apply are sent with the request.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

MOST_PAGES = 20
OFFER = "board string, id string, title string, url string, status string, raw string"


class Partial(ValueError):
    """A listing that can't be trusted to be whole."""


def getter(options: dict) -> Callable[[str, int], str]:
    """Reads one page of a board, from the folder or from the server."""
    folder, url = options.get("path"), options.get("url")
    pushed = {k[7:]: v for k, v in options.items() if k.startswith("filter.")}

    def read(board: str, page: int) -> str:
        if folder:
            name = os.path.join(folder, board, f"{page}.json")
            with open(name, encoding="utf-8") as file:
                return file.read()
        query = urllib.parse.urlencode({**pushed, "page": page})
        with urllib.request.urlopen(f"{url}/{board}?{query}", timeout=20) as answer:
            return answer.read().decode("utf-8")

    return read


def _items(page: dict, key: str) -> list[dict]:
    items = page.get(key) if isinstance(page, dict) else None
    if not isinstance(items, list):
        raise Partial(f"a page has no list {key!r}")
    return items


def by_next_link(read: Callable[[int], str], key: str = "data") -> Iterator[dict]:
    """Pages that name the next one, until there is none."""
    for page in range(1, MOST_PAGES + 1):
        body = json.loads(read(page))
        yield from _items(body, key)
        if not body.get("next_page_url"):
            return
    raise Partial(f"more than {MOST_PAGES} pages")


def by_total(read: Callable[[int], str], key: str = "data") -> Iterator[dict]:
    """Pages that say how many there are."""
    page, total = 1, 1
    while page <= total:
        body = json.loads(read(page))
        yield from _items(body, key)
        try:
            total = int(body["meta"]["pagination"]["total_pages"])
        except (KeyError, TypeError, ValueError):
            raise Partial("a page has no total") from None
        if total > MOST_PAGES:
            raise Partial(f"more than {MOST_PAGES} pages")
        page += 1


def by_short_page(read: Callable[[int], str], size: int = 100) -> Iterator[dict]:
    """Plain lists until one is short; items that aren't published are left out."""
    for page in range(1, MOST_PAGES + 1):
        items = json.loads(read(page))
        if not isinstance(items, list):
            raise Partial("a page isn't a list")
        yield from (i for i in items if i.get("status", "publish") == "publish")
        if len(items) < size:
            return
    raise Partial(f"more than {MOST_PAGES} pages")


DIALECTS = {"next": by_next_link, "total": by_total, "short": by_short_page}


class _Board(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Boards that a query doesn't ask for aren't read; a status that it asks for is sent to the server as well. Spark
        still applies all other filters, and the status again, as a server may not know it."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column == "board":
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.options["boards"] = ",".join(b for b in self.options["boards"].split(",") if b in asked)
                continue
            if column == "status" and isinstance(f, EqualTo):
                self.options.setdefault("filter.status", str(f.value))
            yield f

    def partitions(self) -> list[_Board]:
        """One for each board; a single empty one where none is left."""
        return [_Board(b) for b in self.options["boards"].split(",")]

    def read(self, partition: _Board) -> Iterator[tuple]:
        if not partition.name:
            return
        get = getter(self.options)
        read = lambda page: get(partition.name, page)
        for i in DIALECTS[self.options.get("dialect", "next")](read):
            text = lambda k, i=i: None if i.get(k) is None else str(i[k])
            yield partition.name, text("id"), text("title"), text("url"), text("status"), json.dumps(i, sort_keys=True)


class Offers(DataSource):
    """``spark.read.format("offers")`` with the options boards, dialect, and path or url."""

    @classmethod
    def name(cls) -> str:
        return "offers"

    def schema(self) -> str:
        return OFFER

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark push filters down to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Offers)


def public(offers, closed: tuple[str, ...] = ("archived", "deleted", "draft", "private")):  # noqa: ANN001, ANN201
    """Offers that the public may see."""
    from pyspark.sql import functions as F

    return offers.where(~F.coalesce(F.lower("status"), F.lit("public")).isin(*closed))
