"""Listings read from the pages of platforms that have no feed: cards of a role search, and a search whose results have pages
of their own. Pages are rows; what can't be read as a whole is refused as a whole, with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import unescaped

#: What shows that a page is the search, how its cards begin, and what a card states.
CARDS_PAGE = "Find Volunteer Roles"
CARD = '<div class="card shadow-0'
CARD_TITLE, CARD_ORGANISATION, CARD_LINK = r"(?s)<h5[^>]*>(.*?)</h5>", r"(?s)Organisation\s*:\s*([^<]+)", r'href="((?:https://[^"/]+)?/role/[^"]+)"'
#: The same for the search with detail pages, where a link names a result by its number.
SEARCH_PAGE = "Search Volunteer Opportunities"
RESULT = r'(?s)<a\s+href="(/PublicEnterprise/EnterpriseGvi\?[^"]*)"[^>]*>(.*?)</a>'
NUMBER = r"gviGuid=([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})"
META = r'(?is)<meta\s+[^>]*property="og:%s"[^>]*content="([^"]*)"'
MOST_PAGES, MOST_RESULTS = 20, 200


def plain(markup: Column) -> Column:
    """Text without tags, references decoded, white space single; null if nothing is left."""
    text = F.trim(F.regexp_replace(unescaped(F.regexp_replace(markup, "<[^>]+>", "")), r"\s+", " "))
    return F.when(text != "", text)


def _first(text: Column, pattern: str) -> Column:
    """The first group of the first match; null without a match."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def _absolute(base: Column, link: Column) -> Column:
    return F.when(link.startswith("/"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]+)", 1), link)).otherwise(link)


def cards(pages: DataFrame) -> DataFrame:
    """board, page, place, title, organisation, link of the cards of search pages (board, page, base, html), as they are; a card
    may lack any of them."""
    each = pages.select("board", "page", "base", F.posexplode(F.split("html", CARD)).alias("place", "card")).where("place > 0")
    organisation = F.trim(F.regexp_replace(unescaped(_first(F.col("card"), CARD_ORGANISATION)), r"\s+", " "))
    link = unescaped(_first(F.col("card"), CARD_LINK))
    return each.select("board", "page", "place", plain(_first(F.col("card"), CARD_TITLE)).alias("title"), organisation.alias("organisation"), _absolute(F.col("base"), link).alias("link"))


def card_listing(pages: DataFrame, wanted: DataFrame, most: int = MOST_PAGES) -> tuple[DataFrame, DataFrame]:
    """(roles, refused) of card searches: board, title, link of the cards whose organisation is the wanted one (board,
    organisation), case aside; and board, reason of boards that can't be taken. No such card is an answer.

    Refused: a page that isn't the search, a card without a title, organisation or link, a missing page, a last page that
    names another, more than ``most`` pages. Of a refused board no role is returned.
    """
    found = cards(pages)
    last = pages.groupBy("board").agg(F.max("page").alias("last"), F.count("*").alias("n"), F.min(F.when(F.coalesce(~F.col("html").contains(CARDS_PAGE), F.lit(True)), F.col("page"))).alias("odd"))
    more = pages.join(last.select("board", F.col("last").alias("page")), ["board", "page"]).select("board", F.col("html").contains(F.concat(F.lit("page="), (F.col("page") + 1).cast("string"))).alias("more"))
    broken = found.where("title is null or organisation is null or link is null").select("board").distinct().withColumn("broken", F.lit(True))
    all_ = last.join(more, "board").join(broken, "board", "left")
    # A last page without any card ends a listing, whatever it names.
    filled = found.select("board", "page").distinct().join(last.select("board", F.col("last").alias("page")), ["board", "page"]).select("board", F.lit(True).alias("filled"))
    all_ = all_.join(filled, "board", "left")
    goes_on = F.col("more") & F.coalesce("filled", F.lit(False))
    reason = F.when(F.col("odd").isNotNull(), "a page isn't the search").when(F.col("broken"), "a card can't be read").when(F.col("n") != F.col("last"), "pages are missing").when(goes_on & (F.col("last") >= most), f"more than {most} pages").when(goes_on, "a page that the last one names is missing")
    refused = all_.select("board", reason.alias("reason")).where("reason is not null")
    own = found.join(wanted.select("board", F.lower(F.trim("organisation")).alias("_own")), "board").where(F.lower("organisation") == F.col("_own"))
    return own.join(refused, "board", "left_anti").select("board", "title", "link"), refused


def results(searches: DataFrame) -> DataFrame:
    """board, number, listed: the results of search pages (board, html), each number once with its first title."""
    links = searches.select("board", F.posexplode(F.regexp_extract_all("html", F.lit(RESULT), F.lit(0))).alias("place", "a"))
    number = F.lower(F.regexp_extract(unescaped(F.regexp_extract("a", RESULT, 1)), NUMBER, 1))
    each = links.select("board", "place", number.alias("number"), F.regexp_extract("a", RESULT, 2).alias("text")).where("number <> ''")
    first = F.row_number().over(Window.partitionBy("board", "number").orderBy("place"))
    return each.withColumn("_n", first).where("_n = 1").select("board", "number", plain(F.col("text")).alias("listed"))


def search_listing(searches: DataFrame, details: DataFrame, most: int = MOST_RESULTS) -> tuple[DataFrame, DataFrame]:
    """(offers, refused) of searches (board, html) whose results have pages (board, number, html): board, number, title,
    description; and board, reason. A page's own title counts, else that of the list.

    Refused: a page that isn't the search, ``most`` results or more, a result whose page is missing or has no description.
    """
    found = results(searches)
    pages = details.select("board", F.lower("number").alias("number"), unescaped(_first(F.col("html"), META % "title")).alias("own"), unescaped(_first(F.col("html"), META % "description")).alias("description"))
    both = found.join(pages, ["board", "number"], "left")
    by = both.groupBy("board").agg(F.count("*").alias("n"), F.min(F.when(F.col("description").isNull(), F.col("number"))).alias("silent"))
    all_ = searches.select("board", F.coalesce(F.col("html").contains(SEARCH_PAGE), F.lit(False)).alias("search")).join(by, "board", "left")
    reason = F.when(~F.col("search"), "the page isn't the search").when(F.col("n") >= most, "too many results").when(F.col("silent").isNotNull(), F.concat(F.lit("result "), F.substring("silent", 1, 8), F.lit(" has no description")))
    refused = all_.select("board", reason.alias("reason")).where("reason is not null")
    return both.join(refused, "board", "left_anti").select("board", "number", F.coalesce("own", "listed").alias("title"), "description"), refused
