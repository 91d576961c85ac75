"""Column expressions over text: words, shingles, slugs, keys, quotes."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words of a lower-cased text for verbatim comparison.
WORD = "[a-z0-9']+"


def words(text: Column) -> Column:
    """The words of a text, lower case; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def shingles(tokens: Column, n: int | Column) -> Column:
    """The distinct n-word shingles of an array of words, empty when there are fewer than n.

    ``tokens`` should be a column of its own: an expression would be computed anew for each shingle.
    """
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def longest_free_run(candidate: Column, source: Column, n: int = 8) -> Column:
    """The least n-word run of ``candidate`` (an array of words) that ``source`` (one too) also has.

    Null where there is none, and for a candidate shorter than n.
    """
    shared = F.array_intersect(shingles(candidate, n), shingles(source, n))
    return F.when(F.size(candidate) >= n, F.array_min(shared))


def squeezed(text: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_lines(text: Column) -> Column:
    """Blank runs within lines as one blank, three or more line ends as two, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def quote_supported(quote: Column, source: Column, least: int = 8) -> Column:
    """Whether a quote of at least ``least`` characters stands in the source, white space aside.

    A quote that holds a page header of a multi-page source doesn't count.
    """
    q = squeezed(quote)
    return F.coalesce((F.length(q) >= least) & ~q.contains("## Page:") & squeezed(source).contains(q), F.lit(False))


def quote_backs_number(quote: Column, value: Column) -> Column:
    """Whether a quote holds a number on its own, not as part of a longer one."""
    return F.coalesce(F.array_contains(F.regexp_extract_all(quote, F.lit(r"\d+"), F.lit(0)), value.cast("string")), F.lit(False))


#: What a quotation must hold to back a check, and words that back nothing.
CHECK_WORDS = {
    "enhanced": ("enhanced",),
    "basic": ("basic",),
    "none": ("dbs", "criminal record", "background check", "disclosure"),
    "required_unspecified": ("dbs", "criminal record", "background check", "disclosure"),
}
STOP = ("with", "your", "from", "that", "this", "their", "they", "will", "have", "volunteer", "volunteers", "volunteering", "role", "help", "people", "about")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def quote_backs_check(quote: Column, value: Column) -> Column:
    """Whether a quote holds a word of the check that it is to back."""
    out = F
    for name, found in CHECK_WORDS.items():
        out = out.when(value == name, F.lower(quote).rlike("|".join(found)))
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def quote_backs_season(quote: Column, start: Column, end: Column) -> Column:
    """Whether a quote names both months of a season, in full or by three letters."""
    short = F.array(*(F.lit(m[:3]) for m in MONTHS))
    names = lambda m: F.lower(quote).contains(F.get(short, m - 1))
    return F.coalesce(names(start) & names(end), F.lit(False))


def quote_backs_words(quote: Column, value: Column, stop: tuple[str, ...] = STOP, least: int = 4) -> Column:
    """Whether a quote holds a word of at least ``least`` letters of a value, but a stop word."""
    long = F.array_except(F.regexp_extract_all(F.lower(value), F.lit(f"[a-z]{{{least},}}"), F.lit(0)), F.array(*map(F.lit, stop)))
    return F.coalesce(F.exists(long, lambda w: F.lower(quote).contains(w)), F.lit(False))


def place_key(name: Column) -> Column:
    """A place's name for comparison: lower case, & as and, straight apostrophe, no outer marks."""
    x = F.regexp_replace(F.replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), F.lit("’"), F.lit("'")), r"\s+", " ")
    return F.regexp_replace(x, r"^[ ,.;:]+|[ ,.;:]+$", "")


def capitals(text: Column) -> Column:
    """Upper case letter by letter: a letter whose capital isn't a single one (ß) stays, so lower case leads back to it."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def place_canon(name: Column) -> Column:
    """A place's key without a leading article."""
    return F.regexp_replace(place_key(name), r"^the ", "")


def slug(text: Column, most: int | None = None) -> Column:
    """Lower-case letters and digits with single hyphens between; at most ``most`` characters."""
    out = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.rtrim(F.substring(out, 1, most), F.lit("-")) if most else out


def name_slug(text: Column) -> Column:
    """A slug that keeps possessives together and spells out &."""
    return slug(F.replace(F.replace(F.lower(text), F.lit("'"), F.lit("")), F.lit("&"), F.lit(" and ")))


def title_key(title: Column) -> Column:
    """A title's key: parts in round brackets dropped, letters and digits only, single blanks."""
    x = F.regexp_replace(F.replace(F.lower(unescaped(title)), F.lit("\u2019"), F.lit("'")), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def unescaped(text: Column) -> Column:
    """Character references decoded; texts without & never leave the JVM's hands changed."""
    return F.when(text.contains("&"), _unescape(text)).otherwise(text)


def labelled_line(text: Column, label: str) -> Column:
    """The value of the first line ``label: value``; null where there is none."""
    found = F.regexp_extract(text, rf"(?mi)^\s*{label}\s*:[ \t]*(.+?)\s*$", 1)
    return F.when(found != "", found)


def match_class(needle: Column, term: Column) -> Column:
    """How a term matches what was typed: 0 begins with it, 1 holds it, 2 holds its letters in
    order, null not at all. Case is ignored."""
    q, t = F.lower(needle), F.lower(term)
    pattern = F.array_join(F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), ".*")
    return F.when(t.startswith(q), 0).when(t.contains(q), 1).when(F.rlike(t, F.concat(F.lit("(?s)"), pattern)), 2)


def redacted(text: Column, most: int = 200) -> Column:
    """Secrets of 24 or more token characters masked, then at most ``most`` characters."""
    return F.substring(F.regexp_replace(text, r"[A-Za-z0-9_-]{24,}", "[redacted]"), 1, most)


def markdown_safe(text: Column) -> Column:
    """Markdown's marks escaped."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+!|<>])", r"\\$1")


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The category of the first rule (pattern, category) whose pattern the lower-case text holds."""
    out = F
    low = F.lower(text)
    for pattern, category in rules:
        out = out.when(low.rlike(pattern), F.lit(category))
    return out.otherwise(F.lit(default))


def schedule(text: Column, christmas: Column) -> Column:
    """struct<commitment, times> that a board's timing text states; unknown and flexible unless it says.
    One shift is a one-off only in the Christmas season; a day of the week means weekly."""
    low = F.coalesce(F.lower(text), F.lit(""))
    week, end = low.rlike(r"\b(?:mon|tues|wednes|thurs|fri)days?\b"), low.rlike(r"\b(?:satur|sun)days?\b")
    commitment = (
        F.when(low.rlike(r"\b(?:1|one) (?:complete |full )?shift\b") & F.coalesce(christmas, F.lit(False)), "one_off")
        .when(low.rlike(r"\b(?:per|a|every|each) week\b|\bweekly\b") | week | end, "weekly")
        .when(low.rlike(r"\b(?:per|a|every|each) month\b|\bmonthly\b"), "monthly")
        .otherwise("unknown")
    )
    times = F.array_compact(F.array(F.when(week, F.lit("weekday_daytime")), F.when(end, F.lit("weekend_daytime"))))
    return F.struct(commitment.alias("commitment"), F.when(F.size(times) > 0, times).otherwise(F.array(F.lit("flexible"))).alias("times"))


#: Words of a title and the activity that they stand for, first rule first.
ACTIVITIES = [
    ("shop|retail|e-commerce|warehouse|picker|collections", "shop_warehouse"),
    ("chef|kitchen|cook|catering", "cooking_serving"),
    ("advice|caseworker|mental health", "advice"),
    ("driver|delivery|minibus|handyperson", "practical"),
    ("digital|it support|av support|coordinator|operations|quartermaster|admin|office", "admin"),
    ("welcome|reception|wellbeing|guest welfare|night owl|hotel assistant|befriend", "befriending"),
    ("fundrais|partner events|event", "fundraising"),
]
#: Words of a disclosure label and the check that they state, first rule first.
CHECKS = [
    (r"\bnone\b|\bno\b|\bn/?a\b|not (?:needed|required)|nothing", "none"),
    (r"\benhanced\b", "enhanced"),
    (r"\bbasic\b", "basic"),
    (r"\bdbs\b|disclosure|criminal record|background check", "required_unspecified"),
]


def activity_of(title: Column) -> Column:
    """The activity that a title names, else varies."""
    return first_rule(title, ACTIVITIES, "varies")


def check_of(label: Column) -> Column:
    """The check that a label states, else unknown."""
    return first_rule(F.coalesce(label, F.lit("")), CHECKS, "unknown")


def marker(text: Column, name: str) -> Column:
    """The value of ``name=value`` inside an HTML comment; null where there is none."""
    found = F.regexp_extract(text, rf"<!--[^>]*\b{name}=([^\s>]+)[^>]*-->", 1)
    return F.when(found != "", found)


def serial(items: Column, word: str = "and") -> Column:
    """Items as words: 'a', 'a and b', 'a, b and c'; null items are left out."""
    x = F.array_compact(items)
    n = F.size(x)
    return F.when(n <= 1, F.array_join(x, "")).otherwise(F.concat_ws(f" {word} ", F.array_join(F.slice(x, 1, n - 1), ", "), F.element_at(x, -1)))


def role_text(sections: Column, link: Column, title: Column) -> Column:
    """The sections (array of struct url, text) that belong to a role: the first, those at its link
    and those that name its title; all where only the first would be left."""
    bare = lambda u: F.rtrim(F.regexp_replace(u, "#.*$", ""), F.lit("/"))
    own = F.filter(sections, lambda s, i: (i == 0) | F.coalesce((bare(link) != "") & (bare(s["url"]) == bare(link)), F.lit(False)) | F.coalesce((title != "") & F.lower(s["text"]).contains(F.lower(title)), F.lit(False)))
    return F.when(F.size(own) > 1, own).otherwise(sections)


def place_near_title(text: Column, title: Column, place: Column, span: int = 600) -> Column:
    """Whether a page names a place within ``span`` characters after the end of any occurrence of a title, or in the title
    itself; anywhere on the page where the title doesn't occur. All three compare as place keys. Occurrences of a title are
    counted without overlaps, from the left; a place counts only as a whole within the window."""
    page, head, want = place_key(text), place_key(F.coalesce(title, F.lit(""))), place_key(place)
    n = F.length(head)
    pieces = F.split(page, F.concat(F.lit(r"\Q"), F.replace(head, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    # Where each occurrence begins: the lengths of all pieces before it, and of the titles between them.
    sizes = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.length(p))
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("next"))
    starts = F.aggregate(sizes, start, lambda a, s: F.struct(F.array_append(a["at"], a["next"] + s).alias("at"), (a["next"] + s + n).alias("next")), lambda a: a["at"])
    near = F.exists(starts, lambda s: F.substring(page, s + 1, n + span).contains(want))
    found = page.contains(want) & (want != "")
    return F.coalesce(F.when(found & (n > 0) & page.contains(head), near).otherwise(found), F.lit(False))


def places_stand(text: Column, title: Column, places: Column, span: int = 600) -> Column:
    """The places that a role states, white space made single, if the page names every one near its title; else none, as
    a part of them could make the role look as if it were elsewhere."""
    held = F.coalesce(places, F.array().cast("array<string>"))
    all_ = F.forall(held, lambda p: place_near_title(text, title, p, span))
    return F.when(all_, F.transform(held, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))).otherwise(F.array().cast("array<string>"))
