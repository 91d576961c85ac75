"""Column expressions over dates, numbers, arrays and states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FRESH_DAYS = 21
BANNER_DAYS = 60


def age_days(then: Column, now: Column) -> Column:
    """Whole days of 24 hours gone by, never below 0; null for null."""
    return F.when(then.isNotNull(), F.greatest(F.lit(0).cast("long"), F.timestamp_diff("DAY", then, now)))


def moment(text: Column) -> Column:
    """An ISO time as a timestamp; null where it can't be read."""
    return F.try_to_timestamp(text)


def freshness(age: Column, stale: int = FRESH_DAYS) -> Column:
    """never_checked, stale or fresh."""
    return F.when(age.isNull(), "never_checked").when(age >= stale, "stale").otherwise("fresh")


def suppressed(state: Column, link: Column) -> Column:
    """Whether a source's claims aren't shown: never checked, stale, or its link is dead or bare."""
    return (state != "fresh") | F.coalesce(link.isin("dead", "link_only"), F.lit(False))


def masked(value: Column, hide: Column, instead: Column) -> Column:
    return F.when(hide, instead).otherwise(value)


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the upper of two; null for none."""
    s = F.array_compact(F.sort_array(values))
    return F.when(F.size(s) > 0, F.get(s, (F.size(s) / 2).cast("int")))


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole, half to even; null where whole is 0."""
    return F.bround(F.try_divide(part.cast("double"), whole), digits)


def boilerplate(main_length: Column, full_length: Column) -> Column:
    """The part of a page that isn't its main text."""
    return F.bround(1 - F.try_divide(main_length.cast("double"), full_length), 3)


def confidence(ok: Column, bad: Column, failed: Column) -> Column:
    """The part of checked fields that were confirmed; 1 where none was, 0 after a failed check."""
    return F.when(failed, 0.0).otherwise(F.coalesce(ratio(ok, ok + bad), F.lit(1.0)))


def in_season(start: Column, end: Column, month: Column) -> Column:
    """Whether a month lies in a window of months, which may pass the year's end."""
    return F.when(start <= end, month.between(start, end)).otherwise((month >= start) | (month <= end))


def status_today(status: Column, start: Column, end: Column, today: Column) -> Column:
    """The status that still holds on a day: "closed for the season" says nothing once the season that
    it names has begun, so it is unknown inside its window."""
    inside = F.coalesce(in_season(start, end, F.month(today)), F.lit(False))
    return F.when((status == "seasonal_closed") & inside, "unknown").otherwise(status)


def share_bucket(n: Column, most: Column, buckets: int = 3) -> Column:
    """0 for 0, else 1 to ``buckets`` by the share of the largest."""
    return F.least(F.lit(buckets), F.ceil(n / most * buckets)).cast("int")


def human_date(day: Column) -> Column:
    return F.date_format(day, "EEEE, d MMMM yyyy")


def minutes(seconds: Column) -> Column:
    """Whole minutes, half to even."""
    return F.bround(seconds / 60).cast("int")


def asserted(value: Column, default: str | None = None) -> Column:
    """Whether a text value claims anything: not null, empty, unknown, or the ``default`` that a page
    never spells out (``individual`` for who can apply)."""
    claims = value.isNotNull() & ~value.isin("", "unknown")
    return claims & (value != default) if default else claims


def asserted_list(values: Column) -> Column:
    return values.isNotNull() & (F.size(values) > 0)


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same items as often; null is like an empty array."""
    none = lambda x: F.coalesce(F.array_sort(x), F.array().cast("array<string>"))
    return none(a) == none(b)


def severity(levels: list[str], *found: Column) -> Column:
    """The worst of some levels, by their order in ``levels``."""
    names = F.array(*map(F.lit, levels))
    places = [F.coalesce(F.array_position(names, c), F.lit(0)) for c in found]
    return F.try_element_at(names, reduce(F.greatest, places[1:], places[0]).cast("int")) if len(places) == 1 else F.try_element_at(names, F.greatest(*places).cast("int"))


def joined_reasons(items: Column, most: int) -> Column:
    """Distinct items in order, joined, cut to ``most`` characters with an ellipsis."""
    text = F.array_join(F.array_distinct(items), "; ")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))
