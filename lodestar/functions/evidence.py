"""Rules of evidence: which quotations back a field, and what a field without one becomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields that need a quotation.
FIELDS = ("status", "screening.dbs", "screening.references", "screening.interview", "screening.min_age", "next_intake", "specific_times", "commitment", "seasonal_window", "eligibility", "who_can_apply")
#: What a field without evidence becomes (lists as joined text, so an empty one is empty); null for all others.
FORCED = {"screening.dbs": "unknown", "status": "unknown", "commitment": "unknown", "eligibility": "", "who_can_apply": "individual"}
#: Statuses and applicants that claim something.
CLAIMING = {"status": ("open", "closed", "seasonal_closed", "oversubscribed"), "who_can_apply": ("team_only", "either")}
#: What a quotation must hold for a check, by the check's value, else the last.
CHECKS = {"none": r"\bno\b|none|not (?:need|require)|without", "basic": "basic|dbs|criminal|disclosure", "enhanced": "enhanced", None: "dbs|disclosure|criminal|police|background|checks?"}
LONGEST = 240


def claims(field: str, value: Column) -> Column:
    """Whether a field's value (as text; lists joined) claims anything."""
    if field in CLAIMING:
        return F.coalesce(value.isin(*CLAIMING[field]), F.lit(False))
    if field in ("screening.dbs", "commitment"):
        return F.coalesce(value != "unknown", F.lit(False))
    return value.isNotNull() & (value != "") if field == "eligibility" else value.isNotNull()


def usable(field: str, value: Column, quote: Column, url: Column) -> Column:
    """Whether a quotation of 1 to ``LONGEST`` characters from a web page backs a value."""
    q = F.trim(quote)
    fine = (F.length(q) > 0) & (F.length(q) <= LONGEST) & url.startswith("http")
    low = F.lower(q)
    if field == "screening.min_age":
        fine = fine & q.contains(value.cast("string"))
    elif field == "screening.dbs":
        held = F
        for name, pattern in CHECKS.items():
            held = held.when(value == name, low.rlike(pattern)) if name else held.otherwise(low.rlike(pattern))
        fine = fine & held
    elif field == "screening.references":
        fine = fine & low.contains("refere")
    return F.coalesce(fine, F.lit(False))


def settled(field: str, value: Column, quote: Column, url: Column, published: Column) -> Column:
    """struct<value, verified, cleared> of a field after a manual check: kept with a usable quotation, or where it is
    what was published before; else what it is forced to."""
    said, backed = claims(field, value), usable(field, value, quote, url)
    same = value.eqNullSafe(published) & published.isNotNull()
    cleared = said & ~backed & ~same
    return F.struct(F.when(cleared, F.lit(FORCED.get(field))).otherwise(value).alias("value"), (said & backed).alias("verified"), cleared.alias("cleared"))


def checked_confidence(verified: Column, standing: Column, cleared: Column) -> Column:
    """The verified part of the fields that were checked, half to even at two digits; 0.7 where none was."""
    return F.coalesce(F.bround(F.try_divide(verified.cast("double"), standing + cleared), 2), F.lit(0.7))
