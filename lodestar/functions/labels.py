"""Words for a role's particulars: what is shown of where, how often, when, and what is asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Commitments in words.
FREQUENCY = {"one_off": "One-off", "flexible": "Flexible frequency", "weekly": "Weekly", "fortnightly": "Every fortnight", "monthly": "Monthly", "long_term": "Ongoing commitment", "unknown": "Frequency not stated"}
DOT = " \u00b7 "


def where(location: Column, district: Column, boroughs: Column, label: Column) -> Column:
    """A role's place: its home or remote, else its district before its boroughs or what else is stated."""
    stated = F.coalesce(F.when(F.size(boroughs) > 0, F.array_join(boroughs, ", ")), label, F.lit("Location not stated"))
    placed = F.when(F.coalesce(district, F.lit("")) == "", stated).when(stated == district, district).otherwise(F.concat(district, F.lit(DOT), stated))
    return F.when(location == "own_home", "Your own home").when(location == "remote", "Remote").otherwise(placed)


def frequency(commitment: Column, months: Column, hours: Column) -> Column:
    """How often, for how long at least, and how many hours a shift; 0 is as unknown as null."""
    out = F
    for k, v in FREQUENCY.items():
        out = out.when(commitment == k, v)
    shift = F.regexp_replace(hours.cast("string"), r"\.0$", "")
    return F.concat(out.otherwise(F.lit(FREQUENCY["unknown"])), F.when(months > 0, F.concat(F.lit(f"{DOT}at least "), months.cast("string"), F.lit(" months"))).otherwise(""), F.when(hours > 0, F.concat(F.lit(DOT), shift, F.lit("h per shift"))).otherwise(""))


def timing(times: Column, stale: Column) -> Column:
    """The times that are stated, unless the source is stale."""
    return F.when(stale, "Confirm with charity").when(F.coalesce(times, F.lit("")) != "", times).otherwise("Times not stated")


def requirements(eligibility: Column, age: Column, stale: Column) -> Column:
    """What is asked of a person; an age only from a fresh source."""
    own = F.coalesce(eligibility, F.array().cast("array<string>"))
    return F.when(~stale & (age > 0), F.array_append(own, F.concat(F.lit("Aged "), age.cast("string"), F.lit(" or over")))).otherwise(own)
