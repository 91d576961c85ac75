"""Offers of platform boards as records: what is public, where it is, what it asks, and the record itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T

#: Postcode areas that lie wholly inside the city, and how long a record's parts may be.
AREAS = ("E", "EC", "N", "NW", "SE", "SW", "W", "WC")
TITLE, SUMMARY, TIMES, LIMIT, PLACES, SKILLS = 80, 220, 80, 100, 8, 6
AGES = (13, 80)
OWN_WORDS = " A volunteer role on the charity's own volunteering board."


def _list(value: Column) -> Column:
    return F.coalesce(value, F.array().cast("array<string>"))


def public_items(items: DataFrame) -> DataFrame:
    """Items of a board that shows yes and no (archived, deleted_at, public, publish, can_self_apply): those that one
    person can apply for by themselves."""
    yes = lambda c: F.coalesce(F.col(c) == "Yes", F.lit(False))
    gone = F.coalesce("archived", F.lit(False)) | (F.coalesce("deleted_at", F.lit("")) != "")
    return items.where(~gone & yes("public") & yes("publish") & yes("can_self_apply"))


def public_adverts(items: DataFrame) -> DataFrame:
    """Items of a board of adverts (status, unlisted, advert_target, kind): published, listed, for the public, and
    volunteer roles as far as they say."""
    return items.where((F.col("status") == "Published") & ~F.coalesce("unlisted", F.lit(False)) & (F.col("advert_target") == "public") & (F.col("kind").isNull() | (F.col("kind") == "volunteer")))


def labels(places: Column, venue: Column, address: Column) -> Column:
    """All that an offer says about its place."""
    return F.filter(F.concat(_list(places), F.array(venue, address)), lambda x: x.isNotNull() & (x != ""))


def boroughs_named(said: Column, boroughs: list[str]) -> Column:
    """Boroughs, in their own order, that labels name as words."""
    hay = F.replace(F.lower(F.array_join(said, " ")), F.lit("&"), F.lit(" and "))
    return F.array_compact(F.array(*(F.when(hay.rlike(rf"\b\Q{b.lower()}\E\b"), F.lit(b)) for b in boroughs)))


def in_city(said: Column, named: Column, city: str = "london") -> Column:
    """Whether labels name the city, one of its boroughs, or a postcode of its areas."""
    outward = F.regexp_extract_all(F.upper(F.array_join(said, " ")), F.lit(r"\b([A-Z]{1,2})\d[A-Z\d]?\b(?:\s*\d[A-Z]{2})?\b"), F.lit(1))
    return F.lower(F.array_join(said, " ")).contains(city) | (F.size(named) > 0) | F.arrays_overlap(outward, F.array(*map(F.lit, AREAS)))


def places_of(places: Column, said: Column, named: Column, city: str = "London") -> Column:
    """The places of a record: the city where the board says so, or where only a postcode shows it, and the
    boroughs named; outside of it the first place as it stands."""
    spoken = F.lower(F.array_join(said, " ")).contains(city.lower())
    inside = F.concat(F.when(spoken | (F.size(named) <= 0), F.array(F.lit(city))).otherwise(F.array().cast("array<string>")), named)
    return F.slice(F.when(in_city(said, named, city.lower()), inside).otherwise(F.slice(_list(places), 1, 1)), 1, PLACES)


def described(title: Column, venue: Column, team: Column, kinds: Column) -> Column:
    """A summary of the structured fields alone, never of the board's prose."""
    out = F.concat(title, F.coalesce(F.concat(F.lit(" at "), F.nullif(venue, F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.nullif(team, F.lit("")), F.lit(")")), F.lit("")), F.lit("."))
    out = F.concat(out, F.when(F.size(_list(kinds)) > 0, F.concat(F.lit(" Work areas: "), F.lower(F.array_join(kinds, ", ")), F.lit("."))).otherwise(""))
    return F.substring(F.when(F.length(out) < 15, F.concat(out, F.lit(OWN_WORDS))).otherwise(out), 1, SUMMARY)


def records(offers: DataFrame, boroughs: list[str]) -> DataFrame:
    """A stored record for each offer (org_id, id, title, url, places, venue, address, timing, disclosure, interview,
    age_limit, minimum_age, closes, christmas, kinds, team, virtual, skills, summary), as a projection.

    An unfamiliar label is never turned into a claim: what a board doesn't state clearly is unknown or null.
    """
    c = F.col
    said = labels(c("places"), c("venue"), c("address"))
    df = offers.withColumn("_said", said).withColumn("_named", boroughs_named(F.col("_said"), boroughs))
    when, talk = T.schedule(c("timing"), c("christmas")), F.when(c("interview") == "Yes", True).when(c("interview") == "No", False)
    timed = F.coalesce(c("timing"), F.lit("")) != ""
    own = F.coalesce(c("summary"), F.lit("")) != ""
    verified = F.array_compact(F.array(F.lit("title"), F.lit("stated_places"), F.lit("status"), F.lit("screening.dbs"), F.when(talk.isNotNull(), F.lit("screening.interview")), F.when(timed, F.lit("specific_times"))))
    unsupported = F.array_compact(F.array(F.when(own, F.lit("what_youd_do: model summary of the board's description")).otherwise(F.lit("what_youd_do: built from structured fields")), F.when(c("closes").isNotNull(), F.concat(F.lit("closes "), c("closes")))))
    limit = F.coalesce(c("age_limit"), F.lit(""))
    return df.select(
        F.concat(c("org_id").cast("string"), F.lit("-board-"), c("id").cast("string")).alias("id"),
        "org_id",
        F.substring("title", 1, TITLE).alias("title"),
        F.substring(F.when(own, c("summary")).otherwise(described(c("title"), c("venue"), c("team"), c("kinds"))), 1, SUMMARY).alias("what_youd_do"),
        when["commitment"].alias("commitment"),
        when["times"].alias("when"),
        F.when(timed, F.substring("timing", 1, TIMES)).alias("specific_times"),
        T.activity_of(c("title")).alias("activity"),
        F.when(F.coalesce(c("virtual"), F.lit(False)), "remote").otherwise("in_person").alias("location_type"),
        places_of(c("places"), c("_said"), c("_named")).alias("stated_places"),
        T.check_of(c("disclosure")).alias("dbs"),
        talk.alias("interview"),
        F.when(c("minimum_age").between(*AGES), c("minimum_age")).alias("min_age"),
        F.slice(_list(c("skills")), 1, SKILLS).alias("skills"),
        F.when(limit != "", F.array(F.substring(limit, 1, LIMIT))).otherwise(F.array().cast("array<string>")).alias("eligibility"),
        F.when(c("christmas"), F.struct(F.lit(12).alias("start_month"), F.lit(12).alias("end_month"))).alias("season"),
        F.lit("open").alias("status"),
        c("url").alias("apply_url"),
        verified.alias("verified"),
        unsupported.alias("unsupported"),
    )
