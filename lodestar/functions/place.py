"""The location cascade: from what a role states to areas, zones and labels.

Gazetteers are small tables; callers join them in (``matched``) or pass maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import place_canon

ELSEWHERE = ("remote", "own_home")
#: Outward codes of the central zone.
CENTRAL = r"^(?:EC|WC)\d+[A-Z]?$|^(?:W|SW|SE)1[A-Z]?$"


def matched(df: DataFrame, key: str, places: str, gazetteer: DataFrame) -> DataFrame:
    """key, boroughs, london_only, elsewhere of rows with an array of place names.

    ``gazetteer`` has name, borough; the whole city's names have a null borough.
    """
    names = gazetteer.select(place_canon(F.col("name")).alias("place"), F.col("borough"), F.lit(True).alias("known"))
    each = df.select(key, F.explode_outer(places).alias("raw")).withColumn("place", place_canon(F.col("raw")))
    found = each.join(names, "place", "left")
    out = found.groupBy(key).agg(
        F.array_sort(F.collect_set("borough")).alias("boroughs"),
        F.coalesce(F.bool_or(F.col("known") & F.col("borough").isNull()), F.lit(False)).alias("_city"),
        F.coalesce(F.bool_or(F.col("known").isNull() & F.col("raw").isNotNull()), F.lit(False)).alias("elsewhere"),
    )
    return out.withColumn("london_only", F.col("_city") & (F.size("boroughs") == 0)).drop("_city")


def _none() -> Column:
    return F.array().cast("array<string>")


def areas(location: Column, district: Column, boroughs: Column, london_only: Column, role_zones: Column, coverage: Column) -> Column:
    """A role's areas: none away from a place; its district; its boroughs; none when it is city-wide
    or has zones of its own; else what its organisation covers."""
    return (
        F.when(location.isin(*ELSEWHERE), _none())
        .when(district.isNotNull() & (district != ""), F.array(district))
        .when(F.size(boroughs) > 0, boroughs)
        .when(london_only | (F.size(F.coalesce(role_zones, _none())) > 0), _none())
        .otherwise(F.coalesce(coverage, _none()))
    )


def boroughs_of(areas: Column, district_borough: Column) -> Column:
    """Areas with districts as their boroughs; names that the map lacks stay."""
    return F.array_sort(F.array_distinct(F.transform(areas, lambda a: F.coalesce(F.try_element_at(district_borough, a), a))))


def zones(location: Column, district: Column, boroughs: Column, london_only: Column, role_zones: Column, coverage: Column, district_borough: Column, borough_zone: Column) -> Column:
    """A role's zones, by the same order of evidence; an unknown district has none."""
    zone = lambda b: F.try_element_at(borough_zone, b)
    code = F.upper(F.trim(district))
    own = F.when(code.rlike(CENTRAL), F.array(F.lit("central"))).otherwise(F.array_compact(F.array(zone(F.try_element_at(district_borough, code)))))
    of = lambda bs: F.array_sort(F.array_distinct(F.array_compact(F.transform(bs, zone))))
    known = F.array_append(F.map_values(borough_zone), F.lit("central"))
    return (
        F.when(location.isin(*ELSEWHERE), _none())
        .when(F.coalesce(code, F.lit("")) != "", own)
        .when(F.size(boroughs) > 0, of(boroughs))
        .when(london_only, _none())
        .when(F.size(F.coalesce(role_zones, _none())) > 0, F.array_sort(F.array_intersect(role_zones, known)))
        .otherwise(of(F.coalesce(coverage, _none())))
    )


def in_city(location: Column, n_places: Column, boroughs: Column, london_only: Column) -> Column:
    """Whether a role is in the city as far as it says."""
    return location.isin(*ELSEWHERE) | (n_places <= 0) | (F.size(boroughs) > 0) | london_only


def basis(location: Column, district: Column, boroughs: Column, london_only: Column, role_zones: Column, london_wide: Column, coverage: Column) -> Column:
    """Which evidence a role's place rests on, the most specific first."""
    return (
        F.when(location.isin(*ELSEWHERE), location)
        .when(F.coalesce(district, F.lit("")) != "", "postcode")
        .when(F.size(boroughs) > 0, "role_areas")
        .when(london_only, "london_wide")
        .when(F.size(F.coalesce(role_zones, _none())) > 0, "role_areas")
        .when(F.size(F.coalesce(coverage, _none())) > 0, "charity_coverage")
        .when(london_wide, "london_wide")
        .otherwise("unknown")
    )


def area_label(location: Column, district: Column, boroughs: Column, london_only: Column, role_zones: Column, london_wide: Column, coverage: Column, zone_names: Column) -> Column:
    """Words for a place without an address, only what was said: its boroughs, the city, its zones'
    names, or across the city; null where nothing was, or a postcode or a home says it better."""
    names = F.array_compact(F.transform(F.array_sort(F.array_distinct(role_zones)), lambda z: F.try_element_at(zone_names, z)))
    return (
        F.when(location.isin(*ELSEWHERE) | (F.coalesce(district, F.lit("")) != ""), None)
        .when(F.size(boroughs) > 0, F.array_join(boroughs, ", "))
        .when(london_only, "London")
        .when(F.size(F.coalesce(role_zones, _none())) > 0, F.when(F.size(names) > 0, F.array_join(names, ", ")))
        .when((F.size(F.coalesce(coverage, _none())) <= 0) & london_wide, "Across London")
    )


def usable_for_reach(roles: DataFrame) -> DataFrame:
    """Roles with coordinates where one has to be: in person or hybrid."""
    return roles.where(F.col("coords").isNotNull() & F.col("location_type").isin("in_person", "hybrid"))


def stated_places(places: Column, found: Column) -> Column:
    """A role's places, white space put right, if the page backs every one of them (``found``, an array of
    booleans beside them); none of them otherwise, as a part would say something else."""
    return F.when(F.forall(F.coalesce(found, F.array().cast("array<boolean>")), lambda x: F.coalesce(x, F.lit(False))), F.transform(F.coalesce(places, _none()), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))).otherwise(_none())


def offer_in_city(text: Column, city: str, boroughs: list[str], prefixes: list[str]) -> Column:
    """Whether an offer's text names the city, a borough as a word, or a postcode of its areas."""
    low = F.lower(text)
    names = "|".join(r"\Q" + b.lower() + r"\E" for b in boroughs)
    outward = F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z]{1,2})\d[A-Z\d]?\b"), F.lit(1))
    return low.contains(city.lower()) | low.rlike(rf"\b(?:{names})\b") | F.arrays_overlap(outward, F.array(*map(F.lit, prefixes)))
