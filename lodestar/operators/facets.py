"""Faceted search: optional filters, drill-sideways counts, grids, relaxations, sort orders.

A facet is a name with a predicate (a boolean column). Counts of all options of all facets come from
one scan: each row carries the truth of every facet, an option of a facet is counted where all *other*
facets hold, and one aggregation adds them up.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frequencies and the doors that lead to them. Fixed values.
DOORS = {"one_off": ("one_off",), "weekly": ("weekly", "fortnightly", "monthly"), "long_term": ("long_term",), "flexible": ("flexible",), "fortnightly": ("fortnightly",), "monthly": ("monthly",)}
#: Sort weights. The two orders differ in how weekly, fortnightly and monthly rank.
STATUS_RANK = {"open": 0, "seasonal_closed": 1}
PAGE_WEIGHT = {"one_off": 1, "flexible": 2, "monthly": 3, "weekly": 4, "fortnightly": 4, "long_term": 6}
SOON_WEIGHT = {"one_off": 1, "flexible": 2, "weekly": 3, "fortnightly": 3, "monthly": 3, "long_term": 5}
ELSEWHERE = ("remote", "own_home")


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def true(predicate: Column) -> Column:
    """A predicate that is false where it is null."""
    return F.coalesce(predicate, F.lit(False))


def in_door(commitment: Column, door: str) -> Column:
    """Whether a commitment belongs behind a door: flexible behind all, unknown behind none."""
    return F.when(commitment == "unknown", False).when(commitment == "flexible", True).otherwise(commitment.isin(*DOORS[door]))


@dataclass
class Query:
    """What a visitor chose; empty values choose nothing."""

    door: str = ""
    borough: str = ""
    activity: str = ""
    zones: list[str] = field(default_factory=list)
    text: str = ""
    when: list[str] = field(default_factory=list)
    frequency: str = "any"
    who: str = ""
    remote: bool = False
    open: bool = False

    def predicates(self) -> dict[str, Column]:
        """The predicates of the values that are set, over the columns of roles."""
        c, none = F.col, lambda x: F.size(F.coalesce(x, F.array().cast("array<string>"))) == 0
        away = c("location_type").isin(*ELSEWHERE)
        out: dict[str, Column] = {}
        if self.door:
            out["door"] = in_door(c("commitment"), self.door)
        if self.when:
            out["when"] = none(c("when")) | F.arrays_overlap(c("when"), F.array(*map(F.lit, self.when)))
        if self.frequency == "once":
            out["frequency"] = (F.coalesce(c("min_term_months"), F.lit(0)) <= 0) & c("commitment").isin("one_off", "flexible", "unknown")
        if self.frequency == "regular":
            out["frequency"] = c("commitment") != "one_off"
        if self.text.strip():
            out["text"] = F.lower(F.concat_ws(" ", "title", "org", "summary")).contains(self.text.strip().lower())
        if self.borough:
            out["borough"] = away | none(c("areas")) | F.array_contains("areas", self.borough)
        if self.zones:
            out["zones"] = away | (none(c("areas")) & none(c("zones"))) | F.arrays_overlap(c("zones"), F.array(*map(F.lit, self.zones)))
        if self.activity:
            out["activity"] = c("activity") == self.activity
        if self.who:
            out["who"] = (c("who_can_apply") == "team_only") if self.who == "team_only" else (c("who_can_apply") != "team_only")
        if self.remote:
            out["remote"] = c("location_type").isin("remote", "hybrid")
        if self.open:
            out["open"] = c("status") == "open"
        return out


def matching(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """The rows for which every given predicate holds."""
    return df.where(all_of([true(p) for p in predicates.values()]))


def facet_counts(df: DataFrame, chosen: dict[str, Column], options: dict[str, Column]) -> DataFrame:
    """facet, option, n: rows for each option while the other facets' predicates hold.

    ``options`` maps a facet to the row's options, a value or an array of values; options without
    a row don't show.
    """
    names = list(options)
    held = df.select(*(true(chosen.get(f, F.lit(True))).alias(f"_p{i}") for i, f in enumerate(names)), *(options[f].alias(f"_o{i}") for i, f in enumerate(names)), *(true(p).alias(f"_x{i}") for i, p in enumerate(v for k, v in chosen.items() if k not in options)))
    extra = [F.col(c) for c in held.columns if c.startswith("_x")]
    arrays = []
    for i, f in enumerate(names):
        kind = held.schema[f"_o{i}"].dataType.simpleString()
        values = F.array_distinct(f"_o{i}") if kind.startswith("array") else F.array(f"_o{i}")
        others = all_of([F.col(f"_p{j}") for j in range(len(names)) if j != i] + extra)
        found = F.transform(values, _named(f))
        arrays.append(F.when(others, found).otherwise(F.array().cast("array<struct<facet:string,option:string>>")))
    return held.select(F.explode(F.flatten(F.array(*arrays))).alias("x")).groupBy("x.facet", "x.option").agg(F.count("*").alias("n"))


def _named(facet: str):  # noqa: ANN202
    return lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("option"))


def with_zeros(counts: DataFrame, listed: DataFrame) -> DataFrame:
    """Counts of every listed (facet, option), 0 where no row has it."""
    return F.broadcast(listed).join(counts, ["facet", "option"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def grid(df: DataFrame, first: str, *others: str) -> DataFrame:
    """Counts by ``first`` alone and by it with each other column; only combinations with rows."""
    sets = [[F.col(first)], *([F.col(first), F.col(o)] for o in others)]
    return df.groupingSets(sets, first, *others).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def door_grid(roles: DataFrame) -> DataFrame:
    """door, borough, n, exact: pages of a door and borough, made where a role names the borough;
    roles without any place are on all of the door's pages."""
    doors = F.array(*(F.when(in_door(F.col("commitment"), d), F.lit(d)) for d in DOORS))
    each = roles.select("*", F.explode(F.array_compact(doors)).alias("door"))
    placed = each.where(F.size("areas") > 0).select("door", F.explode(F.array_distinct("areas")).alias("borough")).groupBy("door", "borough").agg(F.count("*").alias("exact"))
    free = each.where(F.size("areas") <= 0).groupBy("door").agg(F.count("*").alias("free"))
    return placed.join(free, "door", "left").select("door", "borough", (F.col("exact") + F.coalesce("free", F.lit(0))).alias("n"), "exact")


def door_activity(roles: DataFrame) -> DataFrame:
    """door, activity, n: pages of a door and an activity that have roles."""
    doors = F.array(*(F.when(in_door(F.col("commitment"), d), F.lit(d)) for d in DOORS))
    return roles.select("activity", F.explode(F.array_compact(doors)).alias("door")).groupBy("door", "activity").agg(F.count("*").alias("n"))


def majority_note(df: DataFrame, by: str, silent: Column, least: int = 3) -> DataFrame:
    """by, n, silent, note: whether a group of ``least`` rows or more is silent on something in half of them."""
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(silent).alias("silent"))
    return out.withColumn("note", (F.col("n") >= least) & (2 * F.col("silent") >= F.col("n")))


def value_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, option, place: the sorted lists of distinct values that filters offer, a row for each value."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("option")) for c in columns)))
    return df.select(each.alias("x")).select("x.*").where("option is not null").distinct().withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy("option")))


def discoverable(roles: DataFrame) -> DataFrame:
    """Roles that one person can ask about: neither for teams only nor closed."""
    return roles.where(~true(F.col("who_can_apply") == "team_only") & ~true(F.col("status") == "closed"))


def unnest_counts(df: DataFrame, values: Column) -> DataFrame:
    """option, n: rows that hold each value of an array, and those with none under null."""
    return df.select(F.explode_outer(F.array_distinct(values)).alias("option")).groupBy("option").agg(F.count("*").alias("n"))


#: What an empty result offers instead: a name, and the choices that it changes, in order of preference.
RELAXED = (
    ("zones", {"zones": []}),
    ("borough", {"borough": ""}),
    ("activity", {"activity": ""}),
    ("open", {"open": False}),
    ("who", {"who": ""}),
    ("door_one_off", {"door": "one_off"}),
    ("door_weekly", {"door": "weekly"}),
)


def relaxations(df: DataFrame, query: Query, most: int = 3) -> DataFrame:
    """relaxed, n, place: the changes of a query that find rows, best first, in one scan; a change
    that leaves the query as it is isn't offered."""
    tried = [(name, replace(query, **change)) for name, change in RELAXED if any(getattr(query, k) != v for k, v in change.items())]
    if not tried:
        return df.sparkSession.createDataFrame([], "relaxed string, n long, place int")
    sums = [F.count_if(all_of([true(p) for p in q.predicates().values()])).alias(name) for name, q in tried]
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("relaxed"), F.col(name).alias("n"), F.lit(i).alias("i")) for i, (name, _) in enumerate(tried))))
    found = df.agg(*sums).select(each.alias("x")).select("x.*").where("n > 0")
    place = F.row_number().over(Window.orderBy(F.desc("n"), "i"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("relaxed", "n", "place")


def binding(chosen: dict[str, Column], order: tuple[str, ...] = ("zones", "borough", "activity", "who", "open")) -> str:
    """The facet that is named as the one in the way: the first that is set, else the time."""
    return next((f for f in order if f in chosen), "door")


def weight(value: Column, table: dict[str, int], other: int = 9) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(value == k, v)
    return out.otherwise(other)


def hours() -> Column:
    """A shift's hours for sorting: 0 is as unknown as null, and comes last."""
    h = F.col("typical_shift_hours")
    return F.when(h != 0, h).otherwise(99.0)


def page_order() -> list[Column]:
    """Open roles first, then by commitment, then by hours, then in their own order."""
    return [weight(F.col("status"), STATUS_RANK, 2), weight(F.col("commitment"), PAGE_WEIGHT), hours(), F.col("ord")]


def soonest_order() -> list[Column]:
    return [weight(F.col("status"), STATUS_RANK, 2), weight(F.col("commitment"), SOON_WEIGHT), hours(), F.col("ord")]


def least_order() -> list[Column]:
    return [weight(F.col("commitment"), PAGE_WEIGHT), hours(), F.col("ord")]


def title_order() -> list[Column]:
    """By title as a reader of the language would."""
    return [F.collate("title", "UNICODE"), F.col("ord")]


def top(df: DataFrame, order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first n rows under an order with an explicit place."""
    best = df.orderBy(*order).limit(n)
    return best.withColumn(place, F.row_number().over(Window.orderBy(*order)))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)
