"""Which items lie within a time of each place: a spatial join by grid cells, then nested bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cost = Callable[[Column, Column, Column, Column], Column]


def straight(per_minute: float) -> Cost:
    """Whole minutes of the straight line between two points at a speed; halves go to the even minute."""
    return lambda x, y, u, v: F.bround(F.sqrt((x - u) * (x - u) + (y - v) * (y - v)) / per_minute).cast("int")


def near(places: DataFrame, items: DataFrame, place: str, item: str, widest: float) -> DataFrame:
    """place, item, x, y, u, v: pairs of places and items (both with x and y) whose cells touch; ``widest`` is a cell's side, so
    no pair that is nearer than that is missed. An equi-join on the cell: a place goes to its nine cells, an item to one.
    Rows without coordinates take part in nothing."""
    cell = lambda c, d=0: F.floor(F.col(c) / widest).cast("long") + d
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    around = F.array(*(F.struct(cell("x", i).alias("cx"), cell("y", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    left = places.where(known).select(place, "x", "y", F.explode(around).alias("c")).select(place, "x", "y", "c.cx", "c.cy")
    right = items.where(known).select(item, F.col("x").alias("u"), F.col("y").alias("v"), cell("x").alias("cx"), cell("y").alias("cy"))
    return left.join(right, ["cx", "cy"]).drop("cx", "cy")


def reached(places: DataFrame, items: DataFrame, place: str, item: str, limits: list[int], per_minute: float, cost: Cost | None = None, table: DataFrame | None = None) -> DataFrame:
    """place, band, item, minutes: each item in every band of minutes that reaches it.

    ``cost`` gives the minutes between two points (default: the straight line), never fewer than the straight line at
    ``per_minute``; ``table`` (place, item, minutes) states them instead for the pairs that it has, however far apart; null
    where there is no way. Rows stay apart, so a place that reaches very many items is no single row or task.
    """
    widest = (max(limits) + 0.5) * per_minute
    pairs = near(places, items, place, item, widest)
    pairs = pairs.withColumn("minutes", (cost or straight(per_minute))(F.col("x"), F.col("y"), F.col("u"), F.col("v")))
    if table is not None:
        known = table.select(place, item, F.col("minutes").cast("int").alias("minutes"))
        pairs = pairs.select(place, item, "minutes").join(known.select(place, item), [place, item], "left_anti").unionByName(known)
    band = F.explode(F.filter(F.array(*map(F.lit, sorted(limits))), lambda b: F.col("minutes") <= b))
    return pairs.where("minutes is not null").select(place, band.alias("band"), item, "minutes")
