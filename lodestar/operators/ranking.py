"""Fit scores of roles for a visitor's preferences."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


REGULAR = ("weekly", "fortnightly", "monthly", "long_term")
AT_HOME = ("remote", "own_home")


@dataclass
class Preferences:
    """``commitment`` is any, once or regular."""

    when: list[str] = field(default_factory=list)
    commitment: str = "any"
    zones: list[str] = field(default_factory=list)
    remote: bool = False


class _Score:
    """Questions, of each of which the first branch that holds counts: points, a conflict, reason and caution."""

    def __init__(self) -> None:
        self.answers: list[Column] = []

    def cascade(self, *branches: tuple) -> None:
        """Each branch is (condition, points, conflict, reason, caution); the last one's condition is None and always holds."""
        out = F
        for condition, points, clash, reason, caution in branches:
            answer = F.struct(F.lit(points).alias("points"), F.lit(int(clash)).alias("clash"), F.lit(reason).cast("string").alias("reason"), F.lit(caution).cast("string").alias("caution"))
            out = out.otherwise(answer) if condition is None else out.when(condition, answer)
        self.answers.append(out)

    def column(self) -> Column:
        total = lambda name: sum((a[name] for a in self.answers), F.lit(0)).cast("int")
        texts = lambda name: F.array_compact(F.array(*(a[name] for a in self.answers)))
        return F.struct(total("points").alias("score"), total("clash").alias("conflicts"), texts("reason").alias("reasons"), texts("caution").alias("cautions"))


def fit(p: Preferences | None) -> Column:
    """struct<score, conflicts, reasons, cautions> over the columns of roles.

    Points: open 8; the wanted frequency 30; a common time 25. For the place, the first that holds:
    remote or hybrid where remote is wanted 25, fully remote beside wanted zones 15, at one's own home
    nothing but a caution, a common zone 25, or 12 where it stems from areas that are named or
    covered rather than an address. Without preferences only the status counts.
    """
    c, s = F.col, _Score()
    size = lambda x: F.size(F.coalesce(x, F.array().cast("array<string>")))
    s.cascade((c("status") == "open", 8, False, None, None), (c("status") == "seasonal_closed", 0, False, None, "seasonal: ask for the next intake"), (c("status") == "oversubscribed", 0, False, None, "oversubscribed: ask for a waiting list"), (None, 0, False, None, "recruitment isn't confirmed"))
    if p is None:
        return s.column()
    flexible, unknown = c("commitment") == "flexible", c("commitment") == "unknown"
    if p.commitment == "once":
        ongoing = (c("min_term_months") > 0) | (c("location_type") == "own_home")
        s.cascade(((c("commitment") == "one_off") & ~F.coalesce(ongoing, F.lit(False)), 30, False, "can be done once", None), (ongoing, 0, True, None, "is an ongoing commitment"), (flexible, 0, False, None, "ask whether once is enough"), (unknown, 0, False, None, "frequency not stated"), (None, 0, True, None, "another commitment than wanted"))
    elif p.commitment != "any":
        s.cascade((c("commitment").isin(*REGULAR), 30, False, "is a regular commitment", None), (flexible, 0, False, None, "ask for a regular slot"), (unknown, 0, False, None, "frequency not stated"), (None, 0, True, None, "another commitment than wanted"))
    if p.when:
        wanted = F.array(*map(F.lit, p.when))
        s.cascade((F.arrays_overlap(c("when"), wanted), 25, False, "right time", None), (F.array_contains("when", "flexible"), 0, False, None, "times to be agreed"), (size(c("when")) == 0, 0, False, None, "times not stated"), (None, 0, True, None, "other times than wanted"))
    if p.zones or p.remote:
        kind, wanted, at_home = c("location_type"), F.array(*map(F.lit, p.zones)).cast("array<string>"), c("location_type").isin(*AT_HOME)
        overlap = F.arrays_overlap(c("zones"), wanted)
        named = c("location_basis").isin("charity_coverage", "role_areas")
        zoned, far = F.lit(bool(p.zones)), F.lit(p.remote and not p.zones)
        s.cascade(
            (F.lit(p.remote) & (kind == "remote"), 25, False, "can be done from home", None),
            (F.lit(p.remote) & (kind == "hybrid"), 25, False, "can be done from home in part", "some of it may be in person"),
            (zoned & (kind == "remote"), 15, False, "no journey", None),
            (zoned & (kind == "own_home"), 0, False, None, "ask whether your address is covered"),
            (overlap & named, 12, False, "covers your area", "covering an area isn't a venue there"),
            (overlap, 25, False, "in your area", None),
            (far, 0, True, None, "isn't remote"),
            ((c("location_basis") == "london_wide") & ~at_home, 0, False, "runs across the city", None),
            ((size(c("zones")) == 0) & ~at_home, 0, False, None, "place not stated"),
            (None, 0, True, None, "outside the wanted areas"),
        )
    return s.column()


def order() -> list[Column]:
    return [F.col("fit.conflicts"), F.desc("fit.score"), F.col("confidence").desc_nulls_last(), F.col("title")]


def ranked(roles: DataFrame, p: Preferences | None, seen: DataFrame | None = None, widened: bool = False) -> DataFrame:
    """Roles with their fit, without those in ``seen`` (id), and without conflicts unless widened."""
    left = roles.join(seen, "id", "left_anti") if seen is not None else roles
    found = left.withColumn("fit", fit(p))
    return found if widened else found.where("fit.conflicts = 0")
