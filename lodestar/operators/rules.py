"""Declarative validation: rules compiled into one projection, one row for each violation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import web


@dataclass(frozen=True)
class Rule:
    """A named rule; ``broken`` is true for a row that violates it (null counts as kept)."""

    name: str
    broken: Column
    message: str


def violations(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """key, rule, message: one scan, whatever the number of rules."""
    hits = F.array(*(F.when(r.broken, F.struct(F.lit(r.name).alias("rule"), F.lit(r.message).alias("message"))) for r in rules))
    return df.select(key, F.explode(F.array_compact(hits)).alias("v")).select(key, "v.rule", "v.message")


def refuse_if_any(found: DataFrame) -> None:
    """Raises if there is a violation; shows the first few."""
    rows = found.limit(5).collect()
    if rows:
        raise ValueError("; ".join(" ".join(map(str, r)) for r in rows))


def text_rule(name: str, least: int = 0, most: int | None = None, pattern: str | None = None, required: bool = True) -> list[Rule]:
    """Rules for a string: present, of a length, of a pattern."""
    c = F.col(name)
    out = [Rule(name, c.isNull(), "is missing")] if required else []
    if least or most:
        out.append(Rule(name, (F.length(c) < least) | (F.length(c) > (most or 1 << 30)), f"must have {least} to {most} characters"))
    return out + ([Rule(name, ~c.rlike(f"^(?:{pattern})$"), "has the wrong form")] if pattern else [])


def enum_rule(name: str, values: tuple[str, ...]) -> Rule:
    return Rule(name, ~F.col(name).isin(*values), "isn't an allowed value")


def range_rule(name: str, low: float, high: float) -> Rule:
    return Rule(name, ~F.col(name).between(low, high), f"must lie between {low} and {high}")


def unique_rule(name: str) -> Rule:
    return Rule(name, F.size(F.array_distinct(name)) < F.size(name), "holds an item twice")


def list_rule(name: str, values: tuple[str, ...], most: int) -> list[Rule]:
    allowed = F.array(*map(F.lit, values))
    return [Rule(name, F.size(name) > most, f"has more than {most} items"), Rule(name, F.size(F.array_except(name, allowed)) > 0, "holds an item that isn't allowed")]


def unknown_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    """Columns that a closed schema doesn't have, with dotted names."""

    def walk(have: T.StructType, want: T.StructType, at: str) -> list[str]:
        out = []
        for f in have.fields:
            if f.name not in want.names:
                out.append(at + f.name)
            elif isinstance(f.dataType, T.StructType) and isinstance(want[f.name].dataType, T.StructType):
                out += walk(f.dataType, want[f.name].dataType, f"{at}{f.name}.")
        return out

    return walk(df.schema, schema, "")


def invariants(roles: DataFrame, orgs: DataFrame) -> DataFrame:
    """id, rule, message: the rules of business over roles (id, ord, org_id, commitment, status, apply_url,
    url_specificity, confidence, min_term_months, has_season, dbs, verified, unsupported, reviewed) and
    organisations (org_id, opted_out, website_url, volunteer_url). A link may leave the organisation's own
    domain only where a person has reviewed the record and a note in ``unsupported`` names the domain. Of roles that
    share an id each but the first (by ``ord``) is a duplicate; of a role without its organisation nothing else is asked."""
    twice = F.row_number().over(Window.partitionBy("id").orderBy("ord")) > 1
    both = roles.withColumn("_twice", twice).join(orgs.select("org_id", "opted_out", web.host(F.col("website_url")).alias("_host"), "volunteer_url", F.lit(True).alias("_there")), "org_id", "left")
    c, there = F.col, web.host(F.col("apply_url"))
    away = (there != "") & (c("_host") != "") & ~web.is_subdomain(there, c("_host"))
    named = c("reviewed") & F.exists(F.coalesce("unsupported", F.array().cast("array<string>")), lambda x: x.contains(there))
    always = [Rule("duplicate", c("_twice"), "id occurs twice"), Rule("organisation", c("_there").isNull(), "organisation is missing")]
    with_org = [
        Rule("opt_out", c("opted_out"), "organisation opted out"),
        Rule("link", (F.coalesce(c("apply_url"), F.lit("")) == "") & (F.coalesce(c("volunteer_url"), F.lit("")) == ""), "no link"),
        Rule("dbs", (c("dbs") == "none") & ~F.coalesce(F.array_contains("verified", "screening.dbs"), F.lit(False)), "no check claimed but not verified"),
        Rule("homepage", (c("url_specificity") == "org_homepage") & (c("confidence") > 0.5), "homepage link with high confidence"),
        Rule("season", (c("status") == "seasonal_closed") & ~c("has_season"), "seasonal without a window"),
        Rule("term", c("commitment").isin("one_off", "flexible") & (c("min_term_months") > 0), "a term on a one-off"),
        Rule("foreign", away & ~F.coalesce(named, F.lit(False)), "link leads to a site that wasn't declared"),
        Rule("open", (c("status") == "open") & F.coalesce(F.array_contains("unsupported", "status"), F.lit(False)), "open isn't supported by the page"),
    ]
    return violations(both, "id", always + [Rule(r.name, c("_there") & r.broken, r.message) for r in with_org])
