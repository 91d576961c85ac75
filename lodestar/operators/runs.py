"""Window-like computations: failure runs, trailing sums, allowances, summaries of a run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.values import BANNER_DAYS, upper_median
from lodestar.sources.scratch import written


def failure_runs(df: DataFrame, by: str, order: list[Column], failed: Column, dead: int = 2) -> DataFrame:
    """by, run, length, dead: every unbroken run of failures; a success ends it."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = df.select("*", failed.alias("_f")).withColumn("run", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("_f").groupBy(by, "run").agg(F.count("*").alias("length")).withColumn("dead", F.col("length") >= dead)


def trailing_sum(df: DataFrame, by: str, second: Column, value: Column, span: int, out: str = "trailing") -> DataFrame:
    """The sum of a value over the last ``span`` whole seconds, the row's own included."""
    w = Window.partitionBy(by).orderBy(second).rangeBetween(-(span - 1), 0)
    return df.withColumn(out, F.sum(value).over(w))


def allowance(df: DataFrame, by: list[str], order: list[Column], asked: Column, cap: int, usd: float | None = None, cost: float | None = None) -> DataFrame:
    """The rows with ``granted``: what of ``asked`` a cap for each group still allows, in order; and, where a budget
    and the cost of one are given, what the budget still pays for."""
    if usd is not None and cost:
        cap = min(cap, math.floor(usd / cost + 1e-9))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(cap) - F.coalesce(F.sum(asked).over(w), F.lit(0))
    return df.withColumn("granted", F.greatest(F.lit(0), F.least(asked, left)).cast("long"))


def outcome_counts(df: DataFrame, outcome: Column, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row: how many rows have one of each group's outcomes."""
    return df.agg(*(F.count_if(outcome.isin(*values)).alias(name) for name, values in groups.items()))


def totals(df: DataFrame, counters: list[str]) -> DataFrame:
    """One row: the sum of each counter."""
    return df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters))


def freshness_summary(df: DataFrame, age: str, hidden: str) -> DataFrame:
    """One row: upper median age, oldest, how many are suppressed, and whether a banner is due.

    The ages are counted by value first, so that what is gathered is one number for each age.
    """
    counts = df.groupBy(age).agg(F.count("*").alias("n"), F.count_if(F.col(hidden)).alias("h"))
    ordered = Window.orderBy(F.col(age).asc_nulls_last())
    known = F.sum(F.when(F.col(age).isNotNull(), F.col("n")).otherwise(0)).over(Window.partitionBy())
    upto = F.sum("n").over(ordered)
    placed = counts.select("*", known.alias("known"), upto.alias("upto"))
    middle = (F.col("known") / 2).cast("long")
    row = placed.agg(
        F.min(F.when(F.col(age).isNotNull() & (F.col("upto") > middle), F.col(age))).alias("median_age"),
        F.max(age).alias("oldest"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("suppressed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    )
    return row.withColumn("banner", F.coalesce(F.col("median_age") >= BANNER_DAYS, F.col("rows") > 0))


def small_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """The upper median of each (small) group."""
    return df.groupBy(by).agg(upper_median(F.collect_list(value)).alias("median"))


def verdict_counts(df: DataFrame, verdict: Column, shown: list[str], good: str) -> DataFrame:
    """verdict, place, n, share, level: counts in a fixed order of display, 0 for those without rows."""
    spark = df.sparkSession
    order = spark.createDataFrame(list(enumerate(shown)), "place int, verdict string")
    counts = df.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))
    out = F.broadcast(order).join(counts, "verdict", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.bround(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy())), 3)
    out = out.withColumn("share", share)
    return out.withColumn("level", F.when(F.col("verdict") != good, None).when(F.col("share") >= 0.7, "good").when(F.col("share") >= 0.4, "mixed").otherwise("poor"))


def change_from_last(df: DataFrame, order: list[Column], count: str) -> DataFrame:
    """The difference to the count before."""
    return df.withColumn("delta", F.col(count) - F.lag(count).over(Window.orderBy(*order)))


def placed(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """Rows with their place in a total order, 1 for the first, without bringing them into one task.

    Rows are dealt out by ranges of the order, each range is numbered apart, and the counts of the ranges
    before it are added: only a count for each range is ever in one place.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    numbered = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    counts = dealt.groupBy(F.col("_range").alias("_of")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_of", before.alias("_before"))
    return numbered.join(F.broadcast(counts), F.col("_range") == F.col("_of")).withColumn(place, (F.col("_n") + F.col("_before")).cast("int")).drop("_range", "_of", "_n", "_before")


def repair_queue(df: DataFrame, last: str) -> DataFrame:
    """Rows by how long ago they were done, never first, with their place."""
    return placed(df, [F.col(last).asc_nulls_first(), F.col("ord")])
