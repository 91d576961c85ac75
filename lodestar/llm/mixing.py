"""Mixing sources to target weights by hash-threshold histograms [DataFrame functions only].

Each source has a token target. Whole repeats of the source are taken first; for the rest, every
document has a fixed pseudo-random rank (60 bits of a digest of its id and text), and the documents with
the lowest ranks are taken until the sizes add up to the rest. No sort finds that rank: sizes are
summed by source and by the leading 12 bits of the rank, the bucket in which the running sum
passes the rest is the boundary, and only that bucket is summed again by its next 12 bits, until
all 60 bits are fixed. Thresholds are nested: a larger target keeps all that a smaller one took.

Cases: a null text has size 0 and is never taken; a null source is a source of its own, after all
others; rows that repeat an id and a text share a rank and are taken together, other texts of the id
have ranks of their own; sources may be many: no task holds all of them; a source of size 0 has target
0; an empty table gives an empty table. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, small, unwrapped, words, wrapped, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BITS, LEVELS = 12, 5


def rank() -> F.Column:
    """60 bits of md5 of the document's id and its text's digest."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    digest = F.md5(F.concat(text(F.col("doc_id")), F.lit(":"), F.md5(text(F.col("text")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def running(df: DataFrame, order: list[F.Column], sums: dict[str, F.Column]) -> DataFrame:
    """``df`` with the sums of what comes before each row in a total order. Rows are dealt out by ranges of the
    order; only one row for each range is ever in one place."""
    dealt = written(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(F.col("range").alias("at")).agg(*(F.sum(x).alias(f"{c}_of") for c, x in sums.items()))
    ranges = ranges.select("at", *(F.coalesce(F.sum(f"{c}_of").over(before), F.lit(0)).alias(f"{c}_before") for c in sums))
    rows = dealt.select("*", *(F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"{c}_inside") for c, x in sums.items()))
    rows = rows.join(F.broadcast(ranges), F.col("range") == F.col("at"))
    return rows.select(*df.columns, *((F.col(f"{c}_inside") + F.col(f"{c}_before")).alias(c) for c in sums))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and rank of each row."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), rank().alias("rank"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row for each source.

    Filling to the level L gives each source the lesser of ``most`` times its size and L times its
    weight. Sources are taken by the level at which they are full; those full below the level that
    the remaining budget would reach are capped, and the first that isn't sets L.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = running(per, [F.col("source").asc_nulls_last()], {"turn": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("long")
    top = (F.col("source_size") * most).cast("double")
    per = per.withColumn("weight", weight).withColumn("full", top / F.col("weight"))
    per = written(running(per, [F.col("full"), F.col("source").asc_nulls_last()], {"used": F.col("source_size"), "gone": F.col("weight")}))
    every = per.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    level = (F.col("total") * F.lit(share) - F.col("used") * most) / (F.col("weights") - F.col("gone"))
    reached = per.crossJoin(F.broadcast(every)).withColumn("level", level)  # one row
    level = reached.agg(F.max(F.when(F.col("level") < F.col("full"), F.col("level"))).alias("level"))
    return per.crossJoin(F.broadcast(level)).select("source", "source_size", F.coalesce(F.least(top, F.col("level") * F.col("weight")), top).alias("target"))


def cutoffs(sized: DataFrame, goals: DataFrame, n_sources: int) -> DataFrame:
    """source, repeats, cut: ranks below ``cut`` are taken once more than ``repeats`` times."""
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("repeats", repeats).select("source", "repeats", (F.col("target") - F.col("repeats") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    rows = sized.where("size > 0").select(F.col("source").alias("of"), "size", "rank")
    so_far = Window.partitionBy("source").orderBy("bucket")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = F.col("of").eqNullSafe(F.col("source")) & (F.shiftright("rank", shift + BITS) == F.col("prefix"))
        sums = rows.join(small(state, n_sources), inside).groupBy("source", "repeats", "rest", "below", F.shiftright("rank", shift).alias("bucket")).agg(F.sum("size").alias("mass"))
        sums = sums.withColumn("below", F.col("below") + F.sum("mass").over(so_far) - F.col("mass"))
        state = sums.where("below <= rest and below + mass > rest").select("source", "repeats", "rest", "below", F.col("bucket").alias("prefix"), "mass")
        if level < LEVELS:
            state = state.drop("mass")
    nearer = F.col("below") * 2 + F.col("mass") <= F.col("rest") * 2
    return state.select("source", (F.col("prefix") + nearer.cast("long")).alias("cut"))


def plan(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """goal_source, source_size, target, repeats, cut of each source; marked small where it is."""
    goals = written(targets(sized, weights, share, most))
    n = goals.count()
    cuts = cutoffs(sized, goals, n).withColumnRenamed("source", "cut_source")
    goals = goals.join(small(cuts, n), F.col("source").eqNullSafe(F.col("cut_source")), "left").withColumnRenamed("source", "goal_source")
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return small(written(goals.select("goal_source", "source_size", "target", repeats.cast("int").alias("repeats"), "cut")), n)


def _times(rank: F.Column) -> F.Column:
    """How often a document is taken."""
    return F.col("repeats") + F.coalesce(rank < F.col("cut"), F.lit(False)).cast("int")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs`` (doc_id, source, text)."""
    sized = written(sizes(docs))
    rows = sized.join(plan(sized, weights, share, most), F.col("source").eqNullSafe(F.col("goal_source")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("rank"))).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, in the columns of ``docs``.

    Documents without a word are left out; the texts aren't shuffled.
    """
    goals = plan(written(sizes(docs)), weights, share, most)
    rows = wrapped(docs, "doc_id", "source", "text").where(F.col("text").rlike(WORD))
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn("times", _times(rank())).where("times > 0")
    return unwrapped(rows.select("row", F.explode(F.sequence(F.lit(1), "times"))))


SQL = f"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) h from documents),
per as (select source, cast(sum(size) as bigint) source_size, row_number() over (order by source nulls last) n from sized group by source),
weighed as (select *, [3, 1, 2][1 + (n - 1) % 3] w from per),
filling as (select *, 2 * source_size / cast(w as double) f, sum(source_size) over () total, sum(w) over () ws,
  coalesce(2 * sum(source_size) over b, 0) used, coalesce(sum(w) over b, 0) gone from weighed
  window b as (order by 2 * source_size / cast(w as double), source nulls last rows between unbounded preceding and 1 preceding)),
level as (select *, (cast(total as double) * 1.5 - cast(used as double)) / cast(ws - gone as double) l from filling),
goal as (select source, source_size, coalesce(least(2.0::double * source_size, max(l) filter (l < f) over () * w), 2.0::double * source_size) target from level),
ranked as (select s.doc_id, s.size, g.source_size, g.target, case when g.source_size > 0 then floor(g.target / g.source_size) else 0 end r,
  coalesce(sum(s.size) over (partition by s.source order by s.h range between unbounded preceding and current row), 0) upto,
  sum(s.size) over (partition by s.source, s.h) mass
  from sized s join goal g on s.source is not distinct from g.source)
select doc_id, size, source_size, cast(target as double) target,
  cast(size * (r + case when 2 * (upto - mass) + mass <= 2 * (target - r * source_size) then 1 else 0 end) as bigint) taken from ranked
"""
