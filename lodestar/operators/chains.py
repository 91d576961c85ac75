"""Edges joined into lines over tables: list ranking by pointer doubling, no walk and nothing collected.

At each point the edges are paired in the order of their other ends, first with second, third with fourth; an odd one
out ends a line there. So lines run on through points where several meet, no two lines have an end in common, and each
edge is in one line. A line's two directions are followed at once as darts (an edge with a direction): each dart points to the one
after it, and every round doubles how far the pointers reach, so lines of n edges take log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.runs import placed
from lodestar.sources.scratch import scoped, written


def _pairs(darts: DataFrame) -> DataFrame:
    """f, t, nf, nt: the dart that follows each, null at a line's end. Neighbours of a point are numbered by ranges of all
    darts, so a point with many takes no single task."""
    numbered = written(placed(darts, [F.col("f"), F.col("t")], "_place").withColumn("_place", F.col("_place").cast("long")))
    first = numbered.groupBy("f").agg(F.min("_place").alias("_first"))
    by_two = numbered.join(first, "f").withColumn("_two", F.floor((F.col("_place") - F.col("_first")) / 2))
    two = by_two.groupBy("f", "_two").agg(F.min("t").alias("one"), F.max("t").alias("other")).where("one <> other")
    # A dart that comes from one of the two goes on to the other.
    on = two.select(F.col("one").alias("f"), F.col("f").alias("t"), F.col("other").alias("nt")).union(two.select("other", "f", "one"))
    return darts.join(on, ["f", "t"], "left").select("f", "t", F.when(F.col("nt").isNotNull(), F.col("t")).alias("nf"), "nt")


def _dart(f: str, t: str) -> Column:
    return F.struct(F.col(f).alias("f"), F.col(t).alias("t"))


def ranked(darts: DataFrame) -> DataFrame:
    """d, last, steps, least, ended: of each dart (f, t, nf, nt) the last one of its line and the steps to it; on a closed line,
    where ``ended`` is false, its least dart instead. Rounds go on while any pointer or least dart still changes."""
    last = F.col("nt").isNull()
    state = written(darts.select(_dart("f", "t").alias("d"), F.when(last, _dart("f", "t")).otherwise(_dart("nf", "nt")).alias("last"), F.when(last, 0).otherwise(1).cast("long").alias("steps"), _dart("f", "t").alias("least"), last.alias("ended")))
    while True:
        open_ = state.where(~F.col("ended"))
        to = state.select(F.col("d").alias("last"), F.col("last").alias("_last"), F.col("steps").alias("_steps"), F.col("least").alias("_least"), F.col("ended").alias("_ended"))
        moved = open_.join(to, "last").select("d", F.col("_last").alias("last"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("least", "_least").alias("least"), F.col("_ended").alias("ended"), (F.col("_ended") | (F.col("_least") < F.col("least"))).alias("_changed"))
        new = written(state.where("ended").withColumn("_changed", F.lit(False)).unionByName(moved))
        goes_on = new.where("_changed").limit(1).count()
        state = new.drop("_changed")
        if not goes_on:
            return state


def chained(edges: DataFrame) -> DataFrame:
    """from, to, closed, place, a, b: the edges (a, b; undirected, repeats and loops dropped) in lines.

    A line is named by its first edge. It begins at the lesser of its two ends; a closed one at its least
    point, in the direction of the lesser neighbour. ``place`` counts from 0, a and b follow the line. Tables of
    the rounds are removed when the lines are written.
    """
    return scoped(edges.sparkSession, lambda: _chained(edges))


def _chained(edges: DataFrame) -> DataFrame:
    once = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("f"), F.greatest("a", "b").alias("t")).distinct()
    darts = written(_pairs(written(once.union(once.select("t", "f")))))
    state = ranked(darts)
    turned = state.select(F.struct(F.col("d.t").alias("f"), F.col("d.f").alias("t")).alias("d"), F.col("last").alias("_last"), F.col("steps").alias("_steps"), F.col("least").alias("_least"))
    both = written(state.join(turned, "d"))
    # An open line begins where its other direction ends; of the two directions the one with the lesser first point stays.
    begin = F.struct(F.col("_last.t").alias("f"), F.col("_last.f").alias("t"))
    line = both.where(F.col("ended") & (F.col("_last.t") < F.col("last.t"))).select(begin.alias("first"), F.lit(False).alias("closed"), F.col("_steps").alias("place"), "d")
    ring = both.where(~F.col("ended") & (F.col("least") < F.col("_least"))).select("d", F.col("least").alias("first"))
    # A closed line is cut before its least dart and ranked again; steps to the end, counted from the other side.
    cut = darts.withColumn("d", _dart("f", "t")).join(ring, "d").select("f", "t", *(F.when((F.col("nf") == F.col("first.f")) & (F.col("nt") == F.col("first.t")), None).otherwise(F.col(c)).alias(c) for c in ("nf", "nt")), "first")
    cut = written(cut)
    again = ranked(cut.drop("first")).select("d", "steps").join(cut.select(_dart("f", "t").alias("d"), "first"), "d")
    size = again.groupBy("first").agg(F.max("steps").alias("_most"))
    loops = again.join(size, "first").select("first", F.lit(True).alias("closed"), (F.col("_most") - F.col("steps")).alias("place"), "d")
    out = line.unionByName(loops)
    return out.select(F.col("first.f").alias("from"), F.col("first.t").alias("to"), "closed", F.col("place").cast("long").alias("place"), F.col("d.f").alias("a"), F.col("d.t").alias("b"))
