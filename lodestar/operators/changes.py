"""Comparing snapshots: fuzzy pairing, field diffs, routes, merges."""

from __future__ import annotations

from collections import defaultdict
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fields whose change a person must see, and the least confidence to do without.
CRITICAL = ("screening.dbs", "screening.references", "screening.interview", "screening.min_age", "screening.induction", "status", "next_intake", "stated_places")
LEAST_CONFIDENCE = 0.85
LEAST_LIKENESS = 0.72
REFUSED = (401, 403, 429, 451)
DEAD_AFTER = 2


@F.pandas_udf(DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of each pair of titles; 0 where bounds of it show that it is less than the least."""
    matcher, last, out = SequenceMatcher(None), None, []
    for x, y in zip(a, b):
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        fits = matcher.real_quick_ratio() >= LEAST_LIKENESS and matcher.quick_ratio() >= LEAST_LIKENESS
        out.append(matcher.ratio() if fits else 0.0)
    return pd.Series(out, dtype="float64")


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """One group's pairs, the most alike first; of equal ones the later old row, then the later new row. Rows of
    kind o and n have id, title and ord; those of kind s are title pairs (title, other) with their likeness."""
    side = lambda k: rows[rows["kind"] == k].sort_values("ord", kind="stable")
    olds, news, scores = side("o"), side("n"), rows[rows["kind"] == "s"]
    old_ids, new_ids = olds["id"].tolist(), news["id"].tolist()
    mine, theirs = defaultdict(list), defaultdict(list)  # places of the free rows of a title, ascending
    for i, t in enumerate(olds["title"]):
        mine[t].append(i)
    for j, t in enumerate(news["title"]):
        theirs[t].append(j)
    group, pairs = rows["group"].iloc[0], []
    for r, level in sorted(scores.groupby("likeness"), key=lambda x: -x[0]):
        partners = defaultdict(list)
        for a, b in zip(level["title"], level["other"]):
            partners[a].append(b)
        for i, a in sorted(((i, a) for a in partners for i in mine[a]), reverse=True):
            best = max((b for b in partners[a] if theirs[b]), key=lambda b: theirs[b][-1], default=None)
            if best is not None:
                mine[a].remove(i)
                pairs.append((group, old_ids[i], new_ids[theirs[best].pop()], r))
    pairs += [(group, old_ids[i], None, None) for i in sorted(i for left in mine.values() for i in left)]
    pairs += [(group, None, new_ids[j], None) for j in sorted(j for left in theirs.values() for j in left)]
    return pd.DataFrame(pairs, columns=["group", "old_id", "new_id", "likeness"])


def paired(old: DataFrame, new: DataFrame, by: str, least: float = LEAST_LIKENESS) -> DataFrame:
    """One-to-one pairs of similar titles inside each group: by, old_id, new_id, likeness.

    Inputs have ``by``, id, title and ord (their order). The most alike pair first; of equal ones the
    later old row, then the later new row. Rows without a partner have a null other side. Each pair of
    different titles that meet in any group is scored once, whatever the number of rows that have them, and
    only where their lengths allow it; groups then choose among the scored titles. The rows of a group must fit a
    task (an organisation's roles do).
    """
    if least < LEAST_LIKENESS:
        raise ValueError(f"titles are only scored from {LEAST_LIKENESS} on")
    side = lambda df, kind: df.select(F.col(by).cast("string").alias("group"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.col("ord").cast("long").alias("ord"))
    olds, news = side(old, "o"), side(new, "n")
    met = olds.select("group", "title").distinct().join(news.select("group", F.col("title").alias("other")).distinct(), "group")
    a, b = F.length("title"), F.length("other")
    met = met.where((a + b == 0) | (2 * F.least(a, b) >= least * (a + b)))
    # equal titles score 1; empty ones are alike as well
    scores = met.select("title", "other").distinct().withColumn("likeness", F.when(F.col("title") == F.col("other"), 1.0).otherwise(_likeness("title", "other"))).where(F.col("likeness") >= least)
    scored = met.join(scores, ["title", "other"]).select("group", F.lit("s").alias("kind"), "title", "other", "likeness")
    every = olds.unionByName(news).unionByName(scored, allowMissingColumns=True)
    out = every.groupBy("group").applyInPandas(_greedy, "group string, old_id string, new_id string, likeness double")
    return out.withColumnRenamed("group", by)


def diff(fields: dict[str, tuple[Column, Column]]) -> Column:
    """The sorted names of fields whose two values differ; null equals null."""
    return F.array_sort(F.array_compact(F.array(*(F.when(~a.eqNullSafe(b), F.lit(name)) for name, (a, b) in fields.items()))))


def flattened(record: Column, paths: dict[str, str]) -> dict[str, Column]:
    """Name -> comparable value of each dotted path: arrays sorted, empty ones null."""
    out = {}
    for name, kind in paths.items():
        value = record[name.split(".")[0]] if "." not in name else record
        if "." in name:
            for part in name.split("."):
                value = value[part]
        out[name] = F.when(F.size(value) > 0, F.array_sort(F.transform(value, lambda x: x.cast("string")))) if kind == "array" else value
    return out


def snapshots(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, kind (pair, added or gone), old, new (structs of the rows) of two snapshots."""
    a = old.select(key, F.struct(*old.columns).alias("old"))
    b = new.select(key, F.struct(*new.columns).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").otherwise("pair")
    return a.join(b, key, "full_outer").select(key, kind.alias("kind"), "old", "new")


def with_value(record: Column, path: str, value: Column) -> Column:
    """A record with the field at a dotted path set; a null record on the way stays null."""
    head, _, rest = path.partition(".")
    return record.withField(head, with_value(record[head], rest, value) if rest else value)


def route(changed: Column, confidence: Column, critical: tuple[str, ...] = CRITICAL, least: float = LEAST_CONFIDENCE) -> Column:
    """auto or review for the changed fields of one record; null where the record is new or gone
    must be turned to review by the caller's join."""
    risky = F.arrays_overlap(changed, F.array(*map(F.lit, critical)))
    return F.when(changed.isNull(), "review").when(F.size(changed) == 0, "auto").when(risky, "review").when(confidence.isNull() | (confidence < least), "review").otherwise("auto")


def route_reasons(changed: Column, confidence: Column, critical: tuple[str, ...] = CRITICAL, least: float = LEAST_CONFIDENCE) -> Column:
    """Why a change goes to review."""
    risky = F.array_intersect(changed, F.array(*map(F.lit, critical)))
    return F.array_compact(F.array(F.when(changed.isNull(), F.lit("new or gone")), F.when(F.size(risky) > 0, F.concat(F.lit("critical: "), F.array_join(risky, ", "))), F.when((F.size(changed) > 0) & (confidence.isNull() | (confidence < least)), F.lit("low confidence"))))


def route_of_all(routes: Column) -> Column:
    """The route of a group: any review wins, and no record at all is a review."""
    return F.when(F.count(routes) == 0, "review").when(F.bool_or(routes == "review"), "review").otherwise("auto")


def failure_route(status: Column, failures: Column) -> Column:
    """refused, dead or retry for a failed fetch; refusals don't count as failures."""
    return F.when(status.isin(*REFUSED), "refused").when(failures >= DEAD_AFTER, "dead").otherwise("retry")


def blank(value: Column) -> Column:
    return value.isNull() | value.cast("string").isin("", "unknown")


def carried(old: Column, new: Column) -> Column:
    """The new value, or the old one where the new is blank and the old isn't."""
    return F.when(blank(new) & ~blank(old), old).otherwise(new)


def carried_notes(old: Column, new: Column, old_domain: Column, new_domain: Column) -> Column:
    """New notes, and old ones that name the link's domain where it stayed the same."""
    named = F.filter(old, lambda n: n.contains(old_domain))
    return F.when(old_domain == new_domain, F.array_union(new, named)).otherwise(new)


def upsert_actions(old: DataFrame, new: DataFrame, key: str, changed: Column, retire: Column) -> DataFrame:
    """key, action of each row of a full outer join aliased ``o`` and ``n``: insert, retire,
    update, keep, untouched."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    action = F.when(F.col(f"o.{key}").isNull(), "insert").when(F.col(f"n.{key}").isNull(), "untouched").when(retire, "retire").when(changed, "update").otherwise("keep")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), action.alias("action"))


def suffixed(df: DataFrame, base: str, order: list[Column], out: str = "id", taken: DataFrame | None = None) -> DataFrame:
    """base, base-2, base-3 … in order, but for names that are taken: the ids of ``taken`` (id), and
    all bases themselves."""
    names = df.select(F.col(base).alias("_t"))
    own = names.limit(0) if taken is None else taken.select(F.col("id").cast("string").alias("_t"))
    tail = F.expr("try_cast(regexp_extract(_t, '-([1-9][0-9]{0,8})$', 1) as int)")
    used = names.union(own).distinct().select(F.regexp_extract("_t", "^(.*)-[1-9][0-9]{0,8}$", 1).alias("_b"), tail.alias("_k")).where("_k >= 2")
    each = used.union(own.distinct().select("_t", F.lit(1))).groupBy("_b").agg(F.array_sort(F.collect_set("_k")).alias("_used"))
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    numbered = df.withColumn("_n", n).join(each, F.col(base) == F.col("_b"), "left")
    # the n-th number that isn't used: each used one up to it moves it on by one
    free = F.aggregate(F.coalesce("_used", F.array().cast("array<int>")), F.col("_n"), lambda a, u: F.when(u <= a, a + 1).otherwise(a))
    return numbered.withColumn("_n", free).withColumn(out, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), F.col("_n").cast("string")))).drop("_n", "_b", "_used")


def taken_clashes(df: DataFrame, col: str) -> DataFrame:
    """Ids that more than one row has, and how many."""
    return df.groupBy(col).agg(F.count("*").alias("n")).where("n > 1")


def rename_hints(added: DataFrame, gone: DataFrame, group: str, same: str) -> DataFrame:
    """Pairs of an added and a gone row of a group that agree on a column."""
    a = added.select(group, same, F.col("id").alias("added_id"))
    return a.join(gone.select(group, same, F.col("id").alias("gone_id")), [group, same])
