"""Joins that look for what is missing, gone, near or contained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import title_key


def feed_gaps(feed: DataFrame, held: DataFrame) -> DataFrame:
    """kind (missing or gone), link, title. A slash at a link's end doesn't count.

    Missing: offers of the feed (title, link) whose title's key and whose link are both not held.
    Gone: held offers whose link the feed lacks, below a prefix (scheme, host, first folder) of the feed.
    """
    bare = F.rtrim(F.coalesce("link", F.lit("")), F.lit("/"))
    prefix = F.concat(F.substring_index("link", "/", 4), F.lit("/"))
    deep = F.size(F.split("link", "/")) > 4
    feed, held = feed.select("title", "link", bare.alias("bare")), held.select("title", "link", bare.alias("bare"))
    keys = held.select(title_key(F.col("title")).alias("key")).distinct()
    missing = feed.withColumn("key", title_key(F.col("title"))).join(keys, "key", "left_anti").join(held.select("bare").distinct(), "bare", "left_anti").select(F.lit("missing").alias("kind"), "link", "title")
    prefixes = feed.where(deep).select(prefix.alias("prefix")).distinct()
    gone = held.where(deep).withColumn("prefix", prefix).join(feed.select("bare").distinct(), "bare", "left_anti").join(prefixes, "prefix", "left_semi").select(F.lit("gone").alias("kind"), "link", "title")
    return missing.unionByName(gone)


def without_either(df: DataFrame, other: DataFrame, keys: list[tuple[Column, Column]]) -> DataFrame:
    """Rows of ``df`` that match no row of ``other`` on any of the key pairs: one anti join each."""
    for i, (mine, theirs) in enumerate(keys):
        df = df.withColumn(f"_k{i}", mine).join(other.select(theirs.alias(f"_k{i}")).where(f"_k{i} is not null").distinct(), f"_k{i}", "left_anti").drop(f"_k{i}")
    return df


def collapsed(df: DataFrame, text: Column, rules: list[tuple[str, str]]) -> DataFrame:
    """title, n: rows whose text matches a rule (pattern, title) become one row a rule with their
    count; the first rule wins, and the others stay as they are with n = 1."""
    title = F
    for pattern, name in rules:
        title = title.when(F.lower(text).rlike(pattern), F.lit(name))
    tagged = df.select(title.otherwise(F.lit(None)).alias("rule"), text.alias("title"))
    grouped = tagged.where("rule is not null").groupBy(F.col("rule").alias("title")).agg(F.count("*").alias("n"))
    return grouped.unionByName(tagged.where("rule is null").select("title", F.lit(1).cast("long").alias("n")))


def bands(pairs: DataFrame, minutes: Column, limits: list[int], key: str, item: str) -> DataFrame:
    """key, band, items: each item in every band that reaches it; null minutes are dropped."""
    each = F.explode(F.filter(F.array(*map(F.lit, limits)), lambda b: minutes <= b))
    return pairs.where(minutes.isNotNull()).select(key, each.alias("band"), item).groupBy(key, "band").agg(F.array_sort(F.collect_set(item)).alias("items"))


def newest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def followed(found: DataFrame, level: int, deeper: int, most: int) -> DataFrame:
    """The pages that a further round can still add to: enough found in the last, and not yet ``most`` in all."""
    counts = found.groupBy("page").agg(F.count("*").alias("all"), F.count_if(F.col("level") == level).alias("n"))
    return counts.where((F.col("n") >= deeper) & (F.col("all") < most)).select("page")


def crawl(start: DataFrame, links: DataFrame, depth: int = 2, most: int = 15, deeper: int = 2, known: DataFrame | None = None) -> DataFrame:
    """page, target, level, pos, place: links followed breadth first from each page, ``depth`` rounds, at most
    ``most`` targets a page in order of level and position, pages that were known before (``known``: page,
    target, pos) first; a further round only for pages whose last found ``deeper`` targets or more.
    ``links`` has source, target, pos. What a page's cap leaves out isn't followed, nor anything of a page that has
    ``most`` targets already, since later ones come after them; so a round makes at most ``most`` times the links of a source."""
    first = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy("page").orderBy("pos", "target"))).where(F.col("_n") <= most).drop("_n")
    home = start.select("page", F.col("page").alias("target"))
    found = known.select("page", "target", F.lit(0).alias("level"), F.col("pos").cast("long").alias("pos")).where("page <> target") if known is not None else None
    frontier = home if found is None else home.union(found.select("page", "target"))
    for level in range(1, depth + 1):
        seen = home if found is None else home.union(found.select("page", "target"))
        step = frontier.select("page", F.col("target").alias("source")).join(links, "source").groupBy("page", "target").agg(F.min("pos").cast("long").alias("pos"))
        step = first(step.join(seen, ["page", "target"], "left_anti")).select("page", "target", F.lit(level).alias("level"), "pos")
        found = step if found is None else found.unionByName(step)
        if level < depth:
            frontier = step.join(followed(found, level, deeper, most), "page", "left_semi").select("page", "target")
    place = F.row_number().over(Window.partitionBy("page").orderBy("level", "pos", "target"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def unseen(now: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The distinct keys of ``now`` that ``seen`` lacks: decisions that a report hasn't named yet."""
    return now.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti")


def attributed(errors: DataFrame, orgs: DataFrame, roles: DataFrame) -> DataFrame:
    """org_id, error: errors ("id: text") with the organisation that they concern, whose own id or one of
    whose roles' ids (roles: id, org_id) stands before the colon; others are left out."""
    named = errors.withColumn("_id", F.substring_index("error", ":", 1))
    ids = orgs.select(F.col("org_id").cast("string").alias("_id"), "org_id").union(roles.select(F.col("id").cast("string").alias("_id"), "org_id")).distinct()
    return named.join(ids, "_id").select("org_id", "error").distinct()


def union_of_lists(df: DataFrame, by: list[str], values: str) -> DataFrame:
    """by, values: the sorted distinct items of an array column over each group's rows."""
    each = df.select(*by, F.explode_outer(values).alias("_v"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_set("_v")).alias(values))
