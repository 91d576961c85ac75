"""Connected components of an edge table, and of the links among candidates that share keys, in
DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import BROADCAST_KEYS, scoped, small, written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its component's least node) for each node of ``edges`` (a, b: long).

    Each round every part hooks onto its least neighbouring part, the hooks are followed to their
    ends by doubling, and the edges are rewritten between the parts that remain; a component of n
    nodes takes O(log n) rounds. All tables stay distributed; each round's are written to the
    shared folder, so that a lost executor costs one round's work at most. A hot node only meets
    sums and joins that Spark combines before the shuffle or splits. Tables of the rounds are removed with the last.
    """
    return scoped(edges.sparkSession, lambda: _components(edges))


def _components(edges: DataFrame) -> DataFrame:
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    labels = written(nodes.select("node", F.col("node").alias("component")))
    while left.limit(1).count():
        both = left.select("a", "b").union(left.select("b", "a"))
        hooks = written(both.groupBy(F.col("a").alias("part")).agg(F.min("b").alias("low")).select("part", F.least("part", "low").alias("to")))
        while True:
            further = hooks.select(F.col("part").alias("to"), F.col("to").alias("end"))
            stepped = hooks.join(further, "to").select("part", F.col("end").alias("next"), (F.col("end") != F.col("to")).alias("moved"))
            stepped = written(stepped)
            hooks = stepped.select("part", F.col("next").alias("to"))
            if not stepped.where("moved").limit(1).count():
                break
        end = hooks.select(F.col("part").alias("component"), "to")
        labels = written(labels.join(end, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        for side in ("a", "b"):
            left = left.join(hooks.select(F.col("part").alias(side), F.col("to").alias(f"{side}_to")), side, "left").withColumn(side, F.coalesce(f"{side}_to", side)).drop(f"{side}_to")
        left = written(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


#: node, most (its elements at most), bits (of each element's hash one is set) of every node; how many longs ``bits`` has.
Marks = tuple[DataFrame, int]


def linked(percent: int) -> F.Column:
    """Whether a pair with overlap ``both`` and sizes x, y has a Jaccard coefficient of so many percent."""
    return 100 * F.col("both") >= percent * (F.col("x") + F.col("y") - F.col("both"))


#: Keys of so many nodes besides their hub, or fewer, are compared pair by pair.
FEW = 8
#: The number of classes of distances to the reference that a linked pair's distance spans, about.
CLASSES = 6
#: Elements that more of a reference's nodes than this have among their first differences go last in the order.
COMMON = 16
#: At most so many of a reference's elements go last, the most frequent ones (a list of 128 KB).
LATE = 16_384
#: References of so many nodes or fewer have their nodes compared pair by pair, by marks: that costs a node about as much
#: as one comparison of sets.
MARKED = 2_048


def hubs(members: DataFrame) -> DataFrame:
    """key, n (its nodes), a (node), b (hub) for each node of a key but its hub: the node that
    shares its keys with the most others. Among copies of one text, that differs least from all."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    ranked = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("fame"))
    best = members.join(ranked, "node").groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("fame", "node")).alias("best"))
    return members.join(best, "key").select("key", "n", F.col("node").alias("a"), F.col("best.node").alias("b")).where("a <> b")


def _may_link(percent: int, p: str, q: str, words: int) -> F.Column:
    """Whether marks (most_p, bits_p, most_q, bits_q) leave it open that two nodes link. A bit that only one of them has
    takes an element that only one of them has, and a link leaves few of those: no link is ever ruled out."""
    bits = lambda c, i: F.get(f"bits_{c}", F.lit(i))
    apart = sum((F.bit_count(bits(p, i).bitwiseXOR(bits(q, i))) for i in range(words)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col(f"most_{p}") + F.col(f"most_{q}"))


def asked_for(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``table`` (node and more) whose node stands in the pairs (a, b): what no pair needs isn't shuffled for
    them. The whole table where the pairs' nodes are too many to be broadcast."""
    nodes = written(pairs.select(F.col("a").alias("of")).union(pairs.select("b")).distinct())
    n = nodes.count()
    return table.join(small(nodes, n, BROADCAST_KEYS), F.col("node") == F.col("of"), "left_semi") if n <= BROADCAST_KEYS else table


def _marks_of(marks: DataFrame, c: str) -> DataFrame:
    """The marks with the names of a pair's side ``c``."""
    return marks.select(F.col("node").alias(c), F.col("most").alias(f"most_{c}"), F.col("bits").alias(f"bits_{c}"))


def possible(pairs: DataFrame, marks: Marks | None, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by their ``marks``; all of them without marks."""
    if marks is None:
        return pairs.select("a", "b")
    found = asked_for(marks[0], pairs)
    both = pairs.select("a", "b").join(_marks_of(found, "a"), "a").join(_marks_of(found, "b"), "b")
    return both.where(_may_link(percent, "a", "b", marks[1])).select("a", "b")


def together(cluster: DataFrame, marks: Marks, percent: int) -> DataFrame:
    """a, b: the pairs that may link by their marks, of nodes of one reference that aren't of one component, and of
    nodes and their reference."""
    found = asked_for(marks[0], cluster)
    side = lambda c: cluster.select(F.col("b").alias(f"b_{c}"), F.col("a").alias(c), F.col("component").alias(f"part_{c}")).join(_marks_of(found, c), c)
    met = side("p").join(side("q"), F.expr("b_p = b_q and part_p <> part_q and p < q") & _may_link(percent, "p", "q", marks[1]))
    return met.select(F.col("p").alias("a"), F.col("q").alias("b")).union(possible(cluster, marks, percent)).distinct()


def resolved(members: DataFrame, compare: Callable[[DataFrame], DataFrame], differences: Callable[[DataFrame], DataFrame], percent: int, marks: Marks | None = None) -> DataFrame:
    """node, component of all nodes with links, where nodes that share a key are candidates.

    ``members`` (key, node) has the nodes of every key that two or more hold; ``compare`` maps pairs
    (a, b) to rows (a, b, x, y, both), the sizes and the overlap of their sets, and ``differences``
    to rows (a, b, mine, theirs), the elements that only a has, and only b (with ``marks`` also x and y). ``marks``, if
    given, spare what cannot link by them any comparison: pairs are compared only where ``possible``, and the nodes of a
    reference are tried ``together`` where it has at most ``MARKED``.

    Each node is compared with the hubs of its keys only, not with all others of them. What links to
    the same hub is of one component, so pairs of a key are left to try only if one of them doesn't link
    to the hub and they are not yet of one component. Within keys of at most ``FEW`` such nodes they are
    compared; those of larger keys are joined on their *differences from a reference* (see ``nearby``), where what a
    whole group shares has cancelled out. The hubs of one component have one reference (see ``referred``), so a node has a
    row for each component that its keys' hubs are of, not for each hub. So a large group of similar sets costs
    a comparison for each set, and no link between components is lost.
    """
    routes = written(hubs(members))
    asked = written(routes.select("a", "b").distinct())
    asked = asked if marks is None else written(possible(asked, marks, percent))
    tried = written(compare(asked).select("a", "b", "x", "y", linked(percent).alias("linked")))
    parts = components(tried.where("linked").select("a", "b"))
    left = routes.where("n > 2").join(tried, ["a", "b"], "inner" if marks is None else "left").join(parts.select(F.col("node").alias("a"), "component"), "a", "left")
    left = left.withColumns({"component": F.coalesce("component", "a"), "linked": F.coalesce("linked", F.lit(False))})
    split = left.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left = written(left.join(split, "key", "left_semi"))

    one = left.where((F.col("n") <= FEW + 1) & ~F.col("linked")).select("key", F.col("a").alias("p"), F.col("x").alias("x_p"), F.col("component").alias("part_p"))
    two = left.where(F.col("n") <= FEW + 1).select("key", F.col("a").alias("q"), F.col("x").alias("x_q"), F.col("component").alias("part_q"), F.col("linked").alias("linked_q"))
    # sizes are known of what was compared
    sized = F.coalesce(F.least("x_p", "x_q") * 100 >= percent * F.greatest("x_p", "x_q"), F.lit(True))
    pairs = one.join(two, "key").where(F.expr("part_p <> part_q and (linked_q or p < q)") & sized)
    pairs = written(pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    pairs = pairs if marks is None else written(possible(pairs, marks, percent))
    if pairs.limit(1).count():
        parts = extended(parts, compare(pairs).where(linked(percent)).select("a", "b"))

    cluster = written(referred(left.where(F.col("n") > FEW + 1).select("a", "b", "x", "y").distinct(), parts))
    if marks is not None and cluster.limit(1).count():
        few = F.col("of_b") <= MARKED
        cluster = written(cluster.join(cluster.groupBy("b").agg(F.count("*").alias("of_b")), "b"))
        pairs = written(together(cluster.where(few), marks, percent))
        if pairs.limit(1).count():
            parts = extended(parts, compare(pairs).where(linked(percent)).select("a", "b"))
        cluster = cluster.where(~few).drop("of_b")
    if cluster.limit(1).count():
        parts = extended(parts, scoped(members.sparkSession, lambda: distant(cluster, differences, percent, marks)))
    return parts


def referred(cluster: DataFrame, parts: DataFrame) -> DataFrame:
    """a, b, x, y, component of each node and each reference of its hubs: the hub ``b`` with the most nodes stands
    for all hubs of its component. Nodes of one hub have one reference; those that are of one component already go."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
    cluster = written(cluster.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"component": F.coalesce("part_a", "a"), "whole": F.coalesce("part_b", "b")}))
    best = cluster.groupBy("whole", "b").agg(F.count("*").alias("n"), F.max("y").alias("y"))
    best = best.groupBy("whole").agg(F.max(F.struct("n", "b", "y")).alias("best"))
    split = cluster.where("component <> whole").select("whole").distinct()
    rows = cluster.groupBy("whole", "a", "component").agg(F.max("x").alias("x")).join(split, "whole", "left_semi").join(best, "whole")
    return rows.select("a", "best.b", "x", "best.y", "component").where("a <> b")


def distant(cluster: DataFrame, differences: Callable[[DataFrame], DataFrame], percent: int, marks: Marks | None = None) -> DataFrame:
    """a, b: the links of a reference with its nodes, and those among its nodes that ``nearby`` finds, by their
    differences from the reference."""
    diff = F.concat(F.sort_array("mine"), F.sort_array("theirs"))
    both = (F.col("x") + F.col("y") - F.size("diff")) / 2
    found = differences(cluster.select("a", "b"))
    cluster = cluster.drop("x", "y") if "x" in found.columns else cluster
    cluster = cluster.join(found, ["a", "b"]).withColumn("diff", diff).drop("mine", "theirs")
    cluster = written(cluster.withColumn("both", both).withColumn("linked", linked(percent)).drop("both"))
    side = lambda c: cluster.select("b", F.col("a").alias(c), F.col("x").alias(f"x_{c}"), F.col("diff").alias(f"diff_{c}"))
    met = written(nearby(cluster, percent).distinct())
    if marks is not None:
        open_ = possible(written(met.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()), marks, percent)
        met = written(met.join(open_.withColumnsRenamed({"a": "p", "b": "q"}), ["p", "q"], "left_semi"))
    checked = met.join(side("p"), ["b", "p"]).join(side("q"), ["b", "q"])
    apart = F.size("diff_p") + F.size("diff_q") - 2 * F.size(F.array_intersect("diff_p", "diff_q"))
    checked = checked.withColumn("both", (F.col("x_p") + F.col("x_q") - apart) / 2).withColumnsRenamed({"x_p": "x", "x_q": "y"})
    checked = checked.where(linked(percent)).select(F.col("p").alias("a"), F.col("q").alias("b"))
    return checked.union(cluster.where("linked").select("a", "b"))


def extended(parts: DataFrame, links: DataFrame) -> DataFrame:
    """node, component with further links (a, b): what they join are single nodes, or components so far."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
    ends = written(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("part_a", "a").alias("x"), F.coalesce("part_b", "b").alias("y")).where("x <> y"))
    if not ends.limit(1).count():
        return parts
    whole = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    alone = ends.where("a = x").select("a").union(ends.where("b = y").select("b")).distinct().toDF("node").join(parts, "node", "left_anti").select("node", F.col("node").alias("component"))
    return written(parts.union(alone).join(whole, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))


def _bit(c: str) -> F.Column:
    """One of 64 bits for a class."""
    return F.expr(f"shiftleft(1L, {c} % 64)")


def nearby(cluster: DataFrame, percent: int) -> DataFrame:
    """b, p, q: the pairs of a reference's nodes that can link, are not of one component, and of which ``p``
    doesn't link to the reference ``b`` (a superset, found by a prefix filter on their differences).

    With sizes x, y and differences of d, e elements from it, two sets differ in d + e - 2 * o
    elements if o of those are common, so a link needs o of at least (d + e - c * (x + y)) / 2,
    where c = (100 - percent) / (100 + percent). That is positive unless both link to it. Under any
    order of the elements, two lists that share o elements share one within their first d - o + 1 and e - o + 1;
    as o grows with the other's distance, these are cut for each class of the other's distance apart.

    The order: what the reference lacks, then what it has, and last what more than ``COMMON`` of its nodes have among
    their first elements (in large clusters, more than a ``LATE``-th of all first elements). Only first elements are ever
    sent, and of them only those that a node of another component has as well, where one of both doesn't link to the reference.
    """
    c, span = (100 - percent) / (100 + percent), 100 / percent
    width = F.greatest(F.lit(1), F.floor(2 * c * F.col("y") / CLASSES)).cast("int")
    many = cluster.select("b", "a", "x", "y", "linked", F.col("component").alias("part"), "diff", F.size("diff").alias("d"), width.alias("width"))
    many = many.withColumn("class", F.floor(F.col("d") / F.col("width")).cast("int"))
    reach = (c * (1 + span) * F.col("x") / F.col("width")).cast("int") + 1
    lowest = F.greatest(F.lit(0), F.col("class") - reach)

    def least(other: F.Column) -> F.Column:
        """The fewest elements common with any node of a class that links."""
        e = other * F.col("width")
        return F.greatest(F.lit(1), F.ceil((F.col("d") + e - c * (F.col("x") + F.least(span * F.col("x"), F.col("y") + e))) / 2 - 1e-6)).cast("int")

    many = many.withColumns({"lowest": lowest, "highest": F.col("class") + reach}).withColumn("most", F.greatest(F.lit(0), F.col("d") - least(F.col("lowest")) + 1))
    heads = many.select("b", F.explode(F.slice("diff", 1, F.col("most"))).alias("e")).groupBy("b", "e").agg(F.count("*").alias("times"))
    heads = heads.join(heads.groupBy("b").agg(F.sum("times").alias("total")), "b")
    # fewer than LATE elements can each have more than a LATE-th of all
    common = heads.where((F.col("times") > COMMON) & (F.col("times") > F.col("total") / LATE)).groupBy("b").agg(F.collect_list("e").alias("common"))
    many = many.join(common, "b", "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))
    many = many.withColumn("diff", F.concat(F.array_except("diff", "common"), F.array_intersect("diff", "common"))).drop("common")
    many = written(many.withColumn("diff", F.slice("diff", 1, F.col("most"))))
    each = many.select("b", "a", "part", "linked", "class", F.posexplode("diff").alias("i", "e"))
    held = each.groupBy("b", "e").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.bit_or(_bit("class")).alias("any"), F.bit_or(F.when(~F.col("linked"), _bit("class"))).alias("free"))
    held = held.where("low < high and free is not null").select("b", "e", "any", "free")
    shared = each.select("b", "a", "i", "e").join(held, ["b", "e"]).join(many.drop("diff"), ["b", "a"])
    # classes that have the element, as bits (several classes share one of 64): only for those is a row made
    met = F.when(F.col("linked"), F.col("free")).otherwise(F.col("any"))
    shared = shared.withColumn("met", met).withColumn("others", F.expr("filter(sequence(lowest, highest), c -> shiftright(met, c % 64) % 2 <> 0)"))
    rows = shared.withColumn("other", F.explode("others"))
    rows = rows.withColumn("least", least(F.col("other"))).where(F.col("least") < (F.col("other") + 1) * F.col("width")).where("i <= d - least")
    rows = written(rows.select("b", "e", F.least("class", "other").alias("lo"), F.greatest("class", "other").alias("hi"), "a", "class", "linked", "part", "x", "d", "i"))
    names = ["class", "part", "x", "d", "i"]
    one = rows.where("not linked").select("b", "e", "lo", "hi", F.col("a").alias("p"), *names)
    two = rows.select("b", "e", "lo", "hi", F.col("a").alias("q"), F.col("linked").alias("linked_q"), *(F.col(n).alias(f"{n}_q") for n in names))
    # what can be common at most, by the places of a common element in both lists, against what a link needs
    may = F.least("i", "i_q") + F.least(F.col("d") - F.col("i"), F.col("d_q") - F.col("i_q"))
    fits = (2 * may >= F.col("d") + F.col("d_q") - c * (F.col("x") + F.col("x_q")) - 1e-6) & (100 * F.least("x", "x_q") >= percent * F.greatest("x", "x_q"))
    met = one.join(two, ["b", "e", "lo", "hi"]).where(F.expr("part <> part_q and (linked_q or p < q) and (class <> class_q or lo = hi)") & fits)
    return met.select("b", "p", "q")
