"""Hard negatives by inverted lists with radii.

Vectors become integers, floor(``SCALE`` * x), and scores are exact integer inner products. k-means centres, fitted on a
bounded sample, split all rows into lists; a list keeps its radius, the largest distance of a member from its centre c.
By Cauchy and Schwarz no member scores above a.c + |a| r with an anchor a, nor below a.c - |a| r. An anchor
first visits the ``FIRST`` lists of the highest bounds; the kth score found there decides which others it visits:
every list whose bound isn't strictly below it. A list that lies outside an anchor's window of scores is skipped. So the
result is exact for any centres; good ones save work.

An anchor searches twice: for its positives (the best rows of its label), then for its negatives (rows of other labels
in the window that a positive's score sets). In Spark, lists are blocks of about ``BLOCK`` rows, by a hash of the row, so
that a list of any length, copies of one vector included, is dealt to many tasks; anchors go in packs to the lists
that they visit, ``SPAN`` blocks at a time. A task keeps the best of each anchor over the blocks that it scans.

Cases: rows with a null label, a null vector, null or non-finite components take no part, nor do those of another
length than the smallest kept vec_id's or with components so large that scores don't fit 64 bits. Rows that share a
vec_id are rows of their own: each is an anchor, and the other's positive; ties go to the smaller vec_id, null ids
last. Where a positive's score is below 0 its window is empty. An empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, written

SCALE, EVERY, SHIFTED, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score, in hundredths: LEAST * positive <= 100 * negative <= MOST * positive.
LEAST, MOST = 30, 90
#: Lists, rows that they are fitted on, and rounds of fitting.
LISTS, FIT_ROWS, FIT_ROUNDS = 64, 20_000, 8
#: Lists that an anchor visits before it has a score to beat.
FIRST = 2
#: Rows of a block, blocks that a pack of anchors meets in one task, anchors of a pack.
BLOCK, SPAN, PACK = 4096, 64, 256
#: Integers below this have exact sums in float64.
EXACT = 2**53
NO_ID = 2**63 - 1
ROW = "rid long, vec_id long, label long, v array<long>"
FOUND = "rid long, slot int, of long, vec_id long, score long"
WANTED = "rid long, label long, v array<long>, slot array<int>, low array<long>, high array<long>, least array<long>"


def prepared(df: DataFrame) -> DataFrame:
    """rid, vec_id, label, v: the rows that take part, as integers, each with a number of its own; written."""
    v = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = rows.where(F.col("label").isNotNull() & (F.size("v") > 0) & finite)
    bound = F.sqrt(F.lit(2.0**60) / F.size("v"))
    rows = rows.where(F.forall("v", lambda x: F.abs(x * SCALE) < bound - 1))
    label = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", label.alias("label"), F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))
    return written(rows)


def centres(rows: DataFrame, lists: int = LISTS) -> np.ndarray:
    """k-means centres of the rows whose hashes are below a bound, about ``FIT_ROWS`` of them. No task sends more than
    its share of the sample: a sorted limit would bring as many rows of every task to the driver."""
    share = FIT_ROWS / max(FIT_ROWS, rows.count())
    sample = rows.where(F.pmod(F.xxhash64("rid"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).orderBy("rid").select("v").toArrow()["v"]
    if not len(sample):
        return np.empty((0, 0))
    x = _matrix(sample.combine_chunks()).astype(np.float64)
    own = np.unique(x, axis=0)
    c = own[np.random.default_rng(13).choice(len(own), min(lists, len(own)), replace=False)]
    for _ in range(FIT_ROUNDS):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for e in np.unique(near):
            c[e] = x[near == e].mean(0)
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def listed(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """``rows`` with their list and their distance from its centre."""
    sent = rows.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = sent.value
        norms = (centre * centre).sum(1)
        for batch in batches:
            x = _matrix(batch.column(3)).astype(np.float64)
            near = (norms - 2 * x @ centre.T).argmin(1)
            far = np.sqrt(((x - centre[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far)], names=["rid", "vec_id", "label", "v", "list", "far"])

    return rows.mapInArrow(run, f"{ROW}, list int, far double")


class Lists:
    """What is known of the lists: centres, radii, spans of blocks. Bounds are widened by more than float64 can be off."""

    def __init__(self, c: np.ndarray, radius: np.ndarray, blocks: np.ndarray) -> None:
        self.c, self.radius, self.spans = c, radius, -(-blocks // SPAN)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that a member of each list may have with each row of ``x``."""
        x = x.astype(np.float64)
        middle, norm = x @ self.c.T, np.sqrt((x * x).sum(1))[:, None]
        slack = 1e-9 * norm * (self.radius + np.sqrt((self.c * self.c).sum(1))) + 1
        reach = norm * self.radius
        empty = self.spans == 0
        return np.where(empty, np.inf, middle - reach - slack), np.where(empty, -np.inf, middle + reach + slack)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, exactly."""
    if len(x) and len(y) and math.sqrt(float((x.astype(np.float64) ** 2).sum(1).max())) * math.sqrt(float((y.astype(np.float64) ** 2).sum(1).max())) < EXACT / 2:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def best(score: np.ndarray, vec_id: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k: higher scores, then smaller vec_ids, then smaller row numbers."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((of[some], vec_id[some], -score[some]))[:k]]
    return np.lexsort((of, vec_id, -score))[:k]


class Pack:
    """Anchors with their windows, and the best rows found for each window."""

    def __init__(self, rid: np.ndarray, label: np.ndarray, x: np.ndarray, slot: list, low: list, high: list, least: list, same: bool, k: int) -> None:
        self.rid, self.label, self.x, self.same, self.k = rid, label, x, same, k
        self.windows = [(i, s, lo, hi, kth) for i in range(len(rid)) for s, lo, hi, kth in zip(slot[i], low[i], high[i], least[i])]
        self.found = [np.empty((3, 0), np.int64) for _ in self.windows]
        self.floor = np.array([w[4] for w in self.windows], np.int64)
        self.norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))

    def scan(self, centre: np.ndarray, radius: float, of: np.ndarray, vec_id: np.ndarray, label: np.ndarray, y: np.ndarray) -> None:
        """Rows of a block that belong to a window; the block's bound is tried against the window's kth score first."""
        middle = self.x.astype(np.float64) @ centre
        slack = 1e-9 * self.norm * (radius + math.sqrt(float(centre @ centre))) + 1
        above, below = middle + self.norm * radius + slack, middle - self.norm * radius - slack
        tried = [n for n, (i, _, lo, hi, _) in enumerate(self.windows) if above[i] >= max(lo, self.floor[n]) and below[i] <= hi]
        if not tried:
            return
        score = scores(self.x, y)
        for n in tried:
            i, _, lo, hi, _ = self.windows[n]
            s = score[i]
            fits = (s >= max(lo, self.floor[n])) & (s <= hi)
            fits &= (label == self.label[i]) & (of != self.rid[i]) if self.same else label != self.label[i]
            at = np.flatnonzero(fits)
            if len(at):
                at = at[best(s[at], vec_id[at], of[at], self.k)]
                both = np.concatenate([self.found[n], np.stack([of[at], vec_id[at], s[at]])], axis=1)
                both = both[:, best(both[2], both[1], both[0], self.k)]
                self.found[n] = both
                if both.shape[1] == self.k:
                    self.floor[n] = max(self.floor[n], both[2, -1])

    def rows(self) -> pa.RecordBatch:
        """FOUND rows."""
        sizes = [f.shape[1] for f in self.found]
        of, vec_id, score = np.concatenate(self.found, axis=1) if self.found else np.empty((3, 0), np.int64)
        rid = np.repeat(np.array([self.rid[w[0]] for w in self.windows], np.int64), sizes)
        slot = np.repeat(np.array([w[1] for w in self.windows], np.int32), sizes)
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(slot, pa.int32()), pa.array(of), pa.array(vec_id, mask=vec_id == NO_ID), pa.array(score)], names=["rid", "slot", "of", "vec_id", "score"])


def _packed(table: pa.Table | pa.RecordBatch, columns: list[str]) -> list[bytes]:
    return [np.ascontiguousarray(table.column(c).to_numpy(zero_copy_only=False), np.int64).tobytes() for c in columns]


def blocks(rows: DataFrame) -> DataFrame:
    """list, span, block, radius and the members, packed: each row of the table holds one block."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column("vec_id").fill_null(NO_ID).to_numpy()
        one = [group.column(c)[0].as_py() for c in ("list", "span", "block")]
        x = np.array(group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64)
        whole = [max(group.column("far").to_pylist()), *_packed(group, ["rid"]), ids.astype(np.int64).tobytes(), *_packed(group, ["label"]), x.tobytes()]
        return pa.table({n: [v] for n, v in zip(("list", "span", "block", "radius", "of", "vec_id", "label", "x"), [*one, *whole])}, pa.schema([("list", pa.int32()), ("span", pa.int32()), ("block", pa.int32()), ("radius", pa.float64()), *((n, pa.binary()) for n in ("of", "vec_id", "label", "x"))]))

    return written(rows.groupBy("list", "span", "block").applyInArrow(pack, "list int, span int, block int, radius double, of binary, vec_id binary, label binary, x binary"))


def visits(wanted: DataFrame, lists: Lists, first: bool) -> DataFrame:
    """Packs of anchors beside each span of a list that they visit: the ``FIRST`` lists of the highest bounds that lie in
    one of the anchor's windows, or all others whose bound isn't below the score to beat."""
    sent = wanted.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, PACK):
                part = whole.slice(at, PACK)
                below, above = known.bounds(_matrix(part.column(2)))
                low, high, least = (part.column(c).to_pylist() for c in (4, 5, 6))
                can = np.zeros(above.shape, bool)  # a window and the list have scores in common
                beats = np.zeros(above.shape, bool)  # and the list's bound isn't below the score to beat
                for i in range(part.num_rows):
                    for lo, hi, kth in zip(low[i], high[i], least[i]):
                        inside = (above[i] >= lo) & (below[i] <= hi)
                        can[i] |= inside
                        beats[i] |= inside & (above[i] >= kth)
                order = np.argsort(-np.where(can, above, -np.inf), axis=1, kind="stable")
                head = np.zeros(above.shape, bool)
                np.put_along_axis(head, order[:, :FIRST], True, axis=1)
                go = can & head if first else beats & ~(can & head)
                for n in np.flatnonzero(go.any(0)):
                    some = part.filter(pa.array(go[:, n]))
                    x = _matrix(some.column(2))
                    for span in range(int(known.spans[n])):
                        columns = [[int(n)], [span], *([b] for b in _packed(some, ["rid", "label"])), [x.tobytes()], *([some.column(c).to_pylist()] for c in (3, 4, 5, 6))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _VISIT.types)], names=_VISIT.names)

    return wanted.select(*(c.split()[0] for c in WANTED.split(", "))).mapInArrow(run, "list int, span int, a_rid binary, a_label binary, a_x binary, a_slot array<array<int>>, a_low array<array<long>>, a_high array<array<long>>, a_least array<array<long>>")


_LISTS = pa.list_(pa.list_(pa.int64()))
_VISIT = pa.schema([("list", pa.int32()), ("span", pa.int32()), ("a_rid", pa.binary()), ("a_label", pa.binary()), ("a_x", pa.binary()), ("a_slot", pa.list_(pa.list_(pa.int32()))), ("a_low", _LISTS), ("a_high", _LISTS), ("a_least", _LISTS)])


def scanned(visit: DataFrame, held: DataFrame, c: np.ndarray, same: bool, k: int) -> DataFrame:
    """FOUND rows of the visits: a pack meets the blocks of its span one after the other. Blocks are many times as large in
    memory as in their file, by which Spark would choose to send them all through the driver; so they are merged."""
    sent = visit.sparkSession.sparkContext.broadcast(c)
    numbers = lambda b: np.frombuffer(b, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, own = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda name, i=i, batch=batch: batch.column(name)[i].as_py()
                key = (at("list"), at("span"), at("a_rid"))
                if key != own:
                    if pack:
                        yield pack.rows()
                    rid = numbers(key[2])
                    pack, own = Pack(rid, numbers(at("a_label")), numbers(at("a_x")).reshape(len(rid), -1), *(at(n) for n in ("a_slot", "a_low", "a_high", "a_least")), same, k), key
                of = numbers(at("of"))
                pack.scan(sent.value[key[0]], at("radius"), of, numbers(at("vec_id")), numbers(at("label")), numbers(at("x")).reshape(len(of), -1))
        if pack:
            yield pack.rows()

    return visit.join(held.hint("merge"), ["list", "span"]).mapInArrow(run, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor's windows, with their rank."""
    order = Window.partitionBy("rid", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "of")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(wanted: DataFrame, held: DataFrame, lists: Lists, same: bool, k: int) -> DataFrame:
    """rid, slot, of, vec_id, score, rank: the first k rows of each window of each anchor."""
    wanted = written(wanted.select(*(c.split()[0] for c in WANTED.split(", "))))
    early = written(_top(scanned(visits(wanted, lists, True), held, lists.c, same, k), k))
    kth = early.where(F.col("rank") == k).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
    raised = F.zip_with("slot", "least", lambda s, low: F.greatest(low, F.coalesce(F.try_element_at(F.coalesce("kth", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<long>"))), s), low)))
    later = wanted.join(kth, "rid", "left").withColumn("least", raised).select(*wanted.columns)
    rest = scanned(visits(later, lists, False), held, lists.c, same, k)
    return _top(early.drop("rank").unionByName(rest), k)


def mined(df: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = bounded(prepared(df))
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "rid").select(F.size("v").alias("d")).head()
    rows = rows.where(F.size("v") == (head.d if head else 0))
    c = centres(rows)
    members = written(listed(rows, c))
    of = members.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    count, radius = np.zeros(len(c), np.int64), np.zeros(len(c))
    for r in of:
        count[r["list"]], radius[r["list"]] = r.n, r.far * (1 + 1e-9)
    lists = Lists(c, radius, -(-count // BLOCK))
    dealt = F.pmod(F.xxhash64("rid"), F.element_at(F.array(*(F.lit(int(max(1, b))) for b in -(-count // BLOCK)), F.lit(1)), F.col("list") + 1)).cast("int")
    held = blocks(members.withColumn("block", dealt).withColumn("span", F.floor(F.col("block") / SPAN).cast("int")))
    anchors = written(rows.where(F.col("vec_id") % EVERY == 0))
    every = F.lit(2**62).cast("long")
    first = anchors.select("rid", "label", "v", *(F.array(x).alias(n) for n, x in zip(("slot", "low", "high", "least"), (F.lit(0), -every, every, -every))))
    positives = written(searched(first, held, lists, True, POSITIVES).select("rid", F.col("rank").cast("int").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score")
    low, high = F.expr(f"(positive_score * {LEAST} + pmod(-positive_score * {LEAST}, 100)) div 100"), F.expr(f"(positive_score * {MOST} - pmod(positive_score * {MOST}, 100)) div 100")
    windows = positives.where(p >= 0).withColumns({"low": low, "high": high}).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("w"))
    second = anchors.join(windows, "rid").select("rid", "label", "v", *(F.col(f"w.{n}").alias(n) for n in ("slot", "low", "high")), F.col("w.low").alias("least"))
    negatives = searched(second, held, lists, False, NEGATIVES).select("rid", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = negatives.join(positives, ["rid", "slot"]).join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = f"""
with kept as (select row_number() over () as rid, vec_id, case when vec_id % {SHIFTED} = 0 then (label + 1) % {LABELS} else label end as label,
  list_transform(embedding, lambda x: floor(x::double * {SCALE})) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (select a.rid, a.vec_id as anchor_id, a.label as own, b.rid as other, b.vec_id, b.label, list_inner_product(a.v, b.v)::bigint as score
  from kept as a join kept as b on a.rid <> b.rid where a.vec_id % {EVERY} = 0),
positives as (select *, row_number() over (partition by rid order by score desc, vec_id, other) as place from scored where label = own),
pairs as (select p.rid, p.place, p.anchor_id, p.vec_id as positive_id, p.score as positive_score, n.vec_id as negative_id, n.score as negative_score,
  row_number() over (partition by p.rid, p.place order by n.score desc, n.vec_id, n.other) as rank
  from positives as p join scored as n on p.rid = n.rid and n.label <> n.own
    and {LEAST} * p.score <= 100 * n.score and 100 * n.score <= {MOST} * p.score where p.place <= {POSITIVES})
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from pairs where rank <= {NEGATIVES}
"""
