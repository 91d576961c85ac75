"""Vector code compression: codebooks of 256 entries for each of four parts of a vector, fitted in whole numbers.

Components become integers, floor(``SCALE`` * x). An entry's distance to a part is screened in float32 as one matrix
product, |c|^2 - 2 x.c; the rounding error of that product is bounded for each row, so every entry whose interval
overlaps the best one's is evaluated again in int64, and ties go to the lower index. Codes and errors are therefore
exact, whatever order a machine's library adds in. A round assigns in tasks, each of which sends one sum for every
component of the entries that it used; only those are shuffled, and the driver holds codebooks alone (256 entries of
a vector's length).

Cases: vectors that are null or hold null or non-finite components take no part; nor do those of another length than
that of the smallest kept vec_id, of a length that four doesn't divide, or with components so large that squared
distances don't fit 64 bits (beyond 131,071 in 64 dimensions). Rows that share a vec_id are ordered by their components
for the first codebooks; null ids come last. Fewer than 256 rows make smaller codebooks. An empty table gives no rows.
Other columns are not looked at. Labels are summed with nulls together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, small, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows that are compared with a codebook at a time.
AT_ONCE = 8192
#: The unit roundoff of float32.
ROUNDOFF = 2.0**-24
CODED = "vec_id long, label long, code string, error long"


def most(d: int) -> int:
    """The largest absolute component for which a squared distance of ``d`` of them fits 62 bits."""
    return math.isqrt(2**62 // (4 * d))


def prepared(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: the rows that take part, as integers; written, as every round reads them."""
    v = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = rows.where((F.size("v") > 0) & (F.size("v") % PARTS == 0) & finite)
    bound = F.sqrt(F.lit(2.0**60) / F.size("v"))
    rows = rows.where(F.forall("v", lambda x: F.abs(x * scale) < bound - 1))
    return written(rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long"))))


def assigned(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The index of the nearest entry of ``book`` for each row of ``x`` (both int64), exactly; ties to the lower."""
    x32, book32 = x.astype(np.float32), book.astype(np.float32)
    norms = (book * book).sum(1)
    score = norms.astype(np.float32) - np.float32(2) * (x32 @ book32.T)
    # A product of d terms of converted numbers is off by at most (d + 2) roundoffs of |x||c|, the norm by one, the
    # subtraction by one; the rest is slack for the bound's own rounding.
    far = math.sqrt(float(norms.max()))
    off = (x.shape[1] + 8) * ROUNDOFF * 1.01 * (far * far + 2 * np.sqrt((x.astype(np.float64) ** 2).sum(1)) * far)
    limit = np.nextafter((score.min(1).astype(np.float64) + 2 * off).astype(np.float32), np.float32(np.inf))
    overlaps = score <= limit[:, None]
    best = score.argmin(1)
    open_rows = np.flatnonzero(overlaps.sum(1) > 1)
    if len(open_rows):
        at, entry = np.nonzero(overlaps[open_rows])
        exact = ((x[open_rows][at] - book[entry]) ** 2).sum(1)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        least = np.repeat(np.minimum.reduceat(exact, first), np.diff(np.append(first, len(at))))
        hit = np.flatnonzero(exact == least)
        one = np.append(True, at[hit][1:] != at[hit][:-1])
        best[open_rows] = entry[hit[one]]
    return best


def _vectors(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """Where a slice begins, and its vectors as rows of int64."""
    for at in range(0, batch.num_rows, AT_ONCE):
        part = batch.column(column).slice(at, AT_ONCE)
        yield at, part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), -1)


def sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, place, n, s: each task's sums of the components of the parts that it gives to an entry."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        count = np.zeros(b.shape[:2], np.int64)
        total = np.zeros(b.shape, np.int64)
        for batch in batches:
            for _, v in _vectors(batch, 0):
                for p, x in enumerate(np.split(v, len(b), axis=1)):
                    own = assigned(x, b[p])
                    count[p] += np.bincount(own, minlength=b.shape[1])
                    order = np.argsort(own, kind="stable")
                    used, start = np.unique(own[order], return_index=True)
                    total[p, used] += np.add.reduceat(x[order], start, axis=0)
        p, e = np.nonzero(count)
        w = b.shape[2]
        out = (np.repeat(p, w), np.repeat(e, w), np.tile(np.arange(w), len(p)), np.repeat(count[p, e], w), total[p, e].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["part", "entry", "place", "n", "s"])

    return rows.select("v").mapInArrow(run, "part int, entry int, place int, n long, s long")


def codebooks(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, width) int64, from the parts of the rows of the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r.v for r in first], np.int64)
    books = np.stack(np.split(start, PARTS, axis=1)) if len(first) else np.empty((PARTS, 0, 0), np.int64)
    for _ in range(rounds if len(first) else 0):
        found = sums(rows, books).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        p, e, w, mean = found.select("part", "entry", "place", F.expr("(s - pmod(s, n)) div n").alias("mean")).toPandas().to_numpy(np.int64).T
        books[p, e, w] = mean
    return books


def digest(books: np.ndarray) -> str:
    """sha256 of all integers by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every row."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        for batch in batches:
            for at, v in _vectors(batch, 2):
                own = np.empty((len(v), len(b)), np.uint8)
                error = np.zeros(len(v), np.int64)
                for p, x in enumerate(np.split(v, len(b), axis=1)):
                    near = assigned(x, b[p])
                    own[:, p] = near
                    error += ((x - b[p][near]) ** 2).sum(1)
                some = batch.slice(at, len(v))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([c.tobytes().hex() for c in own]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, CODED)


def compressed(df: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every row that takes part."""
    rows = bounded(prepared(df))
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("d")).head()
    rows = rows.where(F.size("v") == (head.d if head else 0))
    books = codebooks(rows)
    codes = written(coded(rows, books))
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = codes.join(small(by_label, by_label.count()), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(n: int) -> str:
    """SQL of one round: parts assigned to the entries of ``b<n>``, and the codebooks that follow."""
    return f"""
a{n} as materialized (select part, rid, arg_min(entry, d * 256 + entry) as entry, min(d * 256 + entry) // 256 as d from (
  select x.part, x.rid, c.entry, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
  from x join b{n} as c on x.part = c.part) group by part, rid),
m{n} as (select part, entry, place, floor_div(sum(c)::hugeint, count(*)::hugeint) as c from (
  select a.part, a.entry, unnest(x.v) as c, unnest(range(len(x.v))) as place from a{n} as a join x on x.part = a.part and x.rid = a.rid)
  group by part, entry, place),
b{n + 1} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from b{n} as b left join
  (select part, entry, list(c::bigint order by place) as v from m{n} group by part, entry) as m on m.part = b.part and m.entry = b.entry)"""


_ROUNDS = ",".join(_round(n) for n in range(ROUNDS + 1)).replace("floor_div(sum(c)::hugeint, count(*)::hugeint)", "(sum(c)::hugeint - ((sum(c)::hugeint % count(*)) + count(*)) % count(*)) // count(*)")
SQL = f"""
with kept as materialized (select vec_id, label, row_number() over (order by vec_id, embedding) as rid,
  list_transform(embedding, lambda x: floor(x::double * {SCALE})::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select rid, p.part, v[p.part * len(v) // {PARTS} + 1 : (p.part + 1) * len(v) // {PARTS}] as v
  from kept, range({PARTS}) as p(part)),
b0 as materialized (select part, rid - 1 as entry, v from x where rid <= {ENTRIES}),{_ROUNDS},
codes as (select rid, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{ROUNDS} group by rid),
books as (select sha256(string_agg(c::varchar, ',' order by part, entry, place)) as h from (
  select part, entry, unnest(v) as c, unnest(range(len(v))) as place from b{ROUNDS}))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256
from codes join kept using (rid), books
"""
