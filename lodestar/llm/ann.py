"""Approximate nearest neighbours with score-aware (anisotropic) quantisation.

Vectors are scaled to length one, so that the inner product is the cosine. Each is a coarse centre
plus a residual; the residual is its length times a direction in pairs of dimensions, and each pair
is one of 16 codes (4 bits; two codes to a byte), so dense clusters are told apart as finely as
sparse ones. Codes and their centres are chosen for scores, not for distances: the part of the error
that is parallel to the vector changes its large inner products, so it weighs ``ETA`` times as
much as the rest. Each row is encoded once, into a table in the shared folder. A query turns the codes into a
table of 256 partial scores for each byte; a scan adds them up for every row of a chunk, the best ``RERANK`` rows of
each chunk are scored exactly, in double precision on the original vectors, and the best exact scores of all
chunks are the answer. Every chunk goes this way, however few rows it has. Chunks have a fixed number of rows, so
the share that is reranked, and the recall, don't fall as tables grow. Queries come in blocks of a bounded
number: a block is sent to all workers, its answers are written, and it is released before the next; a worker
keeps only the best k of each query of the block over all its chunks, and only those are shuffled.

Equal vectors in a chunk are one candidate that carries its k + 1 smallest ids, so copies take no
places from others; nothing is dropped, since no answer can need more of them.

Cases: vectors that are null, empty, zero, or hold nulls or non-finite numbers take no part, nor do
rows with a null id; only vectors of the same length as the query are its candidates; rows that share a
vec_id are one query (its smallest vector) and never each other's candidates, and an id is returned
once, with its best score; ties go to the smaller vec_id; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, written

K = 5
EVERY = 50
#: The weight of parallel error: (d - 1) T^2 / (1 - T^2) for scores above T = 0.78 in 64 dimensions.
ETA = 100.0
CENTRES, CODES, WIDTH = 32, 16, 2
FIT_ROWS = 6000
CHUNK, RERANK = 65_536, 512
#: So many rows are encoded at a time.
ENCODED = 4096
QUERY_BLOCK = 4096
OUT = "query_id long, vec_id long, score double"
CODED = "vec_id long, v array<double>, centre int, length float, code binary"


@dataclass
class Quantiser:
    """coarse: (centres, d); codes: (d / 2, 16, 2). ``d`` is even; odd vectors get a zero more."""

    coarse: np.ndarray
    codes: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The coarse centre of each unit vector, its residual's length, and its codes, two to a byte."""
        where = np.argmin(((self.coarse**2).sum(1) - 2 * x @ self.coarse.T), axis=1)
        length, way = _split(x - self.coarse[where])
        own = _assign(way, x, self.codes)
        if own.shape[1] % 2:
            own = np.column_stack([own, np.zeros(len(own), np.uint8)])
        return where, length, own[:, ::2] << 4 | own[:, 1::2]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(bytes, 256): the partial scores of a query for each value of each byte."""
        part = np.einsum("skw,sw->sk", self.codes, q.reshape(-1, WIDTH))
        if len(part) % 2:
            part = np.vstack([part, np.zeros(CODES)])
        return (part[::2, :, None] + part[1::2, None, :]).reshape(-1, CODES * CODES).astype(np.float32)


def _split(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and directions of residuals (0 where there is no length)."""
    length = np.sqrt((r * r).sum(1))
    return length, r / np.where(length > 0, length, 1.0)[:, None]


def _assign(r: np.ndarray, x: np.ndarray, codes: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Codes of residuals ``r`` of unit vectors ``x`` by coordinate descent on the weighted error."""
    n, s = len(r), codes.shape[0]
    r, x = r.reshape(n, s, WIDTH), x.reshape(n, s, WIDTH)
    plain = np.stack([((r[:, j, None, :] - codes[j]) ** 2).sum(2) for j in range(s)], 1)
    along = np.stack([((r[:, j, None, :] - codes[j]) * x[:, j, None, :]).sum(2) for j in range(s)], 1)
    own = plain.argmin(2)
    rows = np.arange(n)
    total = np.take_along_axis(along, own[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(rounds):
        for j in range(s):
            rest = total - along[rows, j, own[:, j]]
            own[:, j] = (plain[:, j] + (ETA - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
            total = rest + along[rows, j, own[:, j]]
    return own.astype(np.uint8)


def train(x: np.ndarray, rounds: int = 6) -> Quantiser:
    """Fit centres by k-means and codes by the weighted error on unit vectors ``x`` (bounded)."""
    draw = np.random.default_rng(7)
    n, d = x.shape
    coarse = x[draw.choice(n, min(CENTRES, n), replace=False)].copy()
    for _ in range(8):
        where = np.argmin((coarse**2).sum(1) - 2 * x @ coarse.T, axis=1)
        for c in np.unique(where):
            coarse[c] = x[where == c].mean(0)
    where = np.argmin((coarse**2).sum(1) - 2 * x @ coarse.T, axis=1)
    (_, r), s = _split(x - coarse[where]), d // WIDTH
    parts, units = r.reshape(n, s, WIDTH), x.reshape(n, s, WIDTH)
    pick = draw.choice(n, CODES, replace=n < CODES)
    codes = np.ascontiguousarray(parts[pick].transpose(1, 0, 2))
    eye = np.eye(WIDTH)
    for _ in range(rounds):
        own = _assign(r, x, codes, 1)
        error = parts - codes[np.arange(s), own]
        along = (error * units).sum(2)
        for j in range(s):
            rest = along.sum(1) - along[:, j]
            for k in range(CODES):
                m = own[:, j] == k
                if m.any():
                    u, v = units[m, j], parts[m, j]
                    left = m.sum() * eye + (ETA - 1) * u.T @ u
                    right = v.sum(0) + (ETA - 1) * (u * (rest[m] + (v * u).sum(1))[:, None]).sum(0)
                    codes[j, k] = np.linalg.solve(left, right)
            along[:, j] = ((parts[:, j] - codes[j, own[:, j]]) * units[:, j]).sum(1)
    return Quantiser(coarse, codes)


def usable(df: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _even(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.zeros(len(x))]) if x.shape[1] % WIDTH else x


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their size."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with a query; each row's sum has the same order wherever the row stands."""
    big = max(np.abs(q).max(), np.abs(x).max(initial=0.0))
    if not 1e-140 < big < 1e140 or np.abs(x).max(1, initial=0.0).min(initial=1.0) < 1e-140:
        x, q = x / np.abs(x).max(1, keepdims=True), q / np.abs(q).max()
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


@dataclass
class Chunk:
    """Rows with their codes: ids, vectors, coarse centres, lengths of residuals, codes by byte."""

    ids: np.ndarray
    x: np.ndarray
    centre: np.ndarray
    length: np.ndarray
    code: np.ndarray


def search(chunk: Chunk, queries: np.ndarray, query_ids: np.ndarray, model: Quantiser, k: int = K, rerank: int = RERANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of the best k rows of a chunk for each query."""
    order = np.argsort(chunk.ids, kind="stable")
    x, ids = np.ascontiguousarray(chunk.x[order]), chunk.ids[order]
    seen: dict[bytes, list[int]] = {}
    for i, key in enumerate(map(bytes, np.ascontiguousarray(x + 0.0).view(np.uint8))):
        same = seen.setdefault(key, [])
        if len(same) <= k and (not same or ids[same[-1]] != ids[i]):
            same.append(i)
    rows = np.array([s[0] for s in seen.values()])
    copies = list(seen.values())
    own, alone = x[rows], all(len(s) == 1 for s in copies)
    where, length = chunk.centre[order][rows], chunk.length[order][rows]
    code = np.ascontiguousarray(chunk.code[order][rows].T.astype(np.intp))
    out_q, out_v, out_s = [], [], []
    for q, query_id in zip(queries, query_ids):
        unit = _even(_unit(q[None]))[0]
        score = np.zeros(len(rows), np.float32)
        for byte, line in zip(code, model.tables(unit)):
            score += line[byte]
        score = score * length + (model.coarse @ unit).astype(np.float32)[where]
        best = np.argpartition(-score, rerank)[:rerank] if len(rows) > rerank else np.argsort(-score)
        score = exact(own[best], q)
        if alone:
            found = ids[rows[best]]
        else:
            found = np.concatenate([ids[copies[b]] for b in best])
            score = np.repeat(score, [len(copies[b]) for b in best])
        other = found != query_id
        found, score = found[other], score[other]
        top = np.lexsort((found, -score))
        if len(np.unique(found)) < len(found):
            first = np.sort(np.unique(found[top], return_index=True)[1])
            top = top[first]
        top = top[:k]
        out_q.append(np.full(len(top), query_id))
        out_v.append(found[top])
        out_s.append(score[top])
    none = np.empty(0)
    return np.concatenate([none.astype(np.int64), *out_q]), np.concatenate([none.astype(np.int64), *out_v]), np.concatenate([none, *out_s])


def best_of(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k rows of each query, an id once with its best score, ties to the smaller id."""
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    first = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])) if len(q) else np.empty(0, bool)
    q, v, s = q[first], v[first], s[first]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    start = np.append(True, q[1:] != q[:-1]) if len(q) else np.empty(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) if len(q) else np.empty(0, int)
    return q[place < k], v[place < k], s[place < k]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def coded(rows: DataFrame, models: Broadcast) -> DataFrame:
    """vec_id, v, centre, length, code of each row, by the model of its number of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pc.list_value_length(whole.column(1)).to_numpy()
            for d in np.unique(size):
                part = whole.filter(pa.array(size == d)) if len(np.unique(size)) > 1 else whole
                for at in range(0, part.num_rows, ENCODED):
                    b = part.slice(at, ENCODED)
                    where, length, code = models.value[int(d)].encode(_even(_unit(_matrix(b.column(1)))))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(where, pa.int32()), pa.array(length, pa.float32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "v", "centre", "length", "code"])

    return rows.mapInArrow(run, CODED)


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Chunk]:
    """The rows of a worker in chunks of ``most``; the last may have fewer."""
    held, n = [], 0

    def whole() -> Chunk:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return Chunk(t.column(0).to_numpy(), _matrix(t.column(1)), t.column(2).to_numpy(), t.column(3).to_numpy(), _codes(t.column(4)))

    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, most - n))
            n += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if n == most:
                yield whole()
                held, n = [], 0
    if n:
        yield whole()


def neighbours(df: DataFrame, k: int = K, every: int = EVERY, chunk: int = CHUNK, rerank: int = RERANK, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id ``every`` divides."""
    context, rows = df.sparkSession.sparkContext, bounded(usable(df))
    queries = written(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    shapes = queries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    models = {}
    for d, _ in shapes:
        same = rows.where(F.size("v") == d)
        share = min(1.0, FIT_ROWS / max(1, same.count()))
        sample = same.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) <= int(share * 1_000_000)).select("v").toPandas()
        models[d] = train(_even(_unit(np.stack(sample["v"].to_numpy()).astype(np.float64))))
    shared = context.broadcast(models)
    table = written(coded(rows.where(F.size("v").isin([d for d, _ in shapes])), shared))
    shared.destroy()
    found = df.sparkSession.createDataFrame([], OUT)
    for d, n in shapes:
        blocks = -(-n // block)
        for b in range(blocks):
            part = queries.where((F.size("v") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).toPandas()
            if not len(part):
                continue
            sent = context.broadcast((np.stack(part["v"].to_numpy()).astype(np.float64), part["vec_id"].to_numpy(), models[d]))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                q, q_ids, model = sent.value
                best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                for c in chunks(batches, chunk):
                    best = best_of(*(np.concatenate(x) for x in zip(best, search(c, q, q_ids, model, k, rerank))), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query_id", "vec_id", "score"])

            found = found.unionByName(written(table.where(F.size("v") == d).mapInArrow(run, OUT)))
            sent.destroy()
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
