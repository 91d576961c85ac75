"""Lines and rings: simplification, seams, centroids, projection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = "array<struct<x:double,y:double>>"
Point = tuple[float, float]


def _kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> list[int]:
    """Places of the points that Douglas-Peucker keeps of an open line, with a stack in place of recursion."""
    if len(x) < 3:
        return list(range(len(x)))
    keep, stack = {0, len(x) - 1}, [(0, len(x) - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        px, py, dx, dy = x[lo + 1 : hi], y[lo + 1 : hi], x[hi] - x[lo], y[hi] - y[lo]
        size = math.hypot(dx, dy)  # 0: the ends are one, and distances are to it
        far = np.abs(dx * (y[lo] - py) - (x[lo] - px) * dy) / size if size else np.hypot(px - x[lo], py - y[lo])
        far = np.where(np.isnan(far), -1.0, far)
        at = int(far.argmax())
        if far[at] > tolerance:
            keep.add(lo + 1 + at)
            stack += [(lo, lo + 1 + at), (lo + 1 + at, hi)]
    return sorted(keep)


def simplified(points: list[Point], tolerance: float) -> list[Point]:
    """Douglas-Peucker on an open line."""
    at = np.array(points, float).reshape(-1, 2)
    return [points[i] for i in _kept(at[:, 0], at[:, 1], tolerance)]


def _kept_ring(x: np.ndarray, y: np.ndarray, tolerance: float) -> list[int]:
    """Places of the points that stay of a closed ring: cut at the vertex farthest from the first, each half simplified."""
    if len(x) < 4:
        return list(range(len(x)))
    n = len(x) - 1 if (x[0], y[0]) == (x[-1], y[-1]) else len(x)
    far = int(np.hypot(x[:n] - x[0], y[:n] - y[0]).argmax())
    back = np.append(np.arange(far, n), 0)
    return _kept(x[: far + 1], y[: far + 1], tolerance)[:-1] + back[_kept(x[back], y[back], tolerance)].tolist()


def simplified_ring(points: list[Point], tolerance: float) -> list[Point]:
    """A closed ring, of which the first point stays first and last."""
    at = np.array(points, float).reshape(-1, 2)
    return [points[i] for i in _kept_ring(at[:, 0], at[:, 1], tolerance)]


def _udf(kept):  # noqa: ANN001, ANN202
    """A function on Arrow lists: points stay in their buffers, as Python objects they take twenty times as much."""

    def run(lines: pa.Array, tolerance: pa.Array) -> pa.Array:
        points, ends = lines.values, lines.offsets.to_numpy()
        x, y = (c.to_numpy(zero_copy_only=False).astype(float) for c in points.flatten())
        none, limit = lines.is_null().to_numpy(zero_copy_only=False), tolerance.to_numpy(zero_copy_only=False)
        at = [[] if none[i] else [int(lo) + k for k in kept(x[lo:hi], y[lo:hi], limit[i])] for i, (lo, hi) in enumerate(zip(ends, ends[1:]))]
        offsets = pa.array(np.cumsum([0, *map(len, at)]), pa.int32(), mask=np.append(none, False))
        return pa.ListArray.from_arrays(offsets, points.take(pa.array([k for line in at for k in line], pa.int64())))

    return F.arrow_udf(run, LINE)


def simplify_line(line: Column, tolerance: float) -> Column:
    return _udf(_kept)(line, F.lit(float(tolerance)))


def simplify_ring(ring: Column, tolerance: float) -> Column:
    return _udf(_kept_ring)(ring, F.lit(float(tolerance)))


def edge(a: Column, b: Column) -> Column:
    """An undirected edge: its ends in order."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def seam(one: DataFrame, other: DataFrame) -> DataFrame:
    """Edges (a, b) that both sides have, whatever their direction, once each."""
    ends = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ends(one).intersect(ends(other))


def stitched(one: list[Point], two: list[Point], seams: list[list[Point]]) -> list[Point]:
    """The outline of two polygons (closed rings) that meet along ``seams``: their edges but the shared ones,
    chained into the longest ring. Seams are given as chains of points."""
    gone = {tuple(sorted(e)) for line in seams for e in zip(line, line[1:])}
    left = [e for ring in (one, two) for e in zip(ring, ring[1:]) if tuple(sorted(e)) not in gone]
    return max(chained(left), key=len, default=[])


def chained(edges: list[tuple[Point, Point]]) -> list[list[Point]]:
    """Undirected edges joined into lines: starts are loose ends in order, then loops."""
    near: dict[Point, list[Point]] = {}
    for a, b in sorted({(min(e), max(e)) for e in edges}):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    lines, used = [], set()
    for start in sorted(near, key=lambda p: (len(near[p]) == 2, p)):
        for first in near[start]:
            if (min(start, first), max(start, first)) in used:
                continue
            line, at, to = [start], start, first
            while to is not None:
                used.add((min(at, to), max(at, to)))
                line.append(to)
                at, ways = to, [p for p in near[to] if (min(to, p), max(to, p)) not in used]
                to = ways[0] if len(near[at]) == 2 and ways else None
            lines.append(line)
    return lines


def doubled_area(ring: Column) -> Column:
    """Twice the signed area of a ring (array of struct x, y) by the shoelace rule."""
    n = F.size(ring)
    parts = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def centroid(ring: Column) -> Column:
    """struct<x, y>: the centroid of a ring; null for one without area."""
    n, area = F.size(ring), doubled_area(ring)

    def along(axis: str) -> Column:
        def part(p: Column, i: Column) -> Column:
            q = F.get(ring, (i + 1) % n)
            return (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"])

        return F.try_divide(F.aggregate(F.transform(ring, part), F.lit(0.0), lambda a, x: a + x), 3 * area)

    return F.when(area != 0, F.struct(along("x").alias("x"), along("y").alias("y")))


def largest_ring(rings: Column) -> Column:
    """The ring with the largest area."""
    sized = F.transform(rings, lambda r: F.struct(F.abs(doubled_area(r)).alias("a"), r.alias("r")))
    return F.array_max(sized)["r"]


def projected(df: DataFrame, lon: str, lat: str, width: float) -> DataFrame:
    """x, y in a picture of a width: equirectangular, scaled by the cosine of the middle latitude,
    y downwards, to a tenth."""
    box = df.agg(F.min(lon).alias("_w"), F.max(lon).alias("_e"), F.min(lat).alias("_s"), F.max(lat).alias("_n"))
    df = df.crossJoin(F.broadcast(box))  # one row
    west, east, south, north = (F.col(c) for c in ("_w", "_e", "_s", "_n"))
    squeeze = F.cos(F.radians((south + north) / 2))
    scale = F.lit(width) / ((east - west) * squeeze)
    return df.withColumns({"x": F.round((F.col(lon) - west) * squeeze * scale, 1), "y": F.round((north - F.col(lat)) * scale, 1)}).drop("_w", "_e", "_s", "_n")
