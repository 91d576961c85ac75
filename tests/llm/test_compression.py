"""Codes against plain integer arithmetic, and the cases that the docstring states."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import compression

VECTORS = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """The contract in plain Python: code and error by position, and the codebooks' digest."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    x = [[math.floor(1024 * c) for c in r[1]] for r in rows]
    w = len(x[0]) // 4
    parts = [[v[p * w : (p + 1) * w] for v in x] for p in range(4)]
    books = [[list(v) for v in part[:256]] for part in parts]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    near = lambda v, book: min((far(v, c), e) for e, c in enumerate(book))
    for _ in range(4):
        for part, book in zip(parts, books):
            own = [near(v, book)[1] for v in part]
            for e in set(own):
                of = [v for v, o in zip(part, own) if o == e]
                book[e] = [sum(c) // len(of) for c in zip(*of)]
    best = [[near(v, book) for v in part] for part, book in zip(parts, books)]
    text = ",".join(str(c) for book in books for e in book for c in e)
    return [("".join(f"{b[i][1]:02x}" for b in best), sum(b[i][0] for b in best)) for i in range(len(rows))], hashlib.sha256(text.encode()).hexdigest()


def test_against_plain_arithmetic(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in draw.normal(size=8).round(2)], int(i % 3) if i % 5 else None) for i in range(700)]
    rows += [(1000 + i, rows[i][1], 1) for i in range(40)]
    got = compression.compressed(spark.createDataFrame(rows, VECTORS)).orderBy("vec_id").collect()
    want, digest = plain(rows)
    assert [(r.code, r.error) for r in got] == want
    assert {r.codebooks_sha256 for r in got} == {digest}
    for label in (None, 0, 1, 2):
        assert {r.label_error for r in got if r.label == label} == {sum(r.error for r in got if r.label == label)}


def test_near_ties_are_decided_in_whole_numbers():
    """Distances that float32 can't tell apart: the screen alone would choose by its rounding."""
    draw = np.random.default_rng(5)
    base = draw.integers(-(2**24), 2**24, 16)
    book = base + draw.integers(-2, 3, (256, 16))
    x = base + draw.integers(-2, 3, (500, 16))
    want = [min((int(((v - c) ** 2).sum()), e) for e, c in enumerate(book))[1] for v in x]
    assert compression.assigned(x, book).tolist() == want
    screen = (book.astype(np.float32) ** 2).sum(1) - 2 * x.astype(np.float32) @ book.astype(np.float32).T
    assert (screen.argmin(1) != want).any()


def test_equal_entries_go_to_the_lower_index():
    book = np.array([[5, 5], [1, 1], [1, 1], [-3, 1]])
    assert compression.assigned(np.array([[1, 1], [0, 2], [-1, 1], [9, 9]]), book).tolist() == [1, 1, 1, 0]


def test_cases(spark):
    inf, nan = float("inf"), float("nan")
    good = [0.5, -0.25, 0.0, 1.0]
    rows = [
        (1, good, 1), (2, None, 1), (3, [0.5, None, 0.0, 1.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1), (5, [nan, 0.0, 0.0, 0.0], 1), (6, [], 1),
        (7, [0.0, 0.0, 0.0, 0.0], None), (8, [1.0, 2.0], 1), (9, [1e30, 0.0, 0.0, 0.0], 1), (1, good, 1), (None, [-0.0001, 0.0, 0.0, 0.0], None),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("v", "part", "entry", "of", "code", "error", "n", "s")})
    got = compression.compressed(df).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "7", "None"]
    want, digest = plain([(r[0], r[1]) for r in rows if r[0] in (1, 7, None)])
    by = {r.vec_id: r for r in got}
    assert [(by[i].code, by[i].error) for i in (1, 1, 7, None)] == want and by[1].codebooks_sha256 == digest
    assert by[7].label_error == by[None].label_error == by[7].error + by[None].error
    assert compression.compressed(df.limit(0)).collect() == []
    assert compression.compressed(spark.createDataFrame([(1, None, 1)], VECTORS)).collect() == []
