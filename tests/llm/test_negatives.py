"""Hard negatives against brute force, and the cases that the docstring states."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import negatives

VECTORS = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """The contract in plain Python; vec_ids are unique here."""
    kept = [(i, [math.floor(256 * c) for c in v], (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in rows]
    out = []
    for i, v, lab in kept:
        if i is None or i % 100:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), math.inf if j is None else j, m) for j, w, m in kept if j != i]
        for s, j, _ in sorted(x for x in score if x[2] == lab)[:5]:
            fits = sorted(x for x in score if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, math.inf if r.positive_id is None else r.positive_id, r["rank"], math.inf if r.negative_id is None else r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(n, draw, hot=0):
    """Vectors around few centres, ``hot`` of them equal, with small values so that scores tie."""
    middle = draw.normal(size=(6, 8))
    x = (middle[draw.integers(0, 6, n)] + 0.4 * draw.normal(size=(n, 8))).round(1)
    x[:hot] = x[0]
    return [(int(i), [float(c) for c in v], int(draw.integers(0, 4))) for i, v in enumerate(x)]


@pytest.mark.parametrize(("seed", "block", "hot"), [(1, 4096, 0), (2, 40, 0), (3, 40, 300)])
def test_against_brute_force(spark, monkeypatch, seed, block, hot):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "SPAN", 2)
    rows = clustered(900, np.random.default_rng(seed), hot)
    random.Random(seed).shuffle(rows)
    want = plain(rows)
    assert len(want) > 50
    assert found(negatives.mined(spark.createDataFrame(rows, VECTORS).repartition(3))) == want


def test_bounds_hold_every_score():
    draw = np.random.default_rng(8)
    x = draw.integers(-2000, 2000, (400, 16))
    c = x[:5].astype(float) + 0.5
    near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
    far = np.sqrt(((x - c[near]) ** 2).sum(1))
    lists = negatives.Lists(c, np.array([far[near == n].max() for n in range(5)]), np.bincount(near, minlength=5))
    below, above = lists.bounds(x[:50])
    score = x[:50] @ x.T
    assert (score <= above[:, near]).all() and (score >= below[:, near]).all()


def test_large_integers_are_multiplied_exactly():
    draw = np.random.default_rng(9)
    x = draw.integers(-(2**28), 2**28, (20, 12))
    assert (negatives.scores(x, x) == x @ x.T).all()
    small = x >> 8
    assert (negatives.scores(small, small) == small @ small.T).all()


def test_a_list_below_the_score_to_beat_is_not_visited(spark):
    """Far lists aren't sent anything once five positives are found, lists with equal bounds are."""
    c = np.array([[1000.0, 0.0], [0.0, 1000.0], [-1000.0, 0.0]])
    lists = negatives.Lists(c, np.array([1.0, 1.0, 1.0]), np.array([1, 1, 1]))
    every = 2**62
    row = lambda least: [(1, 1, [1000, 0], [0], [-every], [every], [least])]
    went = lambda least, first: sorted(r["list"] for r in negatives.visits(spark.createDataFrame(row(least), negatives.WANTED), lists, first).collect())
    assert went(-every, True) == [0, 1]
    assert went(-every, False) == [2]
    assert went(0, False) == []
    near = [(1, 1, [1000, 0], [0], [-1_100_000], [-900_000], [-1_100_000])]
    assert [r["list"] for r in negatives.visits(spark.createDataFrame(near, negatives.WANTED), lists, True).collect()] == [2]


def test_cases(spark):
    inf, nan = float("inf"), float("nan")
    a, b = [1.0, 0.0], [0.5, 0.0]
    rows = [
        (100, a, 1), (1, a, 1), (2, b, 2), (None, b, 3), (3, b, None), (4, None, 2), (5, [None, 1.0], 2), (6, [nan, 1.0], 2), (8, [inf, 1.0], 2),
        (9, [], 2), (10, [0.5, 0.0, 0.0], 2), (11, [1e200, 0.0], 2), (200, [-1.0, 0.0], 5), (201, [1.0, 0.0], 5), (300, [0.0, 1.0], 6), (302, [3.0, 0.0], 6),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("rid", "list", "block", "slot", "score", "v", "rank", "far")})
    kept = [r for r in rows if r[0] in (100, 1, 2, None, 200, 201, 300, 302)]
    want = plain(kept)
    assert found(negatives.mined(df)) == want
    # 300's positive scores 0: negatives that score 0; 200's only positive scores below 0: none.
    assert {w[0] for w in want} == {100, 300} and [w[3] for w in want if w[0] == 100] == [2, math.inf]
    assert negatives.mined(df.limit(0)).collect() == []
    assert negatives.mined(df.where("vec_id = 100")).collect() == []


def test_rows_that_share_an_id(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2)]
    got = found(negatives.mined(spark.createDataFrame(rows, VECTORS)))
    one = [(100, 100, 1, 2, 65536, 32768), (100, 100, 2, 2, 65536, 32768)]
    assert got == sorted(one + one)


def test_only_the_sample_of_centres_is_sent_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(negatives, "FIT_ROWS", 100)
    rows = spark.range(0, 4000, 1, 8).selectExpr("id as rid", "array(id % 17, id % 5) as v")
    taken = []
    monkeypatch.setattr(negatives, "_matrix", lambda column: taken.append(len(column)) or np.array(column.to_pylist(), np.int64))
    monkeypatch.setattr(DataFrame, "limit", lambda *_: pytest.fail("a sorted limit brings the limit of every task to the driver"))
    assert negatives.centres(rows, 8).shape == (8, 2)
    assert 50 < taken[0] < 160
    assert negatives.centres(rows.where("false"), 8).size == 0
