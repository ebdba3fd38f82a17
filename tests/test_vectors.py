import math
import random

import pytest

from boxwright.operators import dedup, vectors


def rmse(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) / len(a))


def good(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture
def rows(monkeypatch):
    """Spread groups of near copies, two lengths, and vectors near to nothing; blocks so small that cells have several."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "SAMPLE", 100)
    rng = random.Random(4)
    centres = [[rng.uniform(-9, 9) for _ in range(12)] for _ in range(12)]
    vecs = [[x + rng.gauss(0, 0.2) for x in rng.choice(centres)] for _ in range(300)]
    vecs += [vecs[0]] * 40 + [[rng.random() for _ in range(3)] for _ in range(30)]
    vecs += [[], [float("nan")] * 12, [1.0] * 11 + [None], [float("inf")] * 12, [float("inf")] * 12, None]
    return list(enumerate(vecs))


@pytest.mark.parametrize("threshold", [0.0, 0.25, 0.6, 50.0])
def test_similar_pairs_by_brute_force(spark, rows, threshold):
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = sorted((r.a, r.b) for r in dedup.similar_pairs(df, threshold).collect())
    want = [(i, j) for i, a in rows for j, b in rows if i < j and good(a) and good(b) and len(a) == len(b) and rmse(a, b) <= threshold]
    assert got == sorted(want)


def test_nearest_by_brute_force(spark, rows):
    rows = [*rows, (900, [0.5] * 7)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r.id: r.distance for r in dedup.nearest(df.where("id % 3 = 0"), df.where("id % 3 <> 0")).collect()}
    train = [v for i, v in rows if i % 3 and good(v)]
    want = {i: min((rmse(v, w) for w in train if len(w) == len(v)), default=None) if good(v) else None for i, v in rows if i % 3 == 0}
    assert got.keys() == want.keys() and got[900] is None
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) if want[i] is not None else got[i] is None for i in want)


def test_empty_tables_have_no_pairs(spark, rows):
    df = spark.createDataFrame(rows, "id int, v array<float>")
    none = df.where("id < 0")
    assert dedup.similar_pairs(none, 1.0).count() == 0 and dedup.nearest(none, df).count() == 0
    assert {r.distance for r in dedup.nearest(df, none).collect()} == {None}
