"""Greedy choices by rounds over tiles against one pass in order."""

import random

import pytest
from pyspark.sql import functions as F

from episodica.operators import cover, spatial


@pytest.fixture(params=[3, 32])
def side(request, monkeypatch):
    """Tiles of a few radii need rounds; those of many don't."""
    monkeypatch.setattr(cover, "SIDE", request.param)
    return request.param


def near(metric, radius):
    return {"l2": lambda r, c: r * r + c * c <= radius**2, "l1": lambda r, c: abs(r) + abs(c) <= radius, "box": lambda r, c: abs(r) < radius and abs(c) < radius}[metric]


def one_pass(points, metric, radius):
    """[(id, n)] of anchors in order; n counts the points whose first near anchor it is."""
    kept, close = [], near(metric, radius)
    for i, r, c in points:
        hit = next((k for k in kept if close(k[1] - r, k[2] - c)), None)
        if hit:
            hit[3] += 1
        else:
            kept.append([i, r, c, 1])
    return kept


@pytest.mark.parametrize("metric,radius,side", [("l2", 7.0, 3), ("l1", 10, 32), ("box", 6, 3)], indirect=["side"])
def test_one_pass(spark, side, metric, radius):
    x = random.Random(1)
    rows = [(g, i, x.randrange(-40, 40), x.randrange(-40, 40)) for g in range(3) for i in range(150)]
    rows += [(0, 1000 + k, 5 * k, 5 * k) for k in range(9)]  # a chain, each better than the next
    rows += [(1, 2000 + k, 3, 3) for k in range(500)]  # one place
    rows += [(2, 5000, None, 1), (2, 5001, 1, None)]
    df = spark.createDataFrame(rows, "g int, id int, r int, c int")
    got = cover.first_fit(df, ["g"], [F.col("id")], radius, ["id"], metric)
    want = [(g, k[0], k[3]) for g in range(3) for k in one_pass([p[1:] for p in rows if p[0] == g and None not in p], metric, radius)]
    assert sorted((r.g, r.id, r.n) for r in got.collect()) == sorted(want)
    kept = cover.anchors(df, ["g"], [F.col("id")], radius, ["id", "r"], metric)
    assert kept.columns == ["g", "id", "r"] and sorted((r.g, r.id) for r in kept.collect()) == sorted(w[:2] for w in want)


def test_order_and_ties(spark, side):
    df = spark.createDataFrame([(1, 0.5, "b", 0, 0), (1, 0.5, "a", 0, 3), (1, 0.9, "c", 0, 6), (None, 0.1, "z", 0, 0), (1, None, "n", 50, 50)], "f int, score double, name string, r int, c int")
    got = spatial.suppress(df, "f", [-F.col("score"), F.col("name")], 4, ["name"])
    assert {(r.f, r.name) for r in got.collect()} == {(1, "c"), (1, "b"), (1, "n"), (None, "z")}
    assert cover.anchors(df.limit(0), ["f"], [F.col("name")], 4, ["name"]).count() == 0


def best_first(left, right, radius):
    out, names, ords = [], set(), set()
    for d, n, o in sorted((((r - u) ** 2 + (c - v) ** 2) ** 0.5, n, o) for n, r, c in left for o, u, v in right):
        if d <= radius and n not in names and o not in ords:
            names.add(n)
            ords.add(o)
            out.append((n, o, d))
    return out


@pytest.mark.parametrize("repeated", [False, True])
def test_pairs(spark, side, repeated):
    x = random.Random(2)
    place = lambda: (x.randrange(-20, 20), x.randrange(-20, 20))
    left = [(g, f"n{i % 60 if repeated else i}", *place()) for g in range(3) for i in range(60)]
    right = [(g, i % 70 if repeated else i, *place()) for g in range(3) for i in range(60)]
    left += [(1, f"chain{k}", 3 * k, 100) for k in range(8)]
    right += [(1, 500 + k, 3 * k + 1 + k / 100, 100) for k in range(8)]
    left, right = [(g, n, float(r), float(c)) for g, n, r, c in left], [(g, n, float(r), float(c)) for g, n, r, c in right]
    a, b = spark.createDataFrame(left, "g int, name string, r double, c double"), spark.createDataFrame(right, "g int, ord int, r double, c double")
    got = cover.assign(a, b, ["g"], 6)
    want = [(g, *p) for g in range(3) for p in best_first([y[1:] for y in left if y[0] == g], [y[1:] for y in right if y[0] == g], 6)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pairs_of_nothing(spark):
    a, b = spark.createDataFrame([(1, "x", 0.0, None)], "g int, name string, r double, c double"), spark.createDataFrame([(1, 1, 0.0, 0.0)], "g int, ord int, r double, c double")
    assert cover.assign(a, b, ["g"], 6).collect() == []
