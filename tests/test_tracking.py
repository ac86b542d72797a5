"""Tracks, crossings and rests in the plane against plain loops."""

import itertools
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from episodica.operators import tracking
from episodica.streaming.machines import Memory


def run(machine, ticks):
    m, out = Memory(), []
    for t, x in enumerate(ticks):
        out += [(t, *row) for row in machine.step(m, SimpleNamespace(**x))]
    return out


def frame(seen, start=None):
    start = start or {}
    return {"seen_r": [p[0] for p in seen], "seen_c": [p[1] for p in seen], "names": list(start) or None, "at_r": [p[0] for p in start.values()], "at_c": [p[1] for p in start.values()]}


def test_crossing_tracks_keep_their_names():
    """Two things pass each other; the order in which they are seen changes."""
    paths = {"a": [(10 * t, 50) for t in range(11)], "b": [(100 - 10 * t, 53) for t in range(11)]}
    ticks = [frame([paths[n][t] for n in (("a", "b") if t % 2 else ("b", "a"))], {n: p[0] for n, p in paths.items()} if t == 0 else None) for t in range(11)]
    got = run(tracking.tracks(12), ticks)
    assert [(t, n, r, c) for t, n, r, c, _, _ in got] == [(t, n, *map(float, paths[n][t])) for t in range(11) for n in "ab"]


def test_no_track_jumps_or_shares_a_place():
    start = {"a": (0, 0), "b": (4, 0)}
    got = run(tracking.tracks(10), [frame([(1, 0)], start), frame([(30, 30)]), frame([]), frame([(5, 0), (2, 0)])])
    assert [(t, n, r, f) for t, n, r, _, f, _ in got] == [
        (0, "a", 1.0, True), (0, "b", 4.0, False), (1, "a", 1.0, False), (1, "b", 4.0, False), (2, "a", 1.0, False), (2, "b", 4.0, False), (3, "a", 2.0, True), (3, "b", 5.0, True)]


@pytest.mark.parametrize("seed", range(20))
def test_assignment_is_greedy(seed):
    r = random.Random(seed)
    names, seen = {n: (r.randrange(9), r.randrange(9)) for n in "abcd"}, [(r.randrange(9), r.randrange(9)) for _ in range(r.randrange(6))]
    free, left, want = set(names), set(range(len(seen))), {}
    while pairs := [((seen[k][0] - names[n][0]) ** 2 + (seen[k][1] - names[n][1]) ** 2, n, k) for n, k in itertools.product(free, left)]:
        d, n, k = min(pairs)
        if d > 16:
            break
        want[n] = k
        free.discard(n)
        left.discard(k)
    assert tracking.assigned(names, seen, 4) == want


def test_crossings():
    at = [100, 44, 40, 25, 19, 22, 28, 31, 20, None, 29, 50, 44, 10, 60, 5]
    ticks = [{"r": None if d is None else float(d), "c": 0.0, "to_r": [0.0, 100.0], "to_c": [0.0, 0.0]} for d in at]
    got = [(t, e, n, word) for t, side, e, n, word, _ in run(tracking.crossings(20, 30, 45), ticks) if side == 0]
    assert got == [(1, "approaching", 0, "first"), (4, "reached", 1, "first"), (7, "left", 1, "first"), (8, "reached", 2, "second"), (11, "left", 2, "second"), (12, "approaching", 2, "second"), (13, "reached", 3, "third"), (14, "left", 3, "third"), (15, "reached", 4, "fourth")]
    assert [(t, e) for t, side, e, *_ in run(tracking.crossings(20, 30), ticks) if side == 1] == [(0, "reached"), (1, "left")]


def plain_rests(rows, still, gap, least):
    out, cur, seen = [], None, None
    for t, r, c in rows:
        if r is None or c is None:
            if cur and t - seen > gap:
                out.append(cur)
                cur = None
            continue
        if cur and abs(cur[2] - r) + abs(cur[3] - c) <= still:
            cur = (cur[0], t, cur[2], cur[3])
        else:
            out += [cur] if cur else []
            cur = (t, t, r, c)
        seen = t
    return [x for x in [*out, *([cur] if cur else [])] if x[1] - x[0] >= least]


def test_rests(spark):
    r, rows, want = random.Random(2), [], []
    for e in range(40):
        own = [(t, None if r.random() < 0.3 else float(r.choice([0, 3, 20])), float(r.choice([0, 2, 30]))) for t in sorted(r.sample(range(60), 30))]
        rows.append((e, own))
        want += [(e, *x) for x in plain_rests(own, 6, 4, 3)]
    df = spark.createDataFrame(rows, "e int, x array<struct<t:bigint,r:double,c:double>>")
    got = df.select("e", F.explode(tracking.rests(F.col("x"), 6, 4, 3)).alias("s")).select("e", "s.*").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20
