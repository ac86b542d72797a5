"""Small cases worked out by hand: ties, rounding, empty inputs and order."""

import math
import re

import pytest
from pyspark.sql import functions as F

from episodica.functions import geometry
from episodica.functions import text as T
from episodica.operators import corpus, cover, folds, gates, grouped, ordered, quality, spatial
from episodica.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_nearest_ties(spark):
    q = spark.createDataFrame([(1, 2), (1, 9)], "k int, t int")
    grid = spark.createDataFrame([(1, 0, "a"), (1, 4, "b")], "k int, t int, v string")
    first = {r.t: r.v for r in ordered.asof(q, grid, "k", "t", ["v"], "nearest").collect()}
    later = {r.t: r.v for r in ordered.asof(q, grid, "k", "t", ["v"], "nearest", tie="later").collect()}
    assert first == {2: "a", 9: "b"} and later == {2: "b", 9: "b"}


def test_forward_is_strict_and_clamps(spark):
    q = spark.createDataFrame([(1, 4), (1, 3)], "k int, t int")
    grid = spark.createDataFrame([(1, 4, "b")], "k int, t int, v string")
    strict = {r.t: r.v for r in ordered.asof(q, grid, "k", "t", ["v"], "forward").collect()}
    clamped = {r.t: r.v for r in ordered.asof(q, grid, "k", "t", ["v"], "forward", clamp=True).collect()}
    assert strict == {4: None, 3: "b"} and clamped == {4: "b", 3: "b"}


def test_point_suppression(spark):
    p = spark.createDataFrame([(1, "a", 10, 10, 0.9), (1, "b", 12, 11, 0.8), (1, "c", 50, 50, 0.7)], "f int, name string, r int, c int, score double")
    got = spatial.suppress(p, "f", [-F.col("score"), F.col("name")], 10, ["name", "r", "c"]).collect()
    assert sorted(r["name"] for r in got) == ["a", "c"]


def test_snap_radius_is_inclusive(spark):
    pts = F.array(F.struct(F.lit(109).alias("r"), F.lit(112).alias("c")))
    far = F.array(F.struct(F.lit(110).alias("r"), F.lit(112).alias("c")))
    assert tuple(one(spark, spatial.snap(pts, F.lit(100), F.lit(100), 15))) == (109, 112)
    assert tuple(one(spark, spatial.snap(far, F.lit(100), F.lit(100), 15))) == (100, 100)


def test_hysteresis(spark):
    assert one(spark, folds.hysteresis(F.array(*map(F.lit, (40, 15, 20, 30, 10))), 18, 26)) == 2


def test_upper_median(spark):
    assert one(spark, folds.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))) == 3
    assert one(spark, folds.upper_median(F.array().cast("array<int>"))) is None


def test_adoption_and_prematurity(spark):
    rows = [(1, i, o, p) for i, (o, p) in enumerate(zip("AABB", "AAAB"))] + [(2, i, o, p) for i, (o, p) in enumerate(zip("AAB", "ABB"))]
    t = spark.createDataFrame(rows, "ep int, step int, o string, p string")
    r = {x.ep: x for x in quality.tick_report(quality.tick_metrics(t, "ep", "step", "o", "p"), ["ep"]).collect()}
    assert (r[1].transitions, r[1].adopted, r[1].median_lag) == (1, 1, 1)
    assert (r[2].predicted, r[2].premature) == (1, 1)


def test_lag_rounds_down(spark):
    a = spark.createDataFrame([(1, 16, 0, "x at <1, 2>"), (1, 16, 1, "x at <1, 2>")], "ep int, t int, ord int, line string")
    b = spark.createDataFrame([(1, 0, 0, "X at <9, 9>  [sam] y"), (1, 15, 0, "x at <50, 2>"), (1, 15, 1, "x at <13, 14>")], "ep int, t int, ord int, line string")
    got = sorted(((r.t_said, r.lag) for r in grouped.pair_lines(a, b, "ep").collect()), key=str)
    assert got == [(0, -1), (15, -1)]


def test_half_even_pixels(spark):
    at = lambda y: geometry.project(F.lit(0.0), F.lit(y), F.lit(0.0), [[0, 0, 0, 3.5], [0, 1, 0, 0], [0, 0, 0, 1]], 256, 256)
    assert tuple(one(spark, at(2.5))) == (2, 4) and tuple(one(spark, at(-7.0))) == (0, 4)


def test_consecutive_only(spark):
    t = spark.createDataFrame([(1, i, v) for i, v in enumerate("xxyx")], "k int, i int, v string")
    assert [r.v for r in ordered.drop_consecutive(t, ["k"], ["i"], "v").orderBy("i").collect()] == list("xyx")


def test_repeats_in_order(spark):
    for text, n in (("a\nthe cube moved to x", 8), ("completed: put down", 4), ("a\nb", 3), ("reached the target", 3), ("z", 1), (None, 1)):
        assert one(spark, T.repeats(F.lit(text).cast("string"))) == n


def test_visibility(spark):
    q = spark.createDataFrame([(1, t) for t in (4, 5, 8, 9)], "k int, t int")
    i = spark.createDataFrame([(1, 5, 9, 0)], "k int, a int, b int, n int")
    assert sorted(r.t for r in ordered.visible(q, i, "k", "t", "a", "b", 2, "n").collect()) == [5, 8]


def test_edge_pad_and_future(spark):
    t = spark.createDataFrame([(1, i, i) for i in range(3)], "k int, i int, v int")
    assert [r.chunk for r in ordered.padded_chunk(t, ["k"], ["i"], "v", 5).orderBy("i").collect()][1] == [1, 2, 2, 2, 2]
    assert [r.f for r in ordered.future(t, ["k"], ["i"], "v", 2, "f").orderBy("i").collect()] == [2, 2, 2]


def test_sustained(spark):
    flags = [True, True, None, True, True, True]
    t = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k int, i int, f boolean")
    assert [r.sustained for r in ordered.sustained(t, ["k"], ["i"], F.col("f"), 2).orderBy("i").collect()] == [False, True, False, False, True, True]


def test_runs_treat_nulls_as_equal(spark):
    t = spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, "a")], "k int, i int, v string")
    assert [r.run for r in ordered.runs(t, ["k"], ["i"], "v").orderBy("i").collect()] == [0, 0, 1]


def test_outcomes(spark):
    t = spark.sql("select map('t', map('0', 'true', '1', 'error')) as m")
    assert [(r.ep, r.ok) for r in readers.outcomes(t, "m").collect()] == [("0", True)]
    assert len(readers.outcomes(t, "m", legacy=True).collect()) == 2


def test_angles(spark):
    assert abs(one(spark, geometry.wrap(F.lit(-math.pi))) - math.pi) < 1e-12
    assert abs(one(spark, geometry.tilt_degrees(F.lit(math.pi), F.lit(0.0), F.lit(0.0)))) < 1e-5
    assert one(spark, geometry.axis_angle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == [0.0, 0.0, 0.0]


def test_gate(spark):
    det = lambda *xs: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("r"), F.lit(c).alias("c")) for n, r, c in xs])
    none = F.array().cast("array<struct<name:string,r:int,c:int>>")
    said = lambda line, window, before=none, late=None: one(spark, corpus.evident(F.lit(line), window, before, window, window, F.array(*(late or [none]))))
    cube = det(("red_cube", 10, 10))
    assert said("a cube appeared at <10, 10>", cube)
    assert not said("a cube appeared at <10, 10>", cube, cube)
    assert not said("highlight appeared at <10, 10>", cube)
    assert said("the cube moved to <1, 1>", cube) and not said("the cube moved to <1, 1>", cube, cube)
    assert said("put down at <12, 12>", cube, none, [cube, cube]) and not said("put down at <12, 12>", cube, none, [cube, none])
    assert said("reached the target at <20, 20>", cube) and said("anything", none)


def test_stages_and_assignment(spark):
    plan = spark.createDataFrame([(1, 0, "pick"), (1, 1, "stage"), (1, 2, "stage")], "t int, ord int, kind string")
    stages = spark.createDataFrame([(1, 7, "pick"), (1, 8, "stage")], "t int, pos int, kind string")
    got = grouped.bind_stages(plan, stages, "t").orderBy("ord").collect()
    assert [(r.stage, r.complete) for r in got] == [(7, True), (8, True), (None, True)]
    a = spark.createDataFrame([(1, "x", 0, 0), (1, "y", 0, 4)], "f int, name string, r int, c int")
    b = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 0, 40)], "f int, ord int, r int, c int")
    assert [(r.a, r.b) for r in cover.assign(a, b, ["f"], 20).collect()] == [("y", 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "x")
    assert (writers.append_new(df, path, ["k"]), writers.append_new(df, path, ["k"])) == (2, 0)
    good, bad = writers.quarantine(df, {"small": F.col("k") < 2})
    assert (good.count(), [r.reason for r in bad.collect()]) == (1, ["small"])
    writers.guarded(df, str(tmp_path / "g"), ["t1"])
    try:
        writers.guarded(df, str(tmp_path / "g"), ["t2"])
        raise AssertionError
    except ValueError:
        pass
    writers.by_split(df.withColumn("split", corpus.split_by_modulo(F.col("k"), 2)), str(tmp_path / "s"), ["split"])
    assert spark.read.json(str(tmp_path / "s" / "split=val")).count() == 1


def test_rest_segments(spark):
    rows = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(v).cast("double").alias("v")) for t, v in ((0, 5), (1, 5), (30, 5), (31, None), (45, None), (46, 5))])
    assert [(r.start, r.end) for r in one(spark, folds.rests(rows, 6, 12, 20))] == [(0, 30)]


def test_frame_evidence(spark):
    from episodica.operators import evidence

    def frames(*names):
        one_ = lambda ns: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(10).alias("r"), F.lit(10).alias("c")) for n in ns]) if ns else F.array().cast("array<struct<name:string,r:int,c:int>>")
        return F.array(*map(one_, names)) if names else F.array().cast("array<array<struct<name:string,r:int,c:int>>>")

    at = (F.lit(12), F.lit(10))
    gone = frames(["arm"], ["arm"], ["button"])
    assert one(spark, evidence.pressed(gone, *at)) and not one(spark, evidence.pressed(frames(["arm"], ["button"], ["arm"]), *at))
    assert one(spark, evidence.absent(gone, *at, "cube")) and not one(spark, evidence.absent(frames(["cube"], []), *at, "cube"))
    assert one(spark, evidence.lifted(frames(["cube"]), frames([], []), *at, "cube")) and not one(spark, evidence.lifted(frames(), frames([], []), *at, "cube"))
    assert one(spark, evidence.placed(frames(["cube"], ["cube"]), *at, "cube", True)) and not one(spark, evidence.placed(frames(["cube", "arm"]), *at, "cube", False))
    assert one(spark, evidence.visited(frames(["arm"]), frames([]), *at)) and not one(spark, evidence.placed(frames(), *at, "cube", True))


def test_plan_predicates(spark):
    from episodica.operators import predicates

    # Open, grasp at z = 0, lift, carry for 30 steps, release.
    q = [0.04] * 5 + [0.02] * 45 + [0.04] * 5
    z = [0.0] * 15 + [0.05] * 40
    rows = [(1, i, [0.0, 0.0, z[i], 3.14159, 0.0, 0.0, q[i]]) for i in range(len(q))]
    states = spark.createDataFrame(rows, "ep int, step int, s array<double>")
    plan = spark.createDataFrame([(1, 0, "pick", "mug"), (1, 1, "place", "mug"), (1, 2, "close", "drawer")], "ep int, ord int, kind string, what string")
    assert [r.t for r in predicates.completions(states, plan, "ep").orderBy("ord").collect()] == [15, 52, None]


def test_lookups(spark):
    from episodica.operators import joins

    a = spark.createDataFrame([(1, "red mug")], "k int, name string")
    b = spark.createDataFrame([(1, "mug", 1), (1, "red", 0), (1, "pan", 2)], "k int, other string, ord int")
    assert joins.either_contains(a, b, "k", "name", "other", "ord").first().other == "red"
    bank = F.array(F.lit("picked cube at <10, 10>"))
    assert one(spark, joins.duplicates_claim(bank, F.lit("picked cube at <17, 17>"))) and not one(spark, joins.duplicates_claim(bank, F.lit("picked cube at <18, 17>")))


def test_state_quality(spark):
    truth = spark.createDataFrame([(1, 0, 0, "a at <1, 1>"), (1, 16, 0, "b")], "ep int, t int, ord int, line string")
    said = spark.createDataFrame([(1, 0, 0, "a at <9, 9>"), (1, 16, 0, "c")], "ep int, t int, ord int, line string")
    r = grouped.state_quality(truth, said, "ep").first()
    assert (r.precision, r.recall, r.final_recall, r.divergence) == (0.75, 0.75, 0.5, 16)


def test_stalls(spark):
    rows = [(e, t, t > 0, c if t == 3 else None, a if t == 4 else None) for e, c, a in (("silent", None, None), ("held", "x", "y"), ("in", "x", "x")) for t in range(10)]
    rows += [("short", t, t > 6, None, None) for t in range(10)]
    found = quality.stalls(spark.createDataFrame(rows, "ep string, t int, behind boolean, claim string, admitted string"), "ep", "t", "claim", "admitted")
    assert {(r.ep, r.length, r.mechanism) for r in found.collect()} == {("silent", 9, "SILENT"), ("held", 9, "HELD"), ("in", 9, "admitted but behind")}


def test_failure_classes_follow_the_oracle_order(spark):
    said = {
        "stall": ["a"] + ["b"] + ["a"] * 9,  # stays at an earlier text
        "ahead": ["c", "c", "c"] + ["x"] * 8,  # a later text
        "far": [f"{t} at <90, 9>" for t in "abbbbbbbbbc"],
        "fine": list("abbbbbbbbbc"),
        "none": ["x"] * 11,
    }
    rows = [(k, t, f"{o} at <1, 1>", p) for k, texts in said.items() for t, (o, p) in enumerate(zip("abbbbbbbbbc", texts))]
    placed = quality.positions(spark.createDataFrame(rows, "ep string, t int, o string, p string"), "ep", "t", "o", "p")
    ends = spark.createDataFrame([(k, False) for k in [*said, "gone"]] + [("won", True), ("open", None)], "ep string, ok boolean")
    got = {r.ep: r["class"] for r in quality.failure_classes(ends, placed, "ep", "t", "ok").collect()}
    assert got == {"stall": "STALL", "ahead": "PREMATURE", "far": "wrong coordinate", "fine": "policy", "none": "content wrong", "gone": "no-trace", "won": "success"}


def test_negatives_keep_rows_of_unknown_kind(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3 == 1) for i in range(300)], "id int, pos boolean")
    got = [r.id for r in corpus.sample_negatives(df, F.col("pos"), 1, ["id"]).collect()]
    assert len(got) == len(set(got)) == 200 and sum(i % 3 == 1 for i in got) == 100 and any(i % 3 == 0 for i in got)
    assert corpus.sample_negatives(df, F.col("pos"), 9, ["id"]).count() == 300


def test_strict_subset(spark):
    df, keys = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int"), lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    assert sorted(r.k for r in gates.strict_subset(df, keys(2), "k").collect()) == [2, 2]
    for bad in (keys(2, 9), keys(1, 2, 3)):
        with pytest.raises(Exception, match="keys that the table lacks|not a strict subset"):
            gates.strict_subset(df, bad, "k").collect()


def test_state_quality_against_brute_force(spark):
    import random

    r = random.Random(3)
    line = lambda: r.choice(["a", "a at <{0}, {1}>", "b at <{0}, {1}> to <{2}, {0}>"]).format(*(r.randrange(60) for _ in range(3)))
    sides = [[(ep, r.randrange(40), n, line()) for ep in range(8) for n in range(r.choice((0, 15, 60)))] for _ in range(2)]
    form = lambda x: (re.sub("<.*?>", "<>", x), [int(v) for v in re.findall(r"\d+", x)])

    def want(ep):
        g, p = ([(t, *form(x)) for e, t, _, x in sorted(side, key=lambda x: x[:3]) if e == ep] for side in sides)
        precision, recall, divergence = [], [], -1
        for tick in sorted({x[0] for x in g + p}):
            truths, free = [x for x in g if x[0] <= tick], [x for x in p if x[0] <= tick]
            said, hits = len(free), 0
            for _, f, at in truths:
                k = next((k for k, (_, h, y) in enumerate(free) if h == f and all(abs(u - v) <= 12 for u, v in zip(at, y))), None)
                if k is not None:
                    free.pop(k)
                    hits += 1
            recall.append(hits / max(len(truths), 1))
            precision.append(hits / said if said else float(not truths))
            divergence = tick if divergence < 0 and hits < len(truths) else divergence
        return (sum(precision) / len(precision), sum(recall) / len(recall), recall[-1], divergence)

    found = grouped.state_quality(*(spark.createDataFrame(s, "ep int, t int, ord int, line string") for s in sides), "ep").collect()
    assert {x.ep for x in found} == {x[0] for s in sides for x in s}
    for x in found:
        assert all(abs(u - v) < 1e-9 for u, v in zip((x.precision, x.recall, x.final_recall, x.divergence), want(x.ep)))


def test_state_quality_takes_all_events(spark):
    from episodica.plans import registry

    folder = "/root/testdata/sf0.001"
    eps = {r.user_id for r in spark.read.parquet(f"{folder}/events.parquet").select("user_id").collect()}
    got = registry.QUERIES["state_quality"](spark, folder).collect()
    lines = spark.read.parquet(f"{folder}/events.parquet").groupBy("user_id").max("event_id").collect()
    assert {r.ep for r in got} == eps and max(x[1] for x in lines) >= 500
    # The even events alone are true and all are said, so every truth is found, and half of the lines are right.
    assert all(r.final_recall == 1 for r in got)


def test_assignment_against_all_pairs(spark):
    import random

    from episodica.plans import registry

    def want(here, there, radius):
        names, ords, out = set(), set(), []
        for d, n, o in sorted((((r - u) ** 2 + (c - v) ** 2) ** 0.5, n, o) for n, r, c in here for o, u, v in there):
            if d <= radius and n not in names and o not in ords:
                names.add(n)
                ords.add(o)
                out.append((n, o, d))
        return out

    def pairs_of(here, there, radius):
        queues = cover._Queue(), cover._Queue()
        for queue, rows in zip(queues, (here, there)):
            for row in rows:
                queue.add(*row)
        return cover._sure_pairs(*queues, radius, lambda at: True)[0]

    x = random.Random(5)
    for n, wide, radius in ((0, 5, 3), (30, 3, 2), (60, 12, 4), (60, 60, 20), (40, 6, 0), (50, 9, 2.5)):
        at = lambda: (x.randrange(-wide, wide), x.randrange(-wide, wide))
        here, there = [(str(x.randrange(50)), *at()) for _ in range(n)], [(x.randrange(50), *at()) for _ in range(n)]
        assert sorted(pairs_of(here, there, radius)) == sorted(want(here, there, radius))
    # Many copies of one place are paired in order.
    assert len(pairs_of([(str(i), 1, 1) for i in range(20_000)], [(i, 1, 2) for i in range(20_000)], 5)) == 20_000
    folder = "/root/testdata/sf0.001"
    points = [(r.label, r.vec_id, *(math.floor(v * 256) for v in r.embedding[:2])) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    pairs = []
    for label in {p[0] for p in points}:
        sides = [[p[1:] for p in points if p[0] == label and p[1] % 2 == k] for k in (0, 1)]
        pairs += [(label, *y) for y in want([(str(n), r, c) for n, r, c in sides[0]], sides[1], 20)]
    assert sorted(map(tuple, registry.QUERIES["assign_points"](spark, folder).collect())) == sorted(pairs)


def test_snapping_takes_every_row(spark):
    from episodica.plans import registry

    p = spark.createDataFrame([("x", 1, 0, 0), ("x", 2, 0, 0), ("x", 3, 100, 0), ("y", 4, 1, 1), (None, 5, 1, 1), ("x", 6, None, 1)], "label string, id bigint, r bigint, c bigint")
    a = spark.createDataFrame([("x", 9, 9, 12), ("x", 8, 12, 9), ("x", 7, -20, 0), ("x", 11, 100, 16), (None, 1, 1, 2)], "label string, id bigint, r bigint, c bigint")
    got = {r.id: (r.r, r.c) for r in spatial.snap_points(p, a, "label", 15).collect()}
    assert got == {1: (12, 9), 2: (12, 9), 3: (100, 0), 4: (1, 1), 5: (1, 1), 6: (None, 1)}
    folder = "/root/testdata/sf0.001"
    ids = {r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()}
    assert {r.id for r in registry.QUERIES["nearest_snap"](spark, folder).collect()} == {i for i in ids if i % 5 != 1}


def test_location_gates(spark):
    import numpy as np

    from episodica.operators import predicates

    camera = predicates.Camera(((100.0, 0, 0, 0), (0, 100.0, 0, 0), (0, 0, 0, 1)))
    n = 200
    s = np.zeros((n, 7))
    s[:, 6] = 0.05  # open
    s[10:60, 6], s[100:150, 6] = 0.02, 0.02  # held twice
    s[20:60, 2], s[110:150, 2] = 0.1, 0.1  # and lifted
    s[:, 1] = np.where(np.arange(n) < 80, 0.1, 2.0)  # rows 10 and 200
    states = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(s)], "ep int, step int, s array<double>")
    at = lambda r, what="bowl": spark.createDataFrame([(1, 0, "place", what, r, 0.0)], "ep int, ord int, kind string, what string, r double, c double")
    first = lambda plan: predicates.completions(states, plan, "ep", camera=camera).first().t
    assert first(at(None)) == first(at(10.0)) == first(at(200.0, "the top drawer")) == 62
    assert first(at(200.0)) == 152 and first(at(90.0)) is None
    assert first(at(200.0).drop("r", "c")) == 62


def test_detection_cache_and_what_it_lacks(spark, tmp_path):
    (tmp_path / "e3.json").write_text('{"0": [["cube", 4.0, 5], ["arm", 1, 2]], "8": []}')
    (tmp_path / "e4.json").write_text('{"16": [["peg", 7, 8]]}')
    (tmp_path / "extra.json").write_text("{}")
    found, lost = readers.detection_cache(spark, str(tmp_path), spark.createDataFrame([(3,), (5,)], "ep bigint"))
    assert sorted(tuple(r) for r in found.collect()) == [(3, 0, "arm", 1, 2), (3, 0, "cube", 4, 5)]
    assert [r.ep for r in lost.collect()] == [5]


def test_reassembly_fails_and_clips(spark):
    df = spark.createDataFrame([(1, 0, 3, [-2.0, 0.5]), (1, 2, 4, [9.0, 1.0])], "ep int, ord int, n int, a array<double>")
    out = readers.reassemble(df, ["ep"], "ord", "n", clip={"a": (-1.0, 1.0)}).orderBy("ord").collect()
    assert [(r.offset, r.complete, r.a) for r in out] == [(0, False, [-1.0, 0.5]), (3, False, [1.0, 1.0])]
    with pytest.raises(Exception, match="a segment is missing"):
        readers.reassemble(df, ["ep"], "ord", "n", strict=True).collect()


def test_sinks_by_content_and_families(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "x string")
    path = str(tmp_path / "c")
    assert [writers.append_content(df, path, "x"), writers.append_content(df, path, "x")] == [2, 0]
    index = writers.meta_family(str(tmp_path / "m"), {"one": df, "two": df.limit(1)})
    assert sorted(tuple(r) for r in index.collect()) == [("one", 3), ("two", 1)]


def test_offsets_over_all_rows(spark):
    df = spark.createDataFrame([(i * 7 % 500, i % 5) for i in range(500)] + [(None, 4)], "k int, n int").repartition(5)
    found = {r.k: r.offset for r in ordered.running_offset(df, ["k"], "n").collect()}
    at, want = 4, {None: 0}
    for k, n in sorted((i * 7 % 500, i % 5) for i in range(500)):
        want[k], at = at, at + n
    assert found == want


def test_windows_at_their_edges(spark):
    ticks = spark.createDataFrame([(1, 0), (1, 16), (1, 40)], "ep int, last bigint")
    rows = spark.createDataFrame([(1, t, f"x{t}") for t in (0, 15, 16, 23, 24, 39, 40)] + [(2, 30, "y")], "ep int, t bigint, v string")
    found = {r.last: [x.v for x in r.before] for r in ordered.window_before(ticks, rows, "ep", "last", "t", ["v"]).collect()}
    assert found == {0: [], 16: ["x0", "x15"], 40: ["x24", "x39"]}


def test_pairs_tell_errors_and_needs(spark):
    a = spark.createDataFrame([(1, 0, 0, "completed: put at <10, 10>"), (1, 32, 0, "completed: put at <10, 10>"), (1, 64, 0, "seen <1, 1>")], "ep int, t int, ord int, line string")
    b = spark.createDataFrame([(1, 40, 0, "completed: put at <13, 14>"), (1, 64, 0, "seen <1, 1>")], "ep int, t int, ord int, line string")
    pairs = grouped.pair_lines(a, b, "ep")
    assert [(r.t_truth, r.t_said, r.errors, r.met) for r in pairs.orderBy("t_truth").collect()] == [(0, 40, [5.0], False), (32, None, [], True), (64, 64, [0.0], None)]
    r = quality.pair_report(pairs, ["ep"]).first()
    assert (r.lines, r.median_lag, r.median_error, r.completions, r.met) == (3, 1.0, 2.5, 2, 1)


def test_greedy_match_against_brute_force(spark):
    import random

    rnd = random.Random(0)
    side = lambda: [(e, rnd.randrange(0, 96, 16), k, f"put {rnd.choice('ab')} at <{rnd.randrange(40)}, {rnd.randrange(40)}>") for e in range(6) for k in range(12)]
    a, b = side(), side()
    schema = "ep int, t int, ord int, line string"
    got = [(r.ep, r.t_truth, r.t_said) for r in grouped.pair_lines(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "ep").collect()]
    want, key = [], lambda x: (x[0], x[1], x[2])
    used = set()
    for e, t, _, line in sorted(a, key=key):
        at = list(map(int, re.findall(r"\d+", line)))
        hit = next((x for x in sorted(b, key=key) if x not in used and x[0] == e and x[3][:5] == line[:5] and all(abs(int(u) - v) <= 12 for u, v in zip(re.findall(r"\d+", x[3]), at))), None)
        used.add(hit)
        want.append((e, t, hit[1] if hit else None))
    assert sorted(got, key=str) == sorted(want, key=str)
