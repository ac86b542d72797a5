"""Machines against plain loops, and over a stream as in batch."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import predicates
from episodica.plans import serving as plans
from episodica.streaming import claims, machines, scans, serving
from episodica.streaming.machines import Machine, Memory

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark):
    spark.conf.set(*machines.STORE)
    yield spark
    spark.conf.unset(machines.STORE[0])


def rows_of(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.collect())


def streamed(spark, ticks, parts, machine, folder, **more):
    """The machine's rows over the parts (filters of ticks), a query started anew for each; and the last progress."""
    source, target, marks = (str(folder / x) for x in ("in", "out", "marks"))
    for part in parts:
        ticks.filter(part).coalesce(1).write.mode("append").parquet(source)
        found = spark.readStream.schema(ticks.schema).parquet(source)
        if more.get("event_time"):
            found = found.withWatermark(more["event_time"], "0 seconds")
        query = machines.stream(found, machine, **more).writeStream.format("parquet").option("path", target).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    return spark.read.parquet(target), query.lastProgress


@pytest.mark.parametrize("name", ["pointer", "feed", "sequence", "cited", "tracker"])
def test_stream_is_batch(store, tmp_path, name):
    ticks, machine = {
        "pointer": (plans.pointer_ticks, serving.pointer()), "feed": (plans.feed_ticks, serving.feed(2, 4, 2, 0.02)), "sequence": (plans.sequence_ticks, serving.sequence_pin()),
        "cited": (plans.class_ticks, serving.cited_class(least=2)), "tracker": (plans.tracker_ticks, serving.tracker_pin()),
    }[name]
    ticks = ticks(store, SF)
    # The second trigger sends ticks of the first one again.
    found, _ = streamed(store, ticks, ["tick < 20", "tick >= 15"], machine, tmp_path)
    assert rows_of(found) == rows_of(machines.batch(ticks, machine)) and found.count() > 300


def counting():
    def step(m, x):
        m.append("seen", x.tick)
        m.set("n", m.get("n", 0) + 1)
        m.put("last", "k", x.tick)
        return [(m.get("n"), len(m.rows("seen")), m.items("last")["k"][0])]

    return Machine(step, "n bigint, held bigint, last bigint", {"n": "bigint"}, {"seen": "t bigint"}, {"last": ("string", "t bigint")})


def test_reset_clears_all(store, tmp_path):
    ticks = store.createDataFrame([(1, t, t == 3) for t in range(6)], "ep bigint, tick bigint, reset boolean")
    want = [(0, 1, 1, 0), (1, 2, 2, 1), (2, 3, 3, 2), (3, 1, 1, 3), (4, 2, 2, 4), (5, 3, 3, 5)]
    assert sorted(tuple(r)[1:] for r in machines.batch(ticks, counting()).collect()) == want
    found, _ = streamed(store, ticks, ["tick < 2", "tick between 2 and 4", "tick = 5"], counting(), tmp_path)
    assert sorted(tuple(r)[1:] for r in found.collect()) == want


def test_idle_episodes_are_forgotten(store, tmp_path):
    """Each part brings other episodes a day later: what is kept does not grow with what was seen."""
    rows = [(10 * day + e, t, f"2024-01-{day + 1:02d} 00:00:0{t}") for day in range(4) for e in range(5) for t in range(3)]
    ticks = store.createDataFrame(rows, "ep bigint, tick bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = [F.dayofmonth("ts") == d + 1 for d in range(4)]
    found, progress = streamed(store, ticks, parts, counting(), tmp_path / "a", idle=3_600_000, event_time="ts")
    assert found.count() == 60 and {r.n for r in found.collect()} == {1, 2, 3}
    assert progress["stateOperators"][0]["numRowsTotal"] <= 2 * 5 * 8
    _, kept = streamed(store, ticks, parts, counting(), tmp_path / "b")
    assert kept["stateOperators"][0]["numRowsTotal"] > progress["stateOperators"][0]["numRowsTotal"]
    back = store.createDataFrame([(1, 0, "2024-02-01 00:00:00")], "ep bigint, tick bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    again, _ = streamed(store, back, ["true"], counting(), tmp_path / "a", idle=3_600_000, event_time="ts")
    assert [r.n for r in again.filter("ep = 1 and tick = 0").orderBy("n").collect()] == [1, 1]  # a new start, though its tick was seen


def motion(r, n):
    """States in which hands grasp, lift, turn, pull, and rest."""
    out, at, turn = [], np.array([0.0, 0.0, 0.1]), 180.0
    while len(out) < n:
        finger, go, to, rise = r.choice([0.02, 0.02, 0.04, 0.0]), r.choice([0.0, 0.0, 0.006, -0.006]), r.choice([180.0, 100.0, 150.0]), r.choice([0.0, 0.004, -0.004])
        for _ in range(r.choice([4, 7, 18, 30])):
            turn += max(-4.0, min(4.0, to - turn))
            at = at + np.array([go, go / 2, rise])
            at[2] = max(at[2], 0.0)
            out.append([*at.tolist(), float(np.radians(turn)), 0.0, 0.0, finger])
    return out[:n]


def plain_chain(states, cuts, plan, settle, camera):
    """fired at each tick, by the predicates over the series so far."""
    j, start, origins, was, again, out = 0, 0, {}, None, 0, []
    for n in cuts:
        if j >= len(plan):
            out.append((j, None, False))
            continue
        kind, what, gate = plan[j]
        at = None
        if start < n:
            found = predicates.Motion(np.array(states[:n]), predicates.Bounds(), camera)
            found.origins, found.gate = dict(origins), None if "drawer" in what else gate
            at = getattr(found, kind)(start, what)
            origins = found.origins
        again = again + 1 if at is not None and at == was else int(at is not None)
        done = at is not None and again >= settle
        out.append((j, at, done))
        was, again = (None, 0) if done else (at, again)
        if done:
            j, start = j + 1, at + 1
    return out


@pytest.mark.parametrize("settle", [1, 3])
def test_scan_is_the_predicate_of_the_series_so_far(settle):
    camera, met = predicates.Camera(((100.0, 0, 128, 0), (0, 100, 128, 0), (0, 0, 1, 1))), set()
    for seed in range(60):
        r = random.Random(seed)
        states = motion(r, 400)
        kinds = [r.choice(["pick", "place", "pour", "open", "close"]) for _ in range(6)]
        kinds[:2] = ["open", "close"] if seed % 2 else kinds[:2]
        plan = [(k, "drawer" if k in ("open", "close") else "it", r.choice([None, (128.0, 128.0)]) if k in ("place", "pour") else None) for k in kinds]
        cuts = sorted(r.sample(range(1, 400), 60))
        machine, m, got = scans.fired(camera=camera, settle=settle), Memory(), []
        for a, b in zip([0, *cuts], cuts):
            class Tick:
                kinds, whats = [p[0] for p in plan], [p[1] for p in plan]
                gate_r, gate_c = ([p[2][i] if p[2] else None for p in plan] for i in (0, 1))
                states_ = states[a:b]

            Tick.states = Tick.states_
            got += machine.step(m, Tick)
        assert got == plain_chain(states, cuts, plan, settle, camera), seed
        met |= {plan[j][0] for j, _, done in got if done}
    assert met == {"pick", "place", "pour", "open", "close"}


def scan_ticks(spark, n=3):
    plan, rows = [("pick", "a"), ("place", "a"), ("open", "drawer"), ("close", "drawer")], []
    for e in range(n):
        states = motion(random.Random(e), 300)
        for t in range(30):
            lines = [f"completed: {plan[t % 4][1]}", "note"] if t % 3 == 0 else [None]
            rows.append((e, t, [k for k, _ in plan], [w for _, w in plan], states[10 * t : 10 * t + 10], t % 7 == 0, lines))
    return spark.createDataFrame(rows, "ep bigint, tick bigint, kinds array<string>, whats array<string>, states array<array<double>>, refuted boolean, lines array<string>")


def test_series_over_a_stream(store, tmp_path):
    ticks = scan_ticks(store)
    parts = ["tick < 3", "tick between 3 and 17", "tick >= 17"]
    for name, machine in (("fired", scans.fired()), ("claims", claims.over_states())):
        found, _ = streamed(store, ticks, parts, machine, tmp_path / name)
        assert rows_of(found) == rows_of(machines.batch(ticks, machine)) and found.count() > 30


def test_claims_find_their_own_evidence(spark):
    """Claims are admitted on what the scan finds; an episode that claims nothing gets them by itself, in the plan's order."""
    ticks = scan_ticks(spark, 6)
    got = [r.verdict for r in machines.batch(ticks, claims.over_states(claims.Rules(grace=1))).collect()]
    assert {"admit", "defer"} <= set(got)
    quiet = ticks.withColumn("lines", F.array().cast("array<string>"))
    by_itself = machines.batch(quiet, claims.over_states(claims.Rules(grace=1))).orderBy("ep", "tick").collect()
    assert {r.verdict for r in by_itself} <= {"auto", "phantom"} and sum(r.verdict == "auto" for r in by_itself) > 3
    for e in range(6):
        assert [r.text for r in by_itself if r.ep == e and r.verdict == "auto"] == [f"[event] completed: {w} (auto)" for w in ("a", "a", "drawer", "drawer")][: sum(r.ep == e and r.verdict == "auto" for r in by_itself)]


def test_new_rows_alone_are_read():
    """After a plan step has begun, no tick reads the series again."""
    machine, reads = scans.fired(), []

    class Watched(Memory):
        def rows(self, name):
            reads.append(name)
            return super().rows(name)

        def tail(self, name, n):
            return self._lists[name][-n:]

    m, states = Watched(), motion(random.Random(3), 300)
    for t in range(30):
        class Tick:
            kinds, whats = ["pour"], ["it"]

        Tick.states = states[10 * t : 10 * t + 10]
        machine.step(m, Tick)
    assert len(reads) == 1


def test_stream_wants_its_store(spark):
    spark.conf.unset(machines.STORE[0])
    with pytest.raises(RuntimeError, match="stateStore"):
        machines.stream(spark.readStream.schema("ep bigint, tick bigint").parquet(f"{SF}/orders.parquet"), counting())


def ticks_of(rows, *names):
    from types import SimpleNamespace

    return [SimpleNamespace(**dict(zip(names, r))) for r in rows]


def run(machine, ticks):
    m = Memory()
    return [row for x in ticks for row in machine.step(m, x)]


def test_press_trigger_tick_by_tick(spark):
    from episodica.operators import evidence

    r = random.Random(3)
    rows = [(e, t, r.choice([None, 5.0, 15.0, 30.0, 60.0, 60.0])) for e in range(4) for t in range(0, 400, 4)]
    df = spark.createDataFrame(rows, "ep int, tick bigint, distance double")
    want = evidence.press_trigger(df, "ep", "tick", "distance", 4).select("ep", "tick", "arrivals", "fires", "latched")
    got = machines.batch(df, evidence.press_machine(4))
    assert rows_of(got) == rows_of(want) and got.filter("latched").count() > 0


def test_dwell_tick_by_tick():
    from episodica.operators import evidence

    flags = [True, True, None, True, True, True, True, False, True, True, True]
    got = run(evidence.dwell_machine(3), ticks_of([(f,) for f in flags], "flag"))
    assert [h for h, _ in got] == [False] * 5 + [True, True] + [False] * 3 + [True] and [k for k, (_, d) in enumerate(got) if d] == [5]


def test_writer_gate():
    rows = [
        ("completed: press the button at <10, 10>", None, False), ("completed: press the button at <10, 10>", None, False), (None, "completed: press it <50, 50>", False),
        ("completed: press the red button at <55, 58>", None, False), ("completed: press the red button at <60, 60>", None, False), ("completed: pick it <50, 50>", None, False),
        ("completed: move to the top of the left-side target", None, True), (None, "completed: move to the top of the right-side target", True), ("completed: move to the top of the right-side target!", None, True),
        ("completed: move to the top of the left-side target", None, True), ("completed: move to the top of the left-side target!", None, False), (None, None, True),
    ]
    got = [v for _, v in run(serving.writer_gate(), ticks_of(rows, "line", "auto", "alternates"))]
    assert got == ["admit", "repeat", "claim", "auto", "admit", "admit", "admit", "claim", "side", "admit", "admit"]


def test_deposits(spark):
    from episodica.operators import evidence

    cube, arm, bin_ = ("red_cube", 10, 10), ("arm", 12, 10), ("bin", 15, 10)
    cases = [([[cube], [cube]], True, True), ([[cube], []], True, True), ([[cube, arm], [cube, arm]], False, True), ([[cube], [arm]], False, False), ([[], []], False, False), ([[bin_], [bin_, cube]], False, False), ([[bin_, arm], [bin_]], True, True), ([[arm], [cube]], True, False)]
    for frames, loose, strict in cases:
        df = spark.createDataFrame([(frames,)], "f array<array<struct<name:string,r:int,c:int>>>")
        got = df.select(*[evidence.deposited(F.col("f"), F.lit(10), F.lit(10), s) for s in (False, True)]).first()
        assert tuple(got) == (loose, strict), frames


def test_grasp_bands(spark):
    widths = spark.createDataFrame([("milk", 2, 0.02, 0.03), ("carry:milk", 2, 0.015, 0.05), ("tomato sauce", 0, 0.004, 0.01), ("sauce", 9, 0.03, 0.031)], "thing string, rank int, p10 double, p90 double")
    plan = spark.createDataFrame([(1, 0, "pick", "the Milk"), (1, 1, "place", "the milk"), (1, 2, "place", "tomato sauce"), (1, 3, "open", "milk drawer"), (1, 4, "pick", "bread")], "ep int, ord int, kind string, what string")
    banded = predicates.grasp_bands(plan, widths)
    got = {r.ord: (r.low, r.high) for r in banded.collect()}
    assert got[0] == pytest.approx((0.016, 0.034)) and got[1] == pytest.approx((0.011, 0.0395)) and got[2] == pytest.approx((0.006, 0.014)) and got[3] == got[4] == (None, None)
    # A band that the finger is not in finds no grasp.
    states = [[0.0, 0.0, 0.0, 3.14, 0.0, 0.0, 0.04]] * 3 + [[0.0, 0.0, 0.01 * k, 3.14, 0.0, 0.0, 0.012] for k in range(15)]
    s = spark.createDataFrame([(1, k, x) for k, x in enumerate(states)], "ep int, step int, s array<double>")
    found = {r.ord: r.t for r in predicates.completions(s, banded.filter("ord in (0, 4)"), "ep").collect()}
    assert found[0] is None and found[4] is not None


def test_phrases_with_false_hits(spark):
    from episodica.operators import joins

    scores = spark.createDataFrame([("a", 1, 0.5, True), ("a", 1, 0.9, False), ("a", 1, 0.01, False), ("a", 2, 0.1, True), ("a", 2, 0.2, False)], "p string, f int, s double, near boolean")
    frames = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "p string, f int")
    got = {r.p: r for r in joins.phrase_report(scores, frames, ["p"], "f", "s", F.col("near")).collect()}
    assert (got["a"].mean_best, got["a"].hit_rate, got["a"].false_per_frame) == pytest.approx((0.2, 1 / 3, 2 / 3)) and tuple(got["b"])[1:] == (0, 0, 0, 1)
