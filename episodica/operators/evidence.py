"""Evidence in a tick's frames: presence and absence near a place.

frames is an array (in time order) of arrays of detections (name, r, c).
Radii are inclusive, in pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.streaming.machines import Machine, Memory

from . import spatial


def _near(frame: Column, r: Column, c: Column, radius: float, part: str | None = None) -> Column:
    of = F.filter(frame, lambda d: d["name"].contains(part)) if part else frame
    return spatial.any_near(of, r, c, radius)


def longest_run(flags: Column) -> Column:
    """The longest run of true; 0 for an empty or null array."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, f):
        run = F.when(f, s["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.coalesce(F.aggregate(flags, start, step, lambda s: s["best"]), F.lit(0))


def trailing_run(flags: Column) -> Column:
    """How many of the last flags are true without a break."""
    return F.coalesce(F.aggregate(flags, F.lit(0), lambda n, f: F.when(f, n + 1).otherwise(0)), F.lit(0))


def pressed(frames: Column, r: Column, c: Column, button: str = "button", near: float = 12, reach: float = 45, need: int = 2) -> Column:
    """The button is hidden in `need` consecutive frames in which the arm is in reach."""
    return longest_run(F.transform(frames, lambda f: ~_near(f, r, c, near, button) & _near(f, r, c, reach, "arm"))) >= need


def absent(frames: Column, r: Column, c: Column, part: str, near: float = 14, need: int = 2) -> Column:
    return longest_run(F.transform(frames, lambda f: ~_near(f, r, c, near, part))) >= need


def lifted(before: Column, frames: Column, r: Column, c: Column, part: str, near: float = 14, need: int = 2) -> Column:
    """Seen in an earlier frame, then absent up to the end for `need` frames or more."""
    seen = F.transform(F.concat(before, frames), lambda f: _near(f, r, c, near, part))
    gone = trailing_run(F.transform(seen, lambda x: ~x))
    return (gone >= need) & (gone < F.size(seen))


def placed(frames: Column, r: Column, c: Column, part: str, strict: bool, near: float = 16, arm: float = 24) -> Column:
    """There in every frame (strict), or in the last one without an arm beside it."""
    if strict:
        return (F.size(frames) > 0) & F.forall(frames, lambda f: _near(f, r, c, near, part))
    last = F.element_at(frames, -1)
    return F.coalesce(_near(last, r, c, near, part) & ~_near(last, r, c, arm, "arm"), F.lit(False))


#: What can be put somewhere, and what hides what is put into it.
MOVABLE, HIDING = ("cube", "peg", "container"), ("bin", "container", "drainer")


def deposited(frames: Column, r: Column, c: Column, strict: bool, near: float = 16, inside: float = 20, arm: float = 24, visit: float = 22) -> Column:
    """Was something put at the place? Into what hides it: the arm came near in a frame. Else a movable thing is there
    in every frame that shows anything (strict), or in the last of these without an arm beside it."""
    of = lambda f, parts: F.filter(f, lambda d: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(d["name"], p)))
    some = F.filter(frames, lambda f: F.size(f) > 0)
    arms = lambda f: F.filter(f, lambda d: d["name"] == "arm")
    hidden = F.exists(some, lambda f: spatial.any_near(of(f, HIDING), r, c, inside))
    came = F.exists(some, lambda f: spatial.any_near(arms(f), r, c, visit))
    rests = lambda f: spatial.any_near(of(f, MOVABLE), r, c, near)
    last = F.element_at(some, -1)
    shown = F.forall(some, rests) if strict else rests(last) & ~spatial.any_near(arms(last), r, c, arm)
    return F.when(F.size(some) == 0, False).when(hidden, came).otherwise(shown)


def visited(before: Column, frames: Column, r: Column, c: Column, reach: float = 22) -> Column:
    """The arm came near in this tick or the one before."""
    return F.exists(F.concat(before, frames), lambda f: _near(f, r, c, reach, "arm"))


def counted(bank: Column, part: str) -> Column:
    return F.size(F.filter(bank, lambda x: F.contains(F.lower(x), F.lit(part)))).cast("bigint")


def press_trigger(ticks: DataFrame, key: str, step: str, distance: str, nth: int, near: float = 20, rest: int = 24, period: int = 80, ahead: int = 28) -> DataFrame:
    """ticks with arrivals, fires and latched: press ahead of the nth arrival, by the period of those before.

    An arrival is a distance under `near` after one that wasn't (or at the
    start; unseen ones are passed over), more than `rest` steps after the last.
    The period is the upper median of the gaps. Once fired, it stays latched.
    """
    w = Window.partitionBy(key).orderBy(step)
    before = F.last(distance, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    comes = (F.col(distance) < near) & (before.isNull() | (before >= near))
    marks = F.collect_list(F.when(comes, F.col(step).cast("bigint"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    none = F.array().cast("array<bigint>")
    far = F.aggregate("marks_", none, lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) > rest), F.array_append(a, x)).otherwise(a))
    out = ticks.withColumn("marks_", marks).withColumn("at_", far)
    gaps = F.array_sort(F.zip_with(F.slice("at_", 2, F.greatest(F.size("at_") - 1, F.lit(0))), F.slice("at_", 1, F.greatest(F.size("at_") - 1, F.lit(0))), lambda b, a: b - a))
    wait = F.when(F.size("at_") > 1, F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))).otherwise(F.lit(period))
    due = F.element_at("at_", -1) + wait * (nth - F.size("at_"))
    fires = (F.size("at_") >= max(1, nth - 1)) & (due - F.col(step) <= ahead)
    out = out.withColumn("fires", F.coalesce(fires, F.lit(False))).withColumn("arrivals", F.size("at_").cast("bigint"))
    return out.withColumn("latched", F.bool_or("fires").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("marks_", "at_")


def press_machine(nth: int, near: float = 20, rest: int = 24, period: int = 80, ahead: int = 28) -> Machine:
    """press_trigger() tick by tick: a tick has its step as `tick`, and distance (null: not seen).

    Only the arrivals are kept, not the steps between them. Gives arrivals, fires, latched.
    """

    def step(m: Memory, x) -> list[tuple]:
        d, t, at = x.distance, int(x.tick), m.get("at", [])
        if d is not None and d == d:
            before = m.get("before")
            if d < near and (before is None or before >= near) and (not at or t - at[-1] > rest):
                at = [*at, t]
                m.set("at", at)
            m.set("before", float(d))
        gaps = sorted(b - a for a, b in zip(at, at[1:]))
        wait = gaps[len(gaps) // 2] if gaps else period
        fires = len(at) >= max(1, nth - 1) and at[-1] + wait * (nth - len(at)) - t <= ahead
        m.set("latched", bool(m.get("latched", False) or fires))
        return [(len(at), fires, m.get("latched"))]

    return Machine(step, "arrivals bigint, fires boolean, latched boolean", {"at": "array<bigint>", "before": "double", "latched": "boolean"})


def dwell_machine(k: int) -> Machine:
    """ordered.sustained() tick by tick: a tick has flag; gives held (the k-th in a row and later) and done (the first such)."""

    def step(m: Memory, x) -> list[tuple]:
        run = m.get("run", 0) + 1 if x.flag is not None and bool(x.flag) else 0
        done = run >= k and not m.get("met", False)
        m.set("run", run)
        m.set("met", bool(m.get("met", False) or done))
        return [(run >= k, done)]

    return Machine(step, "held boolean, done boolean", {"run": "bigint", "met": "boolean"})
