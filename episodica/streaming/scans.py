"""Plan steps found completed while an episode's states arrive, without going over the series again.

States are appended to a list state one by one, with what the masks of
operators.predicates say about them (running counts make these causal). The
predicate of the current plan step is an automaton whose phase, marks and counts
are a few numbers. Only when a plan step begins does it look back, once, at as
much of the series as its rule needs: the grasp that holds what is to be placed,
or the steps that a held turn counts.

At every tick the automaton says what operators.predicates says of the series so
far: opening and closing may name the series' last step until the hand is still.
"""

from __future__ import annotations

import math
import re
from typing import Any

import numpy as np

from episodica.operators.predicates import Bounds, Camera

from .machines import Machine, Memory

#: Columns of the series; since is where the run of steps with the finger in its band began (-1: it is not in it).
SERIES = "x double, y double, z double, tilt double, q double, grasp boolean, wide boolean, edge boolean, shut boolean, still boolean, since bigint"
VALUES = {
    "n": "bigint", "q": "double", "x": "double", "y": "double", "since": "bigint", "grasping": "bigint", "opened": "bigint", "shutting": "bigint", "resting": "bigint",
    "step": "bigint", "from": "bigint", "phase": "string", "mark": "bigint", "free": "boolean", "ref": "double", "cx": "double", "cy": "double", "away": "bigint", "back": "bigint", "best": "double", "at": "bigint", "stop": "bigint", "found": "bigint", "fed": "bigint",
}
MAPS = {"origins": ("string", "x double, y double")}
_KINDS = ("pick", "place", "pour", "open", "close")


def _tilt(axis: list[float]) -> float:
    angle = math.sqrt(sum(v * v for v in axis))
    along = axis[2] / angle if angle > 0 else 0.0
    down = math.cos(angle) + (1 - math.cos(angle)) * along**2
    return math.degrees(math.acos(min(1.0, max(-1.0, -down))))


def append(m: Memory, s: Any, b: Bounds) -> None:
    """One more state (x, y, z, axis-angle, finger) at the series' end."""
    s = [float(v) for v in s]
    n, q = m.get("n", 0), s[6]
    inband, wide = b.band[0] < q < b.band[1], q > b.open
    quiet = abs(q - m.get("q", q)) < b.stall
    moved = math.sqrt((s[0] - m.get("x", s[0])) ** 2 + (s[1] - m.get("y", s[1])) ** 2)
    runs = {"grasping": inband and quiet, "opened": wide, "shutting": q < b.open, "resting": moved < b.slow}
    counts = {k: m.get(k, 0) + 1 if true else 0 for k, true in runs.items()}
    since = (n if m.get("since", -1) < 0 else m.get("since")) if inband else -1
    for k, v in {**counts, "n": n + 1, "q": q, "x": s[0], "y": s[1], "since": since}.items():
        m.set(k, v)
    m.append("series", s[0], s[1], s[2], _tilt(s[3:6]), q, counts["grasping"] >= 5, wide, counts["opened"] == 3, counts["shutting"] >= 5, counts["resting"] >= 5, since)


class Scan:
    """The automaton of the current plan step, between two ticks of which its numbers are kept."""

    def __init__(self, m: Memory, kind: str, what: str, gate: tuple[float, float] | None, bounds: Bounds, camera: Camera | None):
        self.m, self.kind, self.what, self.b, self.camera = m, kind, what, bounds, camera
        self.gate = gate if camera is not None and "drawer" not in what.lower() else None

    def begin(self, j: int, start: int) -> None:
        """Plan step j is looked for from step `start` of the series on."""
        for k in ("phase", "mark", "free", "ref", "cx", "cy", "away", "back", "best", "at", "stop", "found", "fed"):
            self.m.set(k, None)
        self.m.set("step", j)
        self.m.set("from", start)

    def _near(self, row: tuple) -> bool:
        if self.gate is None:
            return True
        (r, c), = self.camera.pixels(np.array([row[:3]], float))
        return math.hypot(r - self.gate[0], c - self.gate[1]) <= self.b.reach

    def look(self) -> int | None:
        """Where the step completes in the series so far."""
        m = self.m
        n, start = m.get("n", 0), m.get("from", 0)
        if self.kind not in _KINDS or start >= n:
            return None
        if m.get("found") is None:
            fed, rows = m.get("fed"), []
            if fed is None:
                series = m.rows("series")
                fed = self._look_back(series[start], start)
                rows = series[fed:]
            else:
                rows = m.tail("series", n - fed)
            feed = getattr(self, f"_{self.kind}")
            for row in rows:
                if m.get("found") is not None:
                    break
                feed(fed, row, start)
                fed += 1
            m.set("fed", fed)
        if m.get("found") is not None:
            return m.get("found")
        return self._open_end(n)

    def _look_back(self, first: tuple, start: int) -> int:
        if self.kind == "place":
            return first[10] if first[10] >= 0 else max(0, start - self.b.look_back)
        if self.kind == "pour":
            self.m.set("ref", first[3])
            return max(0, start - 14)
        return start

    def _open_end(self, n: int) -> int | None:
        m = self.m
        if self.kind == "open" and m.get("phase") == "stroke":
            return n - 1
        if self.kind == "close" and m.get("phase") == "held" and self._closes():
            return n - 1 if m.get("stop") is None else m.get("stop") - 1
        return None

    # The predicates: each takes step i of the series, from where it looks back to.

    def _grasped(self, i: int, row: tuple, also: bool) -> bool:
        """A grasp after the hand was open."""
        free = bool(self.m.get("free") or row[6])
        self.m.set("free", free)
        return free and bool(row[5]) and also

    def _pick(self, i: int, row: tuple, start: int) -> None:
        m = self.m
        if m.get("phase") is None and self._grasped(i, row, True):
            m.set("phase", "lift")
            m.set("ref", row[2])
        if m.get("phase") == "lift" and row[2] >= m.get("ref") + self.b.rise and row[4] < self.b.open:
            m.set("found", i)

    def _place(self, i: int, row: tuple, start: int) -> None:
        m = self.m
        if m.get("phase") is None and row[5]:
            m.set("phase", "lift")
            m.set("ref", row[2])
        if m.get("phase") == "lift":
            if row[6]:
                m.set("phase", None)  # let go before it rose: another grasp is looked for
            elif row[2] >= m.get("ref") + self.b.rise:
                m.set("phase", "carry")
                m.set("mark", max(i + self.b.hold, start))
        if m.get("phase") == "carry" and i >= m.get("mark") and row[7] and self._near(row):
            m.set("found", i)

    def _pour(self, i: int, row: tuple, start: int) -> None:
        m, off = self.m, abs(row[3] - self.m.get("ref"))
        m.set("away", m.get("away", 0) + 1 if off >= self.b.turn else 0)
        m.set("back", m.get("back", 0) + 1 if off <= self.b.back else 0)
        if i >= start:
            if m.get("phase") is None and m.get("away") >= 15 and self._near(row):
                m.set("phase", "turned")
            if m.get("phase") == "turned" and m.get("back") >= 5:
                m.set("found", i)

    def _open(self, i: int, row: tuple, start: int) -> None:
        m = self.m
        if m.get("phase") == "stroke":
            if row[9]:
                m.set("found", i - 1)
            return
        if m.get("phase") is None and self._grasped(i, row, row[3] > self.b.posture):
            m.set("phase", "pull")
            m.set("cx", row[0])
            m.set("cy", row[1])
            m.put("origins", re.sub(r"\s+again$", "", self.what.lower()), row[0], row[1])
        if m.get("phase") == "pull" and math.hypot(row[0] - m.get("cx"), row[1] - m.get("cy")) >= self.b.stroke:
            m.set("phase", "stroke")

    def _closes(self) -> bool:
        m = self.m
        return m.get("ref") - m.get("best") >= self.b.closing and m.get("best") <= self.b.close

    def _close(self, i: int, row: tuple, start: int) -> None:
        m = self.m
        origin = m.items("origins").get(re.sub(r"\s+(again|final)$", "", self.what.lower()))
        if origin is None:
            return
        d = math.hypot(row[0] - origin[0], row[1] - origin[1])
        if m.get("phase") == "held" and not row[8]:
            if self._closes():
                m.set("found", i - 1 if m.get("stop") is None else min(m.get("stop") - 1, i - 1))
            m.set("phase", None)
        elif m.get("phase") == "held":
            if d < m.get("best"):
                m.set("best", d)
                m.set("at", i)
                m.set("stop", None)
            elif m.get("stop") is None and row[9]:
                m.set("stop", i)
        elif row[8]:
            m.set("phase", "held")
            m.set("ref", d)
            m.set("best", d)
            m.set("at", i)
            m.set("stop", None)


def plan_of(x: Any) -> list[tuple[str, str, tuple[float, float] | None]]:
    """A tick's plan: kinds, whats, and gates by pixel (gate_r, gate_c; may be missing or null)."""
    kinds, whats = list(x.kinds), list(x.whats)
    rows, cols = (list(v) if (v := getattr(x, c, None)) is not None else [None] * len(kinds) for c in ("gate_r", "gate_c"))
    return [(k, w, None if r is None or c is None else (r, c)) for k, w, r, c in zip(kinds, whats, rows, cols)]


def advance(m: Memory, x: Any, bounds: Bounds, camera: Camera | None) -> tuple[Scan | None, int, int | None]:
    """(scan, plan step, where it completes) once the tick's states have been appended."""
    for s in x.states if x.states is not None else ():
        append(m, s, bounds)
    plan, j = plan_of(x), m.get("step", 0)
    if j >= len(plan):
        return None, j, None
    scan = Scan(m, *plan[j], bounds, camera)
    return scan, j, scan.look()


def fired(bounds: Bounds = Bounds(), camera: Camera | None = None, settle: int = 1) -> Machine:  # noqa: B008
    """Which plan step is under way, and where it fires.

    A tick has kinds, whats (and gate_r, gate_c) of the plan and the states that came since the one before. A step
    that has fired for `settle` ticks at the same place is complete; the next one is looked for from the step after it.
    Gives j, fired (null: not yet) and done.
    """

    def step(m: Memory, x: Any) -> list[tuple]:
        scan, j, at = advance(m, x, bounds, camera)
        again = m.get("again", 0) + 1 if at is not None and at == m.get("was") else int(at is not None)
        done = at is not None and again >= settle
        m.set("was", None if done else at)
        m.set("again", 0 if done else again)
        if done:
            scan.begin(j + 1, at + 1)
        return [(j, at, done)]

    return Machine(step, "j bigint, fired bigint, done boolean", {**VALUES, "was": "bigint", "again": "bigint"}, {"series": SERIES}, MAPS)
