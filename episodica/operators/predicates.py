"""When does a plan step complete? Predicates over an episode's states, scanned one after another.

A state is ee x, y, z, axis-angle (3), finger. Each predicate scans from the
step after the last completion. Nothing is found where a phase never comes;
the scan then goes on from the last completion. A plan step may name the pixel
of its fixture: placing and pouring then count only within `reach` of it, but
for drawers, whose pixels are those of after they were shut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """Fixed values of the predicates: metres, degrees, steps."""

    open: float = 0.037
    band: tuple[float, float] = (0.006, 0.037)
    stall: float = 0.0015
    rise: float = 0.03
    hold: int = 20
    look_back: int = 120
    turn: float = 25.0
    back: float = 10.0
    posture: float = 75.0
    stroke: float = 0.10
    closing: float = 0.06
    close: float = 0.12
    slow: float = 0.001
    reach: float = 30.0


@dataclass(frozen=True)
class Camera:
    """A 3x4 or 4x4 projection matrix and the image's size."""

    matrix: tuple[tuple[float, ...], ...]
    height: int = 256
    width: int = 256

    def pixels(self, points: np.ndarray) -> np.ndarray:
        """(row, column) of each point: halves to even, clipped to the image."""
        seen = np.column_stack([points, np.ones(len(points))]) @ np.asarray(self.matrix, float)[:3].T
        with np.errstate(divide="ignore", invalid="ignore"):
            at = np.nan_to_num(np.round(seen[:, [1, 0]] / seen[:, 2:]))
        return np.clip(at, 0, [self.height - 1, self.width - 1])


def _held(mask: np.ndarray, k: int) -> np.ndarray:
    """True where the mask has been true for k steps in a row, this one included."""
    total = np.concatenate([[0], np.cumsum(mask)])
    out = np.zeros(len(mask), bool)
    out[k - 1 :] = total[k:] - total[:-k] == k if len(mask) >= k else False
    return out


def _first(mask: np.ndarray, start: int) -> int | None:
    at = np.flatnonzero(mask[start:])
    return start + int(at[0]) if len(at) else None


class Motion:
    """An episode's states and the masks that the predicates share."""

    def __init__(self, states: np.ndarray, bounds: Bounds, camera: Camera | None = None):
        self.pixels, self.gate = camera.pixels(states[:, :3]) if camera else None, None
        self.b, self.xy, self.z, self.q = bounds, states[:, :2], states[:, 2], states[:, 6]
        axis = states[:, 3:6]
        angle = np.linalg.norm(axis, axis=1)
        along = np.divide(axis[:, 2], angle, out=np.zeros_like(angle), where=angle > 0)
        down = np.cos(angle) + (1 - np.cos(angle)) * along**2
        self.tilt = np.degrees(np.arccos(np.clip(-down, -1, 1)))
        self.quiet = np.abs(np.diff(self.q, prepend=self.q[:1])) < bounds.stall
        self.holding(None)
        self.wide, self.shut = self.q > bounds.open, _held(self.q < bounds.open, 5)
        self.still = _held(np.concatenate([[0.0], np.linalg.norm(np.diff(self.xy, axis=0), axis=1)]) < bounds.slow, 5)
        self.origins: dict[str, np.ndarray] = {}

    def holding(self, band: tuple[float, float] | None) -> None:
        """From now on a grasp has the finger in this band (None: that of the bounds)."""
        low, high = band or self.b.band
        self.inband = (self.q > low) & (self.q < high)
        self.grasp = _held(self.inband & self.quiet, 5)

    def near(self) -> np.ndarray:
        """Where the hand is within reach of the step's fixture; everywhere without one."""
        if self.gate is None or self.pixels is None:
            return np.ones(len(self.q), bool)
        return np.hypot(*(self.pixels - np.asarray(self.gate, float)).T) <= self.b.reach

    def _fresh_grasp(self, a: int, also: np.ndarray | None = None) -> int | None:
        opened = np.maximum.accumulate(self.wide[a:]) if a < len(self.q) else self.wide[:0]
        mask = np.concatenate([np.zeros(a, bool), opened]) & self.grasp
        return _first(mask if also is None else mask & also, a)

    def _until_still(self, at: int) -> int:
        stop = _first(self.still, at + 1)
        return len(self.q) - 1 if stop is None else stop - 1

    def pick(self, a: int, what: str) -> int | None:
        g = self._fresh_grasp(a)
        return None if g is None else _first((self.z >= self.z[g] + self.b.rise) & (self.q < self.b.open), g)

    def place(self, a: int, what: str) -> int | None:
        # What is held already was grasped before: since the hand closed, or within the look-back.
        apart = np.flatnonzero(~self.inband[: a + 1])
        since = (int(apart[-1]) + 1 if len(apart) else 0) if self.inband[a] else max(0, a - self.b.look_back)
        g = _first(self.grasp, since)
        while g is not None:
            up = _first(self.wide | (self.z >= self.z[g] + self.b.rise), g)
            if up is None:
                return None
            if not self.wide[up]:
                release = _held(self.wide, 3)
                edge = release & ~np.concatenate([[False], release[:-1]])
                return _first(edge & self.near(), min(max(up + self.b.hold, a), len(edge)))
            g = _first(self.grasp, up + 1)
        return None

    def pour(self, a: int, what: str) -> int | None:
        away = np.abs(self.tilt - self.tilt[a])
        turned = _first(_held(away >= self.b.turn, 15) & self.near(), a)
        return None if turned is None else _first(_held(away <= self.b.back, 5), turned)

    def open(self, a: int, what: str) -> int | None:
        g = self._fresh_grasp(a, self.tilt > self.b.posture)
        if g is None:
            return None
        self.origins[re.sub(r"\s+again$", "", what.lower())] = self.xy[g]
        far = _first(np.linalg.norm(self.xy - self.xy[g], axis=1) >= self.b.stroke, g)
        return None if far is None else self._until_still(far)

    def close(self, a: int, what: str) -> int | None:
        what = re.sub(r"\s+(again|final)$", "", what.lower())
        if what not in self.origins:
            return None
        d = np.linalg.norm(self.xy - self.origins[what], axis=1)
        at = _first(self.shut, a)
        while at is not None:
            end = _first(~self.shut, at)
            end = len(d) if end is None else end
            least = at + int(np.argmin(d[at:end]))
            if d[at] - d[least] >= self.b.closing and d[least] <= self.b.close:
                return min(self._until_still(least), end - 1)
            at = _first(self.shut, end) if end < len(d) else None
        return None


def grasp_bands(plan: DataFrame, widths: DataFrame, least: float = 0.006, most: float = 0.0395, margin: float = 0.004) -> DataFrame:
    """plan with low and high: the finger's band while a thing is held, from measured widths (thing, p10, p90).

    plan has kind and what; a thing is named in what, the first one by `rank` of widths. For placing,
    widths of `carry:<thing>` come first. Other steps and unknown things have none.
    """
    band = F.struct(F.greatest(F.lit(least), F.col("p10") - margin).alias("low"), F.least(F.lit(most), F.col("p90") + margin).alias("high"))
    known = widths.select(F.regexp_replace("thing", "^carry:", "").alias("thing_"), "rank", F.col("thing").startswith("carry:").alias("carry_"), band.alias("band_"))
    per = known.groupBy("thing_").agg(F.min("rank").alias("rank_"), F.max(F.when(~F.col("carry_"), F.col("band_"))).alias("own_"), F.max(F.when(F.col("carry_"), F.col("band_"))).alias("held_"))
    # A row a thing: the list is that of the objects that were measured.
    things = per.agg(F.array_sort(F.collect_list(F.struct("rank_", "thing_", "own_", "held_"))).alias("things_"))
    with_things = plan.crossJoin(F.broadcast(things))
    first = F.get(F.filter("things_", lambda t: F.contains(F.lower("what"), t["thing_"])), F.lit(0))
    chosen = F.when(F.col("kind") == "place", F.coalesce(first["held_"], first["own_"])).when(F.col("kind") == "pick", first["own_"])
    return with_things.withColumn("low", chosen["low"]).withColumn("high", chosen["high"]).drop("things_")


def completions(states: DataFrame, plan: DataFrame, key: str, bounds: Bounds = Bounds(), camera: Camera | None = None) -> DataFrame:  # noqa: B008
    """(key, ord, t): the step at which each plan step completes, null if it is not seen to.

    states: key, step, s (array of 7 or more); plan: key, ord, kind, what and,
    for gates by a camera, r and c (null: none); for picks and places low and
    high, the band of the finger that holds the thing (null: that of the bounds).
    """
    plan = plan.withColumns({c: F.lit(None).cast("double") for c in ("r", "c", "low", "high") if c not in plan.columns})

    def run(k, rows: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        out, at = [], 0
        if len(rows) and len(steps):
            rows = rows.sort_values("step")
            motion, when = Motion(np.stack(rows["s"].to_numpy()).astype(float), bounds, camera), rows["step"].tolist()
            for x in steps.sort_values("ord").itertuples(index=False):
                scan = getattr(motion, x.kind) if x.kind in ("pick", "place", "pour", "open", "close") else None
                gated = not (pd.isna(x.r) or pd.isna(x.c) or "drawer" in x.what.lower())
                motion.gate = (x.r, x.c) if gated else None
                banded = x.kind in ("pick", "place") and not (pd.isna(x.low) or pd.isna(x.high))
                motion.holding((x.low, x.high) if banded else None)
                found = scan(at, x.what) if scan and at < len(when) else None
                out.append((k[0], int(x.ord), None if found is None else int(when[found])))
                at = at if found is None else found + 1
        return pd.DataFrame(out, columns=[key, "ord", "t"]).astype({"t": "Int64"})

    kind = dict(states.dtypes)[key]
    return states.groupBy(key).cogroup(plan.groupBy(key)).applyInPandas(run, f"{key} {kind}, ord bigint, t bigint")
