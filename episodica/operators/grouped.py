"""Order-dependent matching inside an episode, as grouped pandas functions.

Each result depends on what was matched before, which no set operation
expresses; an episode's rows are bounded, so a group fits in a task.
"""

from __future__ import annotations

from collections import deque
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions import text as T


def _sided(rows: pd.DataFrame, *columns: str) -> pd.DataFrame:
    """A cogroup's side; one without rows comes without columns."""
    return rows.reindex(columns=columns) if rows.empty else rows


def _own(df: DataFrame) -> DataFrame:
    """df with columns of its own, for a cogroup with another part of the same frame."""
    return df.select([F.col(c).alias(c, metadata={}) for c in df.columns])


def _parsed(df: DataFrame, key: str) -> DataFrame:
    """Lines with their normal form and flattened coordinates, found by SQL expressions."""
    at = F.flatten(F.transform(T.coords(T.without_evidence(F.col("line"))), lambda p: F.array(p["r"], p["c"])))
    return df.select(key, "t", "ord", T.blank_coords(F.col("line")).alias("form"), at.alias("at"))


def pair_lines(truth: DataFrame, said: DataFrame, key: str, tolerance: int = 12, tick: int = 16) -> DataFrame:
    """(key, t_truth, t_said, lag, errors, met): each true line, in order of (t, ord), takes the first free line that agrees.

    Lines agree if their normal forms are equal and every coordinate is within
    the tolerance in both components. lag is the difference in ticks, rounded
    down; t_said and lag are null where no line is left. errors are the
    distances of the pair's coordinates. met is null but for completions: was
    a line that agrees taken, by this or an earlier one, that was said a tick
    after it or before? Both inputs have key, t, ord, line.
    """

    def run(k, truths: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        truths, lines = (_sided(x, "t", "ord", "form", "at") for x in (truths, lines))
        free, taken, times = _Free(tolerance), _Places(tolerance), []
        for n, x in enumerate(lines.sort_values(["t", "ord"]).itertuples(index=False)):
            times.append(int(x.t))
            free.add(n, x.form, tuple(x.at))
        out = []
        for x in truths.sort_values(["t", "ord"]).itertuples(index=False):
            at, t, errors, met = tuple(x.at), None, [], None
            if found := free.take(x.form, at):
                t, y = times[found[0]], found[1]
                taken.add(t, x.form, y)
                errors = np.hypot(*(np.subtract(y, at)).reshape(-1, 2).T.astype(float)).tolist() if at else []
            if "completed:" in x.form:
                met = taken.since(x.form, at, int(x.t) + tick)
            out.append((k[0], int(x.t), t, None if t is None else (t - int(x.t)) // tick, errors, met))
        return pd.DataFrame(out, columns=[key, "t_truth", "t_said", "lag", "errors", "met"]).astype({"t_said": "Int64", "lag": "Int64", "met": "boolean"})

    kind = dict(truth.dtypes)[key]
    both = _parsed(truth, key).groupBy(key).cogroup(_own(_parsed(said, key)).groupBy(key))
    return both.applyInPandas(run, f"{key} {kind}, t_truth bigint, t_said bigint, lag bigint, errors array<double>, met boolean")


class _Places:
    """Lines by form and cells of the tolerance, with the earliest time of each place."""

    def __init__(self, tolerance: float):
        self.tolerance, self.size, self.places = tolerance, tolerance + 1, {}

    def _cell(self, at: tuple) -> tuple:
        return tuple(x // self.size for x in at[:2])

    def around(self, form: str, at: tuple):
        """(cell, place, what is held there) of the places that agree."""
        cells = self.places.get((form, len(at)), {})
        for cell in product(*[(x - 1, x, x + 1) for x in self._cell(at)]):
            for y, held in cells.get(cell, {}).items():
                if all(abs(u - v) <= self.tolerance for u, v in zip(y, at)):
                    yield cell, y, held

    def add(self, t: int, form: str, at: tuple) -> None:
        held = self.places.setdefault((form, len(at)), {}).setdefault(self._cell(at), {})
        held[at] = min(t, held.get(at, t))

    def since(self, form: str, at: tuple, until: int) -> bool:
        return any(t <= until for _, _, t in self.around(form, at))


class _Free(_Places):
    """Lines without a partner; take() gives the first one that agrees."""

    def add(self, n: int, form: str, at: tuple) -> None:
        """Lines are added in order, so those of one place stay in it."""
        self.places.setdefault((form, len(at)), {}).setdefault(self._cell(at), {}).setdefault(at, deque()).append(n)

    def take(self, form: str, at: tuple) -> tuple[int, tuple] | None:
        """(number, coordinates) of the line, which is then taken."""
        best = min(((held[0], cell, y) for cell, y, held in self.around(form, at)), default=None)
        if best is None:
            return None
        n, cell, y = best
        held = self.places[form, len(at)][cell]
        held[y].popleft()
        if not held[y]:
            del held[y]
        return n, y


def state_quality(truth: DataFrame, said: DataFrame, key: str, tolerance: int = 12) -> DataFrame:
    """(key, precision, recall, final_recall, divergence) of what is known at each tick.

    Precision and recall are means over the ticks at which either side adds a
    line; divergence is the first tick with a recall under 1, or -1.
    """

    def run(k, truths: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for rows in (truths, lines):
            rows = _sided(rows, "t", "ord", "form", "at").sort_values(["t", "ord"])
            sides.append([(int(t), form, tuple(at)) for t, form, at in zip(rows["t"], rows["form"], rows["at"])])
        # Both sides prefer the other's lines in order, so a line that comes later than all others of its side
        # takes the first free one that agrees and moves no earlier pair: a tick only adds its own lines.
        free, seen, hits = (_Free(tolerance), _Free(tolerance)), [0, 0], 0
        precision, recall, divergence = [], [], -1
        for tick in sorted({t for side in sides for t, _, _ in side}):
            for n, side in enumerate(sides):
                while seen[n] < len(side) and side[seen[n]][0] <= tick:
                    _, form, at = side[seen[n]]
                    if free[1 - n].take(form, at):
                        hits += 1
                    else:
                        free[n].add(seen[n], form, at)
                    seen[n] += 1
            g, p = seen
            recall.append(hits / max(g, 1))
            precision.append(hits / p if p else float(not g))
            if divergence < 0 and hits < g:
                divergence = tick
        mean = lambda x: float(np.mean(x)) if x else None
        return pd.DataFrame([(k[0], mean(precision), mean(recall), recall[-1] if recall else None, divergence)], columns=[key, "precision", "recall", "final_recall", "divergence"])

    kind = dict(truth.dtypes)[key]
    both = _parsed(truth, key).groupBy(key).cogroup(_own(_parsed(said, key)).groupBy(key))
    return both.applyInPandas(run, f"{key} {kind}, precision double, recall double, final_recall double, divergence bigint")


def bind_stages(plan: DataFrame, stages: DataFrame, key: str) -> DataFrame:
    """(key, ord, stage): each plan step takes the next stage if its kind is the same; `complete` if all are taken.

    plan has key, ord, kind; stages have key, pos, kind.
    """

    def run(k, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = _sided(a, "ord", "kind"), _sided(b, "pos", "kind")
        queue, out = deque(b.sort_values("pos").itertuples(index=False)), []
        for x in a.sort_values("ord").itertuples(index=False):
            taken = queue.popleft().pos if queue and queue[0].kind == x.kind else None
            out.append([k[0], int(x.ord), taken, False])
        for row in out:
            row[3] = not queue
        return pd.DataFrame(out, columns=[key, "ord", "stage", "complete"]).astype({"stage": "Int64"})

    kind = dict(plan.dtypes)[key]
    return plan.groupBy(key).cogroup(_own(stages).groupBy(key)).applyInPandas(run, f"{key} {kind}, ord bigint, stage bigint, complete boolean")


def chained_events(df: DataFrame, key: str, step: str, value: str, phases: list[tuple[str, float]]) -> DataFrame:
    """(key, phase, t): the first step after the previous phase's with the value `above` or `below` a bound.

    A phase that is never reached ends the chain.
    """

    w, found = Window.partitionBy(key), []
    for n, (kind, bound) in enumerate(phases):
        meets = F.col(value) > bound if kind == "above" else F.col(value) < bound
        if n:
            meets = meets & (F.col(step) > F.col(f"at_{n - 1}"))
        df = df.withColumn(f"at_{n}", F.min(F.when(meets, F.col(step))).over(w))
        found.append(F.struct(F.lit(n).cast("bigint").alias("phase"), F.first(f"at_{n}").cast("bigint").alias("t")))
    reached = df.groupBy(key).agg(F.array(*found).alias("f_"))
    return reached.select(key, F.explode("f_").alias("f_")).select(key, "f_.*").filter("t is not null")
