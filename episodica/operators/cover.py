"""Greedy choices in the plane by rounds over tiles: the results of one pass in order, without a group in one task.

A tile's task sees its points and those around it. It goes through them in
order and decides what it can be sure of: a point whose better neighbours are all
decided. What depends on points beyond its view stays open; the next round goes
on with what was decided everywhere. The best open point (or pair) can always be decided,
so rounds end; most end after two or three, and a chain of points, each better than the next,
takes a round for each tile that it runs through.

Points of one place are one row (the best) before tiles are dealt, so copies don't gather.
Coordinates that are null or not finite take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.sources.files import scratch

#: A tile's side, in radii.
SIDE = 32


def _close(metric: str, radius: float) -> Callable[[float, float], bool]:
    """Are two points with these differences neighbours? l2 and l1 take the bound in, box doesn't."""
    if metric == "l2":
        return lambda r, c: r * r + c * c <= radius * radius
    if metric == "l1":
        return lambda r, c: abs(r) + abs(c) <= radius
    if metric == "box":
        return lambda r, c: abs(r) < radius and abs(c) < radius
    raise ValueError(metric)


def _finite(df: DataFrame) -> DataFrame:
    real = lambda x: F.col(x).cast("double")
    fits = lambda x: F.col(x).isNotNull() & ~F.isnan(real(x)) & (F.abs(real(x)) < float("inf"))
    return df.filter(fits("r") & fits("c"))


def _views(df: DataFrame, radius: float, margin: float) -> DataFrame:
    """A row for each tile that sees the point: tile_r_, tile_c_, and own_ where the point is the tile's."""
    size = SIDE * (radius or 1)
    # Tile 0 is around 0, so that small numbers of either sign are in one.
    tile = lambda x, d: F.floor((F.col(x) + d) / size + 0.5).cast("bigint")
    seen = lambda x: F.array_distinct(F.array(tile(x, -margin), tile(x, 0), tile(x, margin)))
    out = df.withColumn("tile_r_", F.explode(seen("r"))).withColumn("tile_c_", F.explode(seen("c")))
    return out.withColumn("own_", (F.col("tile_r_") == tile("r", 0)) & (F.col("tile_c_") == tile("c", 0)))


def _held(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Near:
    """Points by cells of the radius."""

    def __init__(self, radius: float, close: Callable[[float, float], bool]):
        self.size, self.close, self.cells = radius or 1, close, {}

    def add(self, r: float, c: float, value: object) -> None:
        self.cells.setdefault((r // self.size, c // self.size), []).append((r, c, value))

    def around(self, r: float, c: float):
        i, j = r // self.size, c // self.size
        for a, b in product((-1, 0, 1), repeat=2):
            for u, v, value in self.cells.get((i + a, j + b), ()):
                if self.close(u - r, v - c):
                    yield value


def anchors(df: DataFrame, group: list[str], order: list[Column], radius: float, columns: list[str], metric: str = "l2") -> DataFrame:
    """(group, columns) of the points that stay: in the given order, a point stays unless one that stays is near it.

    df has r and c; columns are kept, r and c among them or not.
    """
    names = [f"o{k}_" for k in range(len(order))]
    row = F.struct(*[c.alias(n) for n, c in zip(names, order)], *[F.col(c) for c in columns if c not in ("r", "c")])
    best = _finite(df).groupBy(*group, "r", "c").agg(F.min(row).alias("row_")).select(*group, "r", "c", "row_.*")
    now = best.withColumn("stays_", F.lit(False))
    shape, close = now.schema, _close(metric, radius)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(names, kind="stable", na_position="first")
        met, keep, state = _Near(radius, close), [], []
        for r, c, own, stays in zip(rows["r"].tolist(), rows["c"].tolist(), rows["own_"].tolist(), rows["stays_"].tolist()):
            known = stays
            if not stays:
                better = list(met.around(r, c))
                if True in better:  # one that stays
                    keep.append(False)
                    state.append(False)
                    continue
                known = own and not better
            met.add(r, c, known)
            keep.append(own)
            state.append(known)
        return rows.assign(stays_=state)[keep][shape.names]

    run.__annotations__ = {}
    tiled = [*group, "tile_r_", "tile_c_"]
    while True:
        now = _held(_views(now, radius, radius).groupBy(*tiled).applyInPandas(run, shape))
        if not now.filter(~F.col("stays_")).limit(1).count():
            return now.select(*group, *columns)


def first_fit(df: DataFrame, group: list[str], order: list[Column], radius: float, columns: list[str], metric: str = "l1", least: int = 1) -> DataFrame:
    """(group, columns, n): anchors as above, each with the points whose first near anchor it is; those met `least` times.

    A point has the anchor that comes first in the order, not the nearest one.
    """
    finite, names = _finite(df), [f"p{k}_" for k in range(len(order))]
    found = anchors(finite.select("*", *[c.alias(n) for n, c in zip(names, order)]), group, [F.col(n) for n in names], radius, [*columns, *[c for c in ("r", "c") if c not in columns], *names], metric)
    places = finite.groupBy(*group, "r", "c").agg(F.count("*").alias("n"))
    cell = lambda x, d=0: F.floor(F.col(x) / (radius or 1)).cast("bigint") + d
    around = lambda x: F.explode(F.array(*[cell(x, d) for d in (-1, 0, 1)]))
    a = found.select(*[F.col(g).alias(f"g{k}_") for k, g in enumerate(group)], F.struct(*names, *[F.col(c) for c in columns], F.col("r").alias("ar_"), F.col("c").alias("ac_")).alias("anchor_"), around("r").alias("i_"), "r", "c").withColumn("j_", around("c")).drop("r", "c")
    on = (F.col("i_") == cell("r")) & (F.col("j_") == cell("c"))
    for k, g in enumerate(group):
        on = on & F.col(f"g{k}_").eqNullSafe(F.col(g))
    dr, dc = F.col("r") - F.col("anchor_.ar_"), F.col("c") - F.col("anchor_.ac_")
    near = {"l2": dr * dr + dc * dc <= radius * radius, "l1": F.abs(dr) + F.abs(dc) <= radius, "box": (F.abs(dr) < radius) & (F.abs(dc) < radius)}[metric]
    first = places.join(a, on & near).groupBy(*group, "r", "c").agg(F.first("n").alias("n"), F.min("anchor_").alias("a_"))
    counted = first.groupBy(*group, "a_").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return counted.select(*group, *[F.col(f"a_.{c}").alias(c) for c in columns], "n")


class _Queue:
    """Names (or ordinals) of each place, the smallest free one first."""

    def __init__(self):
        self.places: dict[tuple[float, float], list] = {}
        self.used: set = set()

    def add(self, name, r: float, c: float) -> None:
        self.places.setdefault((r, c), []).append(name)

    def ready(self) -> None:
        for held in self.places.values():
            heapq.heapify(held)

    def first(self, at: tuple[float, float]):
        held = self.places[at]
        while held and held[0] in self.used:
            heapq.heappop(held)
        return held[0] if held else None


def _sure_pairs(names: _Queue, ords: _Queue, radius: float, sure: Callable[[tuple[float, float]], bool]) -> tuple[list[tuple], bool]:
    """((name, ordinal, distance) of greedy pairs that no point out of view can change, is anything left open); sure: are a place's neighbours all in view?"""
    names.ready()
    ords.ready()
    near: dict[float, dict] = {}
    cells = _Near(radius, _close("l2", radius))
    for at in ords.places:
        cells.add(*at, at)
    for at in names.places:
        for to in cells.around(*at):
            near.setdefault(((at[0] - to[0]) ** 2 + (at[1] - to[1]) ** 2) ** 0.5, {}).setdefault(at, []).append(to)
    out, left, open_ = [], False, {at for held in (names, ords) for at in held.places if not sure(at)}
    for d in sorted(near):
        if d > radius:
            break
        # At one distance names go in order, and each takes the smallest ordinal.
        queue = [(n, at) for at in near[d] if (n := names.first(at)) is not None]
        heapq.heapify(queue)
        while queue:
            n, places = queue[0][0], []
            while queue and queue[0][0] == n:  # a name may stand in several places
                places.append(heapq.heappop(queue)[1])
            free = {at: [to for to in near[d][at] if ords.first(to) is not None] for at in places}
            touched = {to for found in free.values() for to in found}
            if touched and (open_ & touched or open_ & {at for at in places if free[at]}):
                open_ |= touched | {at for at in places if free[at]}
                left = True
                continue  # what these places take is not known in this view
            if touched:
                best = min(ords.first(to) for to in touched)
                names.used.add(n)
                ords.used.add(best)
                out.append((n, int(best), float(d)))
            for at in places:
                if free[at] and (n_ := names.first(at)) is not None:
                    heapq.heappush(queue, (n_, at))
    return out, left


def _several(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Names that stand in more than one place."""
    places = df.filter(F.col(name).isNotNull()).groupBy(*[F.col(k).alias(f"{k}_m") for k in key], F.col(name).alias("name_m"))
    return places.agg(F.min(F.struct("r", "c")).alias("x_"), F.max(F.struct("r", "c")).alias("y_")).filter("x_ <> y_").drop("x_", "y_")


def _matches(rest: DataFrame, name: str, found: DataFrame, key: list[str], of: str) -> Column:
    same = rest[name] == found[of]
    for k in key:
        same = same & rest[k].eqNullSafe(found[f"{k}_m"])
    return same


def assign(left: DataFrame, right: DataFrame, key: list[str], radius: float) -> DataFrame:
    """(key..., a, b, d): one-to-one pairs of names a and ordinals b, nearest first, ties by name and ordinal.

    left has key, name, r, c; right has key, ord, r, c. Names and ordinals that stand in several places
    of a key are settled last, with what is then left of that key in one group.
    """
    types = dict(left.dtypes)
    real = [F.col(x).cast("double").alias(x) for x in ("r", "c")]
    a = _finite(left).select(*key, F.col("name").alias("a"), F.lit(None).cast("bigint").alias("b"), *real)
    b = _finite(right).select(*key, F.lit(None).cast(types["name"]).alias("a"), F.col("ord").cast("bigint").alias("b"), *real)
    rest, size, out = a.unionByName(b), SIDE * (radius or 1), None
    for c, flag in (("a", "am_"), ("b", "bm_")):
        many = _several(rest, key, c).withColumn(flag, F.lit(True))
        rest = rest.join(many, _matches(rest, c, many, key, "name_m"), "left").select(*rest.columns, flag)
    rest = rest.withColumn("several_", F.coalesce("am_", "bm_", F.lit(False))).drop("am_", "bm_")
    shape, columns = ", ".join(f"`{k}` {types[k]}" for k in key) + f", a {types['name']}, b bigint, d double", [*key, "a", "b", "d"]

    def pairs_in(k, rows: pd.DataFrame, tiled: bool) -> pd.DataFrame:
        names, ords, own, several = _Queue(), _Queue(), set(), set()
        for x in rows.itertuples(index=False):
            if x.a is None or x.a != x.a:
                ords.add(int(x.b), x.r, x.c)
            else:
                names.add(x.a, x.r, x.c)
                if not tiled or x.own_:
                    own.add(x.a)
            if tiled and x.several_:
                several.add((x.r, x.c))
        low = [(t - 0.5) * size - radius for t in k[len(key) :]]
        # All neighbours of what is within a radius of the tile are in view.
        sure = lambda at: at not in several and all(m <= v < m + size + 2 * radius for m, v in zip(low, at))
        pairs, open_ = _sure_pairs(names, ords, radius, sure)
        found = [(*k[: len(key)], *p) for p in pairs if p[0] in own]
        # A row without a pair tells that something was left open.
        return pd.DataFrame([*found, *[(*k[: len(key)], None, None, None)] * open_], columns=columns, dtype=object)

    def run(k, rows):
        return pairs_in(k, rows, True)

    def last(k, rows):
        return pairs_in(k, rows, False)

    while True:
        found = _held(_views(rest, radius, 2 * radius).groupBy(*key, "tile_r_", "tile_c_").applyInPandas(run, shape))
        pairs = found.filter("b is not null")
        out = pairs if out is None else out.unionByName(pairs)
        if not found.filter("b is null").limit(1).count():
            return out
        some = pairs.limit(1).count()
        for c in ("a", "b"):
            gone = pairs.select(*[F.col(k).alias(f"{k}_m") for k in key], F.col(c).alias("gone_m"))
            rest = rest.join(gone, _matches(rest, c, gone, key, "gone_m"), "left_anti")
        rest = _held(rest)
        if not some:
            return out.unionByName(_held(rest.groupBy(*key).applyInPandas(last, shape)))
