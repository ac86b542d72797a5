"""Radius joins, greedy point suppression and snapping within a group of points.

Theta joins always have an equality on a group first; large groups are dealt
into square cells of the radius' size, and a point meets the cells around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions import geometry

from . import cover


def _cells(df: DataFrame, r: str, c: str, radius: float, spread: bool) -> DataFrame:
    cell = lambda x: F.floor(F.col(x) / radius).cast("bigint")
    if not spread:
        return df.withColumn("cell_r_", cell(r)).withColumn("cell_c_", cell(c))
    around = lambda x: F.explode(F.array(*[cell(x) + d for d in (-1, 0, 1)]))
    return df.withColumn("cell_r_", around(r)).withColumn("cell_c_", around(c))


def radius_filter(left: DataFrame, right: DataFrame, group: str, radius: float, near: bool = True, squared: float | None = None) -> DataFrame:
    """Rows of left (r, c) with a row of right in their group within the radius, or (near=False) without one.

    The bound is inclusive and is tested on squared distances.
    """
    a = _cells(left, "r", "c", radius, False).alias("a")
    b = _cells(right.select(group, "r", "c"), "r", "c", radius, True).alias("b")
    same = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.cell_r_") == F.col("b.cell_r_")) & (F.col("a.cell_c_") == F.col("b.cell_c_"))
    close = geometry.squared(F.col("a.r"), F.col("a.c"), F.col("b.r"), F.col("b.c")) <= (squared or radius * radius)
    return a.join(b, same & close, "left_semi" if near else "left_anti").drop("cell_r_", "cell_c_")


def any_near(points: Column, r: Column, c: Column, radius: float) -> Column:
    """Is one of the points (array of structs with r, c) within the radius? False for a null array."""
    return F.coalesce(F.exists(points, lambda p: geometry.squared(p["r"], p["c"], r, c) <= radius * radius), F.lit(False))


def appeared(now: Column, before: Column, r: Column, c: Column, radius: float) -> Column:
    """Near a point now, and near none before."""
    return any_near(now, r, c, radius) & ~any_near(before, r, c, radius)


def suppress(df: DataFrame, group: str, order: list[Column], radius: float, columns: list[str]) -> DataFrame:
    """Greedy suppression: in the given order a point stays unless a kept one is within the radius."""
    return cover.anchors(df, [group], order, radius, columns).select(group, *columns)


def snap(points: Column, r: Column, c: Column, radius: float) -> Column:
    """(r, c) of the nearest point within the radius, the first of several; else the place itself."""
    ranked = F.transform(points, lambda p, i: F.struct(geometry.squared(p["r"], p["c"], r, c).alias("d"), i.alias("i"), p["r"].alias("r"), p["c"].alias("c")))
    best = F.array_min(ranked)
    return F.when(best["d"] <= radius * radius, F.struct(best["r"].alias("r"), best["c"].alias("c"))).otherwise(F.struct(r.alias("r"), c.alias("c")))


def snap_points(points: DataFrame, anchors: DataFrame, group: str, radius: float) -> DataFrame:
    """points with r, c of the nearest anchor of their group within the radius, the smallest id of several; else their own.

    anchors have group, id, r, c. Places of both sides are compared once,
    however many rows stand there; a cell's anchors are one row, which holds
    no more places than the cell has (the radius squared for whole pixels).
    """
    places = _cells(points.select(group, "r", "c").distinct(), "r", "c", radius, True)
    held = _cells(anchors.groupBy(group, "r", "c").agg(F.min("id").alias("id")), "r", "c", radius, False)
    held = held.groupBy(group, "cell_r_", "cell_c_").agg(F.collect_list(F.struct("id", "r", "c")).alias("pts_"))
    ranked = F.transform("pts_", lambda p: F.struct(geometry.squared(p["r"], p["c"], F.col("r"), F.col("c")).alias("d"), p["id"].alias("id"), p["r"].alias("r"), p["c"].alias("c")))
    near = places.join(held, [group, "cell_r_", "cell_c_"]).withColumn("at_", F.array_min(ranked)).filter(F.col("at_.d") <= radius * radius)
    best = near.groupBy(*[F.col(c).alias(f"{c}_") for c in (group, "r", "c")]).agg(F.min("at_").alias("best_"))
    own = (points[group] == best[f"{group}_"]) & (points["r"] == best["r_"]) & (points["c"] == best["c_"])
    at = lambda c: F.coalesce(F.col(f"best_.{c}"), points[c]).alias(c)
    return points.join(best, own, "left").select(*[at(c) if c in ("r", "c") else points[c] for c in points.columns])


def clusters(df: DataFrame, group: list[str], order: list[Column], radius: float, columns: list[str], least: int) -> DataFrame:
    """(group, columns, n) of anchors: points that, in order, lie within an L1 radius of the first one; those met `least` times."""
    return cover.first_fit(df, group, order, radius, columns, "l1", least)


def routes(df: DataFrame, group: list[str], order: list[Column], radius: float, columns: list[str]) -> DataFrame:
    """Points more than the radius from all kept before, in order."""
    return cover.anchors(df, group, order, radius, columns)


def class_clusters(df: DataFrame, group: list[str], order: list[Column], side: float, columns: list[str]) -> DataFrame:
    """(group, columns, n): a place joins the first one of its group whose anchor is less than `side` away in both coordinates; else it is an anchor."""
    return cover.first_fit(df, group, order, side, columns, "box")
