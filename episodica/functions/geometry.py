"""Distances, angles, projections and direction words as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return (r1 - r2) * (r1 - r2) + (c1 - c2) * (c1 - c2)


def euclid(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.sqrt(squared(r1, c1, r2, c2))


def l1(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.abs(r1 - r2) + F.abs(c1 - c2)


def linf(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.greatest(F.abs(r1 - r2), F.abs(c1 - c2))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def wrap(angle: Column) -> Column:
    """The angle in (-pi, pi]."""
    return F.lit(math.pi) - F.pmod(F.lit(math.pi) - angle, F.lit(2 * math.pi))


def cross(ar: Column, ac: Column, br: Column, bc: Column) -> Column:
    return ar * bc - ac * br


def dot(a: list[Column], b: list[Column]) -> Column:
    """The sum of products of two vectors' parts."""
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def tilt_degrees(ax: Column, ay: Column, az: Column) -> Column:
    """Degrees between the rotated approach axis and straight down, from an axis-angle vector."""
    theta = F.sqrt(ax * ax + ay * ay + az * az)
    k = F.when(theta > 0, az / theta).otherwise(F.lit(0.0))
    r22 = F.cos(theta) + (1 - F.cos(theta)) * k * k
    return F.degrees(F.acos(clip(-r22, -1.0, 1.0)))


def axis_angle(x: Column, y: Column, z: Column, w: Column) -> Column:
    """A quaternion as an axis-angle vector; zero where the rotation is none."""
    w = clip(w, -1.0, 1.0)
    den = F.sqrt(1 - w * w)
    scale = F.when(den < 1e-9, F.lit(0.0)).otherwise(2 * F.acos(w) / den)
    return F.array(x * scale, y * scale, z * scale)


def project(x: Column, y: Column, z: Column, matrix: list[list[float]], height: int, width: int) -> Column:
    """Pixel (r, c) of a point by a 3x4 or 4x4 matrix: halves to even, clipped to the image."""
    u, v, w = (matrix[i][0] * x + matrix[i][1] * y + matrix[i][2] * z + matrix[i][3] for i in range(3))
    w = F.nullif(w, F.lit(0.0))
    r, c = (F.bround(e / w, 0).cast("int") for e in (v, u))
    return F.struct(clip(r, 0, height - 1).cast("int").alias("r"), clip(c, 0, width - 1).cast("int").alias("c"))


def color_bin(x: Column, size: int, bins: int) -> Column:
    return F.least(F.floor(x / size), F.lit(bins - 1)).cast("int")


def direction(dr: Column, dc: Column, dead: float) -> Column:
    """Words for a displacement; a component within the dead zone gives none."""
    down = F.when(dr > dead, "down").when(dr < -dead, "up")
    side = F.when(dc > dead, "right").when(dc < -dead, "left")
    words = F.concat_ws("-", down, side)
    return F.when(words == "", "still").otherwise(words)
