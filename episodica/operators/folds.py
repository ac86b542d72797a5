"""Sequential folds over an episode's ordered rows, as SQL aggregates of arrays.

A fold sees one episode's rows in one array; episodes are bounded in length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_rows(df: DataFrame, key: list[str], order: list[str], columns: list[str], name: str = "rows_") -> DataFrame:
    held = F.struct(*order, *[c for c in columns if c not in order])
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(held)).alias(name))


def hysteresis(values: Column, enter: float, leave: float) -> Column:
    """How often a distance comes to `enter` or less, after it was above `leave` (or at the start)."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("n"))

    def step(s, v):
        comes = ~s["inside"] & (v <= enter)
        goes = s["inside"] & (v > leave)
        return F.struct(F.when(comes, True).when(goes, False).otherwise(s["inside"]).alias("inside"), (s["n"] + comes.cast("bigint")).alias("n"))

    return F.aggregate(values, start, step, lambda s: s["n"])


def track(values: Column, start: Column, jump: float) -> Column:
    """The tracked value: each next one is followed unless it is more than `jump` away."""
    return F.aggregate(values, start, lambda s, v: F.when(F.abs(v - s) <= jump, v).otherwise(s))


def rests(rows: Column, still: float, gap: int, least: int) -> Column:
    """Rest segments of array<struct<t, v>> (v null where nothing was seen).

    A segment is anchored at its first value: it goes on while values stay
    within `still` of it, and ends on another value, or when nothing was seen
    for more than `gap`. Segments of `least` or more in t stay.
    """
    kind = "struct<start:bigint,end:bigint,v:double>"
    none = F.lit(None).cast(kind)
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), none.alias("cur"), F.lit(None).cast("bigint").alias("seen"))

    def step(s, x):
        cur, seen, t = s["cur"], s["seen"], x["t"].cast("bigint")
        lost = x["v"].isNull() & cur.isNotNull() & (t - seen > gap)
        stays = x["v"].isNotNull() & cur.isNotNull() & (F.abs(cur["v"] - x["v"]) <= still)
        fresh = F.struct(t.alias("start"), t.alias("end"), x["v"].cast("double").alias("v"))
        longer = F.struct(cur["start"].alias("start"), t.alias("end"), cur["v"].alias("v"))
        closes = lost | (x["v"].isNotNull() & cur.isNotNull() & ~stays)
        return F.struct(
            F.when(closes, F.array_append(s["out"], cur)).otherwise(s["out"]).alias("out"),
            F.when(lost, none).when(x["v"].isNull(), cur).when(stays, longer).otherwise(fresh).alias("cur"),
            F.when(x["v"].isNull(), seen).otherwise(t).alias("seen"),
        )

    done = lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["cur"]))
    return F.filter(F.aggregate(rows, start, step, done), lambda x: x["end"] - x["start"] >= least)


def upper_median(values: Column) -> Column:
    """The element at the middle of the sorted values, the upper one of two; null if there are none."""
    return F.when(F.size(values) > 0, F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")))


def drops(segments: Column, pads: Column, same: float = 14, reach: float = 20) -> Column:
    """Where a thing was put down: rest segments after the first, repeats at one place merged, with the nearest pad in reach.

    segments: array<struct<start, r, c>>; pads: array<struct<r, c>>; distances are L1.
    """
    l1 = lambda a, b: F.abs(a["r"] - b["r"]) + F.abs(a["c"] - b["c"])
    rest = F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1)))
    kept = F.aggregate(rest, F.slice(segments, 1, 0), lambda out, s: F.when((F.size(out) > 0) & (l1(F.element_at(out, -1), s) <= same), out).otherwise(F.array_append(out, s)))
    nearest = lambda s: F.array_min(F.transform(pads, lambda p, i: F.struct(l1(p, s).alias("d"), i.alias("i"), p["r"].alias("r"), p["c"].alias("c"))))
    pad = lambda s: F.when(nearest(s)["d"] <= reach, F.struct(nearest(s)["r"].alias("r"), nearest(s)["c"].alias("c")))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["r"].alias("r"), s["c"].alias("c"), pad(s).alias("pad")))


def kth_pad(found: Column, k: Column) -> Column:
    """The pad of the k-th drop (from 0) that has one; null if there are fewer."""
    return F.get(F.filter(found, lambda d: d["pad"].isNotNull()), k)["pad"]
