"""Things followed in the plane from frame to frame, and the events of coming and going.

Machines (streaming.machines), so that whole episodes and streams give the same.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from episodica.streaming.machines import Machine, Memory

#: How the n-th time is told; later ones as the last.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth")


def _points(rows: Any, cols: Any) -> list[tuple[float, float]]:
    rows, cols = ([] if v is None else list(v) for v in (rows, cols))
    return [(float(r), float(c)) for r, c in zip(rows, cols) if r is not None and c is not None and r == r and c == c]


def assigned(tracks: dict[str, tuple[float, float]], seen: list[tuple[float, float]], jump: float) -> dict[str, int]:
    """Which place each track goes on to: nearest pairs first, one to one, none farther than `jump`; ties by name, then by order."""
    near = sorted((d, name, k) for name, (r, c) in tracks.items() for k, p in enumerate(seen) if (d := (p[0] - r) ** 2 + (p[1] - c) ** 2) <= jump * jump)
    out: dict[str, int] = {}
    used: set[int] = set()
    for _, name, k in near:
        if name not in out and k not in used:
            out[name] = k
            used.add(k)
    return out


def tracks(jump: float) -> Machine:
    """Named tracks over frames.

    A tick is a frame: seen_r and seen_c (places), and names, at_r and at_c (tracks that begin
    there or are set anew; may be null). Each track goes on to one of the frame's places, as
    `assigned` says; one that has none within `jump` stays. Gives name, r, c, found and moved (how far).
    """

    def step(m: Memory, x: Any) -> list[tuple]:
        for name, (r, c) in zip([] if x.names is None else list(x.names), _points(x.at_r, x.at_c)):
            m.put("tracks", name, r, c)
        now, seen = dict(m.items("tracks")), _points(x.seen_r, x.seen_c)
        to, out = assigned(now, seen, jump), []
        for name in sorted(now):
            (r, c), at = now[name], seen[to[name]] if name in to else now[name]
            if name in to:
                m.put("tracks", name, *at)
            out.append((name, *at, name in to, ((at[0] - r) ** 2 + (at[1] - c) ** 2) ** 0.5))
        return out

    return Machine(step, "name string, r double, c double, found boolean, moved double", {}, {}, {"tracks": ("string", "r double, c double")})


def crossings(enter: float, leave: float, warn: float | None = None, closer: float = 1.0) -> Machine:
    """Events of a thing that comes to targets and leaves them, each side counted apart.

    A tick has r and c (of the thing; null: not seen, no event) and to_r and to_c (the targets, always
    in the same order). Within `enter` it has `reached` a side, once, until it is farther than
    `leave`; then it has `left`. Before that, on its way from beyond `enter` to `warn` or less, it is
    `approaching` if it has come nearer by more than `closer` since it was last seen; once for each time it
    reaches the side. Gives side, event, n (how often it has reached the side), nth (in words) and distance.
    """

    def step(m: Memory, x: Any) -> list[tuple]:
        if x.r is None or x.c is None or x.r != x.r or x.c != x.c:
            return []
        out = []
        for side, (r, c) in enumerate(_points(x.to_r, x.to_c)):
            far, n, before, warned = m.items("sides").get(side, (True, 0, None, False))
            d = ((x.r - r) ** 2 + (x.c - c) ** 2) ** 0.5
            told = lambda event, n, side=side, d=d: out.append((side, event, n, ORDINALS[min(max(n, 1), len(ORDINALS)) - 1], d))
            if warn is not None and far and not warned and before is not None and enter < d <= warn and d < before - closer:
                warned = True
                told("approaching", n)
            if far and d <= enter:
                far, warned, n = False, False, n + 1
                told("reached", n)
            elif d > leave:
                if not far:
                    told("left", n)
                far = True
            m.put("sides", side, far, n, d, warned)
        return out

    return Machine(step, "side bigint, event string, n bigint, nth string, distance double", {}, {}, {"sides": ("bigint", "far boolean, n bigint, before double, warned boolean")})


def rests(rows: Column, still: float, gap: int, least: int) -> Column:
    """Rest segments of array<struct<t, r, c>> in order of t (r or c null where nothing was seen).

    A segment is anchored at its first place: it goes on while places stay within an L1 distance of
    `still`, and ends at another place, or when nothing was seen for more than `gap`. Segments of
    `least` or more in t stay: array<struct<start, end, r, c>>, as folds.drops takes them.
    """
    kind = "struct<start:bigint,end:bigint,r:double,c:double>"
    none = F.lit(None).cast(kind)
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), none.alias("cur"), F.lit(None).cast("bigint").alias("seen"))

    def step(s, x):
        cur, t, there = s["cur"], x["t"].cast("bigint"), x["r"].isNotNull() & x["c"].isNotNull()
        lost = ~there & cur.isNotNull() & (t - s["seen"] > gap)
        stays = there & cur.isNotNull() & (F.abs(cur["r"] - x["r"]) + F.abs(cur["c"] - x["c"]) <= still)
        place = lambda a, r, c: F.struct(a.alias("start"), t.alias("end"), r.cast("double").alias("r"), c.cast("double").alias("c"))
        ended = lost | (there & cur.isNotNull() & ~stays)
        return F.struct(
            F.when(ended, F.array_append(s["out"], cur)).otherwise(s["out"]).alias("out"),
            F.when(lost, none).when(~there, cur).when(stays, place(cur["start"], cur["r"], cur["c"])).otherwise(place(t, x["r"], x["c"])).alias("cur"),
            F.when(there, t).otherwise(s["seen"]).alias("seen"),
        )

    whole = F.aggregate(rows, start, step, lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["cur"])))
    return F.filter(whole, lambda x: x["end"] - x["start"] >= least)
