"""Queries of things followed in the plane: an event is seen at (value, k), k being the number in its props."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.operators import folds, tracking
from episodica.streaming import machines

from .serving import _XS, _ticks

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def track_ticks(spark, d):
    """Three places an event; two tracks begin at the first event's, crosswise."""
    x = _ticks(spark, d)
    first = F.col("tick") == 0
    pair = lambda *xs: F.array(*xs)
    v, k = F.col("value"), F.col("k")
    return x.select("ep", "tick", pair(v, v / 2, k).alias("seen_r"), pair(k, v, v / 2).alias("seen_c"), F.when(first, F.array(F.lit("a"), F.lit("b"))).alias("names"), F.when(first, pair(v, k)).alias("at_r"), F.when(first, pair(k, v)).alias("at_c"))


_PAIRS = """list_filter(flatten(list_transform(seen, lambda p, i: [
  {'d': (p.r - a.r) ** 2 + (p.c - a.c) ** 2, 'n': 'a', 'i': i, 'p': p}, {'d': (p.r - b.r) ** 2 + (p.c - b.c) ** 2, 'n': 'b', 'i': i, 'p': p}])), lambda x: x.d <= 1600)"""


@query(f"""with recursive {_XS},
t as (select ep, step as i, [{{'r': value, 'c': k}}, {{'r': value / 2, 'c': value}}, {{'r': k, 'c': value / 2}}] as seen, {{'r': value, 'c': k}} as a0, {{'r': k, 'c': value}} as b0 from xs),
r as (
  select ep, -1::bigint as i, null::struct(r double, c double) as a, null::struct(r double, c double) as b, null::struct(r double, c double) as a1, null::struct(r double, c double) as b1, false as af, false as bf from (select distinct ep from t)
  union all
  select ep, i, coalesce(list_min(list_filter([one, two], lambda x: x.n = 'a')).p, a), coalesce(list_min(list_filter([one, two], lambda x: x.n = 'b')).p, b), a, b,
    list_min(list_filter([one, two], lambda x: x.n = 'a')) is not null, list_min(list_filter([one, two], lambda x: x.n = 'b')) is not null
  from (
    select *, list_min(list_filter(ps, lambda x: x.n <> one.n and x.i <> one.i)) as two
    from (select *, list_min(ps) as one
      from (select *, {_PAIRS} as ps
        from (select r.ep, t.i, t.seen, case when t.i = 0 then t.a0 else r.a end as a, case when t.i = 0 then t.b0 else r.b end as b from r join t on t.ep = r.ep and t.i = r.i + 1))))),
u as (select ep, i as tick, 'a' as name, a as p, a1 as q, af as found from r where i >= 0 union all select ep, i, 'b', b, b1, bf from r where i >= 0)
select ep, tick, name, p.r as r, p.c as c, found, sqrt((p.r - q.r) ** 2 + (p.c - q.c) ** 2) as moved from u""")
def planar_tracks(spark, d):
    return machines.batch(track_ticks(spark, d), tracking.tracks(40))


def crossing_ticks(spark, d):
    """Targets are the places of a user's first two events."""
    x, by = _ticks(spark, d), Window.partitionBy("ep").orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda c: F.array(F.first(c).over(by), F.nth_value(c, 2).over(by))
    return x.select("ep", "tick", F.col("value").alias("r"), F.col("k").alias("c"), at("value").alias("to_r"), at("k").alias("to_c"))


@query(f"""with recursive {_XS},
tg as (select ep, step as side, value as tr, k as tc from xs where step < 2),
t as (select xs.ep, side, step as i, sqrt((value - tr) ** 2 + (k - tc) ** 2) as d from xs join tg on tg.ep = xs.ep),
r as (
  select ep, side, -1::bigint as i, true as far, 0::bigint as n, null::double as before, false as warned, false as came, false as left_, false as near, null::double as d from tg
  union all
  select ep, side, i, case when came then false when d > 30 then true else far end, n + came::int, d, case when came then false else warned or near end, came, not far and d > 30, near, d
  from (select *, far and d <= 20 as came from (select r.ep, r.side, t.i, r.far, r.n, r.warned, t.d, r.far and not r.warned and coalesce(t.d > 20 and t.d <= 45 and t.d < r.before - 1, false) as near
    from r join t on t.ep = r.ep and t.side = r.side and t.i = r.i + 1))),
e as (select ep, i as tick, side, unnest(list_filter([case when near then 'approaching' end, case when came then 'reached' end, case when left_ then 'left' end], lambda x: x is not null)) as event, n, d from r where i >= 0)
select ep, tick, side, event, n, ['first', 'second', 'third', 'fourth', 'fifth', 'sixth'][least(greatest(n, 1), 6)] as nth, d as distance from e""")
def side_crossings(spark, d):
    return machines.batch(crossing_ticks(spark, d), tracking.crossings(20, 30, 45))


@query(f"""with recursive {_XS},
t as (select ep, step as i, case when sg <> 'error' then value end as v, case when sg <> 'error' then k end as k from xs),
r as (
  select ep, -1::bigint as i, null::bigint as start, null::bigint as last, null::double as ar, null::double as ac, null::bigint as seen, null::struct(s bigint, e bigint, r double, c double) as ended from (select distinct ep from t)
  union all
  select ep, i, case when lost then null when v is null then start when stays then start else i end, case when lost then null when v is null then last else i end,
    case when lost then null when v is null or stays then ar else v end, case when lost then null when v is null or stays then ac else k end, case when v is null then seen else i end,
    case when lost or (v is not null and start is not null and not stays) then {{'s': start, 'e': last, 'r': ar, 'c': ac}} end
  from (select r.*exclude (i, ended), t.i, t.v, t.k, t.v is null and r.start is not null and t.i - r.seen > 2 as lost, coalesce(r.start is not null and t.v is not null and abs(r.ar - t.v) + abs(r.ac - t.k) <= 60, false) as stays
    from r join t on t.ep = r.ep and t.i = r.i + 1)),
z as (select ep, {{'s': start, 'e': last, 'r': ar, 'c': ac}} as x from r where start is not null and i = (select max(i) from t where t.ep = r.ep) union all select ep, ended from r where ended is not null)
select ep, x.s as start, x.e as "end", x.r as r, x.c as c from z where x.e - x.s >= 2""")
def planar_rests(spark, d):
    seen = F.col("sg") != "error"
    x = _ticks(spark, d).select("ep", F.col("tick").alias("t"), F.when(seen, F.col("value")).alias("r"), F.when(seen, F.col("k")).alias("c"))
    rows = folds.ordered_rows(x, ["ep"], ["t"], ["r", "c"])
    return rows.select("ep", F.explode(tracking.rests(F.col("rows_"), 60, 2, 2)).alias("s")).select("ep", "s.*")
