"""Queries of machines that carry state from tick to tick, each with its recursion in SQL.

An episode is a user, a tick one of their events; points are (value, k), k being the number in the event's props.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.operators.predicates import Bounds
from episodica.streaming import machines, scans, serving

from .base import EV, episodes

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Events of a user's first RECORDED ones are the recorded plan.
RECORDED = 6


def _ticks(spark, d):
    """ep, tick, sg, value, k, ts of all events."""
    k = F.get_json_object("props", "$.k").cast("double")
    return episodes(spark, d).select("ep", F.col("step").alias("tick"), "sg", "value", k.alias("k"), "ts")


_XS = EV + ", xs as (select ep, step, sg, value, (props->>'k')::double as k, ts from ev)"


@query(f"""with recursive {_XS},
pl as (select ep, list(sg order by step) as plan, list(value order by step) as tr, list(k order by step) as tc from xs where step < {RECORDED} group by ep),
t as (select ep, step - {RECORDED} as i, step, sg, value, k, count(*) filter (sg = 'purchase') over (partition by ep order by step) as done from xs where step >= {RECORDED}),
r as (
  select ep, -1::bigint as i, -1::bigint as tick, ''::varchar as held, 0::bigint as j, 0::bigint as stall, false as arrived, false as valve, false as corrected from pl
  union all
  select ep, i, step, plan[least(j2, len(plan) - 1) + 1], j2, case when valve then 0 else s1 end, arrived, valve, lower(plan[least(j2, len(plan) - 1) + 1]) <> lower(trim(sg))
  from (
    select *, j1 + case when valve then 1 else 0 end as j2
    from (
      select *, s1 > 6 and done > j1 as valve
      from (
        select *, j + arrived::int as j1, case when arrived then 0 else stall end + 1 as s1
        from (
          select r.ep, t.i, t.step, t.sg, t.done, r.j, r.stall, pl.plan, coalesce((tr[r.j + 1] - t.value) ** 2 + (tc[r.j + 1] - t.k) ** 2 <= 14 ** 2, false) as arrived
          from r join t on t.ep = r.ep and t.i = r.i + 1 join pl on pl.ep = r.ep)))))
select ep, tick, held, j, arrived, valve, corrected from r where i >= 0""")
def plan_pointer(spark, d):
    return machines.batch(pointer_ticks(spark, d), serving.pointer())


def pointer_ticks(spark, d):
    x, by = _ticks(spark, d), Window.partitionBy("ep").orderBy("tick")
    plan = x.filter(F.col("tick") < RECORDED).groupBy("ep").agg(F.array_sort(F.collect_list(F.struct("tick", "sg", "value", "k"))).alias("p"))
    plan = plan.select("ep", F.col("p.sg").alias("plan"), F.col("p.value").alias("to_r"), F.col("p.k").alias("to_c"))
    done = F.count_if(F.col("sg") == "purchase").over(by)
    later = x.filter(F.col("tick") >= RECORDED).withColumn("done", done)
    return later.join(plan, "ep").select("ep", "tick", "plan", "to_r", "to_c", F.col("sg").alias("said"), "done", F.array("value").alias("seen_r"), F.array("k").alias("seen_c"))


#: The plan of the feed: kinds, and the event that makes each step's predicate true.
_KINDS, _WHEN = ("pick", "place", "open", "close", "pour", "pick"), ("view", "click", "purchase", "signup", "error", "view")


def feed_ticks(spark, d):
    x = _ticks(spark, d)
    texts = lambda xs: F.array(*map(F.lit, xs))
    band = lambda v: F.array(*[F.lit(v if k == "pick" else None).cast("double") for k in _KINDS])
    holds = F.transform(texts(_WHEN), lambda w: w == F.col("sg"))
    return x.select("ep", "tick", texts(_KINDS).alias("kinds"), band(0.01).alias("low"), band(0.04).alias("high"), holds.alias("holds"), (F.col("k") / 2000).alias("q"), (F.col("value") / 1000).alias("z"), (F.minute("ts") * 3.0).alias("tilt"))


def _feed_sql() -> str:
    kinds, when = (", ".join(f"'{x}'" for x in xs) for xs in (_KINDS, _WHEN))
    return f"""with recursive {_XS},
t as (select ep, step as i, k / 2000 as q, value / 1000 as z, minute(ts) * 3.0::double as tilt, sg from xs),
lv as (select unnest([0, 1, 2])::bigint as level),
pk as (select [{kinds}] as kinds, [{when}] as whens),
r as (
  select ep, level, -1::bigint as i, 0::bigint as idx, null::varchar as kind, false as moved, []::double[] as recent, null::double as first, 0::bigint as n, null::double as open_tilt, null::double as gz
  from (select distinct ep from t), lv
  union all
  select ep, level, i, idx2, kind, moved, case when moved then [] else recent end, case when moved then null else first end, case when moved then 0 else n end,
    case when moved and kinds[idx2 + 1] = 'open' then tilt else open_tilt end, case when moved then null else gz end
  from (
    select *, idx + moved::int as idx2
    from (
      select *, live and case when level = 0 then fired
          when kind = 'pick' then coalesce(z - gz >= 0.03, false) or fired
          when not fired then false
          when kind = 'close' and level = 2 and open_tilt is not null then q >= 0.037 and abs(tilt - open_tilt) <= 10
          when kind in ('place', 'put', 'close') then q >= 0.037
          when kind = 'pour' then n >= 2 and abs(tilt - first) <= 10
          else true end as moved
      from (
        select *, case when level > 0 and kind = 'pick' and gz0 is null and len(recent) = 2 and list_min(recent) >= 0.01 and list_max(recent) <= 0.04 and list_max(recent) - list_min(recent) < 0.02 then z else gz0 end as gz
        from (
          select r.ep, r.level, t.i, t.q, t.z, t.tilt, r.idx, pk.kinds, pk.kinds[r.idx + 1] as kind, t.i > 4 and r.idx < len(pk.kinds) as live, r.gz as gz0, r.open_tilt,
            coalesce(pk.whens[r.idx + 1] = t.sg, false) as fired,
            case when t.i > 4 then list_append(r.recent, t.q)[-2:] else r.recent end as recent,
            case when t.i > 4 then coalesce(r.first, t.tilt) end as first, case when t.i > 4 then r.n + 1 else 0 end as n
          from r join t on t.ep = r.ep and t.i = r.i + 1, pk)))))
select level, ep, i as tick, idx, kind, moved from r where i >= 0"""


@query(_feed_sql())
def oracle_feed(spark, d):
    ticks = feed_ticks(spark, d)
    levels = [machines.batch(ticks, serving.feed(level, wait=4, grasp_steps=2, spread=0.02)).select(F.lit(level).cast("bigint").alias("level"), "*") for level in (0, 1, 2)]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


_CITE = "' at <' || floor(value)::bigint || ', ' || k::bigint || '>'"


def _cite(*head):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head], F.lit(" at <"), F.floor("value").cast("string"), F.lit(", "), F.col("k").cast("bigint").cast("string"), F.lit(">"))


def sequence_ticks(spark, d):
    """The first events of a user are recorded steps, of later ones purchases are completions and the others are citations."""
    x = _ticks(spark, d)
    verb = F.when(F.col("sg").isin("view", "click"), "pick the cube").otherwise("drop the cube")
    early, sold = F.col("tick") < RECORDED, F.col("sg") == "purchase"
    thing = F.when(F.col("sg") == "error", F.array(F.lit("red_cube"))).otherwise(F.array().cast("array<string>"))
    at = lambda c: F.when(F.col("sg") == "error", F.array(F.floor(c).cast("double"))).otherwise(F.array().cast("array<double>"))
    return x.select("ep", "tick", F.when(~early & ~sold, _cite(verb)).alias("said"), F.when(early, _cite(verb)).alias("shown"), F.when(~early & sold, F.when(F.col("k") < 50, "pick").otherwise("drop")).alias("completed"), thing.alias("names"), at("value").alias("seen_r"), at("k").alias("seen_c"))


@query(f"""with {_XS},
t as (select *, case when sg in ('view', 'click') then 'pick' else 'drop' end as side, floor(value)::bigint as v, k::bigint as c from xs),
rec as (select ep, side, row_number() over (partition by ep, side order by step) - 1 as nth, step, v, c from t where step < {RECORDED}),
n as (select t.ep, t.step, t.side, t.sg, t.v, t.c, case when step >= {RECORDED} and sg <> 'purchase' then side || ' the cube at <' || v || ', ' || c || '>' else '' end as said,
    count(*) filter (step >= {RECORDED} and sg = 'purchase' and k < 50) over w as done_pick, count(*) filter (step >= {RECORDED} and sg = 'purchase' and k >= 50) over w as done_drop from t window w as (partition by ep order by step)),
m as (select n.*, case when side = 'pick' then done_pick else done_drop end as done, (select count(*) from rec where rec.ep = n.ep and rec.side = 'pick' and rec.step <= n.step) as picks,
    (select count(*) from rec where rec.ep = n.ep and rec.side = 'drop' and rec.step <= n.step) as drops from n),
x as (select m.*, due.v as dv, due.c as dc,
    exists (select 1 from rec where rec.ep = m.ep and rec.step <= m.step and (rec.v, rec.c) <> (due.v, due.c) and abs(rec.v - m.v) + abs(rec.c - m.c) <= 10) as other
  from m left join rec as due on due.ep = m.ep and due.side = m.side and due.nth = m.done and due.step <= m.step),
y as (select *, said <> '' and sg <> 'error' and picks >= 2 and drops >= 1 and dv is not null and abs(v - dv) + abs(c - dc) > 20 and other as pinned from x)
select ep, step as tick, case when pinned then side || ' the cube at <' || dv || ', ' || dc || '>' else said end as text, pinned from y""")
def sequence_pins(spark, d):
    return machines.batch(sequence_ticks(spark, d), serving.sequence_pin())


_FRAMES = 3


def class_ticks(spark, d):
    """A tick is three events; each sees a thing named after the event, the last one cites what is wanted (after the first one)."""
    x = _ticks(spark, d).withColumn("n", F.floor(F.col("tick") / _FRAMES))
    g = x.groupBy("ep", "n").agg(F.array_sort(F.collect_list(F.struct("tick", "sg", F.floor("value").alias("r"), F.col("k").cast("bigint").alias("c")))).alias("f"))
    last = F.element_at("f", -1)
    said = F.concat(F.lit("pick up the cube at <"), last["c"].cast("string"), F.lit(", "), last["r"].cast("string"), F.lit(">"))
    part = lambda c, t: F.transform("f", lambda s: s[c].cast(t))
    return g.select("ep", F.col("n").alias("tick"), said.alias("said"), F.get("f", F.lit(0))["sg"].alias("wanted"), part("sg", "string").alias("names"), part("r", "double").alias("seen_r"), part("c", "double").alias("seen_c"))


@query(f"""with {_XS}, f as (select ep, step, step // {_FRAMES} as tick, sg, floor(value)::bigint as r, k::bigint as c from xs),
t as (select ep, tick, arg_min(sg, step) as wanted, arg_max(c, step) as cr, arg_max(r, step) as cc from f group by ep, tick),
n as (select t.*, (select count(*) from f where f.ep = t.ep and f.tick = t.tick and f.sg = t.wanted) as many,
    exists (select 1 from f where f.ep = t.ep and f.tick <= t.tick and f.sg = t.wanted and abs(f.r - t.cr) + abs(f.c - t.cc) <= 14) as seen from t),
b as (select ep, tick, r, c from (
    select n.ep, n.tick, f.r, f.c, row_number() over (partition by n.ep, n.tick order by abs(f.r - cr) + abs(f.c - cc), f.step) as nth
    from n join f on f.ep = n.ep and f.tick = n.tick and f.sg = n.wanted where many >= 2 and not seen) where nth = 1)
select n.ep, n.tick, 'pick up the cube at <' || coalesce(b.r, cr) || ', ' || coalesce(b.c, cc) || '>' as text, b.r is not null as fixed from n left join b on b.ep = n.ep and b.tick = n.tick""")
def cited_classes(spark, d):
    return machines.batch(class_ticks(spark, d), serving.cited_class(least=2))


def tracker_ticks(spark, d):
    """A user's sign-up pins the thing `signup`, a purchase `purchase`; every event sees a thing of each name, apart from each other, and cites one."""
    x = _ticks(spark, d)
    pinned = F.col("sg").isin("signup", "purchase")
    named = F.when(F.col("k") % 2 == 0, "signup").otherwise("purchase")
    names, rows = F.array(F.lit("signup"), F.lit("purchase"), F.lit("purchase")), F.array(F.floor("value"), F.floor(F.col("value") / 2), F.col("k").cast("bigint"))
    cols = F.array(F.col("k").cast("bigint"), F.floor("value"), F.floor("value"))
    real = lambda a: F.transform(a, lambda v: v.cast("double"))
    return x.select("ep", "tick", _cite("pick up the ", named).alias("said"), named.alias("name"), F.when(pinned, F.col("sg")).alias("pin"), F.floor("value").cast("double").alias("pin_r"), F.col("k").alias("pin_c"), names.alias("names"), real(rows).alias("seen_r"), real(cols).alias("seen_c"))


def _follow(name: str, seen: str) -> str:
    """Where the pinned thing of a name goes: seen is a list of struct(r, c)."""
    d = f"list_transform({seen}, lambda p, i: {{'d': (p.r - {name}0.r) ** 2 + (p.c - {name}0.c) ** 2, 'i': i, 'r': p.r, 'c': p.c}})"
    return f"case when {name}0 is null then null when list_min({d}).d <= 900 then {{'r': list_min({d}).r, 'c': list_min({d}).c}} else {name}0 end"


@query(f"""with recursive {_XS},
t as (select ep, step as i, sg, floor(value)::double as v, floor(value / 2)::double as h, k, case when k::bigint % 2 = 0 then 'signup' else 'purchase' end as name from xs),
r as (
  select ep, -1::bigint as i, null::struct(r double, c double) as s, null::struct(r double, c double) as p, ''::varchar as name, 0::double as v, 0::double as k from (select distinct ep from t)
  union all
  select ep, i, {_follow("s", "[{'r': v, 'c': k}]")}, {_follow("p", "[{'r': h, 'c': v}, {'r': k, 'c': v}]")}, name, v, k
  from (select r.ep, t.i, t.name, t.v, t.h, t.k, case when t.sg = 'signup' then {{'r': t.v, 'c': t.k}} else r.s end as s0, case when t.sg = 'purchase' then {{'r': t.v, 'c': t.k}} else r.p end as p0
    from r join t on t.ep = r.ep and t.i = r.i + 1)),
x as (select *, case when name = 'signup' then s else p end as spot from r where i >= 0),
y as (select *, spot is not null and abs(v - spot.r) + abs(k - spot.c) > 6 as pinned from x)
select ep, i as tick, 'pick up the ' || name || ' at <' || case when pinned then spot.r else v end::bigint || ', ' || case when pinned then spot.c else k end::bigint || '>' as text, coalesce(pinned, false) as pinned, spot.r as r, spot.c as c from y""")
def tracker_pins(spark, d):
    return machines.batch(tracker_ticks(spark, d), serving.tracker_pin())


#: States of events: the finger is k / 2000, the hand's height value / 500; a tick brings four, and the plan is to pick and place three times.
_PER_TICK, _HANDS = 4, Bounds(stall=1.0, hold=3, look_back=20)


def scan_ticks(spark, d):
    x = _ticks(spark, d)
    state = F.array(F.col("value") / 1000, F.col("k") / 1000, F.col("value") / 500, F.radians(F.minute("ts") * 3.0), F.lit(0.0), F.lit(0.0), F.col("k") / 2000)
    rows = x.groupBy("ep", F.floor(F.col("tick") / _PER_TICK).alias("t")).agg(F.array_sort(F.collect_list(F.struct("tick", state.alias("s")))).alias("r"))
    texts = lambda *xs: F.array_repeat(F.array(*map(F.lit, xs)), 3)
    return rows.select("ep", F.col("t").alias("tick"), F.flatten(texts("pick", "place")).alias("kinds"), F.flatten(texts("it", "it")).alias("whats"), F.col("r.s").alias("states"))


@query(f"""with recursive {_XS},
m as (select ep, step as i, k / 2000 as q, value / 500 as z, k / 2000 > 0.037 as wide, k / 2000 > 0.006 and k / 2000 < 0.037 as inband from xs),
s as (select *, count(*) filter (inband) over (w rows 4 preceding) = 5 as grasp, coalesce(max(i) filter (not inband) over w, -1) + 1 as since,
    wide and lag(wide) over w and lag(wide, 2) over w and not coalesce(lag(wide, 3) over w, false) as edge from m window w as (partition by ep order by i)),
gr as (select *, (select min(b.i) from s b where b.ep = a.ep and b.i >= a.i and (b.wide or b.z >= a.z + 0.03)) as up from s a where grasp),
ups as (select gr.ep, gr.i, gr.z, gr.up, s.wide as freed from gr join s on s.ep = gr.ep and s.i = gr.up),
nx as (select s.ep, s.i, u.up, u.freed from s join ups u on u.ep = s.ep and u.i = (select min(g.i) from gr g where g.ep = s.ep and g.i >= s.i)),
walk as (select ep, i as s0, up, freed from nx union all select w.ep, w.s0, nx.up, nx.freed from walk w join nx on nx.ep = w.ep and nx.i = w.up + 1 where w.freed),
lifts as (select ep, s0, up from walk where not freed),
pick as (select a.ep, a.i as start, (select min(b.i) from s b where b.ep = a.ep and b.i >= g.i and b.z >= g.z + 0.03 and b.q < 0.037) as p
  from s a join gr g on g.ep = a.ep and g.i = (select min(h.i) from gr h where h.ep = a.ep and h.i >= (select min(v.i) from s v where v.ep = a.ep and v.i >= a.i and v.wide))),
place as (select a.ep, a.i as start, (select min(b.i) from s b where b.ep = a.ep and b.edge and b.i >= greatest(l.up + 3, a.i)) as p
  from s a join lifts l on l.ep = a.ep and l.s0 = case when a.inband then a.since else greatest(0, a.i - 20) end),
found as (select 0 as kind, * from pick union all select 1, * from place),
t as (select ep, step // {_PER_TICK} as tick, max(step) + 1 as n from ev group by 1, 2),
r as (
  select ep, -1::bigint as tick, 0::bigint as j, 0::bigint as start, null::bigint as fired, 0::bigint as was from (select distinct ep from t)
  union all
  select r.ep, t.tick, r.j + (f.p is not null)::int, coalesce(f.p + 1, r.start), f.p, r.j
  from r join t on t.ep = r.ep and t.tick = r.tick + 1 left join found f on f.ep = r.ep and f.start = r.start and f.kind = r.j % 2 and f.p < t.n and r.j < 6)
select ep, tick, was as j, fired, fired is not null as done from r where tick >= 0""")
def fired_scan(spark, d):
    return machines.batch(scan_ticks(spark, d), scans.fired(_HANDS))


_GATED = """case sg when 'view' then 'completed: pick up the cube' when 'click' then 'completed: place it' when 'signup' then 'completed: move to the top of the ' || case when k < 50 then 'left' else 'right' end || '-side target'
  when 'error' then 'a note' else 'completed: pick it' end || case when sg in ('view', 'click', 'purchase') then ' at <' || floor(value / 10)::bigint || ', ' || floor(k / 10)::bigint || '>' else '' end"""


def gate_ticks(spark, d):
    """A purchase is claimed by evidence, another event is a line of the writer."""
    x = _ticks(spark, d)
    at = lambda c: F.floor(F.col(c) / 10).cast("string")
    side = F.concat(F.lit("completed: move to the top of the "), F.when(F.col("k") < 50, "left").otherwise("right"), F.lit("-side target"))
    place = F.concat(F.lit(" at <"), at("value"), F.lit(", "), at("k"), F.lit(">"))
    heads = {"view": "completed: pick up the cube", "click": "completed: place it", "purchase": "completed: pick it"}
    text = F.when(F.col("sg") == "signup", side).when(F.col("sg") == "error", "a note")
    for sg, head in heads.items():
        text = text.when(F.col("sg") == sg, F.concat(F.lit(head), place))
    sold = F.col("sg") == "purchase"
    return x.select("ep", "tick", F.when(~sold, text).alias("line"), F.when(sold, text).alias("auto"), (F.col("ep") % 2 == 0).alias("alternates"))


@query(f"""with recursive {_XS},
t as (select ep, step as i, sg, {_GATED} as text, case when sg in ('view', 'purchase') then 'pick' when sg = 'click' then 'place' end as verb, floor(value / 10)::bigint as v, floor(k / 10)::bigint as c,
    case when sg = 'signup' then case when k < 50 then 'left' else 'right' end end as side from xs),
a as (select t.*, verb is not null and exists (select 1 from t o where o.ep = t.ep and o.sg = 'purchase' and o.i < t.i and o.verb = t.verb and abs(o.v - t.v) + abs(o.c - t.c) <= 14) as claimed from t),
r as (
  select ep, -1::bigint as i, null::varchar as last, null::varchar as was, null::varchar as text, null::varchar as verdict from (select distinct ep from t)
  union all
  select ep, i, case when verdict in ('claim', 'admit') then text else last end, case when verdict in ('claim', 'admit') then coalesce(side, was) else was end, text, verdict
  from (select r.ep, a.i, r.last, r.was, a.text, a.side, case when a.sg = 'purchase' then 'claim' when a.text = r.last then 'repeat' when a.claimed then 'auto' when a.side = r.was and r.ep % 2 = 0 then 'side' else 'admit' end as verdict
    from r join a on a.ep = r.ep and a.i = r.i + 1))
select ep, i as tick, text, verdict from r where i >= 0""")
def gated_lines(spark, d):
    return machines.batch(gate_ticks(spark, d), serving.writer_gate())
