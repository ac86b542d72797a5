"""Queries of ordered-sequence operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.operators import folds, ordered, quality

from .base import EV, TICKS, TURNS, episodes, ticks, turns

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {EV}, m as (select *, case when lag(sg) over w is distinct from sg or step = 0 then 1 else 0 end as ch from ev window w as (partition by ep order by step)),
r as (select *, sum(ch) over (partition by ep order by step) - 1 as run from m)
select ep, run::bigint as run, any_value(sg) as sg, min(step) as start, max(step) as "end", count(*) as length from r group by ep, run""")
def run_segments(spark, d):
    return ordered.run_segments(episodes(spark, d), ["ep"], ["step"], "sg", "step")


_METRICS = f"""with {TICKS},
m as (select *, step > 0 and o <> lag(o) over w as om, step > 0 and p <> lag(p) over w as pm from tk window w as (partition by ep order by step)),
x as (select m.*, (select min(j.step) from tk j where j.ep = m.ep and j.step >= m.step and j.p = m.o) - m.step as lag0,
  not exists (select 1 from tk j where j.ep = m.ep and j.step <= m.step and j.o = m.p) as fresh from m)
"""


@query(_METRICS + """, l as (select ep, list_sort(list(lag0) filter (om and lag0 is not null)) as ls from x group by ep)
select x.ep, count(*) as ticks, count(*) filter (o = p) as content, count(*) filter (om) as transitions,
  count(*) filter (om and lag0 is not null) as adopted, max(lag0) filter (om) as max_lag, count(*) filter (pm) as predicted,
  count(*) filter (pm and fresh) as premature, any_value(ls[len(ls) // 2 + 1]) as median_lag
from x join l on x.ep = l.ep group by x.ep""")
def tick_diag(spark, d):
    return quality.tick_report(quality.tick_metrics(ticks(spark, d), "ep", "step", "o", "p"), ["ep"])


@query(f"""with {TICKS}, b as (select *, sum(case when o = p then 1 else 0 end) over (partition by ep order by step) as g from tk),
r as (select ep, g, count(*) as length, min(step) as start, max(step) as "end" from b where o <> p group by ep, g)
select ep, length, start, "end" from (select *, row_number() over (partition by ep order by length desc, start) as n from r) where n = 1""")
def mismatch_runs(spark, d):
    return quality.mismatch_runs(ticks(spark, d), "ep", "step", F.col("o") != F.col("p"))


@query(f"""with recursive {EV}, h as (
  select ep, step, value <= 30 as inside, case when value <= 30 then 1 else 0 end as n from ev where step = 0
  union all
  select e.ep, e.step, case when not h.inside and e.value <= 30 then true when h.inside and e.value > 60 then false else h.inside end,
    h.n + case when not h.inside and e.value <= 30 then 1 else 0 end
  from h join ev e on e.ep = h.ep and e.step = h.step + 1)
select ep, max(n)::bigint as crossings from h group by ep""")
def hysteresis_count(spark, d):
    rows = folds.ordered_rows(episodes(spark, d), ["ep"], ["step"], ["value"])
    return rows.select("ep", folds.hysteresis(F.transform("rows_", lambda x: x["value"]), 30, 60).alias("crossings"))


@query(f"""with recursive {EV}, h as (
  select ep, step, value as cur from ev where step = 0
  union all select e.ep, e.step, case when abs(e.value - h.cur) <= 20 then e.value else h.cur end from h join ev e on e.ep = h.ep and e.step = h.step + 1)
select ep, arg_max(cur, step) as tracked from h group by ep""")
def nn_track(spark, d):
    rows = folds.ordered_rows(episodes(spark, d), ["ep"], ["step"], ["value"])
    values = F.transform("rows_", lambda x: x["value"])
    return rows.select("ep", folds.track(values, F.get(values, 0), 20).alias("tracked"))


@query(f"""with recursive {EV}, h as (
  select ep, step, step as start, value as anchor from ev where step = 0
  union all select e.ep, e.step, case when abs(h.anchor - e.value) <= 25 then h.start else e.step end, case when abs(h.anchor - e.value) <= 25 then h.anchor else e.value end
  from h join ev e on e.ep = h.ep and e.step = h.step + 1)
select ep, start, max(step) as "end", any_value(anchor) as v from h group by ep, start having max(step) - start >= 3""")
def rest_segments(spark, d):
    rows = folds.ordered_rows(episodes(spark, d), ["ep"], ["step"], ["value"])
    found = folds.rests(F.transform("rows_", lambda x: F.struct(x["step"].alias("t"), x["value"].alias("v"))), 25, 12, 3)
    return rows.select("ep", F.explode(found).alias("s")).select("ep", "s.*")


@query(f"""with {EV}, f as (select *, value > 50 as m from ev), g as (select *, sum(case when m then 0 else 1 end) over (partition by ep order by step) as b from f),
n as (select *, row_number() over (partition by ep, b order by step) - case when b > 0 then 1 else 0 end as nth from g)
select ep, step, m and nth >= 3 as held from n""")
def sustained_k(spark, d):
    return ordered.sustained(episodes(spark, d), ["ep"], ["step"], F.col("value") > 50, 3, "held").select("ep", "step", "held")


_ASOF = f"with {EV}, g as (select ep, step as t, sg from ev where step % 4 = 0)"


def _grid(spark, d):
    e = episodes(spark, d)
    return e.select("ep", F.col("step").alias("t"), "event_id"), e.filter("step % 4 = 0").select("ep", F.col("step").alias("t"), "sg")


def _nearest(tie: str) -> str:
    return _ASOF + f""", c as (select e.ep, e.step as t, e.event_id, g.t as at_found, g.sg, row_number() over (partition by e.ep, e.step order by abs(g.t - e.step), g.t {tie}) as n
from ev e join g on g.ep = e.ep and abs(g.t - e.step) <= 4) select ep, t, event_id, at_found, sg from c where n = 1"""


@query(_nearest("asc"))
def asof_nearest(spark, d):
    return ordered.asof(*_grid(spark, d), "ep", "t", ["sg"], "nearest")


@query(_nearest("desc"))
def asof_nearest_later(spark, d):
    return ordered.asof(*_grid(spark, d), "ep", "t", ["sg"], "nearest", tie="later")


@query(_ASOF + " select e.ep, e.step as t, e.event_id, g.t as at_found, g.sg from ev e asof join g on e.ep = g.ep and e.step >= g.t")
def asof_prev(spark, d):
    return ordered.asof(*_grid(spark, d), "ep", "t", ["sg"], "backward")


@query(_ASOF + """, l as (select ep, max(t) as lt, arg_max(sg, t) as ls from g group by ep)
select e.ep, e.step as t, e.event_id, coalesce(g.t, l.lt) as at_found, coalesce(g.sg, l.ls) as sg
from ev e join l on l.ep = e.ep asof left join g on e.ep = g.ep and e.step < g.t""")
def asof_next(spark, d):
    return ordered.asof(*_grid(spark, d), "ep", "t", ["sg"], "forward", clamp=True)


@query(_ASOF + """, n as (select g.ep, g.t, lag(g.t) over (partition by ep order by t) as tp from g)
select e.ep, e.step, greatest(0.1, least(1.0, (n.t - e.step)::double / greatest(n.t - coalesce(n.tp, 0), 1))) as weight
from ev e asof join n on e.ep = n.ep and e.step < n.t""")
def ramp_weight(spark, d):
    left, grid = _grid(spark, d)
    grid = grid.withColumn("tp", F.lag("t").over(Window.partitionBy("ep").orderBy("t")))
    found = ordered.asof(left, grid, "ep", "t", ["tp"], "forward").filter("at_found is not null")
    w = (F.col("at_found") - F.col("t")).cast("double") / F.greatest(F.col("at_found") - F.coalesce("tp", F.lit(0)), F.lit(1))
    return found.select("ep", F.col("t").alias("step"), F.greatest(F.lit(0.1), F.least(F.lit(1.0), w)).alias("weight"))


@query(f"""with {EV}, i as (select ep, step as from_step, case when value > 80 then -1 else step + floor(value / 10)::bigint end as until_step, event_id from ev),
q as (select ep, step as t from ev where step % 5 = 0),
j as (select q.ep, q.t, i.event_id, i.from_step, row_number() over (partition by q.ep, q.t order by i.from_step desc, i.event_id desc) as rank
  from q join i on i.ep = q.ep and i.from_step <= q.t and (i.until_step < 0 or q.t < i.until_step))
select ep, t, event_id, from_step, rank::int as rank from j where rank <= 3""")
def interval_visible_topk(spark, d):
    e = episodes(spark, d)
    until = F.when(F.col("value") > 80, -1).otherwise(F.col("step") + F.floor(F.col("value") / 10)).cast("bigint")
    items = e.select("ep", F.col("step").alias("from_step"), until.alias("until_step"), "event_id")
    asked = e.filter("step % 5 = 0").select("ep", F.col("step").alias("t"))
    return ordered.visible(asked, items, "ep", "t", "from_step", "until_step", 3, "event_id").select("ep", "t", "event_id", "from_step", "rank")


@query(f"""with {EV}, l as (select ep, count(*) as n, (count(*) // 3) as dend from ev group by ep),
g as (select ep, unnest(list_distinct(list_concat(list_concat(range(8, dend, 8), range((dend // 16 + 1) * 16, n, 16)), [n - 1]))) as "end" from l),
t as (select ep, "end", coalesce(lag("end") over (partition by ep order by "end"), -1) as last from g)
select t.ep, t.last, t."end", count(e.step) as n_events, list_sort(list_distinct(list_append(range(greatest(t.last, 0), t."end" + 1, 4), t."end"))) as samples
from t left join ev e on e.ep = t.ep and e.step > t.last and e.step <= t."end" group by t.ep, t.last, t."end" """)
def event_windows(spark, d):
    e = episodes(spark, d)
    lengths = e.groupBy("ep").agg(F.count("*").alias("n")).withColumn("dend", F.floor(F.col("n") / 3).cast("bigint"))
    t = ordered.tick_grid(lengths, "ep", "n", "dend", 8)
    # Each step meets the first tick end at or after it, so no tick is paired with other steps of its episode.
    ends = t.select("ep", F.col("end").alias("at"))
    met = ordered.asof(e.select("ep", (F.col("step") - 1).alias("at")), ends, "ep", "at", [], "forward")
    counted = met.groupBy("ep", F.col("at_found").alias("end")).agg(F.count("*").alias("n_"))
    out = t.join(counted, ["ep", "end"], "left").withColumn("n_events", F.coalesce("n_", F.lit(0)))
    return out.select("ep", F.col("last").cast("bigint").alias("last"), "end", "n_events", ordered.in_window_samples(F.col("last"), F.col("end")).alias("samples"))


@query(f"""with {TURNS} select ep, turn, coalesce(list(role) over (partition by ep order by turn, text rows between 8 preceding and 1 preceding), []) as bank,
len(coalesce(list(role) over (partition by ep order by turn, text rows between unbounded preceding and current row), []))::bigint as n_after from tu""")
def bank_last8(spark, d):
    t = ordered.bank(turns(spark, d), ["ep"], ["turn", "text"], "role", 8, False)
    t = ordered.bank(t, ["ep"], ["turn", "text"], "role", None, True, "after")
    return t.select("ep", "turn", "bank", F.size("after").cast("bigint").alias("n_after"))


@query(f"with {EV} select ep, step, sg from (select *, lag(sg) over (partition by ep order by step) as b from ev) where b is distinct from sg or step = 0")
def consecutive_dedup(spark, d):
    return ordered.drop_consecutive(episodes(spark, d), ["ep"], ["step"], "sg").select("ep", "step", "sg")


@query(f"with {EV} select ep, tick, sg, step from (select ep, (step // 16) as tick, sg, step, row_number() over (partition by ep, step // 16, sg order by step) as n from ev) where n = 1")
def kind_dedup(spark, d):
    e = episodes(spark, d).withColumn("tick", F.floor(F.col("step") / 16).cast("bigint"))
    return ordered.first_per(e, ["ep", "tick", "sg"], ["step"]).select("ep", "tick", "sg", "step")


@query(f"""with {EV}, c as (select ep, step, list(value) over (partition by ep order by step rows between current row and 4 following) as g, last_value(value) over (partition by ep order by step rows between current row and 4 following) as l from ev)
select ep, step, list_concat(g, list_transform(range(5 - len(g)), lambda x: l)) as chunk from c""")
def edge_pad_chunk(spark, d):
    return ordered.padded_chunk(episodes(spark, d), ["ep"], ["step"], "value", 5).select("ep", "step", "chunk")


@query(f"""with {EV} select ep, step, coalesce(lead(value, 8) over w, last_value(value) over (partition by ep order by step rows between unbounded preceding and unbounded following)) as later
from ev window w as (partition by ep order by step)""")
def future_clamp(spark, d):
    return ordered.future(episodes(spark, d), ["ep"], ["step"], "value", 8, "later").select("ep", "step", "later")


@query(f"""with {EV}, c as (select ep, step // 10 as piece, list(value order by step) as g from ev group by ep, step // 10)
select ep, piece, list_concat(g, list_transform(range(10 - len(g)), lambda x: g[-1])) as chunk, len(g)::bigint as n_valid from c""")
def seq_chunks(spark, d):
    return ordered.chunks(episodes(spark, d), ["ep"], "step", "value", 10)


@query(f"""with {EV}, l as (select ep, count(*) as n from ev group by ep) select ep, n, (sum(n) over (order by ep rows unbounded preceding) - n)::bigint as "offset" from l""")
def dense_offset(spark, d):
    n = episodes(spark, d).groupBy("ep").agg(F.count("*").alias("n"))
    return ordered.running_offset(n, ["ep"], "n")


@query(f"""with {EV} select ep, step, (select e2.step from ev e2 where e2.ep = ev.ep and e2.sg = 'purchase' and e2.step between ev.step + 1 and ev.step + 16 order by e2.step limit 1) as within16,
(select e2.sg from ev e2 where e2.ep = ev.ep and e2.sg not in ('view', 'click') and e2.step > ev.step order by e2.step limit 1) as next_real from ev""")
def look_ahead(spark, d):
    e = ordered.look_ahead(episodes(spark, d), ["ep"], ["step"], F.col("step"), F.col("sg") == "purchase", 16, "within16")
    return ordered.look_ahead(e, ["ep"], ["step"], F.col("sg"), ~F.col("sg").isin("view", "click"), None, "next_real").select("ep", "step", "within16", "next_real")


@query(f"""with {EV}, l as (select ep, max(step) as m from ev group by ep) select e.ep, e.step, least(e.step + 16, l.m) as due from ev e join l using (ep) where sg = 'click'""")
def press_delay(spark, d):
    last = F.max("step").over(Window.partitionBy("ep"))
    return episodes(spark, d).withColumn("m", last).filter("sg = 'click'").select("ep", "step", F.least(F.col("step") + 16, F.col("m")).alias("due"))


@query(f"""with {EV} select ep, step, coalesce(sum(case when sg = 'signup' then 1 else 0 end) over (partition by ep order by step), 0)::bigint as session from ev""")
def sessionize_markers(spark, d):
    return ordered.sessions(episodes(spark, d), ["ep"], ["step"], F.col("sg") == "signup").select("ep", "step", "session")


@query(f"""with {EV}, m as (select ep, step, value, round(abs(value - lag(value) over (partition by ep order by step)), 6) as speed from ev) select ep, step, speed, coalesce(speed < 5, false) as still from m""")
def diff_speed(spark, d):
    w = Window.partitionBy("ep").orderBy("step")
    e = episodes(spark, d).withColumn("speed", F.round(F.abs(F.col("value") - F.lag("value").over(w)), 6))
    return e.select("ep", "step", "speed", F.coalesce(F.col("speed") < 5, F.lit(False)).alias("still"))


@query(f"""with {EV}, b as (select *, step // 16 as tick from ev) select ep, tick, round(arg_max(value, step) - arg_min(value, step), 6) as moved, abs(arg_max(value, step) - arg_min(value, step)) >= 6 as far from b group by ep, tick""")
def displacement(spark, d):
    e = episodes(spark, d).withColumn("tick", F.floor(F.col("step") / 16).cast("bigint"))
    moved = F.max_by("value", "step") - F.min_by("value", "step")
    return e.groupBy("ep", "tick").agg(F.round(moved, 6).alias("moved"), (F.abs(moved) >= 6).alias("far"))


@query(f"""with {EV}, a as (select ep, step, value / 100 * 6.0 as a from ev), d as (select ep, step, a - lag(a) over (partition by ep order by step) as x from a)
select ep, round(sum(x - 2 * pi() * ceil((x - pi()) / (2 * pi()))), 6) as sweep from d group by ep""")
def angular_sweep(spark, d):
    from episodica.functions import geometry

    w = Window.partitionBy("ep").orderBy("step")
    a = episodes(spark, d).withColumn("a", F.col("value") / 100 * 6.0)
    return a.withColumn("x", F.col("a") - F.lag("a").over(w)).groupBy("ep").agg(F.round(F.sum(geometry.wrap(F.col("x"))), 6).alias("sweep"))


@query(f"""with {EV}, n as (select *, count(*) over (partition by ep) as n from ev), m as (select ep, median(value) as base from n where step < n * 0.2 group by ep)
select n.ep, min(step) as release from n join m using (ep) where step >= n * 0.25 and value > base + 7 group by n.ep""")
def release_step(spark, d):
    n = episodes(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("ep")))
    base = n.filter(F.col("step") < F.col("n") * 0.2).groupBy("ep").agg(F.median("value").alias("base"))
    late = (F.col("step") >= F.col("n") * 0.25) & (F.col("value") > F.col("base") + 7)
    return n.join(base, "ep").filter(late).groupBy("ep").agg(F.min("step").alias("release"))


@query(f"""with {TICKS} select ep, min(step) as first_divergence, arg_min(o, step) as wanted from tk where o <> p and step > 0 group by ep""")
def first_divergence(spark, d):
    t = ticks(spark, d).filter("o <> p and step > 0")
    return t.groupBy("ep").agg(F.min("step").alias("first_divergence"), F.min_by("o", "step").alias("wanted"))


@query(f"""with {EV}, g as (select ep, step, step - lag(step) over (partition by ep order by step) as gap from ev where sg = 'click'),
m as (select ep, count(*) as n, list_sort(list(gap) filter (gap is not null)) as gs, max(step) as last from g group by ep)
select ep, n, gs[len(gs) // 2 + 1] as period, last + gs[len(gs) // 2 + 1] as due from m where n >= 2""")
def arrival_period(spark, d):
    w = Window.partitionBy("ep").orderBy("step")
    g = episodes(spark, d).filter("sg = 'click'").withColumn("gap", F.col("step") - F.lag("step").over(w))
    m = g.groupBy("ep").agg(F.count("*").alias("n"), F.collect_list("gap").alias("gs"), F.max("step").alias("last")).filter("n >= 2")
    return m.withColumn("period", folds.upper_median(F.col("gs"))).select("ep", "n", "period", (F.col("last") + F.col("period")).alias("due"))


@query(f"""with {EV}, g as (select ep, step as t from ev where value < 60), w as (select ep, step // 10 * 10 as t0, step // 10 * 10 + 10 as t1 from ev group by ep, step // 10),
a as (select w.*, unnest([t0, t0 + 5, t1]) as anc from w),
c as (select a.*, g.t, row_number() over (partition by a.ep, t0, anc order by abs(g.t - anc), g.t desc) as n from a join g on g.ep = a.ep and g.t <= t1 + 4)
select w.ep, w.t0, w.t1, coalesce(array_to_string(list_sort(list(distinct c.t) filter (c.t is not null)), ','), '') as frames from w left join c on c.ep = w.ep and c.t0 = w.t0 and c.n = 1 group by w.ep, w.t0, w.t1""")
def window_frames(spark, d):
    e = episodes(spark, d)
    windows = e.select("ep", (F.floor(F.col("step") / 10) * 10).alias("t0")).distinct().withColumn("t1", F.col("t0") + 10)
    found = ordered.window_frames(windows, e.filter("value < 60").select("ep", F.col("step").alias("t")), "ep", "t0", "t1", "t")
    return found.select("ep", "t0", "t1", F.array_join("frames", ",").alias("frames"))


@query(_METRICS + """, f as (select ep, arg_min(o, step) as family from tk group by ep),
l as (select family, list_sort(list(lag0) filter (om and lag0 is not null)) as ls from x join f using (ep) group by family)
select x.family, count(*) as ticks, count(*) filter (o = p) as content, count(*) filter (om) as transitions,
  count(*) filter (om and lag0 is not null) as adopted, max(lag0) filter (om) as max_lag, count(*) filter (pm) as predicted,
  count(*) filter (pm and fresh) as premature, any_value(ls[len(ls) // 2 + 1]) as median_lag
from (select * from x join f using (ep)) as x join l on x.family = l.family group by x.family""")
def family_ticks(spark, d):
    """Ticks pooled by the family of their episode: what it was first told."""
    t = ticks(spark, d)
    family = t.groupBy("ep").agg(F.min_by("o", "step").alias("family"))
    return quality.tick_report(quality.tick_metrics(t, "ep", "step", "o", "p").join(family, "ep"), ["family"])
