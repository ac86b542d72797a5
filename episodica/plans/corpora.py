"""The training corpus as one query: an event is a step, four steps a tick, and their texts carry the event's value and number."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.operators import corpus, ordered, records

from .serving import _XS, _ticks

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: What an event's line says; errors say nothing.
_SAYS = {"view": "the cube moved to", "click": "completed: put it down at", "signup": "the cube reached the target at", "purchase": "a cube appeared at"}


def _steps(spark, d):
    x = _ticks(spark, d).withColumnRenamed("tick", "step").withColumn("tick", F.floor(F.col("step") / 4))
    at = F.concat(F.lit(" <"), F.floor("value").cast("string"), F.lit(", "), F.col("k").cast("bigint").cast("string"), F.lit(">"))
    says = F.create_map(*[F.lit(v) for pair in _SAYS.items() for v in pair])
    own = F.when(F.col("sg") != "error", F.concat(F.col("sg"), F.lit(" at"), at))
    x = x.withColumns({"line": F.concat(F.lit("[event] "), F.try_element_at(says, F.col("sg")), at), "own": own})
    return ordered.look_ahead(x, ["ep"], ["step"], F.col("own"), F.col("own").isNotNull(), 16, "following")


_STEPS = _XS + """, st as (
  select *, step // 4 as tick, floor(value)::bigint as v, k::bigint as c, '[event] ' || case sg """ + " ".join(f"when '{k}' then '{v} '" for k, v in _SAYS.items()) + """ end || '<' || floor(value)::bigint || ', ' || k::bigint || '>' as line,
    case when sg <> 'error' then sg || ' at <' || floor(value)::bigint || ', ' || k::bigint || '>' end as own from xs),
so as (select *, (select arg_min(n.own, n.step) from st n where n.ep = st.ep and n.step > st.step and n.step <= st.step + 16 and n.own is not null) as following from st),
sa as (select *, case when tick < 2 then 'watch the demonstration; remain static' else coalesce(own, following, 'all tasks completed; remain static') end as says from so),
tk as (select ep, tick, greatest(tick * 4 - 1, 0) as since, max(step) as last_step, case when tick < 2 then 'demo' else 'execution' end as phase from st group by ep, tick),
kl as (select * from (select ep, tick, step, line, row_number() over (partition by ep, tick, regexp_replace(line, '<[^>]*>', '', 'g') order by step) as nth from st where line is not null and value >= 10) where nth = 1),
nl as (select *, row_number() over (partition by ep order by step) as n from kl)"""


@query(f"""with {_STEPS},
t as (select tk.*, (select string_agg(line, chr(10) order by step) from kl where kl.ep = tk.ep and kl.tick = tk.tick) as told, (select coalesce(max(n), 0) from nl where nl.ep = tk.ep and nl.tick < tk.tick) as many,
    (select says from sa where sa.ep = tk.ep and sa.step = least(since, last_step)) as expected,
    (select string_agg('+' || (step - since) || ': ' || sg || '<' || v || ', ' || c || '>', chr(10) order by step) from st where st.ep = tk.ep and st.tick = tk.tick) as seen from tk)
select ep, tick, case when ep % 10 = 0 then 'val' else 'train' end as split, phase, coalesce(told, 'NONE') as target, seen, expected,
  coalesce((select string_agg(line, chr(10) order by n) from nl where nl.ep = t.ep and nl.n > many - 8 and nl.n <= many), '') as bank,
  case when ep % 10 = 0 or told is null then 1 when told like '%moved to%' then 8 when told like '%completed: put it down%' then 4 when told like '%' || chr(10) || '%' then 3 when told like '%reached the target%' then 3 else 1 end::bigint as copies
from t""")
def writer_records(spark, d):
    x = _steps(spark, d)
    said = corpus.reasoner_target(F.when(F.col("tick") < 2, "demo").otherwise("execution"), F.col("own"), F.lit(None), F.col("following"), F.lit(None))
    before = F.lag("said").over(Window.partitionBy("ep").orderBy("step"))
    by_step = x.withColumn("said", said)
    ticks = by_step.withColumn("before", F.coalesce(before, F.col("said"))).groupBy("ep", "tick").agg(F.min_by("before", "step").alias("expected"))
    ticks = ticks.select("ep", "tick", F.greatest(F.col("tick") * 4 - 1, F.lit(0)).alias("since"), F.when(F.col("tick") < 2, "demo").otherwise("execution").alias("phase"), "expected")
    lines = x.filter("line is not null").select("ep", "tick", "step", "line", "value")
    dets = x.select("ep", "tick", F.col("step").alias("frame"), F.array(F.struct(F.col("sg").alias("name"), F.floor("value").cast("int").alias("r"), F.col("k").cast("int").alias("c"))).alias("dets"))
    found = records.writer(ticks, lines, dets, "ep", "tick", ["step"], "line", F.col("value") >= 10, corpus.split_by_modulo(F.col("ep")))
    return found.select("ep", "tick", "split", "phase", "target", "seen", "expected", F.array_join("bank", "\n").alias("bank"), "copies")


@query(f"""with {_STEPS},
t as (select tk.*, sa.says, (select coalesce(max(n), 0) from nl where nl.ep = tk.ep and nl.tick <= tk.tick) as many from tk join sa on sa.ep = tk.ep and sa.step = tk.last_step),
b as (select t.*, (select list(line order by n) from nl where nl.ep = t.ep and nl.n <= many) as bank,
    regexp_extract(says, '<(-?\\d+), (-?\\d+)>', ['r', 'c']) as p,
    (select list({{'r': v, 'c': c}}) from nl join st using (ep, step) where nl.ep = t.ep and nl.n <= many) as places from t)
select ep, tick, case when ep % 10 = 0 then 'val' else 'train' end as split, phase, coalesce(array_to_string(bank, chr(10)), '') as bank,
  case when p.r = '' or len(list_filter(coalesce(places, []), lambda q: (q.r - p.r::bigint) ** 2 + (q.c - p.c::bigint) ** 2 <= 900)) > 0 then says else trim(regexp_replace(says, '\\s*at\\s*<[^>]*>', '')) end as target
from b""")
def reasoner_records(spark, d):
    x = _steps(spark, d)
    last = x.groupBy("ep", "tick").agg(F.max_by(F.struct("own", "following"), "step").alias("x"))
    none = F.lit(None).cast("string")
    ticks = last.select("ep", "tick", F.when(F.col("tick") < 2, "demo").otherwise("execution").alias("phase"), "x.own", "x.following", none.alias("waiting"), none.alias("held"))
    lines = x.filter("line is not null").select("ep", "tick", "step", "line", "value")
    found = records.reasoner(ticks, lines, "ep", "tick", ["step"], "line", F.col("value") >= 10, corpus.split_by_modulo(F.col("ep")))
    return found.select("ep", "tick", "split", "phase", F.array_join("bank", "\n").alias("bank"), "target")


#: What an event is seen as, and the line of each rule of corpus.evident, chosen by the number in its props.
_SEEN = {"view": "red_cube", "click": "container", "signup": "highlight", "purchase": "arc_tip", "error": "arm"}


def _evident_sql() -> str:
    seen = " ".join(f"when '{k}' then '{v}'" for k, v in _SEEN.items())
    near = lambda dets, p, radius, part="": f"len(list_filter({dets}, lambda d: contains(d.n, '{part}') and (d.r - {p}.r) ** 2 + (d.c - {p}.c) ** 2 <= {radius} ** 2)) > 0"
    stray = "len(list_filter(list_filter(win, lambda d: contains(d.n, part)), lambda d: len(list_filter(prior, lambda q: (q.r - d.r) ** 2 + (q.c - d.c) ** 2 < 36)) = 0)) > 0"
    return f"""with {_XS},
d as (select ep, step, k::bigint % 7 as rule, {{'n': case sg {seen} end, 'r': floor(value)::bigint, 'c': k::bigint}} as cur from xs),
w as (select *, lag(cur) over o as p1, lag(cur, 2) over o as p2, lead(cur) over o as nx, step > 0 as some from d window o as (partition by ep order by step)),
x as (select *, list_filter([cur, nx], lambda q: q is not null) as win, list_filter([p1, p2], lambda q: q is not null) as before, case when rule = 3 and cur.n = 'container' then 'container' else 'cube' end as part from w),
y as (select *, list_filter(before, lambda q: contains(q.n, part)) as prior from x)
select ep, step, case rule
    when 0 then {near("win", "cur", 14)} and not ({near("before", "cur", 14)})
    when 1 then {near("win", "cur", 22, "highlight")}
    when 2 then nx is not null and {near("win", "nx", 12, "arc_tip")}
    when 3 then len(prior) = 0 or {stray}
    when 4 then nx is not null and contains(cur.n, 'cube') and not ({near("[nx]", "cur", 16, "cube")}) and {near("[nx]", "cur", 16, "container")}
    when 5 then {near("[cur]", "cur", 16)} and (nx is null or {near("[nx]", "cur", 16)})
    else {near("win", "cur", 22, "cube")} end as evident
from y"""


@query(_evident_sql())
def evident_lines(spark, d):
    """All rules of evidence: an event's line against what it, the next one and the two before were seen as."""
    names = F.create_map(*[F.lit(v) for pair in _SEEN.items() for v in pair])
    x, by = _ticks(spark, d), Window.partitionBy("ep").orderBy("tick")
    seen = F.struct(F.try_element_at(names, F.col("sg")).alias("name"), F.floor("value").cast("int").alias("r"), F.col("k").cast("int").alias("c"))
    x = x.withColumn("cur", seen)
    x = x.withColumns({"p1": F.lag("cur").over(by), "p2": F.lag("cur", 2).over(by), "nx": F.lead("cur").over(by), "rule": F.col("k").cast("bigint") % 7})
    held = lambda *cs: F.filter(F.array(*[F.col(c) for c in cs]), lambda q: q.isNotNull())
    at = lambda c: F.concat(F.lit("<"), F.col(c)["r"].cast("string"), F.lit(", "), F.col(c)["c"].cast("string"), F.lit(">"))
    # A tip that has nowhere to go names one place only, which no rule is about; it is not borne out here.
    tip = F.when(F.col("nx").isNotNull(), F.concat(F.lit("the arc tip moved from <0, 0> to "), at("nx"))).otherwise("the highlight appeared at <-999, -999>")
    moving = F.concat(F.lit("the "), F.when(F.col("cur")["name"] == "container", "container").otherwise("cube"), F.lit(" is being moved at "), at("cur"))
    told = [F.concat(F.lit("a thing appeared at "), at("cur")), F.concat(F.lit("the highlight appeared at "), at("cur")), tip, moving, F.concat(F.lit("they were placed over the cubes at "), at("cur")), F.concat(F.lit("put down at "), at("cur")), F.concat(F.lit("it reached the target at "), at("cur"))]
    line = told[-1]
    for n, text in enumerate(told[:-1]):
        line = F.when(F.col("rule") == n, text).otherwise(line)
    window, before, first, last = held("cur", "nx"), held("p1", "p2"), held("cur"), held("nx")
    late = F.filter(F.array(first, last), lambda f: F.size(f) > 0)
    return x.select("ep", F.col("tick").alias("step"), corpus.evident(line, window, before, first, last, late).alias("evident"))
