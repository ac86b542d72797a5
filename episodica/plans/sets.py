"""Queries of filters, splits, joins, spatial operators and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.functions import geometry
from episodica.functions import text as T
from episodica.operators import corpus, cover, grouped, quality, spatial
from episodica.sources import readers

from .base import EV, PT, TURNS, episodes, points, table, turns

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select o_orderkey, case when o_orderkey % 10 = 0 then 'val' else 'train' end as split, case when o_custkey between 32 and 39 then 'val' else 'train' end as by_range from orders")
def split_mod(spark, d):
    return table(spark, d, "orders").select("o_orderkey", corpus.split_by_modulo(F.col("o_orderkey")).alias("split"), corpus.split_by_range(F.col("o_custkey"), 32, 39).alias("by_range"))


@query("select o_custkey, o_orderkey, case when row_number() over (partition by o_custkey order by o_orderkey desc) <= 3 then 'val' else 'train' end as split from orders")
def split_topn(spark, d):
    return corpus.split_by_top(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 3)


@query(f"""with {EV}, p as (select ep, step, sg from ev where sg = 'purchase'), n as (select ep, step, sg, row_number() over (order by md5('0:' || ep || ':' || step), ep, step) as k from ev where sg <> 'purchase')
select ep, step, sg from p union all select ep, step, sg from n where k <= 3 * (select count(*) from p)""")
def neg_downsample(spark, d):
    return corpus.sample_negatives(episodes(spark, d).select("ep", "step", "sg"), F.col("sg") == "purchase", 3, ["ep", "step"])


_LINE = """case event_id % 7 when 0 then 'the red cube moved to <' || (event_id % 200) || ', ' || (event_id % 150) || '>'
 when 1 then '[event] completed: put down the cube at <' || (event_id % 90) || ', 5>  [sam] ok' when 2 then 'the cube reached the target at <1, 2>'
 when 3 then 'white highlight appeared at <7, ' || (event_id % 33) || '>' when 4 then 'Scene: red_cube<1, 2>, arm<3, 4>' when 5 then 'a cube appeared at <9, 9>' else 'a' || chr(10) || 'b NONE' end"""


def _lines(spark, d):
    n = F.col("event_id")
    say = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    m = lambda k: (n % k).cast("string")
    line = (
        F.when(n % 7 == 0, say("the red cube moved to <", m(200), ", ", m(150), ">"))
        .when(n % 7 == 1, say("[event] completed: put down the cube at <", m(90), ", 5>  [sam] ok"))
        .when(n % 7 == 2, "the cube reached the target at <1, 2>")
        .when(n % 7 == 3, say("white highlight appeared at <7, ", m(33), ">"))
        .when(n % 7 == 4, "Scene: red_cube<1, 2>, arm<3, 4>")
        .when(n % 7 == 5, "a cube appeared at <9, 9>")
        .otherwise("a\nb NONE")
    )
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("ep"), line.alias("line"))


_LN = f"ln as (select event_id, user_id as ep, {_LINE} as line from events)"


@query(f"""with {_LN}, r as (select *, case when line like '%moved to%' then 8 when line like '%completed: put down%' then 4 when contains(line, chr(10)) then 3 when line like '%reached the target%' then 3 else 1 end as n from ln)
select event_id, unnest(range(1, n + 1))::int as copy from r""")
def oversample_case(spark, d):
    return corpus.repeat(_lines(spark, d), T.repeats(F.col("line"))).select("event_id", "copy")


@query(f"""with {_LN} select event_id, case when lower(line) like '%scene:%' then 'SCENE' when lower(line) like '%highlight appeared%' then 'HIGHLIGHT' when lower(line) like '%appeared at%' then 'APPEAR' when lower(line) like '%placed over%' then 'COVER'
 when lower(line) like '%moved to%' then 'MOVE' when lower(line) like '%reached the target%' then 'REACH' when lower(line) like '%completed:%' then 'DONE' else 'OTHER' end as kind from ln""")
def line_kind(spark, d):
    return _lines(spark, d).select("event_id", T.line_kind(F.col("line")).alias("kind"))


@query(f"""with {_LN}, c as (select event_id, list_transform(regexp_extract_all(line, '<\\s*(-?\\d+)\\s*,\\s*(-?\\d+)\\s*>', 1), lambda x: x::int) as r, list_transform(regexp_extract_all(line, '<\\s*(-?\\d+)\\s*,\\s*(-?\\d+)\\s*>', 2), lambda x: x::int) as c from ln)
select event_id, len(r)::bigint as n, r[1] as r, c[1] as c from c""")
def coord_extract(spark, d):
    at = T.coords(F.col("line"))
    return _lines(spark, d).select("event_id", F.size(at).cast("bigint").alias("n"), F.get(at, 0)["r"].alias("r"), F.get(at, 0)["c"].alias("c"))


@query(f"""with {_LN} select event_id, lower(trim(regexp_replace(split_part(replace(regexp_replace(line, '<\\s*-?\\d+\\s*,\\s*-?\\d+\\s*>', '<>', 'g'), '[event]', ''), '  [sam]', 1), '\\s+', ' ', 'g'))) as blank,
 trim(regexp_replace(line, '\\s*at\\s*<\\s*-?\\d+\\s*,\\s*-?\\d+\\s*>', '', 'g')) as bare from ln""")
def norm_text(spark, d):
    return _lines(spark, d).select("event_id", T.blank_coords(F.col("line")).alias("blank"), T.without_at(F.col("line")).alias("bare"))


@query(f"""with {_LN}, t as (select event_id, regexp_extract_all(line, '(\\w+)<\\s*(\\d+)\\s*,\\s*(\\d+)\\s*>', 1) as n, regexp_extract_all(line, '(\\w+)<\\s*(\\d+)\\s*,\\s*(\\d+)\\s*>', 2) as r, regexp_extract_all(line, '(\\w+)<\\s*(\\d+)\\s*,\\s*(\\d+)\\s*>', 3) as c from ln)
select event_id, case when len(n) = 0 then '(none)' else array_to_string(list_transform(range(1, len(n) + 1), lambda i: n[i] || '<' || r[i]::int || ', ' || c[i]::int || '>'), ', ') end as shown from t""")
def detection_tokens(spark, d):
    return _lines(spark, d).select("event_id", T.shown(T.detections(F.col("line"))).alias("shown"))


@query(f"""with {_LN} select event_id, list_filter(list_transform(string_split(line, chr(10)), lambda x: trim(x)), lambda x: x <> '' and upper(x) <> 'NONE') as parts from ln""")
def split_lines(spark, d):
    return _lines(spark, d).select("event_id", T.lines(F.col("line")).alias("parts"))


@query(f"""with {_LN}, k as (select ep, event_id, line, row_number() over (partition by ep, event_id // 50, lower(regexp_replace(line, '<[^>]*>', '<>', 'g')) order by event_id) as n from ln where event_id % 3 <> 0),
g as (select ep, event_id // 50 as tick, string_agg(line, chr(10) order by event_id) as target from k where n = 1 group by ep, event_id // 50),
t as (select distinct ep, event_id // 50 as tick from ln)
select t.ep, t.tick, coalesce(g.target, 'NONE') as target from t left join g on t.ep = g.ep and t.tick = g.tick""")
def corpus_targets(spark, d):
    lines = _lines(spark, d).withColumn("tick", F.floor(F.col("event_id") / 50).cast("bigint"))
    kept = corpus.kept_lines(lines, ["ep", "tick"], ["event_id"], "line", F.col("event_id") % 3 != 0)
    return corpus.targets(kept, lines.select("ep", "tick").distinct(), ["ep", "tick"], ["event_id"], "line")


_NEAR = f"with {PT}, a as (select * from pt where id % 2 = 0), b as (select * from pt where id % 2 = 1)"


@query(_NEAR + " select a.id, a.label from a where exists (select 1 from b where b.label = a.label and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 36)")
def radius_semi(spark, d):
    p = points(spark, d)
    return spatial.radius_filter(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), "label", 6).select("id", "label")


@query(_NEAR + " select a.id, a.label from a where not exists (select 1 from b where b.label = a.label and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 36)")
def radius_anti(spark, d):
    p = points(spark, d)
    return spatial.radius_filter(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), "label", 6, near=False).select("id", "label")


@query(f"""with recursive {PT}, s as (select *, row_number() over (partition by label order by score desc, id) as k from pt), h as (
  select label, 1::bigint as k, [{{'r': r, 'c': c}}] as kept, [id] as ids from s where k = 1
  union all
  select h.label, s.k, case when bad then kept else list_append(kept, {{'r': s.r, 'c': s.c}}) end, case when bad then ids else list_append(ids, s.id) end
  from h join s on s.label = h.label and s.k = h.k + 1,
    lateral (select len(list_filter(h.kept, lambda x: (x.r - s.r) * (x.r - s.r) + (x.c - s.c) * (x.c - s.c) <= 100)) > 0 as bad))
select label, unnest(arg_max(ids, k)) as id from h group by label""")
def nms_greedy(spark, d):
    return spatial.suppress(points(spark, d), "label", [-F.col("score"), F.col("id")], 10, ["id", "r", "c"]).select("label", "id")


@query(f"""with {PT}, q as (select * from pt where id % 5 <> 1), b as (select * from pt where id % 5 = 1),
n as (select q.id, q.r, q.c, b.r as br, b.c as bc, (q.r - b.r) * (q.r - b.r) + (q.c - b.c) * (q.c - b.c) as d2, row_number() over (partition by q.id order by (q.r - b.r) * (q.r - b.r) + (q.c - b.c) * (q.c - b.c), b.id) as k from q left join b on b.label = q.label)
select id, case when d2 <= 225 then br else r end as r, case when d2 <= 225 then bc else c end as c from n where k = 1""")
def nearest_snap(spark, d):
    """As nearest_snap, with every row: those that are no anchor are snapped."""
    p = points(spark, d)
    return spatial.snap_points(p.filter("id % 5 <> 1"), p.filter("id % 5 = 1"), "label", 15).select("id", "r", "c")


@query("""select l_returnflag, l_linestatus, count(l_quantity) as n, quantile_cont(l_extendedprice, 0.5) as median, quantile_cont(l_extendedprice, 0.1) as p10, quantile_cont(l_extendedprice, 0.9) as p90,
quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) as iqr from lineitem group by 1, 2""")
def percentile_report(spark, d):
    return quality.percentiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("""select d.lang, d.source, count(*) as n, avg(l.quality::double) as rate, (grouping(d.lang) * 2 + grouping(d.source))::bigint as level from documents d join labels l using (doc_id)
where l.quality is not null group by rollup (d.lang, d.source)""")
def rate_rollup(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    return quality.rates(joined, F.col("quality").cast("boolean"), ["lang", "source"])


@query("""with m as (select l_returnflag, l_linenumber, round(avg(l_quantity)::decimal(38,10), 1)::double as m from lineitem group by 1, 2)
select l_returnflag, round(avg(m)::decimal(38,10), 1)::double as mean, count(*) as groups from m group by 1""")
def two_level_mean(spark, d):
    return quality.two_level_mean(table(spark, d, "lineitem"), "l_returnflag", ["l_linenumber"], "l_quantity")


@query("""with o as (select doc_id, quality = 1 as ok from labels where doc_id % 3 <> 0), v as (select doc_id, toxic = 0 as ok from labels where doc_id % 3 <> 1), f as (select doc_id, quality = 0 as ok from labels),
a as (select coalesce(v.doc_id, o.doc_id) as doc_id, coalesce(v.ok, o.ok) as ok from o full join v on o.doc_id = v.doc_id)
select count(*) filter (a.ok and not f.ok) as win, count(*) filter (not a.ok and f.ok) as lose, count(*) filter (a.ok and f.ok) as both, count(*) filter (not a.ok and not f.ok) as neither from a join f using (doc_id)""")
def paired_arms(spark, d):
    x = table(spark, d, "labels")
    on = x.filter("doc_id % 3 <> 0").select("doc_id", (F.col("quality") == 1).alias("ok"))
    over = x.filter("doc_id % 3 <> 1").select("doc_id", (F.col("toxic") == 0).alias("ok"))
    return quality.paired(on, over, x.select("doc_id", (F.col("quality") == 0).alias("ok")), ["doc_id"], "ok")


@query("""with s as (select s_nationkey, count(*) as n, max(s_acctbal) as top from supplier group by 1), b as (select max(n) as bn, max(top) as bt from s where s_nationkey <> 0)
select s.*, s_nationkey <> 0 and n = bn as n_is_best, s_nationkey <> 0 and top = bt as top_is_best from s, b""")
def best_per_column(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_acctbal").alias("top"))
    return quality.best_per_column(s, F.col("s_nationkey") != 0, ["n", "top"])


@query(f"with {PT} select label, id, rank::int as rank from (select *, row_number() over (partition by label order by score desc, id) as rank from pt) where rank <= 3")
def top_detections(spark, d):
    w = Window.partitionBy("label").orderBy(F.desc("score"), "id")
    return points(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("label", "id", "rank")


@query(f"""with {TURNS} select ep, count(*) as n, 'Task: ' || ep || chr(10) || 'Memory:' || chr(10) || string_agg(role, chr(10) order by turn, text) || chr(10) || 'Expected next: NONE' as prompt from tu group by ep""")
def prompt_build(spark, d):
    g = turns(spark, d).groupBy("ep").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("b"))
    bank = F.transform("b", lambda x: x["role"])
    return g.select("ep", "n", T.prompt(F.col("ep").cast("string"), bank, F.lit(None).cast("string")).alias("prompt"))


@query("""with v as (select vec_id, floor(embedding[4]::double * 100) as dr, floor(embedding[5]::double * 100) as dc from embeddings),
w as (select *, case when dr > 8 then 'down' when dr < -8 then 'up' end as a, case when dc > 8 then 'right' when dc < -8 then 'left' end as b from v)
select vec_id, case when a is null and b is null then 'still' else concat_ws('-', a, b) end as words from w""")
def direction_words(spark, d):
    at = lambda i: F.floor(F.col("embedding")[i].cast("double") * 100)
    return table(spark, d, "embeddings").select("vec_id", geometry.direction(at(3), at(4), 8).alias("words"))


_M = [[300.0, 10.0, -5.0, 128.0], [4.0, 280.0, 6.0, 120.0], [0.0, 0.1, 0.2, 1.0]]


@query("""with v as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings), p as (select vec_id, 0.0 * x + 0.1 * y + 0.2 * z + 1.0 as w, 300.0 * x + 10.0 * y + -5.0 * z + 128.0 as u, 4.0 * x + 280.0 * y + 6.0 * z + 120.0 as v from v)
select vec_id, greatest(least(round_even(v / w, 0)::int, 255), 0) as r, greatest(least(round_even(u / w, 0)::int, 255), 0) as c from p""")
def projection(spark, d):
    x, y, z = (F.col("embedding")[i].cast("double") for i in range(3))
    return table(spark, d, "embeddings").select("vec_id", geometry.project(x, y, z, _M, 256, 256).alias("p")).select("vec_id", "p.*")


@query("""with v as (select vec_id, embedding[1]::double * 3 as x, embedding[2]::double * 3 as y, embedding[3]::double * 3 as z from embeddings), t as (select *, sqrt(x * x + y * y + z * z) as a from v)
select vec_id, round(degrees(acos(greatest(-1, least(1, -(cos(a) + (1 - cos(a)) * (z / a) * (z / a)))))), 6) as tilt from t""")
def tilt(spark, d):
    x, y, z = (F.col("embedding")[i].cast("double") * 3 for i in range(3))
    return table(spark, d, "embeddings").select("vec_id", F.round(geometry.tilt_degrees(x, y, z), 6).alias("tilt"))


@query("select event_id, (props->>'$.k')::int as k from events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""with a as (select n_nationkey as k, n_name as name, 0 as p from nation where n_nationkey % 2 = 0 union all select r_regionkey, r_name, 1 from region)
select k, name from a qualify p = min(p) over (partition by k)""")
def first_wins_union(spark, d):
    n = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return readers.first_source([n, r], ["k"])


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 10 = 0)")
def anti_missing(spark, d):
    have = table(spark, d, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return readers.missing(table(spark, d, "customer").select("c_custkey"), have, ["c_custkey"])


@query("""with n as (select n_nationkey, row_number() over (order by n_nationkey) - 1 as k, count(*) over () as n from nation) select n_nationkey from n where k % greatest(1, n // 6) = 0 and k // greatest(1, n // 6) < 6""")
def stride_sample(spark, d):
    return readers.stride_sample(table(spark, d, "nation").select("n_nationkey"), ["n_nationkey"], 6)


@query("""with b as (select o.o_orderkey, o.o_custkey, c.c_acctbal as own, n.n_nationkey as band from orders o left join customer c on c.c_custkey = o.o_custkey and c.c_acctbal > 0 left join customer d on d.c_custkey = o.o_custkey left join nation n on n.n_nationkey = d.c_nationkey and n.n_nationkey % 2 = 0)
select o_orderkey, coalesce(own, band, -1.0) as prior from b""")
def fallback_chain(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    own = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("own"))
    band = c.join(n.filter("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_nationkey").cast("double").alias("band"))
    o = table(spark, d, "orders").join(own, "o_custkey", "left").join(band, "o_custkey", "left")
    return o.select("o_orderkey", F.coalesce("own", "band", F.lit(-1.0)).alias("prior"))


@query(f"""with {EV}, x as (select ep, sg, value <= 60 as seen, value <= 60 or step % 3 = 0 as known from ev)
select ep, sg, count(*) as n, count(*) filter (seen) as seen, count(*) filter (known) as known, (grouping(ep) * 2 + grouping(sg))::bigint as level from x group by grouping sets ((ep, sg), (sg), ())""")
def derivability(spark, d):
    e = episodes(spark, d).select("ep", "sg", (F.col("value") <= 60).alias("seen"), ((F.col("value") <= 60) | (F.col("step") % 3 == 0)).alias("known"))
    sets = [[F.col("ep"), F.col("sg")], [F.col("sg")], []]
    return e.groupingSets(sets, "ep", "sg").agg(F.count("*").alias("n"), F.count_if("seen").alias("seen"), F.count_if("known").alias("known"), F.grouping_id().cast("bigint").alias("level"))


@query(f"""with recursive {TURNS}, tr as (select ep, turn * 16 as t, lower(role) as form, row_number() over (partition by ep order by turn) as i from tu where turn % 2 = 0),
sd as (select ep, list(struct_pack(t := turn * 16, form := lower(role)) order by turn) as l from tu group by ep),
m as (select ep, 0::bigint as i, []::bigint[] as used, null::bigint as t_truth, null::bigint as t_said from sd
  union all select ep, i, case when hit is null then used else list_append(used, hit) end, t, l[hit].t
  from (select tr.ep, tr.i, m.used, tr.t, l, list_position(list_transform(l, lambda x, k: x.form = tr.form and not list_contains(m.used, k)), true) as hit from m join tr on tr.ep = m.ep and tr.i = m.i + 1 join sd on sd.ep = m.ep))
select ep, t_truth, t_said, floor((t_said - t_truth) / 16.0)::bigint as lag from m where i > 0""")
def greedy_match(spark, d):
    t = turns(spark, d).select("ep", (F.col("turn") * 16).alias("t"), F.col("turn").alias("ord"), F.col("role").alias("line"))
    return grouped.pair_lines(t.filter("ord % 2 = 0"), t, "ep").drop("errors", "met")


@query(f"""with recursive {PT}, pr as (select x.label, x.id::varchar as a, y.id as b, (x.r - y.r) ** 2 + (x.c - y.c) ** 2 as q from pt x join pt y on y.label = x.label where x.id % 2 = 0 and y.id % 2 = 1 and (x.r - y.r) ** 2 + (x.c - y.c) ** 2 <= 400),
nb as (select *, row_number() over (partition by label order by q, a, b) as i from pr),
m as (select label, 0::bigint as i, []::varchar[] as ua, []::bigint[] as ub, null::varchar as a, null::bigint as b, null::double as q, false as ok from (select distinct label from nb)
  union all select label, i, case when ok then list_append(ua, a) else ua end, case when ok then list_append(ub, b) else ub end, a, b, q, ok
  from (select nb.label, nb.i, m.ua, m.ub, nb.a, nb.b, nb.q, not list_contains(m.ua, nb.a) and not list_contains(m.ub, nb.b) as ok from m join nb on nb.label = m.label and nb.i = m.i + 1))
select label, a, b, sqrt(q) as d from m where ok""")
def assign_points(spark, d):
    p = points(spark, d)
    left = p.filter("id % 2 = 0").select("label", F.col("id").cast("string").alias("name"), "r", "c")
    right = p.filter("id % 2 = 1").select("label", F.col("id").alias("ord"), "r", "c")
    return cover.assign(left, right, ["label"], 20)


@query(f"""with {EV}, a as (select ep, min(step) as t from ev where value > 80 group by ep), b as (select ev.ep, min(step) as t from ev join a on a.ep = ev.ep and step > t where value < 20 group by ev.ep),
c as (select ev.ep, min(step) as t from ev join b on b.ep = ev.ep and step > t where value > 60 group by ev.ep)
select ep, 0::bigint as phase, t from a union all select ep, 1, t from b union all select ep, 2, t from c""")
def chained_events(spark, d):
    return grouped.chained_events(episodes(spark, d), "ep", "step", "value", [("above", 80.0), ("below", 20.0), ("above", 60.0)])


@query(f"""with recursive {EV},
t as (select ep, step as tick, step * 10 as step, case when value > 40 then step * 10 - 5 end as fired, value > 90 as refuted,
    case sg when 'click' then 'completed: view' when 'view' then '[event] completed: click' else sg end as text, case sg when 'click' then 'view' when 'view' then 'click' end as claim from ev),
pl as (select ['view', 'click', 'view'] as plan),
r as (
  select ep, -1::bigint as tick, 0::bigint as j, 0::bigint as since, 0::bigint as rc, []::varchar[] as pending, ''::varchar as last_line, 0::bigint as size, []::varchar[] as said, []::varchar[] as texts from (select distinct ep from t)
  union all
  select ep, tick, j2 + (verdict = 'admit' and claim is not null)::int, case when verdict = 'admit' and claim is not null then step else since2 end, case when verdict = 'admit' and claim is not null then 0 else rc3 end,
    case when verdict in ('defer', 'refute-defer') then list_append(pending2, text) else pending2 end, case when verdict = 'admit' then text else last2 end, size2 + (verdict = 'admit')::int,
    list_filter([case when phantom then 'phantom' end, case when hit is not null then 'admit-pending' end, verdict], lambda x: x is not null),
    list_filter([case when phantom then wanted end, case when hit is not null then pending[hit] end, text], lambda x: x is not null)
  from (
    select *, case when claim is null then case when size2 > 0 and lower(trim(last2)) = lower(trim(text)) then 'reject-dup' else 'admit' end
        when claim is distinct from plan[j2 + 1] then 'reject' when hit is not null or not usable then 'defer' when refuted then 'refute-defer' else 'admit' end as verdict
    from (
      select *, j + (hit is not null)::int as j2, case when hit is not null then step else since1 end as since2, case when hit is not null then 0 else rc2 end as rc3, size + (hit is not null)::int as size2,
        case when hit is not null then pending[hit] else last_line end as last2, case when hit is not null then list_concat(pending[:hit - 1], pending[hit + 1:]) else pending end as pending2
      from (
        select *, case when usable and not refuted then list_position(list_transform(pending, lambda p: case when p = 'completed: view' then 'view' else 'click' end), wanted) end as hit
        from (
          select *, could and not phantom as usable, case when phantom then fired + 1 else since end as since1, case when phantom then 0 else rc1 end as rc2
          from (
            select *, could and rc1 >= 3 as phantom
            from (
              select *, case when could then case when refuted then rc + 1 else 0 end else rc end as rc1
              from (select r.ep, t.tick, t.step, t.fired, t.refuted, t.text, t.claim, r.j, r.since, r.rc, r.pending, r.last_line, r.size, pl.plan, pl.plan[r.j + 1] as wanted, coalesce(t.fired >= r.since and pl.plan[r.j + 1] is not null, false) as could
                from r join t on t.ep = r.ep and t.tick = r.tick + 1, pl)))))))),
u as (select ep, tick, j, size, unnest(said) as verdict, unnest(texts) as text from r)
select ep::varchar as ep, tick::int as tick, verdict, text, j::int as j, size::int as bank_size from u""")
def claim_machine(spark, d):
    from episodica.streaming import claims

    e = episodes(spark, d)
    step = F.col("step") * 10
    line = F.when(F.col("sg") == "click", "completed: view").when(F.col("sg") == "view", "[event] completed: click").otherwise(F.col("sg"))
    fired = F.when(F.col("value") > 40, step - 5).cast("int")
    t = e.select(F.col("ep").cast("string").alias("ep"), F.array(F.lit("view"), F.lit("click"), F.lit("view")).alias("plan"), F.col("step").cast("int").alias("tick"), step.cast("int").alias("step"), F.lit(0).alias("ord"), fired.alias("fired"), (F.col("value") > 90).alias("refuted"), line.alias("text"))
    return claims.batch(t)


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def smoke_pricing(spark, d):
    x = table(spark, d, "lineitem").filter("l_shipdate <= timestamp'1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))




@query(f"""with {EV}, m as (select *, case when lag(sg) over w is distinct from sg or step = 0 then 1 else 0 end as ch from ev window w as (partition by ep order by step)),
r as (select *, (sum(ch) over (partition by ep order by step) - 1)::bigint as run from m) select ep, step, case when run % 3 <> 2 then run end as run from r""")
def segment_lookup(spark, d):
    from episodica.operators import joins, ordered

    e = episodes(spark, d)
    s = ordered.run_segments(e, ["ep"], ["step"], "sg", "step").filter("run % 3 <> 2")
    s = s.select("ep", F.col("start"), (F.col("end") + 1).alias("stop"), "run")
    return joins.segment_of(e.select("ep", "step"), s, "ep", "step", "start", "stop", ["run"])


@query("""with o as (select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2), w as (select o_custkey, count(*) // 3 as wanted from orders group by 1)
select o_custkey, arg_min(o_orderstatus, (abs(n - wanted), o_orderstatus)) as o_orderstatus from o join w using (o_custkey) group by o_custkey""")
def best_occurrence(spark, d):
    from episodica.operators import joins

    o = table(spark, d, "orders")
    have = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("length"))
    wanted = o.groupBy("o_custkey").agg(F.floor(F.count("*") / 3).alias("wanted"))
    return joins.closest_length(have, wanted, ["o_custkey"], "o_orderstatus")


@query("""with l as (select user_id as ep, event_id, ['red', 'green', 'blue'][(event_id % 3 + 1)::int] as color, event_id % 200 as r, event_id % 90 as c from events where event_id % 4 <> 3)
select ep, color, arg_max(r, event_id)::int as r, arg_max(c, event_id)::int as c from l group by ep, color""")
def folded_places(spark, d):
    from episodica.operators import joins

    n = F.col("event_id")
    color = F.get(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), (n % 3).cast("int"))
    at = F.format_string("<%d, %d>", n % 200, n % 90)
    moved = F.concat(F.lit("the "), color, F.lit(" cube container moved from <1, 2> to "), at)
    covered = F.concat(F.lit("containers were placed over the cubes: "), color, F.lit("_cube_container"), at)
    line = F.when(n % 4 == 0, covered).when(n % 4 == 3, "nothing").otherwise(moved)
    lines = table(spark, d, "events").select(F.col("user_id").alias("ep"), "event_id", line.alias("line"))
    return joins.latest_places(lines, "ep", ["event_id"], "line")


@query("""with a as (select c_custkey, c_nationkey from customer where c_custkey % 7 <> 0), b as (select c_custkey, case when c_custkey % 11 = 0 then -1 else c_nationkey end as c_nationkey from customer where c_custkey % 5 <> 0)
select coalesce(a.c_custkey, b.c_custkey) as c_custkey, a.c_nationkey as a_, b.c_nationkey as b_ from a full join b on a.c_custkey = b.c_custkey where a.c_nationkey is distinct from b.c_nationkey""")
def parity_check(spark, d):
    from episodica.operators import joins

    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    other = c.filter("c_custkey % 5 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 11 == 0, -1).otherwise(F.col("c_nationkey")))
    return joins.mismatches(c.filter("c_custkey % 7 <> 0"), other, ["c_custkey"], "c_nationkey")


@query(f"""with {EV}, f as (select *, value < 50 as hid from ev), b as (select *, sum(case when hid then 0 else 1 end) over (partition by ep order by step) as g from f),
r as (select ep, g, count(*) filter (hid) as n from b group by ep, g), t as (select ep, max(g) as g from b group by ep)
select t.ep, (select max(n) from r where r.ep = t.ep)::int as longest, (select n from r where r.ep = t.ep and r.g = t.g)::int as trailing from t""")
def absence_runs(spark, d):
    from episodica.operators import evidence, folds

    rows = folds.ordered_rows(episodes(spark, d), ["ep"], ["step"], ["value"])
    hid = F.transform("rows_", lambda x: x["value"] < 50)
    return rows.select("ep", evidence.longest_run(hid).alias("longest"), evidence.trailing_run(hid).alias("trailing"))


@query(f"""with {PT}, b as (select label, id // 10 as frame, max(score) as best from pt group by 1, 2) select label, round(avg(best), 6) as mean_best, round(avg(case when best >= 0.15 then 1.0 else 0.0 end), 6) as hit_rate, count(*) as frames from b group by label""")
def phrase_scores(spark, d):
    from episodica.operators import joins

    p = points(spark, d).withColumn("frame", F.floor(F.col("id") / 10))
    return joins.best_scores(p, ["label"], "frame", "score").withColumns({"mean_best": F.round("mean_best", 6), "hit_rate": F.round("hit_rate", 6)})


@query()
def plan_completions(spark, d):
    from episodica.operators import predicates

    v = table(spark, d, "embeddings").withColumnRenamed("label", "ep")
    v = v.select("ep", F.col("vec_id").alias("step"), F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double")).alias("s"))
    plan = v.select("ep").distinct().select("ep", F.posexplode(F.array(F.lit("pick"), F.lit("place"), F.lit("open"))).alias("ord", "kind"), F.lit("drawer").alias("what"))
    return predicates.completions(v, plan, "ep")


_PAIR = f"{_LN}, pr as (select event_id, ep, line, lag(line) over (partition by ep order by event_id) as said from ln)"


def _pairs(spark, d):
    return _lines(spark, d).withColumn("said", F.lag("line").over(Window.partitionBy("ep").orderBy("event_id"))).filter("said is not null")


@query(f"""with {_PAIR}, x as (select ep, rtrim(lower(trim(line)), '.') as a, rtrim(lower(trim(said)), '.') as b from pr where said is not null),
y as (select *, regexp_replace(a, '\\s*at\\s*<[^>]*>', '', 'g') = regexp_replace(b, '\\s*at\\s*<[^>]*>', '', 'g') as form, regexp_extract(a, '<\\s*(\\d+)\\s*,\\s*(\\d+)\\s*>', ['r', 'c']) as p, regexp_extract(b, '<\\s*(\\d+)\\s*,\\s*(\\d+)\\s*>', ['r', 'c']) as q from x),
z as (select *, sqrt((try_cast(p.r as double) - try_cast(q.r as double)) ** 2 + (try_cast(p.c as double) - try_cast(q.c as double)) ** 2) as d from y)
select ep, count(*) as n, avg((a = b)::int) as exact, avg(form::int) as same_form, avg((d <= 8)::int) as within_8, avg((d <= 30)::int) as within_30, grouping(ep)::bigint as level from z group by grouping sets ((ep), ())""")
def target_rates(spark, d):
    return quality.target_rates(_pairs(spark, d), ["ep"], F.col("line"), F.col("said"))


@query(f"""with {_LN}, x as (select ep, event_id as t, lower(trim(regexp_replace(split_part(replace(regexp_replace(line, '<[^>]*>', '<>', 'g'), '[event]', ''), '  [sam]', 1), '\\s+', ' ', 'g'))) as form from ln where line like '%completed:%'),
s as (select * from x where t % 2 = 0), g as (select * from x where t % 2 = 1)
select ep, count(*) as said, count(*) filter (exists (select 1 from g where g.ep = s.ep and g.form = s.form and abs(g.t - s.t) <= 60)) as "right" from s group by ep""")
def completion_precision(spark, d):
    x = _lines(spark, d).withColumn("t", F.col("event_id"))
    return quality.completion_precision(x.filter("t % 2 = 1"), x.filter("t % 2 = 0"), "ep", 60)


@query("select ceil(avg(strlen(text)) * count(*))::bigint as text, ceil(avg(strlen(lang)) * count(*))::bigint as lang from documents")
def size_estimate(spark, d):
    return quality.size_estimate(table(spark, d, "documents"), ["text", "lang"])


@query()
def state_quality(spark, d):
    x = _lines(spark, d).select("ep", F.floor(F.col("event_id") / 16).alias("t"), F.col("event_id").alias("ord"), "line")
    return grouped.state_quality(x.filter("ord % 2 = 0"), x, "ep")


@query(f"""with {PT}, x as (select *, id // 10 as frame, r * r + c * c <= 900 as near from pt), f as (select label, frame from x group by all),
b as (select label, frame, max(case when near then score end) as best, count(*) filter (not near and score >= 0.1) as bad from x group by label, frame)
select label, round(avg(greatest(coalesce(best, 0), 0)), 6) as mean_best, round(avg((greatest(coalesce(best, 0), 0) >= 0.1)::int), 6) as hit_rate, round(sum(bad) / count(*), 6) as false_per_frame, count(*) as frames from f join b using (label, frame) group by label""")
def phrase_hits(spark, d):
    from episodica.operators import joins

    p = points(spark, d).withColumn("frame", F.floor(F.col("id") / 10))
    found = joins.phrase_report(p, p, ["label"], "frame", "score", F.col("r") * F.col("r") + F.col("c") * F.col("c") <= 900, 0.1)
    return found.withColumns({c: F.round(c, 6) for c in ("mean_best", "hit_rate", "false_per_frame")})
