"""Queries of gates, texts, grids, reports and other rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.functions import geometry
from episodica.functions import text as T
from episodica.operators import corpus, evidence, folds, gates, grouped, joins, ordered, quality, spatial
from episodica.sources import readers, writers

from .base import EV, PT, episodes, points, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _say(*parts):
    return F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in parts])


# Traces: an oracle's and a predicted text with a coordinate, a claim and an admitted line.

_TRACE = EV + """, tr as (
  select ep, step, event_id, value, sg || ' at <' || (event_id % 97) || ', ' || (event_id % 41) || '>' as o,
    case when event_id % 3 = 0 then coalesce(lag(sg) over w, '') || ' at <1, 2>' when event_id % 3 = 1 then sg || ' at <' || (event_id % 97 + event_id % 23) || ', ' || (event_id % 41) || '>' else sg end as p,
    case when event_id % 5 = 0 then 'claim ' || (event_id % 3) end as claim, case when event_id % 4 = 0 then 'claim ' || (event_id % 3) end as admitted
  from ev window w as (partition by ep order by step)),
fo as (select *, trim(lower(regexp_replace(o, '\\s*at\\s*<[^>]*>', ''))) as oc, trim(lower(regexp_replace(p, '\\s*at\\s*<[^>]*>', ''))) as pc from tr),
sp as (select ep as k, oc as t, min(step) as a, max(step) as b from fo group by ep, oc),
pl as (select fo.*, oc = pc as content, coalesce(oc <> pc and a < step, false) as behind, coalesce(oc <> pc and not a < step and b > step, false) as ahead,
  case when oc = pc and p like '%at <%' then abs(regexp_extract(o, '<(\\d+), ', 1)::int - regexp_extract(p, '<(\\d+), ', 1)::int) + abs(regexp_extract(o, ', (\\d+)>', 1)::int - regexp_extract(p, ', (\\d+)>', 1)::int) end as gap
  from fo left join sp on k = ep and t = pc),
rn as (select *, sum(case when behind then 0 else 1 end) over (partition by ep order by step) as g from pl),
lr as (select ep, g, count(*) as length, min(step) as s, max(step) as e from rn where behind group by ep, g),
mr as (select * from (select *, row_number() over (partition by ep order by length desc, s) as nth from lr) where nth = 1)"""


def _trace(spark, d):
    n, w = F.col("event_id"), Window.partitionBy("ep").orderBy("step")
    before = F.coalesce(F.lag("sg").over(w), F.lit(""))
    said = F.when(n % 3 == 0, _say(before, " at <1, 2>")).when(n % 3 == 1, _say(F.col("sg"), " at <", n % 97 + n % 23, ", ", n % 41, ">")).otherwise(F.col("sg"))
    claim = _say("claim ", n % 3)
    e = episodes(spark, d).select("ep", "step", "event_id", "value", _say(F.col("sg"), " at <", n % 97, ", ", n % 41, ">").alias("o"), said.alias("p"), F.when(n % 5 == 0, claim).alias("claim"), F.when(n % 4 == 0, claim).alias("admitted"))
    return quality.positions(e, "ep", "step", "o", "p")


@query(f"""with {_TRACE}, by_ep as (select ep, avg(content::int) as cm, coalesce(avg(case when gap is not null then (gap > 14)::int end), 0) as cb, count(*) filter (ahead) as ah from pl group by ep),
x as (select c_custkey as ep, c_custkey % 4 = 0 as ok from customer where c_custkey % 6 <> 5)
select case when ok then 'success' when cm is null then 'no-trace' when cm >= 0.8 and cb <= 0.3 then 'policy' when cb > 0.5 then 'wrong coordinate' when coalesce(length, 0) >= 8 then 'STALL' when ah >= 3 then 'PREMATURE' else 'content wrong' end as class, count(*) as n
from x left join by_ep using (ep) left join mr using (ep) group by 1""")
def failure_classes(spark, d):
    n = F.col("c_custkey")
    outcomes = table(spark, d, "customer").select(n.alias("ep"), F.when(n % 6 != 5, n % 4 == 0).alias("ok"))
    return quality.failure_classes(outcomes, _trace(spark, d), "ep", "step", "ok").groupBy("class").agg(F.count("*").alias("n"))


@query(f"""with {_TRACE}, st as (select ep, length, s, e from mr where length >= 3),
c as (select st.ep, any_value(st.length) as length, count(claim) as claims, count(claim) filter (claim not in (select p2.admitted from pl p2 where p2.ep = st.ep and p2.step between st.s and st.e and p2.admitted is not null)) as held
  from st join pl on pl.ep = st.ep and step between s and e group by st.ep)
select ep, length, case when claims = 0 then 'SILENT' when held > 0 then 'HELD' else 'admitted but behind' end as mechanism from c""")
def stall_mechanisms(spark, d):
    return quality.stalls(_trace(spark, d), "ep", "step", "claim", "admitted", 3)


@query(f"""with {_TRACE}, g as (select ep, count(*) as ticks, count(*) filter (content) as content, count(gap) as grounded, count(*) filter (gap > 14) as far, list_sort(list(gap) filter (gap is not null)) as gs from pl group by ep)
select ep, ticks, content, grounded, far, gs[len(gs) // 2 + 1] as median_gap from g""")
def grounded_ticks(spark, d):
    return quality.grounding(_trace(spark, d), ["ep"])


@query(f"""with {EV}, m as (select *, sum((sg = 'error')::int) over (partition by ep order by step) as run from ev), l as (select ep, max(run) as last from m group by ep)
select ep, count(*) as ticks, min(step) as first from m join l using (ep) where run = last and run > 0 and sg <> 'error' group by ep
union all select c_custkey, null, null from customer where c_custkey not in (select ep from m join l using (ep) where run = last and run > 0 and sg <> 'error')""")
def outcome_trace(spark, d):
    last = quality.last_run(episodes(spark, d), "ep", ["step"], F.col("sg") == "error").groupBy("ep").agg(F.count("*").alias("ticks"), F.min("step").alias("first"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("ep"))
    return last.unionByName(asked.join(last, "ep", "left_anti"), allowMissingColumns=True)


@query(f"""with {EV}, m as (select *, sum((sg = 'error')::int) over (partition by ep order by step) as session from ev),
s as (select *, coalesce(sum((sg = 'purchase')::int) over (partition by ep, session order by step rows between unbounded preceding and 1 preceding), 0) as shut from m where session > 0)
select ep, session::bigint as session, count(*) as n from s where shut = 0 group by ep, session""")
def marked_sessions(spark, d):
    found = ordered.occurrences(episodes(spark, d), ["ep"], ["step"], F.col("sg") == "error", F.col("sg") == "purchase")
    return found.groupBy("ep", "session").agg(F.count("*").alias("n"))


# Texts

_INSTRUCTION = """i as (select p_partkey as id, p_size, ['Pick up', 'Put down', 'place', 'POUR', 'open', 'close', 'push'][(p_partkey % 7 + 1)::int] || ' ' ||
  ['a', 'two', 'six', 'many'][(p_size % 4 + 1)::int] || ' ' || ['red', 'green', 'blue', 'pink'][(p_partkey % 4 + 1)::int] || ' cubes and one ' || ['blue', 'red'][(p_partkey % 2 + 1)::int] || ' cube from the ' ||
  ['big container', 'peg', 'stick', 'box'][(p_size % 4 + 1)::int] || ' at <' || p_size || ', ' || (p_partkey % 50) || '>' as t from part)"""


def _instructions(spark, d):
    n, s = F.col("p_partkey"), F.col("p_size")
    one = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    t = _say(one(["Pick up", "Put down", "place", "POUR", "open", "close", "push"], n % 7), " ", one(["a", "two", "six", "many"], s % 4), " ", one(["red", "green", "blue", "pink"], n % 4), " cubes and one ", one(["blue", "red"], n % 2), " cube from the ", one(["big container", "peg", "stick", "box"], s % 4), " at <", s, ", ", n % 50, ">")
    return table(spark, d, "part").select(n.alias("id"), s, t.alias("t"))


@query(f"""with {_INSTRUCTION} select id, case when lower(t) like 'pick%' then 'pick' when lower(t) like 'place%' or lower(t) like 'put%' then 'place' when lower(t) like 'pour%' then 'pour' when lower(t) like 'open%' then 'open' when lower(t) like 'close%' then 'close' else 'other' end as kind,
  case when t like '%container%' then 'container' when t like '%peg%' then 'peg' when t like '%stick%' then 'stick' else 'cube' end as lifted,
  case when t like '%pink%' then 'pink' when t like '%green%' then 'green' when t like '%red%' then 'red' else 'none' end as word from i""")
def instruction_kinds(spark, d):
    t = F.col("t")
    return _instructions(spark, d).select("id", T.instruction_kind(t).alias("kind"), T.lift_class(t).alias("lifted"), T.first_keyword(t, ["pink", "green", "red"], "none").alias("word"))


@query(f"""with {_INSTRUCTION}, q as (select id, case w when 'a' then 1 when 'one' then 1 when 'two' then 2 when 'six' then 6 else 0 end as n, c from (
  select id, unnest(regexp_extract_all(lower(t), '(\\w+) (red|green|blue) cube', 1)) as w, unnest(regexp_extract_all(lower(t), '(\\w+) (red|green|blue) cube', 2)) as c from i)),
s as (select id, c, sum(n) as n from q group by id, c having sum(n) > 0)
select i.id, coalesce(string_agg(c || ':' || n, ',' order by case c when 'red' then 1 when 'green' then 2 else 3 end), '') as quota from i left join s on s.id = i.id group by i.id""")
def color_quotas(spark, d):
    asked = F.transform(T.color_quota(F.col("t")), lambda x: _say(x["color"], ":", x["n"]))
    return _instructions(spark, d).select("id", F.array_join(asked, ",").alias("quota"))


@query("""with h as (select event_id, event_type as e, (props->>'k')::int as k, floor(value)::int as v,
  case event_type when 'view' then 'Pick the second' when 'click' then 'a' when 'error' then 'fourth' else 'Look: first of the' end || ' highlighted cube at <' || (props->>'k') || ', ' || floor(value)::int || '>'
    || case when value < 50 then ', which is ' || event_type || ' now' else '; ' || event_type end as t from events)
select event_id, case e when 'view' then 'second' when 'error' then 'fourth' end as ordinal, k as r, v as c, case when t like '%which is%' then e end as color,
  case e when 'view' then 2 when 'click' then null when 'error' then 4 else 1 end::int as nth from h""")
def highlights(spark, d):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    head = F.when(kind == "view", "Pick the second").when(kind == "click", "a").when(kind == "error", "fourth").otherwise("Look: first of the")
    tail = F.when(F.col("value") < 50, _say(", which is ", kind, " now")).otherwise(_say("; ", kind))
    t = F.concat(head, F.lit(" highlighted cube at <"), k, F.lit(", "), F.floor("value").cast("string"), F.lit(">"), tail)
    x = table(spark, d, "events").select("event_id", t.alias("t"))
    return x.select("event_id", T.highlight(F.col("t")).alias("h"), "t").select("event_id", "h.*", T.ordinal(F.col("t")).alias("nth"))


@query("""select p_partkey as id, case p_type when 'ECONOMY' then 'cheap one' else replace(replace(p_type, ' ', '_') || '_x', '_', ' ') end as shown from part""")
def humanised(spark, d):
    name = F.when(F.col("p_type") == "ECONOMY", F.col("p_type")).otherwise(_say(F.replace(F.col("p_type"), F.lit(" "), F.lit("_")), "_x"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.humanise(name, {"ECONOMY": "cheap one"}).alias("shown"))


@query("""with x as (select event_id, event_type as e, (props->>'k')::bigint as k, floor(value)::bigint as v from events),
p as (select *, (k - 10) ** 2 + (v - 20) ** 2 as a1, (k - 40) ** 2 + (v - 5) ** 2 as a2, (v - 10) ** 2 + (k - 20) ** 2 as b1, (v - 40) ** 2 + (k - 5) ** 2 as b2 from x)
select event_id, e || ' from <' || (case when least(a1, a2) > 100 then k || ', ' || v when a1 <= a2 then '10, 20' else '40, 5' end) || '> to <' || (case when least(b1, b2) > 100 then v || ', ' || k when b1 <= b2 then '10, 20' else '40, 5' end) || '> end' as line from p""")
def snapped_lines(spark, d):
    anchors = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((10, 20), (40, 5))])
    k, v = F.get_json_object("props", "$.k"), F.floor("value")
    line = _say(F.col("event_type"), " from <", k, ", ", v, "> to <", v, ", ", k, "> end")
    return table(spark, d, "events").select("event_id", T.move_coords(line, lambda r, c: spatial.snap(anchors, r, c, 10)).alias("line"))


@query("""select event_id, '[' || printf('%.3f', event_id / 8.0) || ', ' || printf('%.3f', -(event_id % 7) / 4.0) || ']' as shown from events""")
def state_readouts(spark, d):
    n = F.col("event_id")
    return table(spark, d, "events").select(n, T.readout(n / 8, -(n % 7) / 4).alias("shown"))


@query("""select event_id, 'k=' || case when value > 50 then 'big' else props->>'k' end || case when value > 50 then ',n=' || floor(value)::bigint else '' end || ',t=' || event_type as m from events""")
def merged_maps(spark, d):
    """An event's props and type, and what its value says over them."""
    big, none = F.col("value") > 50, F.create_map().cast("map<string,string>")
    old = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("t"), F.col("event_type")))
    new = F.when(big, F.create_map(F.lit("k"), F.lit("big"), F.lit("n"), F.floor("value").cast("string"))).otherwise(none)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(T.merged(old, new)), lambda e: _say(e["key"], "=", e["value"]))), ",")
    return table(spark, d, "events").select("event_id", shown.alias("m"))


@query("""select name, row_number() over (order by n, name) as nth from (select replace(p_name, ' ', '_') || p_size || '_' || p_partkey as name, p_size as n from part)""")
def natural_order(spark, d):
    names = table(spark, d, "part").select(_say(F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size"), "_", F.col("p_partkey")).alias("name"))
    ranked = ordered.running_offset(names.withColumns({"n": T.embedded_number(F.col("name")), "one": F.lit(1)}), ["n", "name"], "one", name="before")
    return ranked.select("name", (F.col("before") + 1).cast("bigint").alias("nth"))


@query("""select page_id, sha256(to_base64(encode(coalesce(html, '')))) as coded, strlen(coalesce(html, ''))::bigint as n from pages""")
def coded_pages(spark, d):
    coded = F.regexp_replace(F.base64(F.encode(F.coalesce("html", F.lit("")), "UTF-8")), "[\r\n]", "")
    p = table(spark, d, "pages").select("page_id", coded.alias("coded"))
    return p.select("page_id", F.sha2("coded", 256).alias("coded"), F.octet_length(F.unbase64("coded")).cast("bigint").alias("n"))


@query("""select p_partkey as id, concat_ws(',', case when list_has_any(w, ['ring', 'bolt']) then 'metal' end, case when list_has_any(w, ['red', 'blue']) then 'colored' end, 'arm') as names
from (select p_partkey, string_split(lower(p_name), ' ') as w from part)""")
def trigger_words(spark, d):
    bag = F.split(F.lower("p_name"), " ")
    names = T.vocabulary(bag, [("metal", ("ring", "bolt")), ("colored", ("red", "blue"))], ("arm",))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(names, ",").alias("names"))


@query("""select event_id, case when event_id % 4 = 0 then (case when event_id % 8 <> 0 then 'kept ' || event_type end) else event_type end as sg from events where event_id % 8 <> 0""")
def fallback_tokens(spark, d):
    n = F.col("event_id")
    online = F.when(n % 4 == 0, " No Record ").otherwise(F.col("event_type"))
    recorded = F.when(n % 8 == 0, "remain static").otherwise(_say("kept ", F.col("event_type")))
    return table(spark, d, "events").select(n, T.event_text(online, recorded).alias("sg")).filter("sg is not null")


@query("""with x as (select conv_id, turn, unnest(string_split_regex(coalesce(text, ''), '[.,\\n]')) as s, generate_subscripts(string_split_regex(coalesce(text, ''), '[.,\\n]'), 1)::bigint as n from conversations),
w as (select *, list_filter(string_split_regex(split_part(s, 'at <', 1), '\\s+'), lambda v: v <> '') as ws from x),
f as (select *, list_min(list_filter(range(1, len(ws)), lambda i: ws[i] in ('the', 'a', 'another') and len(list_filter(ws[i:], lambda v: regexp_matches(v, '[^\\w\\-]'))) = 0)) as i from w)
select conv_id, turn, n, coalesce(array_to_string(ws[i + 1:], '_'), 'object') as name from f""")
def object_names(spark, d):
    said = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.,\n]")).alias("n", "s"))
    return said.select("conv_id", "turn", (F.col("n") + 1).cast("bigint").alias("n"), T.object_name(F.col("s")).alias("name"))


@query("""select conv_id, turn, 'system:be brief|user:' || coalesce(text, '') || '|assistant:' || role as m from conversations""")
def chat_messages(spark, d):
    m = T.chat(F.lit("be brief"), F.col("text"), F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(m, lambda x: _say(x["role"], ":", x["content"])), "|").alias("m"))


# Gates

@query(f"""with {PT}, q as (select *, 'x' || (id % 5) as name from pt)
select id, r > 5 and r < 251 and c > 5 and c < 251 as inside, least(r, c) <= 2 or greatest(r, c) >= 253 as border from q where score >= 0.0 and name in ('x0', 'x1', 'x2') and name not in ('x1') and not (id % 3 <> 0 or id % 4 = 0)""")
def detection_gates(spark, d):
    i = F.col("id")
    p = points(spark, d).withColumn("name", _say("x", i % 5)).withColumn("offset", i % 3).withColumn("target", F.when(i % 4 == 0, " none ").otherwise("line"))
    kept = gates.canonical(gates.named(gates.scored(p, "score", 0.0), "name", ["x0", "x1", "x2"], ["x1"]), "offset", "target")
    return kept.select("id", gates.inside(F.col("r"), F.col("c")).alias("inside"), gates.at_border(F.col("r"), F.col("c")).alias("border"))


@query("""select s_suppkey as id, s_nationkey::bigint as seed from supplier where not (s_nationkey * 5 >= 100 or s_nationkey * 5 + 10 > 100)""")
def seed_windows(spark, d):
    seed, n = F.col("s_nationkey") * 5, F.lit(10)
    fine = table(spark, d, "supplier").filter(~gates.leaks(seed, n))
    return fine.select(F.col("s_suppkey").alias("id"), (gates.guarded_seeds(seed.cast("bigint"), n) / 5).cast("bigint").alias("seed"))


@query("""select s_suppkey as id, n_name as family from supplier join nation on s_nationkey = n_nationkey where n_nationkey % 3 <> 0
union all select null, 'lost ' || count(*) from supplier where s_nationkey % 3 = 0""")
def known_families(spark, d):
    names = table(spark, d, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("family"))
    kept, lost = gates.known(table(spark, d, "supplier"), names, "s_nationkey")
    return kept.select(F.col("s_suppkey").alias("id"), "family").union(lost.select(F.lit(None).cast("bigint"), _say("lost ", F.col("lost"))))


@query("""select c_custkey as id from customer where c_mktsegment in ('BUILDING', 'MACHINERY')""")
def allow_list(spark, d):
    keys = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "c_mktsegment string")
    return gates.strict_subset(table(spark, d, "customer"), keys, "c_mktsegment").select(F.col("c_custkey").alias("id"))


# Grids and sequences

_LEN = EV + ", le as (select ep, count(*) as n from ev group by ep)"


def _lengths(spark, d):
    return episodes(spark, d).groupBy("ep").agg(F.count("*").alias("n"))


@query(f"""with {_LEN}, g as (select ep, o as "offset", unnest(range(case when o = 0 then 16 else o end, n, 16)) as "end" from le, unnest([0, 5, 9]) as t(o) where n > 0 union select ep, o, n - 1 from le, unnest([0, 5, 9]) as t(o) where n > 0)
select ep, "offset"::bigint as "offset", coalesce(lag("end") over (partition by ep, "offset" order by "end"), 0)::bigint as last, "end"::bigint as "end" from g""")
def offset_grids(spark, d):
    return ordered.offset_grid(_lengths(spark, d), "ep", "n", [0, 5, 9])


@query(f"""with {EV}, tk as (select ep, step as last from ev where sg = 'view')
select tk.ep, tk.last, count(ev.step) as n, coalesce(string_agg(ev.step || ':' || ev.sg, ',' order by ev.step), '') as seen from tk left join ev on ev.ep = tk.ep and ev.step >= tk.last - 16 and ev.step < tk.last group by tk.ep, tk.last""")
def previous_windows(spark, d):
    e = episodes(spark, d)
    ticks = e.filter("sg = 'view'").select("ep", F.col("step").alias("last"))
    found = ordered.window_before(ticks, e, "ep", "last", "step", ["sg"])
    return found.select("ep", "last", F.size("before").cast("bigint").alias("n"), F.array_join(F.transform("before", lambda x: _say(x["step"], ":", x["sg"])), ",").alias("seen"))


@query(f"""with {EV}, x as (select *, case when sg = 'click' then 'Press the button' else sg end as t from ev),
m as (select *, case when lag(t) over w is distinct from t then 1 else 0 end as ch, lag(t) over w as was0 from x window w as (partition by ep order by step)),
r as (select *, sum(ch) over (partition by ep order by step) as run from m),
s as (select *, min(step) over (partition by ep, run) as since, first_value(was0) over (partition by ep, run order by step) as was from r)
select ep, step, case when lower(was) like '%press the%' and step - since <= 2 and not value > 60 then was end as held from s""")
def press_gaps(spark, d):
    t = F.when(F.col("sg") == "click", "Press the button").otherwise(F.col("sg"))
    return ordered.held_press(episodes(spark, d), ["ep"], ["step"], "step", t, F.col("value") > 60, 2).select("ep", "step", "held")


@query(f"""with {EV}, x as (select ep, step, max(step) over (partition by ep) as l from ev)
select ep, step, least(step + 3, l) || '|' || (least(step + 3, l) > step) || '|' || least(step + 7, l) || '|' || (least(step + 7, l) > least(step + 3, l)) as f from x""")
def future_offsets(spark, d):
    e = episodes(spark, d).withColumn("l", F.max("step").over(Window.partitionBy("ep")))
    steps = ordered.future_steps(F.col("step"), F.col("l"), [3, 7])
    return e.select("ep", "step", F.array_join(F.transform(steps, lambda x: _say(x["at"], "|", x["valid"])), "|").alias("f"))


@query("""with o as (select o_custkey as ep, o_orderkey as seg, (o_orderkey % 4)::bigint as n from orders), s as (select *, (sum(n) over (partition by ep order by seg) - n)::bigint as start from o)
select ep, seg, start, w as within, start + w as step from s, unnest(range(n)) as t(w)""")
def segment_steps(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("ep"), F.col("o_orderkey").alias("seg"), (F.col("o_orderkey") % 4).alias("n"))
    return ordered.segment_steps(o, ["ep"], ["seg"], "n", [])


@query(f"""with {PT}, g as (select *, lag(r) over w as a, lag(c) over w as b from pt window w as (partition by label order by id))
select label, id, round(sqrt((r - a) ** 2 + (c - b) ** 2), 6) as gap, coalesce((r - a) ** 2 + (c - b) ** 2 > 2500, false) as broken from g""")
def chain_gaps(spark, d):
    found = ordered.chain_gaps(points(spark, d), ["label"], ["id"], ["r", "c"], ["r", "c"], 50)
    return found.select("label", "id", F.round("gap", 6).alias("gap"), "broken")


@query(f"""with {EV} select ep, step, case when value > 40 then count(*) filter (value > 40) over (partition by ep order by step) end as nth from ev""")
def stroke_numbers(spark, d):
    return ordered.numbered(episodes(spark, d), ["ep"], ["step"], F.col("value") > 40).select("ep", "step", "nth")


# Reports

@query(f"""with {EV} select sg, event_id % 3 as kind, count(*) as n, round(avg((value <= 300)::int), 6) as identity, round(avg((value > 5)::int), 6) as dynamics,
  case when avg((value <= 300)::int) < 0.9 or avg((value > 5)::int) < 0.9 then 'LOW' else '' end as flag from ev group by sg, event_id % 3""")
def family_rates(spark, d):
    e = episodes(spark, d).withColumn("kind", F.col("event_id") % 3)
    out = quality.kind_rates(e, ["sg", "kind"], F.col("value") <= 300, F.col("value") > 5)
    return out.withColumn("identity", F.round("identity", 6)).withColumn("dynamics", F.round("dynamics", 6))


@query("""with m as (select p_brand as arm, avg(p_size) as mean from part where p_type <> 'ECONOMY' group by p_brand), b as (select mean as base from m where arm = 'Brand#2')
select arm, round(mean, 6) as mean, round(mean - base, 6) as delta, abs(mean - base) >= 1 as shaded from m left join b on true""")
def subset_deltas(spark, d):
    out = quality.subset_delta(table(spark, d, "part").withColumnRenamed("p_brand", "arm"), "arm", "p_type", "p_size", F.col("p_type") != "ECONOMY", "Brand#2", 1.0)
    return out.select("arm", F.round("mean", 6).alias("mean"), F.round("delta", 6).alias("delta"), "shaded")


@query("""with o as (select n_regionkey::varchar as family, s_nationkey as member, avg(s_acctbal) as tsr, avg(s_suppkey) as csr from supplier join nation on s_nationkey = n_nationkey group by 1, 2)
select coalesce(family, 'ALL') as family, count(*) as members, round(avg(tsr), 4) as tsr, round(avg(csr), 4) as csr from o group by grouping sets ((family), ())""")
def family_means(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("n_regionkey").cast("string").alias("family"), F.col("s_nationkey").alias("member"), F.col("s_acctbal").alias("tsr"), F.col("s_suppkey").alias("csr"))
    return quality.family_means(s, "family", "member", ["tsr", "csr"]).select("family", "members", F.round("tsr", 4).alias("tsr"), F.round("csr", 4).alias("csr"))


@query(f"""with {PT}, a as (select label, count(*) as n, median(r) as median_r, median(c) as median_c, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) as iqr_r, quantile_cont(c, 0.75) - quantile_cont(c, 0.25) as iqr_c,
  avg((least(r, c) <= 2 or greatest(r, c) >= 253)::int) as border, avg((id % 50 = 0)::int) as fallback, bool_or(id % 2 = 0) as s from pt group by label)
select label, n, round(median_r, 6) as median_r, round(median_c, 6) as median_c, round(iqr_r, 6) as iqr_r, round(iqr_c, 6) as iqr_c, round(border, 6) as border, round(fallback, 6) as fallback,
  concat_ws(' ', case when border > 0 then 'BORDER' end, case when fallback > 0 then 'FALLBACK' end, case when s and greatest(iqr_r, iqr_c) > 60 then 'SPREAD' end) as flags from a""")
def place_reports(spark, d):
    out = quality.place_report(points(spark, d), ["label"], "r", "c", F.col("id") % 50 == 0, F.col("id") % 2 == 0)
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("median_r", "median_c", "iqr_r", "iqr_c", "border", "fallback")], "flags")


@query("""select lower(o_orderpriority) as verb, count(*) as n, round(median(o_totalprice), 4) as median, round(quantile_cont(o_totalprice, 0.1), 4) as p10, round(quantile_cont(o_totalprice, 0.9), 4) as p90,
  round(avg((o_totalprice >= 100000)::int), 6) as "open", round(median(o_custkey), 4) as median_rise, round(avg((o_custkey > 500)::int), 6) as lifted from orders group by 1""")
def boundary_reports(spark, d):
    out = quality.boundary_report(table(spark, d, "orders"), F.lower("o_orderpriority"), F.col("o_totalprice"), F.col("o_custkey"), 100000, 500)
    return out.select("verb", "n", *[F.round(c, 4).alias(c) for c in ("median", "p10", "p90", "median_rise")], F.round("open", 6).alias("open"), F.round("lifted", 6).alias("lifted"))


@query(f"""with {EV} select ep, string_agg(distinct sg, ',' order by sg) as kinds from ev group by ep""")
def distinct_sets(spark, d):
    return episodes(spark, d).groupBy("ep").agg(F.array_join(F.array_sort(F.collect_set("sg")), ",").alias("kinds"))


@query(f"""with {_LEN} select ep % 4 as family, count(*) as n, min(n) as shortest, median(n) as p50, round(avg(n), 6) as mean, max(n) as longest, sum(n)::bigint as total from le group by 1""")
def episode_lengths(spark, d):
    return quality.length_stats(_lengths(spark, d).withColumn("family", F.col("ep") % 4), ["family"], "n").withColumn("mean", F.round("mean", 6))


# Lookups

@query("""with pl as (select p_size as task, trim(lower(p_name)) as t, p_partkey as nth, p_partkey % 90 as r, p_size as c from part where p_partkey % 3 <> 0),
f as (select task, t, min(nth) as nth from pl group by task, t)
select p_partkey as id, pl.r, pl.c from part left join f on f.task = p_size and f.t = trim(lower(p_name)) left join pl on pl.task = f.task and pl.t = f.t and pl.nth = f.nth""")
def plan_medians(spark, d):
    p = table(spark, d, "part")
    n = F.col("p_partkey")
    plan = p.select(F.col("p_size").alias("task"), F.upper("p_name").alias("name"), n.alias("nth"), F.when(n % 3 == 0, "pick").otherwise("place").alias("kind"), (n % 90).alias("r"), F.col("p_size").alias("c"))
    return joins.step_medians(p.select(n.alias("id"), F.col("p_size").alias("task"), F.col("p_name").alias("name")), plan, "task", "name").select("id", "r", "c")


@query("""select s_suppkey as frame, n_name as phrase, (s_suppkey * 7 + n_nationkey * 3) % 100 as score from supplier, nation""")
def phrase_frames(spark, d):
    found = joins.phrase_frames(table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "nation").select("n_nationkey", "n_name"))
    return found.select(F.col("s_suppkey").alias("frame"), F.col("n_name").alias("phrase"), ((F.col("s_suppkey") * 7 + F.col("n_nationkey") * 3) % 100).alias("score"))


@query(f"""with {EV}, x as (select ep, step, (props->>'k')::bigint as k, floor(value)::bigint as v from ev),
y as (select *, lag(k) over w as k1, lag(v) over w as v1, lag(k, 2) over w as k2, lag(v, 2) over w as v2 from x window w as (partition by ep order by step)),
z as (select *, coalesce((k - k1) ** 2 + (v - v1) ** 2 <= 400, false) as a1, coalesce((v - k1) ** 2 + (k - v1) ** 2 <= 400, false) as b1, coalesce((k - k2) ** 2 + (v - v2) ** 2 <= 400, false) as a2, coalesce((v - k2) ** 2 + (k - v2) ** 2 <= 400, false) as b2 from y)
select ep, step, (a1 or a2) and (b1 or b2) as near, a1 and b1 as seen from z""")
def targets_near(spark, d):
    """An event's two goals (its place, and that with row and column exchanged) against the places of the two events before."""
    w = Window.partitionBy("ep").orderBy("step")
    x = episodes(spark, d).select("ep", "step", F.get_json_object("props", "$.k").cast("int").alias("k"), F.floor("value").cast("int").alias("v"))
    place = lambda r, c: F.struct(r.alias("r"), c.alias("c"))
    x = x.withColumns({"p1": F.lag(place(F.col("k"), F.col("v"))).over(w), "p2": F.lag(place(F.col("k"), F.col("v")), 2).over(w)})
    goals, held = F.array(place(F.col("k"), F.col("v")), place(F.col("v"), F.col("k"))), lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c)))
    none = F.lit(None).cast("array<struct<r:int,c:int>>")
    return x.select("ep", "step", joins.all_near(goals, held("p1"), held("p2"), radius=20).alias("near"), joins.all_near(goals, held("p1"), none, radius=20).alias("seen"))


@query("""select event_id, event_id % 3 = 0 and event_id % 5 = 0 and event_id % 2 = 0 as shown from events""")
def covered_sites(spark, d):
    n = F.col("event_id")
    det = lambda name, ok: F.when(ok, F.array(F.struct(F.lit(name).alias("name"), F.lit(10).alias("r"), F.lit(12).alias("c")))).otherwise(F.array().cast("array<struct<name:string,r:int,c:int>>"))
    first = F.concat(det("red_cube", n % 3 == 0), det("red_container", n % 2 != 0))
    last = F.concat(det("red_cube", n % 5 != 0), det("red_container", F.lit(True)))
    line = F.lit("containers were placed over the cubes at <10, 12>")
    none = F.array().cast("array<struct<name:string,r:int,c:int>>")
    return table(spark, d, "events").select(n, corpus.evident(line, none, none, first, last, F.array(none)).alias("shown"))


@query(f"""with {EV}, x as (select ep, step, sg, (props->>'k')::bigint as k, floor(value)::bigint as v from ev)
select ep, step, exists (select 1 from x y where y.ep = x.ep and y.step between x.step - 5 and x.step - 1 and y.sg = x.sg and abs(y.k - x.k) + abs(y.v - x.v) <= 14) as repeated from x""")
def repeated_claims(spark, d):
    """An event's claim against those of the five before."""
    line = _say("[event] completed: ", F.col("sg"), " at <", F.get_json_object("props", "$.k"), ", ", F.floor("value"), ">  [sam] cube")
    bank = F.collect_list("line").over(Window.partitionBy("ep").orderBy("step").rowsBetween(-5, -1))
    x = episodes(spark, d).select("ep", "step", line.alias("line")).withColumn("bank", bank)
    return x.select("ep", "step", joins.duplicates_claim(F.col("bank"), F.col("line")).alias("repeated"))


@query("""with a as (select s_suppkey as id, s_nationkey as k, ['ring', 'red ring', 'bolt'][(s_suppkey % 3 + 1)::int] as name from supplier), b as (select n_nationkey as k, i as nth, ['big red ring', 'ring', 'nut bolt'][i] as other from nation, unnest([1, 2, 3]) as t(i))
select a.id, arg_min(other, nth) filter (contains(name, other) or contains(other, name)) as other from a left join b using (k) group by a.id""")
def contained_names(spark, d):
    n = F.col("s_suppkey")
    one = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    a = table(spark, d, "supplier").select(n.alias("id"), F.col("s_nationkey").alias("k"), one(["ring", "red ring", "bolt"], n % 3).alias("name"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("nth")).withColumn("other", one(["big red ring", "ring", "nut bolt"], F.col("nth") - 1))
    return joins.either_contains(a, b, "k", "name", "other", "nth").select("id", "other")


# Places and motion

@query(f"""with {PT}, x as (select label, median(10 * (c - 3) - 4 * (r - 2)) as med from pt group by label) select label, round(med, 6) as med, case when med < 0 then 'clockwise' else 'counterclockwise' end as dir from x""")
def stroke_sides(spark, d):
    med = F.percentile(geometry.cross(F.lit(10), F.lit(4), F.col("r") - 2, F.col("c") - 3), F.lit(0.5))
    x = points(spark, d).groupBy("label").agg(med.alias("med"))
    return x.select("label", F.round("med", 6).alias("med"), F.when(F.col("med") < 0, "clockwise").otherwise("counterclockwise").alias("dir"))


@query(f"""with recursive {EV}, q as (select ep, step, (value * 2)::int as r, step as i from ev),
m as (select ep, i, r, step, r as last, false as kept from q where i = 0
  union all select q.ep, q.i, q.r, q.step, case when m.i = 0 or abs(m.last - q.r) > 14 then q.r else m.last end, m.i = 0 or abs(m.last - q.r) > 14 from m join q on q.ep = m.ep and q.i = m.i + 1),
p as (select ep, step, r, case when abs(r - 40) <= abs(r - 100) then 40 else 100 end as pad from m where kept)
select ep, count(*) as n, arg_min(pad, step) filter (abs(r - pad) <= 20) as first_pad from p group by ep""")
def rest_drops(spark, d):
    e = episodes(spark, d).withColumn("r", (F.col("value") * 2).cast("decimal(18,6)").cast("double"))
    e = e.withColumn("r", F.rint("r").cast("int"))
    rows = folds.ordered_rows(e, ["ep"], ["step"], ["r"])
    segments = F.transform("rows_", lambda x: F.struct(x["step"].alias("start"), x["r"].alias("r"), F.lit(0).alias("c")))
    pads = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(0).alias("c")) for r in (40, 100)])
    found = rows.select("ep", folds.drops(segments, pads).alias("d")).filter("size(d) > 0")
    return found.select("ep", F.size("d").cast("bigint").alias("n"), folds.kth_pad(F.col("d"), F.lit(0))["r"].alias("first_pad"))


@query("""select event_id, least(floor(value / 8), 7)::bigint as bin, user_id % 5 = 2 as mine from events""")
def color_bins(spark, d):
    return table(spark, d, "events").select("event_id", geometry.color_bin(F.col("value"), 8, 8).cast("bigint").alias("bin"), corpus.shard(F.col("user_id"), 2, 5).alias("mine"))


@query(f"""with {EV}, a as (select *, coalesce(value > 20, false) as gone from ev), g as (select *, sum((not gone)::int) over (partition by ep order by step) as b from a),
r as (select *, row_number() over (partition by ep, b order by step) - (b > 0)::int as run from g)
select ep, min(step) as deposited from r where gone and run >= 3 group by ep""")
def dwell_deposits(spark, d):
    held = ordered.sustained(episodes(spark, d), ["ep"], ["step"], F.col("value") > 20, 3, "full")
    return held.filter("full").groupBy("ep").agg(F.min("step").alias("deposited"))


_PTS = PT + ", q as (select label, r, c, id, row_number() over (partition by label order by id) - 1 as i from pt)"


@query(f"""with recursive {_PTS}, m as (select label, i, [struct_pack(r := r, c := c, id := id)] as kept from q where i = 0
  union all select q.label, q.i, case when len(list_filter(kept, lambda k: (k.r - q.r) ** 2 + (k.c - q.c) ** 2 <= 900)) = 0 then list_append(kept, struct_pack(r := q.r, c := q.c, id := q.id)) else kept end from m join q on q.label = m.label and q.i = m.i + 1)
select label, k.id as id, k.r as r, k.c as c from (select label, unnest(arg_max(kept, i)) as k from m group by label)""")
def distinct_routes(spark, d):
    return spatial.routes(points(spark, d), ["label"], [F.col("id")], 30, ["id", "r", "c"])


@query(f"""with recursive {_PTS}, m as (select label, i, [struct_pack(id := id, r := r, c := c, n := 1)] as kept from q where i = 0
  union all select label, i, case when hit is null then list_append(kept, struct_pack(id := id, r := r, c := c, n := 1)) else list_transform(kept, lambda k, j: struct_pack(id := k.id, r := k.r, c := k.c, n := k.n + (j = hit)::int)) end
  from (select q.label, q.i, q.id, q.r, q.c, m.kept, list_position(list_transform(kept, lambda k: abs(k.r - q.r) + abs(k.c - q.c) <= 30), true) as hit from m join q on q.label = m.label and q.i = m.i + 1))
select label, k.id as id, k.r as r, k.c as c, k.n::bigint as n from (select label, unnest(list_filter(arg_max(kept, i), lambda k: k.n >= 3)) as k from m group by label)""")
def point_clusters(spark, d):
    return spatial.clusters(points(spark, d), ["label"], [F.col("id")], 30, ["id", "r", "c"], 3)


@query(f"""with recursive {_PTS}, m as (select label, i, [struct_pack(s := id % 2, id := id, r := r, c := c, n := 1)] as kept from q where i = 0
  union all select label, i, case when hit is null then list_append(kept, struct_pack(s := s, id := id, r := r, c := c, n := 1)) else list_transform(kept, lambda k, j: struct_pack(s := k.s, id := k.id, r := k.r, c := k.c, n := k.n + (j = hit)::int)) end
  from (select q.label, q.i, q.id, q.id % 2 as s, q.r, q.c, m.kept, list_position(list_transform(kept, lambda k: k.s = q.id % 2 and abs(k.r - q.r) < 18 and abs(k.c - q.c) < 18), true) as hit from m join q on q.label = m.label and q.i = m.i + 1))
select label, 'k' || k.s as name, k.id as id, k.n::bigint as n from (select label, unnest(arg_max(kept, i)) as k from m group by label)""")
def class_clusters(spark, d):
    named = points(spark, d).withColumn("name", _say("k", F.col("id") % 2))
    return spatial.class_clusters(named, ["label", "name"], [F.col("id")], 18, ["id"])


@query(f"""with {EV}, f as (select ep, step, event_id % 3 = 0 as b, event_id % 2 = 0 as a, value > 20 as s from ev),
x as (select *, """ + ", ".join(f"lag({c}, {k}) over w as {c}{k}" for c in "bas" for k in range(1, 6)) + """ from f window w as (partition by ep order by step))
select ep, step, coalesce((not b and a) and (not b1 and a1), false) or coalesce((not b1 and a1) and (not b2 and a2), false) or coalesce((not b2 and a2) and (not b3 and a3), false) as pressed,
  coalesce(not s and not s1, false) or coalesce(not s1 and not s2, false) or coalesce(not s2 and not s3, false) as absent,
  coalesce(not s and not s1, false) and (coalesce(s2, false) or coalesce(s3, false) or coalesce(s4, false) or coalesce(s5, false)) as lifted,
  s and coalesce(s1, true) and coalesce(s2, true) and coalesce(s3, true) as rested, s and not a as put, a or coalesce(a1, false) or coalesce(a2, false) or coalesce(a3, false) or coalesce(a4, false) or coalesce(a5, false) as visited from x""")
def frame_evidence(spark, d):
    n, w = F.col("event_id"), Window.partitionBy("ep").orderBy("step")
    det = lambda name, c, ok: F.when(ok, F.array(F.struct(F.lit(name).alias("name"), F.lit(10).alias("r"), F.lit(c).alias("c")))).otherwise(F.array().cast("array<struct<name:string,r:int,c:int>>"))
    frame = F.concat(det("button", 10, n % 3 == 0), det("arm", 30, n % 2 == 0), det("red_cube", 12, F.col("value") > 20))
    x = episodes(spark, d).withColumn("f", frame).select("ep", "step", F.collect_list("f").over(w.rowsBetween(-3, 0)).alias("now"), F.collect_list("f").over(w.rowsBetween(-5, -4)).alias("old"))
    at, old, now = (F.lit(10), F.lit(12)), F.col("old"), F.col("now")
    return x.select("ep", "step", evidence.pressed(now, F.lit(10), F.lit(10)).alias("pressed"), evidence.absent(now, *at, "cube").alias("absent"), evidence.lifted(old, now, *at, "cube").alias("lifted"), evidence.placed(now, *at, "cube", True).alias("rested"), evidence.placed(now, *at, "cube", False).alias("put"), evidence.visited(old, now, *at).alias("visited"))


@query("""select conv_id, turn, count(*) filter (lower(coalesce(text, '')) like '%an%') over (partition by conv_id order by turn) as n from conversations""")
def bank_counts(spark, d):
    lines = ordered.bank(table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), ["conv_id"], ["turn"], "text", None, True)
    return lines.select("conv_id", "turn", evidence.counted(F.col("bank"), "an").alias("n"))


@query(f"""with recursive {EV}, e as (select ep, step * 9 as step, value as d from ev),
x as (select *, lag(d) over (partition by ep order by step) as b, row_number() over (partition by ep order by step) as i from e),
m as (select ep, i, step, case when d < 20 then [step] else []::bigint[] end as a from x where i = 1
  union all select x.ep, x.i, x.step, case when x.d < 20 and x.b >= 20 and (len(a) = 0 or x.step - a[-1] > 24) then list_append(a, x.step) else a end from m join x on x.ep = m.ep and x.i = m.i + 1),
g as (select *, list_sort(list_transform(range(1, len(a)), lambda j: a[j + 1] - a[j])) as gaps from m),
f as (select ep, step, len(a)::bigint as arrivals, coalesce(len(a) >= 3 and a[-1] + gaps[len(gaps) // 2 + 1] * (4 - len(a)) - step <= 28, false) as fires from g)
select *, bool_or(fires) over (partition by ep order by step) as latched from f""")
def press_triggers(spark, d):
    e = episodes(spark, d).select("ep", (F.col("step") * 9).alias("step"), F.col("value").alias("d"))
    return evidence.press_trigger(e, "ep", "step", "d", 4).select("ep", "step", "arrivals", "fires", "latched")


@query(f"""with recursive {EV}, p as (select ep, step as ord, sg as kind from ev), s as (select ep, step as pos, sg as kind, row_number() over (partition by ep order by step) as n from ev where value > 50),
c as (select ep, max(n) as n from s group by ep),
m as (select ep, -1::bigint as ord, 1::bigint as nxt, null::bigint as stage from (select distinct ep from p)
  union all select p.ep, p.ord, case when s.kind = p.kind then nxt + 1 else nxt end, case when s.kind = p.kind then s.pos end from m join p on p.ep = m.ep and p.ord = m.ord + 1 left join s on s.ep = p.ep and s.n = m.nxt),
l as (select ep, max(nxt) as nxt from m group by ep)
select m.ep, ord, stage, l.nxt > coalesce(c.n, 0) as complete from m join l using (ep) left join c using (ep) where ord >= 0""")
def stage_bindings(spark, d):
    e = episodes(spark, d)
    plan = e.select("ep", F.col("step").alias("ord"), F.col("sg").alias("kind"))
    return grouped.bind_stages(plan, e.filter("value > 50").select("ep", F.col("step").alias("pos"), F.col("sg").alias("kind")), "ep")


# Sources and sinks

@query("""select name from (select 'part_' || lpad(p_partkey::varchar, 9, '0') as name, row_number() over (order by p_partkey) - 1 as nth from part) where nth in (3, 7, 500)""")
def file_subset(spark, d):
    files = table(spark, d, "part").select(_say("part_", F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("name"))
    return readers.file_subset(files, "name", [3, 7, 500])


@query("""select o_orderkey as id from orders where o_orderkey % 3 = 0""")
def unparsed_names(spark, d):
    n = F.col("o_orderkey")
    name = F.when(n % 3 == 0, _say("notes_", n, ".txt")).otherwise(_say("pick_up_", n % 5, "_seed", n, "_task2.hdf5"))
    return readers.unparsed(table(spark, d, "orders").select(n.alias("id"), name.alias("file")), "file").select("id")


@query(f"""with {EV}, k as (select distinct ep, step from ev where sg in ('view', 'click')) select k.ep, string_agg(case when sg = 'view' then printf('%.2f', value) else 'nan' end, ',' order by k.step) as view, string_agg(case when sg = 'click' then printf('%.2f', value) else 'nan' end, ',' order by k.step) as click from k join ev on ev.ep = k.ep and ev.step = k.step group by k.ep""")
def ragged_metrics(spark, d):
    found = writers.ragged(episodes(spark, d), "ep", "step", "sg", "value", ["view", "click"])
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.when(F.isnan(x), "nan").otherwise(F.format_string("%.2f", x))), ",")
    return found.select("ep", shown("view").alias("view"), shown("click").alias("click"))


@query("""with r as (select n_regionkey as region, count(*) as nations from nation group by 1)
select 0::bigint as nth, '| region | nations |' as line union all select 1, '|-|-|' union all select row_number() over (order by region) + 1, '| ' || region || ' | ' || nations || ' |' from r""")
def markdown_report(spark, d):
    return writers.markdown(table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations")), ["region"])
