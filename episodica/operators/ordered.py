"""Operators over rows in a total order within a key (an episode).

`order` is a list of columns that orders the rows of a key totally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Ranges that an order over all rows is dealt to.
RANGES = 256


def _w(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def steps(df: DataFrame, key: list[str], order: list[str], name: str = "step") -> DataFrame:
    """Rows numbered from 0 within their key."""
    return df.withColumn(name, (F.row_number().over(_w(key, order)) - 1).cast("bigint"))


def changes(df: DataFrame, key: list[str], order: list[str], value: str, name: str = "change") -> DataFrame:
    """True at the first row of a key and where the value differs from the row before (nulls are equal)."""
    w = _w(key, order)
    return df.withColumn(name, (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w)))


def runs(df: DataFrame, key: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """The number (from 0) of the run of equal values that a row is in."""
    w = _w(key, order)
    marked = changes(df, key, order, value, "change_")
    total = F.sum(F.col("change_").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(name, total - 1).drop("change_")


def run_segments(df: DataFrame, key: list[str], order: list[str], value: str, step: str) -> DataFrame:
    """A row for each run: its value, first and last step, and length."""
    numbered = runs(df, key, order, value)
    return numbered.groupBy(*key, "run").agg(F.first(value).alias(value), F.min(step).alias("start"), F.max(step).alias("end"), F.count("*").alias("length"))


def sustained(df: DataFrame, key: list[str], order: list[str], flag: Column, k: int, name: str = "sustained") -> DataFrame:
    """True from the k-th consecutive row on for which the flag holds (a null flag doesn't)."""
    w = _w(key, order)
    held = df.withColumn("flag_", F.coalesce(flag, F.lit(False)))
    held = held.withColumn("broken_", F.sum((~F.col("flag_")).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(_w([*key, "broken_"], order)) - F.when(F.col("broken_") > 0, 1).otherwise(0)
    return held.withColumn(name, F.col("flag_") & (nth >= k)).drop("flag_", "broken_")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], direction: str = "backward", tie: str = "first", clamp: bool = False) -> DataFrame:
    """left and the values (and time, as at_found) of one row of right with its key.

    backward: the last row at or before; forward: the first row after
    (strictly; with clamp, the last row where there is none); nearest: the
    closest, the earlier (tie="first") or later one of two as close. Both
    sides are merged and sorted once per key; right has one row a key and time.
    """
    fields = F.struct(F.col(at).alias("t"), *values)
    none = F.lit(None)
    a = left.select(key, at, F.struct(*left.columns).alias("row_"), F.lit(1).alias("side_"), none.alias("hit_"))
    b = right.select(key, at, none.alias("row_"), F.lit(0).alias("side_"), fields.alias("hit_"))
    w = Window.partitionBy(key).orderBy(at, "side_")
    both = a.unionByName(b)
    both = both.withColumn("back_", F.last("hit_", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("next_", F.first("hit_", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    if clamp:
        both = both.withColumn("next_", F.coalesce("next_", F.last("hit_", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    before, after = F.col(at) - F.col("back_.t"), F.col("next_.t") - F.col(at)
    nearer = after < before if tie == "first" else after <= before
    found = {"backward": F.col("back_"), "forward": F.col("next_"), "nearest": F.when(F.col("back_").isNull() | nearer, F.coalesce("next_", "back_")).otherwise(F.col("back_"))}[direction]
    kept = both.filter("side_ = 1").select("row_", found.alias("found_"))
    return kept.select("row_.*", F.col("found_.t").alias("at_found"), *[F.col(f"found_.{v}").alias(v) for v in values])


def window_frames(ticks: DataFrame, frames: DataFrame, key: str, start: str, end: str, at: str, middle: int = 5, slack: int = 4, name: str = "frames") -> DataFrame:
    """ticks with the steps of the frames nearest to their start, `middle` steps on, and their end: each once, in order.

    Of two as near the later one counts; frames more than `slack` steps after the end are not taken.
    """
    anchors = F.array_distinct(F.array(F.col(start), F.col(start) + middle, F.col(end)))
    asked = ticks.select(key, start, end).distinct().withColumn(at, F.explode(anchors))
    before = asof(asked, frames.select(key, at), key, at, [], "backward").withColumnRenamed("at_found", "back_")
    both = asof(before, frames.select(key, at), key, at, [], "forward")
    after = F.when(F.col("at_found") <= F.col(end) + slack, F.col("at_found"))
    nearest = F.when(F.col("back_").isNull() | (after - F.col(at) <= F.col(at) - F.col("back_")), after).otherwise(F.col("back_"))
    held = both.groupBy(key, start, end).agg(F.array_sort(F.collect_set(nearest)).alias(name))
    return ticks.join(held, [key, start, end], "left")


def look_ahead(df: DataFrame, key: list[str], order: list[str], value: Column, fits: Column, most: int | None, name: str) -> DataFrame:
    """The first fitting value of the next `most` rows (None: of all later rows)."""
    w = _w(key, order).rowsBetween(1, Window.unboundedFollowing if most is None else most)
    return df.withColumn(name, F.first(F.when(fits, value), True).over(w))


def future(df: DataFrame, key: list[str], order: list[str], value: str, offset: int, name: str) -> DataFrame:
    """The value `offset` rows on, that of the key's last row beyond its end."""
    w = _w(key, order)
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = F.count("*").over(w.rowsBetween(offset, offset)) > 0
    return df.withColumn(name, F.when(inside, F.lead(value, offset).over(w)).otherwise(last))


def padded_chunk(df: DataFrame, key: list[str], order: list[str], value: str, horizon: int, name: str = "chunk") -> DataFrame:
    """The values of this and the next horizon - 1 rows; the last one repeats beyond the end."""
    w = _w(key, order).rowsBetween(0, horizon - 1)
    got = F.collect_list(value).over(w)
    return df.withColumn("got_", got).withColumn(name, F.concat("got_", F.array_repeat(F.element_at("got_", -1), F.lit(horizon) - F.size("got_")))).drop("got_")


def chunks(df: DataFrame, key: list[str], step: str, value: str, size: int) -> DataFrame:
    """Non-overlapping pieces of `size` steps, padded with their last value, and a mask of what is real."""
    bucket = F.floor(F.col(step) / size).cast("bigint").alias("piece")
    held = df.groupBy(*key, bucket).agg(F.array_sort(F.collect_list(F.struct(step, value))).alias("rows_"))
    got = F.transform("rows_", lambda x: x[value])
    n = F.size("rows_")
    return held.select(*key, "piece", F.concat(got, F.array_repeat(F.element_at(got, -1), size - n)).alias("chunk"), n.cast("bigint").alias("n_valid"))


def running_offset(df: DataFrame, order: list[str], length: str, partition: list[str] | None = None, name: str = "offset") -> DataFrame:
    """The sum of the lengths before each row.

    Without a partition a numeric first column deals the rows to ranges, whose
    sums are added up apart; rows ordered by other columns alone go through
    one task.
    """
    if not partition and isinstance(df.schema[order[0]].dataType, NumericType):
        bounds = sorted(set(df.approxQuantile(order[0], [i / RANGES for i in range(1, RANGES)], 0.25 / RANGES)))  # RANGES at most
        place = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col(order[0]))) if bounds else F.lit(0)
        dealt = df.withColumn("range_", F.when(F.col(order[0]).isNull(), F.lit(-1)).otherwise(place))
        sums = dealt.groupBy("range_").agg(F.sum(length).alias("sum_"))
        before = sums.select("range_", F.coalesce(F.sum("sum_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
        w = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return dealt.join(F.broadcast(before), "range_").withColumn(name, F.sum(length).over(w) - F.col(length) + F.col("before_")).select(*df.columns, name)
    w = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(length).over(w) - F.col(length))


def bank(df: DataFrame, key: list[str], order: list[str], line: str, last: int | None, inclusive: bool, name: str = "bank") -> DataFrame:
    """The lines before a row (with its own, if inclusive), or the last few of them."""
    w = _w(key, order).rowsBetween(Window.unboundedPreceding if last is None else -(last - (1 if inclusive else 0)), 0 if inclusive else -1)
    return df.withColumn(name, F.coalesce(F.collect_list(line).over(w), F.array()))


def drop_consecutive(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows that repeat the value of the row just before go."""
    return changes(df, key, order, value, "new_").filter("new_").drop("new_")


def first_per(df: DataFrame, by: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank_", F.row_number().over(_w(by, order))).filter(F.col("rank_") <= n).drop("rank_")


def sessions(df: DataFrame, key: list[str], order: list[str], opens: Column, name: str = "session") -> DataFrame:
    """Numbers rows by the opening markers up to them; rows before the first are 0."""
    w = _w(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(opens, 1).otherwise(0)).over(w).cast("bigint"))


def tick_grid(episodes: DataFrame, key: str, length: str, demo_end: str, demo_width: int, width: int = 16) -> DataFrame:
    """(key, last, end): tick ends of each episode and the end before.

    Demo ticks end at multiples of demo_width below demo_end, then come
    multiples of width after it; the last step ends the last tick.
    """
    t, d = F.col(length), F.col(demo_end)
    up = lambda a, b, s: F.when(a <= b, F.sequence(a, b, s)).otherwise(F.array().cast("array<bigint>"))
    demo = up(F.lit(demo_width).cast("bigint"), (d - 1).cast("bigint"), F.lit(demo_width).cast("bigint"))
    rest = up(((F.floor(d / width) + 1) * width).cast("bigint"), (t - 1).cast("bigint"), F.lit(width).cast("bigint"))
    ends = F.array_sort(F.array_distinct(F.concat(demo, rest, F.array((t - 1).cast("bigint")))))
    ticks = episodes.select(key, F.explode(ends).alias("end")).filter(F.col("end") >= 0)
    return ticks.withColumn("last", F.coalesce(F.lag("end").over(Window.partitionBy(key).orderBy("end")), F.lit(-1)))


def in_window_samples(last: Column, end: Column, stride: int = 4) -> Column:
    """Steps sampled in a tick: every stride-th from its start, and its end."""
    start = F.greatest(last, F.lit(0)).cast("bigint")
    return F.array_sort(F.array_union(F.sequence(start, end.cast("bigint"), F.lit(stride).cast("bigint")), F.array(end.cast("bigint"))))


def visible(queries: DataFrame, items: DataFrame, key: str, at: str, start: str, until: str, budget: int, tiebreak: str) -> DataFrame:
    """For each query the most recent `budget` items with start <= at and (until < 0 or at < until)."""
    q, i = queries.alias("q"), items.alias("i")
    seen = (F.col(f"i.{start}") <= F.col(f"q.{at}")) & ((F.col(f"i.{until}") < 0) | (F.col(f"q.{at}") < F.col(f"i.{until}")))
    joined = q.join(i, (F.col(f"q.{key}") == F.col(f"i.{key}")) & seen).select("q.*", *[F.col(f"i.{c}") for c in items.columns if c != key])
    w = Window.partitionBy(key, at).orderBy(F.desc(start), F.desc(tiebreak))
    return joined.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= budget)


def offset_grid(episodes: DataFrame, key: str, length: str, offsets: list[int], width: int = 16) -> DataFrame:
    """(key, offset, last, end): a grid of ticks for each offset; the last step ends the last tick.

    Grid 0 starts a tick's width after step 0; a later one has its first tick end at its offset.
    """
    t = F.col(length)
    up = lambda a: F.when(a <= t - 1, F.sequence(a, (t - 1).cast("bigint"), F.lit(width).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    ends = lambda o: F.array_union(up(F.lit(o if o else width).cast("bigint")), F.array((t - 1).cast("bigint")))
    grids = F.array(*[F.struct(F.lit(o).cast("bigint").alias("offset"), F.array_sort(ends(o)).alias("ends")) for o in offsets])
    ticks = episodes.filter(t > 0).select(key, F.explode(grids).alias("g_")).select(key, "g_.offset", F.posexplode("g_.ends").alias("n_", "end"), F.col("g_.ends").alias("e_"))
    return ticks.select(key, "offset", F.when(F.col("n_") > 0, F.get("e_", F.col("n_") - 1)).otherwise(F.lit(0)).alias("last"), "end")


def window_before(ticks: DataFrame, rows: DataFrame, key: str, last: str, at: str, values: list[str], width: int = 16) -> DataFrame:
    """ticks and, as array before, the rows (at, values) of the width steps before each one's start.

    A row is copied to the one or two buckets of `width` steps that a window can overlap, so that the join is on
    equal keys; last is unique within a key.
    """
    held = F.struct(at, *values)
    a = ticks.select(key, last, F.explode(F.array_distinct(F.array(F.floor((F.col(last) - width) / width), F.floor((F.col(last) - 1) / width)))).alias("b_"))
    b = rows.select(F.col(key).alias("k_"), F.floor(F.col(at) / width).alias("c_"), F.col(at).alias("t_"), held.alias("x_"))
    near = a.join(b, (F.col(key) == F.col("k_")) & (F.col("b_") == F.col("c_")) & (F.col("t_") >= F.col(last) - width) & (F.col("t_") < F.col(last)))
    found = near.groupBy(key, last).agg(F.array_sort(F.collect_list("x_")).alias("before"))
    return ticks.join(found, [key, last], "left").withColumn("before", F.coalesce("before", F.slice(F.array(F.lit(None).cast(rows.select(held.alias("x")).schema["x"].dataType)), 1, 0)))


def held_press(df: DataFrame, key: str, order: list[str], step: str, text: Column, done: Column, most: int = 31) -> DataFrame:
    """df with held: the text of the run before, where that was a press whose completion isn't known yet.

    It holds for `most` steps of the new run. done: whether the completion of
    the run before is known at the row.
    """
    w = _w(key, order)
    marked = runs(df.withColumn("text_", text), key, order, "text_", "run_")
    firsts = marked.withColumn("since_", F.min(step).over(Window.partitionBy(*key, "run_")))
    # The row before the run's first one has the text of the run before.
    started = firsts.withColumn("was_", F.when(F.col(step) == F.col("since_"), F.lag("text_").over(w)))
    before = started.withColumn("was_", F.first("was_", True).over(Window.partitionBy(*key, "run_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    holds = F.contains(F.lower("was_"), F.lit("press the")) & (F.col(step) - F.col("since_") <= most) & ~done
    return before.withColumn("held", F.when(F.coalesce(holds, F.lit(False)), F.col("was_"))).drop("text_", "run_", "since_", "was_")


def future_steps(step: Column, last: Column, offsets: list[int]) -> Column:
    """array<struct<at, valid>>: steps at the offsets, clamped to the last one; valid while they still grow."""
    at = [F.least(step + o, last) for o in offsets]
    before = [step, *at[:-1]]
    return F.array(*[F.struct(a.cast("bigint").alias("at"), (a > b).alias("valid")) for a, b in zip(at, before)])


def segment_steps(df: DataFrame, key: list[str], order: list[str], length: str, values: list[str]) -> DataFrame:
    """A row for each step of consecutive segments: its step in the key, its step in the segment, the segment's start."""
    placed = running_offset(df, order, length, key, "start").filter(F.col(length) > 0)
    return placed.select(*key, *order, *values, F.col("start").cast("bigint").alias("start"), F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col(length) - 1).cast("bigint"))).alias("within")).withColumn("step", F.col("start") + F.col("within"))


def chain_gaps(df: DataFrame, key: list[str], order: list[str], first: list[str], last: list[str], most: float) -> DataFrame:
    """df with gap, the distance of a piece's first place from the last one of the piece before, and broken, if that is over `most`."""
    w = _w(key, order)
    total = sum((F.col(a) - F.lag(b).over(w)) * (F.col(a) - F.lag(b).over(w)) for a, b in zip(first, last))
    gap = F.sqrt(total)
    return df.withColumn("gap", gap).withColumn("broken", F.coalesce(F.col("gap") > most, F.lit(False)))


def numbered(df: DataFrame, key: list[str], order: list[str], accepted: Column, name: str = "nth") -> DataFrame:
    """Accepted rows counted from 1 within their key; others null."""
    w = _w(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.when(accepted, F.count_if(accepted).over(w)))


def occurrences(df: DataFrame, key: list[str], order: list[str], opens: Column, closes: Column, name: str = "session") -> DataFrame:
    """Rows within sessions, numbered from 1: a marker opens one, another closes it; rows outside of all go."""
    opened = sessions(df, key, order, opens, name).filter(F.col(name) > 0)
    v = _w([*key, name], order).rowsBetween(Window.unboundedPreceding, -1)
    return opened.withColumn("shut_", F.coalesce(F.count_if(closes).over(v), F.lit(0))).filter("shut_ = 0").drop("shut_")
