"""Lookups and checks between tables of an episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions import text as T

from . import ordered


def segment_of(rows: DataFrame, segments: DataFrame, key: str, at: str, start: str, end: str, values: list[str]) -> DataFrame:
    """rows with the values of the segment [start, end) that holds them; null outside of all."""
    found = ordered.asof(rows, segments.withColumnRenamed(start, at), key, at, [end, *values])
    inside = F.col(at) < F.col(end)
    return found.select(*rows.columns, *[F.when(inside, F.col(v)).alias(v) for v in values])


def closest_length(occurrences: DataFrame, wanted: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of each key's occurrences the one whose length is closest to the wanted one, the first of several."""
    joined = occurrences.join(wanted, key)
    return joined.groupBy(*key).agg(F.min_by(order, F.struct(F.abs(F.col("length") - F.col("wanted")), F.col(order))).alias(order))


def either_contains(left: DataFrame, right: DataFrame, key: str, name: str, other: str, order: str) -> DataFrame:
    """left with the first row of right (in its order) where either name contains the other."""
    near = (left[key] == right[key]) & (left[name].contains(right[other]) | right[other].contains(left[name]))
    joined = left.join(right, near, "left").drop(right[key])
    return joined.groupBy(*left.columns).agg(F.min_by(other, order).alias(other))


def latest_places(lines: DataFrame, key: str, order: list[str], line: str) -> DataFrame:
    """(key, color, r, c): where each container was last put, folded from cover and move lines."""
    low, ending = F.lower(F.col(line)), "_cube_container"
    place = lambda color, p: F.struct(color.alias("color"), p["r"].alias("r"), p["c"].alias("c"))
    named = F.filter(T.detections(F.col(line)), lambda d: d["name"].endswith(ending))
    covers = F.transform(named, lambda d: place(F.substring(d["name"], F.lit(1), F.length(d["name"]) - len(ending)), d))
    # A move names a color and two places; the second one is where it ends.
    color, to = F.regexp_extract(low, r"the (\w+) cube container moved from ", 1), F.get(T.coords(low), 1)
    moves = F.when((color != "") & to.isNotNull(), F.array(place(color, to))).otherwise(F.slice(covers, 1, 0))
    at = lines.select(key, *order, F.posexplode(F.when(low.contains("were placed over the cubes"), covers).otherwise(moves)).alias("n_", "x"))
    last = F.max_by(F.struct(F.col("x.r").alias("r"), F.col("x.c").alias("c")), F.struct(*order, "n_"))
    return at.groupBy(key, F.col("x.color").alias("color")).agg(last.alias("p")).select(key, "color", "p.r", "p.c")


def mismatches(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that one side lacks or whose values differ; empty if the tables agree."""
    x, y = a.select(*key, F.col(value).alias("a_")), b.select(*key, F.col(value).alias("b_"))
    both = x.withColumn("in_a", F.lit(True)).join(y.withColumn("in_b", F.lit(True)), key, "full")
    return both.filter(F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("a_").eqNullSafe(F.col("b_"))).drop("in_a", "in_b")


def allowed(df: DataFrame, keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of allowed keys, allowed keys that df lacks)."""
    return df.join(keys, key, "left_semi"), keys.join(df, key, "left_anti")


def duplicates_claim(bank: Column, line: Column, radius: float = 14) -> Column:
    """Does the bank hold a line of the same form whose first coordinate is within the L1 radius?"""
    at = F.get(T.coords(line), 0)

    def same(x):
        p = F.get(T.coords(x), 0)
        return (T.blank_coords(x) == T.blank_coords(line)) & (F.abs(p["r"] - at["r"]) + F.abs(p["c"] - at["c"]) <= radius)

    return F.coalesce(F.exists(bank, lambda x: F.coalesce(same(x), F.lit(False))), F.lit(False))


def best_scores(scores: DataFrame, phrase: list[str], frame: str, score: str, hit: float = 0.15) -> DataFrame:
    """Per phrase: its mean best score per frame and the share of frames that reach `hit`."""
    best = scores.groupBy(*phrase, frame).agg(F.max(score).alias("best_"))
    return best.groupBy(*phrase).agg(F.avg("best_").alias("mean_best"), F.avg((F.col("best_") >= hit).cast("double")).alias("hit_rate"), F.count("*").alias("frames"))


def phrase_report(scores: DataFrame, frames: DataFrame, phrase: list[str], frame: str, score: str, near: Column, hit: float = 0.15) -> DataFrame:
    """Per phrase over its frames: mean of the best score near the place (0 without one), share of hits, false hits a frame.

    frames has phrase and frame, those without a detection too; a false hit reaches `hit` elsewhere.
    """
    there = F.coalesce(near, F.lit(False))
    best = scores.groupBy(*phrase, frame).agg(F.max(F.when(there, F.col(score))).alias("best_"), F.count_if(~there & (F.col(score) >= hit)).alias("false_"))
    whole = frames.select(*phrase, frame).distinct().join(best, [*phrase, frame], "left").withColumn("best_", F.greatest(F.coalesce("best_", F.lit(0.0)), F.lit(0.0)))
    return whole.groupBy(*phrase).agg(F.avg("best_").alias("mean_best"), F.avg((F.col("best_") >= hit).cast("double")).alias("hit_rate"), (F.sum(F.coalesce("false_", F.lit(0))) / F.count("*")).alias("false_per_frame"), F.count("*").alias("frames"))


def step_medians(steps: DataFrame, plan: DataFrame, key: str, text: str) -> DataFrame:
    """steps and (r, c) of their plan's first step of the same text that isn't a pick; plan has key, text, nth, kind, r, c."""
    form = F.trim(F.lower(F.col(text)))
    first = plan.filter("kind <> 'pick'").groupBy(F.col(key).alias("k_"), form.alias("t_")).agg(F.min_by(F.struct("r", "c"), "nth").alias("m_"))
    return steps.join(first, (F.col(key) == F.col("k_")) & (form == F.col("t_")), "left").select(*steps.columns, F.col("m_.r").alias("r"), F.col("m_.c").alias("c"))


def all_near(targets: Column, *found: Column, radius: float) -> Column:
    """Is every target within the radius of a point of one of the arrays? True without targets."""
    return F.forall(targets, lambda t: F.exists(F.concat(*[F.coalesce(f, F.slice(targets, 1, 0)) for f in found]), lambda p: (p["r"] - t["r"]) * (p["r"] - t["r"]) + (p["c"] - t["c"]) * (p["c"] - t["c"]) <= radius * radius))


def phrase_frames(frames: DataFrame, phrases: DataFrame) -> DataFrame:
    """Every frame with every phrase, as rows of the frames' own partitions: the phrases, a bounded list, are an array.

    The phrases are checked to be 10,000 at most, since each task holds them.
    """
    held = phrases.agg(F.collect_list(F.struct(*phrases.columns)).alias("p_"))
    held = held.select(F.when(F.size("p_") > 10_000, F.raise_error(F.lit("more than 10,000 phrases")).cast(held.schema["p_"].dataType)).otherwise(F.col("p_")).alias("p_"))
    return frames.join(F.broadcast(held), F.lit(True), "left").select(*frames.columns, F.explode("p_").alias("p_")).select(*frames.columns, "p_.*")
