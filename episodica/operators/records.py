"""Training records of the two agents: what the writer is to note at a tick, and what the reasoner is to say after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions import text as T

from . import corpus


def tick_banks(ticks: DataFrame, kept: DataFrame, key: str, tick: str, order: list[str], line: str, last: int | None = 8, inclusive: bool = False, name: str = "bank") -> DataFrame:
    """ticks with the lines of all ticks before (and of their own), or the last few of them, in order.

    Lines are numbered within their key, and a tick meets the numbers that it needs, so that no episode's lines
    are gathered but for a whole bank (last=None), which is as long as what it returns.
    """
    by = Window.partitionBy(key).orderBy(tick, *order)
    lines = kept.select(F.col(key).alias("k_"), F.col(tick).alias("t_"), F.row_number().over(by).alias("n_"), F.col(line).alias("l_"))
    counts = kept.groupBy(key, tick).agg(F.count("*").alias("own_"))
    so_far = F.sum(F.coalesce("own_", F.lit(0))).over(Window.partitionBy(key).orderBy(tick).rowsBetween(Window.unboundedPreceding, 0))
    placed = ticks.join(counts, [key, tick], "left").withColumn("to_", so_far - (0 if inclusive else F.coalesce("own_", F.lit(0))))
    first = F.lit(1) if last is None else F.greatest(F.col("to_") - (last - 1), F.lit(1))
    wanted = placed.filter("to_ > 0").select(key, tick, F.explode(F.sequence(first.cast("int"), F.col("to_").cast("int"))).alias("m_"))
    met = wanted.join(lines, (wanted[key] == lines["k_"]) & (wanted["m_"] == lines["n_"])).groupBy(key, tick).agg(F.array_sort(F.collect_list(F.struct("n_", "l_"))).alias("b_"))
    found = placed.join(met, [key, tick], "left").drop("own_", "to_")
    return found.withColumn(name, F.coalesce(F.transform("b_", lambda x: x["l_"]), F.array().cast("array<string>"))).drop("b_")


def seen_text(ticks: DataFrame, dets: DataFrame, key: str, tick: str, frame: str, since: str, name: str = "seen") -> DataFrame:
    """ticks with their frames' detections as text, a line `+steps: detections` for each frame.

    dets has key, tick, frame, and dets (array of name, r, c); since is the step that a tick's frames are counted from.
    """
    told = F.concat(F.lit("+"), (F.col(frame) - F.col(since)).cast("string"), F.lit(": "), T.shown(F.col("dets")))
    joined = dets.join(ticks.select(key, tick, since), [key, tick]).groupBy(key, tick).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f_"), told.alias("s_")))).alias("x_"))
    return ticks.join(joined, [key, tick], "left").withColumn(name, F.coalesce(F.array_join(F.transform("x_", lambda x: x["s_"]), "\n"), F.lit(""))).drop("x_")


def writer(ticks: DataFrame, lines: DataFrame, dets: DataFrame, key: str, tick: str, order: list[str], line: str, evidence: Column, split: Column, last: int = 8) -> DataFrame:
    """A record for each tick: phase, bank, seen, expected, target, and copies (1 outside of training).

    ticks has key, tick, since, phase and expected (what the reasoner said last); lines has key,
    tick, order and line; dets as for seen_text with frame.
    """
    kept = corpus.kept_lines(lines, [key, tick], order, line, evidence)
    told = corpus.targets(kept, ticks, [key, tick], order, line)
    whole = seen_text(tick_banks(told, kept, key, tick, order, line, last), dets, key, tick, "frame", "since")
    copies = F.when(split == "train", T.repeats(F.col("target"))).otherwise(1)
    return whole.withColumn("split", split).withColumn("copies", copies.cast("bigint"))


def reasoner(ticks: DataFrame, lines: DataFrame, key: str, tick: str, order: list[str], line: str, evidence: Column, split: Column, last: int | None = None, radius: float = 30) -> DataFrame:
    """A record for each tick: the bank with the tick's own lines, and the target as far as the bank lets one know it.

    ticks has key, tick, phase, own, waiting, following and held (texts; null: none).
    """
    kept = corpus.kept_lines(lines, [key, tick], order, line, evidence)
    whole = tick_banks(ticks, kept, key, tick, order, line, last, True)
    said = corpus.reasoner_target(F.col("phase"), F.col("own"), F.col("waiting"), F.col("following"), F.col("held"))
    return whole.withColumn("target", corpus.knowable(said, F.col("bank"), radius)).withColumn("split", split)
