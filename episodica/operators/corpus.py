"""Building a corpus of records: splits, sampling, gates on evidence, kept lines, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions import text as T

from . import spatial


def split_by_modulo(key: Column, n: int = 10) -> Column:
    return F.when(key % n == 0, "val").otherwise("train")


def split_by_range(key: Column, low: int, high: int) -> Column:
    return F.when(key.between(low, high), "val").otherwise("train")


def split_by_top(df: DataFrame, group: list[str], key: str, n: int, name: str = "split") -> DataFrame:
    """The n largest keys of each group validate."""
    w = Window.partitionBy(*group).orderBy(F.desc(key))
    return df.withColumn(name, F.when(F.row_number().over(w) <= n, "val").otherwise("train"))


def shard(key: Column, n: int, of: int) -> Column:
    return F.pmod(key, F.lit(of)) == n


def sample_negatives(df: DataFrame, positive: Column, ratio: int, key: list[str], seed: str = "0") -> DataFrame:
    """All positives and at most `ratio` times as many negatives, the least by an MD5 of seed and key (then by key).

    A null predicate is negative. The last digest prefix that is let in is found
    from counts by prefix, and only rows of that one are ranked; none is collected.
    """
    marked = df.withColumn("pos_", F.coalesce(positive, F.lit(False)))
    hashed = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]))
    marked = marked.withColumn("h_", hashed).withColumn("b_", F.substring("h_", 1, 4))
    # One row a prefix, 65,536 at most.
    counts = marked.groupBy("b_").agg(F.count_if(~F.col("pos_")).alias("n_"), F.count_if("pos_").alias("p_"))
    total = Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    room = counts.select("b_", (F.sum("p_").over(Window.partitionBy()) * ratio - F.coalesce(F.sum("n_").over(total), F.lit(0))).alias("room_"), "n_")
    placed = marked.filter("not pos_").join(F.broadcast(room), "b_").filter("room_ > 0")
    whole, last = placed.filter("n_ <= room_"), placed.filter("n_ > room_")
    ranked = last.withColumn("nth_", F.row_number().over(Window.partitionBy("b_").orderBy("h_", *key))).filter("nth_ <= room_")
    return marked.filter("pos_").select(*df.columns).unionByName(whole.select(*df.columns)).unionByName(ranked.select(*df.columns))


def repeat(df: DataFrame, times: Column, name: str = "copy") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), times)))


def evident(line: Column, window: Column, before: Column, first: Column, last: Column, late: Column) -> Column:
    """Does the picture bear out an event line? The first rule that fits decides; none means yes.

    window, before: detections (name, r, c) of the tick and of the one before
    it; first, last: those of the tick's first and last frame; late: of its
    last two frames, as an array of arrays. A detection is near within the
    rule's radius in pixels.
    """
    s, at = F.lower(T.text(line)), T.coords(line)
    has = lambda w: s.contains(w)
    named = lambda dets, part: F.filter(F.coalesce(dets, F.array()), lambda d: d["name"].contains(part))
    near = lambda dets, p, radius: spatial.any_near(dets, p["r"], p["c"], radius)
    head, tail, some = F.get(at, 0), F.element_at(at, -1), F.size(at) > 0
    moving = F.when(has("container"), "container").otherwise("cube")
    now = F.filter(window, lambda d: F.contains(d["name"], moving))
    then = F.filter(F.coalesce(before, F.array()), lambda d: F.contains(d["name"], moving))
    # A member of the tick at least 6 pixels from all of its class before.
    strayed = F.exists(now, lambda d: ~F.exists(then, lambda p: (p["r"] - d["r"]) * (p["r"] - d["r"]) + (p["c"] - d["c"]) * (p["c"] - d["c"]) < 36))
    covered = F.exists(at, lambda p: near(named(first, "cube"), p, 16) & ~near(named(last, "cube"), p, 16) & near(named(last, "container"), p, 16) & ~near(named(first, "container"), p, 16))
    rules = (
        (has("appeared at") & ~has("highlight") & some, near(window, head, 14) & ~near(before, head, 14)),
        (has("highlight appeared") & some, near(named(window, "highlight"), head, 22)),
        (has("arc tip moved") & (F.size(at) >= 2), near(named(window, "arc_tip"), tail, 12)),
        (has("is being moved") | has("moved to") | has("moved from"), (F.size(then) == 0) | strayed),
        (has("were placed over the cubes"), covered),
        ((has("put down") | has("put it down")) & some, F.forall(F.coalesce(late, F.array()), lambda frame: near(frame, tail, 16))),
        (has("reached the target") & some, near(named(window, "cube"), head, 22)),
    )
    out = F.lit(True)
    for rule, holds in reversed(rules):
        out = F.when(rule, F.coalesce(holds, F.lit(False))).otherwise(out)
    return out


def kept_lines(df: DataFrame, tick: list[str], order: list[str], line: str, evidence: Column) -> DataFrame:
    """Evident lines, the first of each kind (text without coordinates) in a tick.

    A line without evidence doesn't block a later one of its kind.
    """
    good = df.filter(evidence).withColumn("kind_", T.blank_coords(F.col(line)))
    w = Window.partitionBy(*tick, "kind_").orderBy(*order)
    return good.withColumn("nth_", F.row_number().over(w)).filter("nth_ = 1").drop("nth_", "kind_")


def targets(lines: DataFrame, ticks: DataFrame, tick: list[str], order: list[str], line: str) -> DataFrame:
    """Per tick its lines joined by line feeds in order; `NONE` without any."""
    held = lines.groupBy(*tick).agg(F.array_sort(F.collect_list(F.struct(*order, line))).alias("l_"))
    joined = ticks.join(held, tick, "left")
    return joined.withColumn("target", F.when(F.col("l_").isNull(), "NONE").otherwise(F.array_join(F.transform("l_", lambda x: x[line]), "\n"))).drop("l_")


def reasoner_target(phase: Column, own: Column, waiting: Column, following: Column, held: Column) -> Column:
    """What the reasoner is to say, by precedence: demo, waiting, held, next real one, done."""
    return F.when(phase == "demo", "watch the demonstration; remain static").when(waiting.isNotNull(), waiting).when(held.isNotNull(), held).when(own.isNotNull(), own).otherwise(F.coalesce(following, F.lit("all tasks completed; remain static")))


def knowable(target: Column, bank: Column, radius: float = 30) -> Column:
    """The target, without ` at <r, c>` if its coordinate is far from all of the bank's."""
    at, known = T.coords(target), F.flatten(F.transform(bank, lambda x: T.coords(x)))
    near = F.exists(at, lambda p: spatial.any_near(known, p["r"], p["c"], radius))
    return F.when((F.size(at) == 0) | near, target).otherwise(T.without_at(target))
