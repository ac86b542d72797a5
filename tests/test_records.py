"""Training records against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from episodica.operators import corpus, records


def data(spark):
    r = random.Random(4)
    ticks = [(e, t, 4 * t, "demo" if t < 1 else "execution") for e in range(5) for t in range(12)]
    said = ["moved to", "completed: put it down at", "a cube appeared at"]
    lines = [(e, t, n, f"[event] {r.choice(said)} <{r.randrange(50)}, {r.randrange(50)}>", r.random() < 0.7) for e, t, _, _ in ticks if e != 3 for n in range(r.choice([0, 0, 1, 3]))]
    return ticks, lines, spark.createDataFrame(ticks, "ep int, tick int, since int, phase string"), spark.createDataFrame(lines, "ep int, tick int, n int, line string, good boolean")


def kept(lines):
    out, seen = [], set()
    for e, t, n, line, good in sorted(lines):
        kind = (e, t, re.sub("<[^>]*>", "<>", line))
        if good and kind not in seen:
            seen.add(kind)
            out.append((e, t, n, line))
    return out


@pytest.mark.parametrize("last,inclusive", [(8, False), (2, True), (None, True), (None, False)])
def test_banks(spark, last, inclusive):
    ticks, lines, a, b = data(spark)
    own = corpus.kept_lines(b, ["ep", "tick"], ["n"], "line", F.col("good"))
    got = {(r.ep, r.tick): r.bank for r in records.tick_banks(a, own, "ep", "tick", ["n"], "line", last, inclusive).collect()}
    for e, t, _, _ in ticks:
        want = [x[3] for x in kept(lines) if x[0] == e and (x[1] < t or inclusive and x[1] == t)]
        assert got[e, t] == (want if last is None else want[-last:])
    assert len(got) == len(ticks)


def test_writer_and_reasoner(spark):
    ticks, lines, a, b = data(spark)
    dets = a.select("ep", "tick", F.explode(F.sequence(F.col("since"), F.col("since") + 3)).alias("frame")).withColumn("dets", F.when(F.col("frame") % 2 == 0, F.array(F.struct(F.lit("cube").alias("name"), F.lit(1).alias("r"), F.col("frame").alias("c")))))
    found = records.writer(a.withColumn("expected", F.lit("x")), b, dets, "ep", "tick", ["n"], "line", F.col("good"), corpus.split_by_modulo(F.col("ep"), 5)).collect()
    assert len(found) == len(ticks)
    for r in found:
        own = [x[3] for x in kept(lines) if x[:2] == (r.ep, r.tick)]
        assert r.target == ("\n".join(own) or "NONE") and r.split == ("train" if r.ep % 5 else "val")
        assert r.seen.split("\n") == [f"+{k}: " + ("(none)" if (r.since + k) % 2 else f"cube<1, {r.since + k}>") for k in range(4)]
        assert r.copies == (1 if r.split == "val" or not own else 8 if "moved to" in r.target else 4 if "put it down" in r.target else 3 if len(own) > 1 else 1)
    none = F.lit(None).cast("string")
    steps = a.withColumns({"own": F.when(F.col("tick") % 3 > 0, F.concat(F.lit("pick at <"), F.col("tick") * 4, F.lit(", 10>"))), "waiting": none, "held": none, "following": F.when(F.col("tick") < 9, F.lit("go on"))})
    for r in records.reasoner(steps, b, "ep", "tick", ["n"], "line", F.col("good"), F.lit("train"), radius=12).collect():
        places = [tuple(map(int, p)) for x in kept(lines) if x[0] == r.ep and x[1] <= r.tick for p in re.findall(r"<(\d+), (\d+)>", x[3])]
        near = any((p[0] - 4 * r.tick) ** 2 + (p[1] - 10) ** 2 <= 144 for p in places)
        own = (f"pick at <{4 * r.tick}, 10>" if near else "pick") if r.tick % 3 else "go on" if r.tick < 9 else "all tasks completed; remain static"
        assert r.target == ("watch the demonstration; remain static" if r.tick < 1 else own)


def test_no_lines(spark):
    _, _, a, b = data(spark)
    got = records.writer(a.withColumn("expected", F.lit("x")), b.limit(0), spark.createDataFrame([], "ep int, tick int, frame int, dets array<struct<name:string,r:int,c:int>>"), "ep", "tick", ["n"], "line", F.col("good"), F.lit("train"))
    assert {(r.target, r.seen, tuple(r.bank), r.copies) for r in got.collect()} == {("NONE", "", (), 1)}
