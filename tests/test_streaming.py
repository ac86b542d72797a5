"""The claim machine by hand, and the same over a stream as in batch."""

import json

from pyspark.sql import functions as F

from episodica.streaming import claims, machines

SCHEMA = "ep string, plan array<string>, tick int, step int, ord int, fired int, refuted boolean, text string"


def verdicts(spark, ticks, rules=None, plan=("pick a", "place b")):
    rows = [("e", list(plan), k, s, n, f, bool(r), t) for k, (s, f, r, lines) in enumerate(ticks) for n, t in enumerate(lines or [None])]
    got = claims.batch(spark.createDataFrame(rows, SCHEMA), rules or claims.Rules()).collect()
    return [(r.tick, r.verdict) for r in got]


def test_admit_defer_reject(spark):
    got = verdicts(spark, [(10, None, 0, ["completed: pick a", "completed: place b", "note", "note"]), (20, 15, 0, []), (30, 29, 0, ["completed: place b"])])
    assert got == [(0, "defer"), (0, "reject"), (0, "admit"), (0, "reject-dup"), (1, "admit-pending"), (2, "admit")]


def test_settling(spark):
    got = verdicts(spark, [(10, 10, 0, ["completed: pick a"]), (20, 10, 0, ["completed: pick a"]), (30, 10, 0, [])], claims.Rules(settle=2))
    assert got == [(0, "settling"), (1, "settling-dup"), (2, "settled")]


def test_auto_and_phantom(spark):
    assert verdicts(spark, [(10, 5, 0, []), (26, 5, 0, [])])[-1] == (1, "auto")
    got = verdicts(spark, [(10, 8, 1, ["completed: pick a"]), (20, 8, 1, []), (30, 8, 1, []), (40, 8, 0, [])])
    assert got == [(0, "refute-defer"), (2, "phantom")]


def test_stream_equals_batch(spark, tmp_path):
    lines = ["completed: pick a", None, "x", "x", "completed: place b", None]
    rows = [(f"e{e}", ["pick a", "place b"], k, 10 * k + 10, 0, 10 * k + 5 if (k + e) % 2 else None, (k + e) % 5 == 0, lines[(k + e) % 6]) for e in range(4) for k in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = claims.whole_ticks(df)
    spark.conf.set(*machines.STORE)
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for part in range(2):  # two triggers, in order
        whole.filter((F.col("tick") >= 4 * part) & (F.col("tick") < 4 * part + 4)).coalesce(1).write.mode("append").parquet(source)
        query = claims.stream(spark.readStream.schema(whole.schema).parquet(source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    key = lambda r: json.dumps(r.asDict(), sort_keys=True)
    assert sorted(map(key, spark.read.parquet(target).collect())) == sorted(map(key, claims.batch(df).collect()))


def test_event_time_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.write.parquet(source)
    counts = claims.windowed_counts(spark.readStream.schema(events.schema).parquet(source), "ts", "10 minutes", "1 hour", ["event_type"])
    query = counts.writeStream.format("memory").queryName("counts_").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counts_").agg(F.sum("count")).first()[0] == events.count()
