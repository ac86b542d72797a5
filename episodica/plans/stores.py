"""Queries of sources and sinks: the driver's tables are written in the store's form and read back from it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.sources import bank, traces
from episodica.sources.files import scratch

from .base import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with t as (select label as ep, row_number() over (partition by label order by vec_id) - 1 as pos, count(*) over (partition by label) as steps, vec_id, embedding as v from embeddings)
select ep::bigint as ep, steps, pos, vec_id // 20 as start, case when vec_id % 3 = 0 then -1 else vec_id // 20 + vec_id % 7 end as until, v[1]::double as head, v[len(v)]::double as tail, len(v)::bigint as size from t""")
def token_bank(spark, d):
    """All vectors as tokens of their label's episode, written as archives and read back."""
    by, n = Window.partitionBy("label").orderBy("vec_id"), F.col("vec_id")
    until = F.when(n % 3 == 0, -1).otherwise(F.floor(n / 20) + n % 7)
    x = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("ep"), F.count("*").over(Window.partitionBy("label")).alias("steps"), (F.row_number().over(by) - 1).alias("pos"), F.floor(n / 20).alias("start"), until.alias("until"), F.col("embedding").alias("vector"))
    folder = scratch(spark)
    bank.write_bank(x, folder)
    at = lambda k: F.element_at("vector", k).cast("double")
    return bank.read_bank(spark, folder).select("ep", "steps", "pos", "start", "until", at(1).alias("head"), at(-1).alias("tail"), F.size("vector").cast("bigint").alias("size"))


_EVENT = "event_id bigint, user_id bigint, event_type string, value double, props string"


def _as_lines(spark, d) -> str:
    """The events as files of JSON lines; where they are."""
    folder = f"{scratch(spark)}/lines"
    table(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props")).alias("value")).write.text(folder)
    return folder


@query("select event_id, user_id, event_type, value, props from events")
def tailed_lines(spark, d):
    """The events through files of lines, in pieces of 64 KB."""
    found = traces.tail(spark, _as_lines(spark, d), suffix=".txt", bytes_per_partition=1 << 16)
    return found.select(F.from_json("line", _EVENT).alias("x")).select("x.*")


@query("select event_id, user_id, event_type, value, (props->>'k')::bigint as k from events")
def traced_events(spark, d):
    """The events as a stream of lines into a trace, and what the trace has."""
    folder = scratch(spark)
    lines = traces.tail(spark, _as_lines(spark, d), stream=True, suffix=".txt")
    x = lines.select(F.from_json("line", _EVENT).alias("x")).select("x.event_id", "x.user_id", "x.event_type", "x.value", F.get_json_object("x.props", "$.k").cast("bigint").alias("k"))
    query = traces.append(x, f"{folder}/trace", f"{folder}/marks").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return traces.trace(spark, f"{folder}/trace", x.schema)
