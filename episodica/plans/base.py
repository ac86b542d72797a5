"""Shared inputs of the queries: the driver's tables as episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators import ordered

#: The same episodes in SQL: user_id is the episode, (ts, event_id) the order.
EV = """ev as (
  select user_id as ep, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as step,
    event_id, ts, event_type as sg, value, props from events)"""
#: The text before it stands for the predicted one.
TICKS = EV + """, tk as (
  select ep, step, sg as o, coalesce(lag(sg) over (partition by ep order by step), '') as p, value from ev)"""
#: Bank lines: a conversation's turns.
TURNS = "tu as (select conv_id as ep, turn, role, text from conversations)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ep, step, event_id, ts, sg, value, props."""
    e = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "ep", "event_type": "sg"})
    return ordered.steps(e, ["ep"], ["ts", "event_id"])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ep, step, o (oracle), p (predicted: the oracle's text one tick ago), value."""
    from pyspark.sql import Window

    e = episodes(spark, sf_dir)
    before = F.lag("sg").over(Window.partitionBy("ep").orderBy("step"))
    return e.select("ep", "step", F.col("sg").alias("o"), F.coalesce(before, F.lit("")).alias("p"), "value")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "ep")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: label, id, r, c (first two components scaled to whole pixels), score."""
    v = table(spark, sf_dir, "embeddings")
    at = lambda i: F.floor(F.col("embedding")[i].cast("double") * 256).cast("bigint")
    return v.select("label", F.col("vec_id").alias("id"), at(0).alias("r"), at(1).alias("c"), F.col("embedding")[2].cast("double").alias("score"))


PT = """pt as (
  select label, vec_id as id, floor(embedding[1]::double * 256)::bigint as r, floor(embedding[2]::double * 256)::bigint as c,
    embedding[3]::double as score from embeddings)"""
