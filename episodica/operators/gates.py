"""Filters, allow-lists and preconditions on rows and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First and last pixel row or column that counts as the border.
EDGE = (2, 253)


def canonical(df: DataFrame, offset: str, target: str) -> DataFrame:
    """Rows of the canonical grid that have something to say."""
    return df.filter((F.col(offset) == 0) & (F.upper(F.trim(F.col(target))) != "NONE"))


def scored(df: DataFrame, score: str, least: float) -> DataFrame:
    return df.filter(F.col(score) >= least)


def inside(r: Column, c: Column, low: float = 5, high: float = 251) -> Column:
    """Strictly between both bounds in both coordinates."""
    return (r > low) & (r < high) & (c > low) & (c < high)


def at_border(r: Column, c: Column, edge: tuple[int, int] = EDGE) -> Column:
    return (F.least(r, c) <= edge[0]) | (F.greatest(r, c) >= edge[1])


def known(df: DataFrame, names: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows joined with the dimension, how many rows have a key that it lacks)."""
    lost = df.join(names, key, "left_anti").agg(F.count("*").alias("lost"))
    return df.join(names, key), lost


def named(df: DataFrame, name: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows whose name is in include (None: any) and not in exclude; null names go."""
    keep = F.col(name).isNotNull() if include is None else F.col(name).isin(include)
    return df.filter(keep & ~F.col(name).isin(exclude or []))


def strict_subset(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the keys, which have to be some, but not all, of df's; else the query fails when it runs."""
    mine = df.select(key).distinct().withColumn("mine_", F.lit(True))
    asked = keys.select(key).distinct().withColumn("asked_", F.lit(True))
    check = mine.join(asked, key, "full").agg(F.count_if(F.col("mine_").isNull()).alias("strange_"), F.count_if(F.col("asked_").isNull()).alias("left_"))
    fails = F.when(F.col("strange_") > 0, F.raise_error(F.lit("keys that the table lacks"))).when(F.col("left_") == 0, F.raise_error(F.lit("not a strict subset")))
    passed = check.select(F.coalesce(fails.cast("boolean"), F.lit(True)).alias("passed_"))  # one row
    return df.join(asked.select(key), key, "left_semi").join(F.broadcast(passed), F.col("passed_")).drop("passed_")


def guarded_seeds(seed: Column, count: Column, first_held: int = 100) -> Column:
    """The seed; an error where a window of count seeds from it on reaches the ones that were trained on."""
    bad = (seed >= first_held) | (seed + count > first_held)
    return F.when(bad, F.raise_error(F.lit("seeds that were trained on")).cast("bigint")).otherwise(seed)


def leaks(seed: Column, count: Column, first_held: int = 100) -> Column:
    return (seed >= first_held) | (seed + count > first_held)
