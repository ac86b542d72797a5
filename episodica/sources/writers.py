"""Sinks: split-routed records, idempotent and guarded writes, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_split(df: DataFrame, path: str, split: list[str], mode: str = "overwrite") -> None:
    """JSON lines in a folder for each split."""
    df.write.mode(mode).partitionBy(*split).json(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> int:
    """Append the rows whose key isn't at the path yet; how many those are."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(key)
    try:
        fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti")
    except Exception as error:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def guarded(df: DataFrame, path: str, selection: list[str]) -> None:
    """Overwrite only a build of the same selection."""
    spark, mark = df.sparkSession, f"{path.rstrip('/')}.selection"
    wanted = spark.createDataFrame([(x,) for x in sorted(selection)], "item string")
    try:
        have = spark.read.parquet(mark)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        if have.exceptAll(wanted).union(wanted.exceptAll(have)).limit(1).count():
            raise ValueError(f"{path} holds a build of another selection")
    df.write.mode("overwrite").parquet(path)
    wanted.coalesce(1).write.mode("overwrite").parquet(mark)


def quarantine(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the first reason that holds)."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(reasons.items()):
        reason = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def require(df: DataFrame, what: str) -> None:
    """Fails if the frame of violations has a row."""
    if rows := df.limit(10).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def append_content(df: DataFrame, path: str, content: str) -> int:
    """Append contents that aren't at the path yet, under their SHA-256 (column address); how many those are."""
    return append_new(df.withColumn("address", F.sha2(F.col(content).cast("binary"), 256)), path, ["address"])


def meta_family(path: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Write each part as JSON lines under its name, and an index (part, rows), which is returned."""
    spark, counts = next(iter(parts.values())).sparkSession, []
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
        counts.append((name, spark.read.schema(df.schema).json(f"{path.rstrip('/')}/{name}").count()))
    index = spark.createDataFrame(counts, "part string, rows bigint")
    index.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/index")
    return index


def ragged(df: DataFrame, key: str, step: str, name: str, value: str, names: list[str]) -> DataFrame:
    """A row a key with an array for each name: its values by step, NaN where a step has none."""
    at = df.filter(F.col(name).isin(names)).groupBy(key, step).pivot(name, names).agg(F.first(value))
    own = [F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))).alias(n) for n in names]
    held = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(step, *own))).alias("rows_"))
    series = lambda n: F.transform("rows_", lambda x: x[n]).alias(n)
    return held.select(key, *map(series, names))


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """A small report's lines as a Markdown table, in one column `line`, numbered by `nth`."""
    from pyspark.sql import Window

    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    body = df.select((F.row_number().over(Window.orderBy(*order)) + 1).cast("bigint").alias("nth"), cells.alias("line"))
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, "|" + "-|" * len(df.columns))], "nth bigint, line string")
    return head.unionByName(body)
