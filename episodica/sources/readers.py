"""Readers with explicit schemas, and keys from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Parts of an episode's file name: words, order, seed and task.
NAME = r"^(.*)_(\d+)_seed(\d+)_task(\d+)\.\w+$"


def parquet(spark: SparkSession, path: str, schema: StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df.select(*columns) if columns else df


def json_lines(spark: SparkSession, path: str, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """JSON lines; a line that doesn't fit fails the read, missing fields get their defaults."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(schema[name].dataType)))
    return df


def json_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def prefiltered_json(spark: SparkSession, path: str, schema: StructType, needle: str) -> DataFrame:
    """Parses only lines that hold the needle."""
    lines = spark.read.text(path).filter(F.col("value").contains(needle))
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def with_file(df: DataFrame, name: str = "file") -> DataFrame:
    return df.withColumn(name, F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def name_keys(file: Column) -> Column:
    """struct<words, ord, seed, task> of a file name; null if it has another form."""
    part = lambda i: F.regexp_extract(file, NAME, i)
    return F.when(file.rlike(NAME), F.struct(part(1).alias("words"), part(2).cast("int").alias("ord"), part(3).cast("int").alias("seed"), part(4).cast("int").alias("task")))


def stride_sample(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every n-th row of a small list in order, at most `most`, where n is as large as possible."""
    w = Window.orderBy(*order)
    n = df.withColumn("rn_", F.row_number().over(w) - 1).withColumn("n_", F.count("*").over(Window.partitionBy()))
    stride = F.greatest(F.lit(1), F.floor(F.col("n_") / most).cast("int"))
    return n.filter((F.col("rn_") % stride == 0) & (F.floor(F.col("rn_") / stride) < most)).drop("rn_", "n_")


def first_source(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """All rows; of a key that several parts have, those of the first part."""
    tagged = [p.withColumn("priority_", F.lit(n)) for n, p in enumerate(parts)]
    both = tagged[0]
    for p in tagged[1:]:
        both = both.unionByName(p)
    w = Window.partitionBy(*key)
    return both.withColumn("least_", F.min("priority_").over(w)).filter("priority_ = least_").drop("priority_", "least_")


def outcomes(nested: DataFrame, column: str, legacy: bool = False) -> DataFrame:
    """(task, ep, ok) of map<task, map<ep, text>>; values that are no booleans go (legacy: count as true)."""
    tasks = nested.select(F.explode(column).alias("task", "eps")).select("task", F.explode("eps").alias("ep", "value"))
    ok = F.col("value").try_cast("boolean")
    out = tasks.select("task", "ep", (F.coalesce(ok, F.lit(True)) if legacy else ok).alias("ok"))
    return out.filter("ok is not null")


def file_subset(files: DataFrame, name: str, positions: list[int]) -> DataFrame:
    """The files at the positions (from 0) of their order by name; a list of files, so one task ranks it."""
    nth = F.row_number().over(Window.orderBy(name)) - 1
    return files.withColumn("nth_", nth).filter(F.col("nth_").isin(positions)).drop("nth_")


def unparsed(files: DataFrame, file: str) -> DataFrame:
    """Files whose name has another form than NAME."""
    return files.filter(name_keys(F.col(file)).isNull())


def detection_cache(spark: SparkSession, path: str, wanted: DataFrame, key: str = "ep") -> tuple[DataFrame, DataFrame]:
    """((key, frame, name, r, c) of the files e<key>.json, keys of wanted without a file).

    A file maps frames to lists of [name, row, column].
    """
    texts = spark.read.option("wholetext", True).text(f"{path.rstrip('/')}/e*.json").withColumn("file_", F.col("_metadata.file_name"))
    numbered = texts.select(F.regexp_extract("file_", r"^e(\d+)\.json$", 1).try_cast("bigint").alias(key), F.from_json("value", "map<string,array<array<string>>>").alias("m")).filter(F.col(key).isNotNull())
    frames = numbered.select(key, F.explode("m").alias("frame", "dets")).select(key, F.col("frame").cast("bigint").alias("frame"), F.explode("dets").alias("d"))
    rows = frames.select(key, "frame", F.get("d", F.lit(0)).alias("name"), *[F.get("d", F.lit(i)).cast("double").cast("int").alias(n) for i, n in ((1, "r"), (2, "c"))])
    return rows.join(wanted.select(key).distinct(), key, "left_semi"), wanted.select(key).distinct().join(numbered.select(key), key, "left_anti")


def reassemble(segments: DataFrame, key: list[str], order: str, length: str, strict: bool = False, clip: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Segments with their offset in the whole, and whether orders are 0, 1, ... without a gap (strict: else an error).

    clip: bounds for columns of numbers or arrays of them.
    """
    w = Window.partitionBy(*key).orderBy(order)
    out = segments.withColumn("offset", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(length))
    out = out.withColumn("nth_", F.row_number().over(w) - 1)
    out = out.withColumn("complete", F.every(F.col("nth_") == F.col(order)).over(Window.partitionBy(*key))).drop("nth_")
    if strict:
        out = out.withColumn("complete", F.when(F.col("complete"), True).otherwise(F.raise_error(F.lit("a segment is missing")).cast("boolean")))
    for name, (low, high) in (clip or {}).items():
        held = lambda x: F.greatest(F.least(x, F.lit(high)), F.lit(low))  # noqa: B023, E731
        out = out.withColumn(name, F.transform(name, held) if isinstance(out.schema[name].dataType, ArrayType) else held(F.col(name)))
    return out


def missing(wanted: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    return wanted.join(have, key, "left_anti")
