"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import wraps
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor can reach.

    Where the setting is unset, /tmp/checkpoints serves a local master; on any
    other it is an error, since executors would write to disks of their own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    name = uuid.uuid4().hex
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
        # Results may be read until the end; only folders of our own are removed.
        atexit.register(shutil.rmtree, f"/tmp/checkpoints/{name}", ignore_errors=True)
    return f"{base.rstrip('/')}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the reliable checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a table in the shared folder; its size is known to the planner."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_of(uri: str):
    """(file system, path) of a folder that Spark names by a URI."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def slices(batches, rows: int = 256):
    """The record batches cut into pieces, so that long texts stay few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no such column (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


class Memo:
    """A bounded memo; what was added first goes first and is computed again when met."""

    def __init__(self, size: int):
        self.size, self.map = size, {}

    def values(self, keys: list, compute: Callable[[list], Iterable], longest: int = 256) -> list:
        """The value of each key (None can't be one); longer keys are computed, but not kept."""
        out = list(map(self.map.get, keys))
        if None in out:
            gaps = [k for k, v in enumerate(out) if v is None]
            new = list(dict.fromkeys([keys[k] for k in gaps]))
            found = dict(zip(new, compute(new)))
            for k in gaps:
                out[k] = found[keys[k]]
            self.map.update(found if max(map(len, new)) <= longest else {k: v for k, v in found.items() if len(k) <= longest})
            if len(self.map) > self.size:
                for k in list(islice(self.map, len(self.map) - self.size * 3 // 4)):
                    del self.map[k]
        return out


def runs(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Pieces of the batches with up to `most` characters or bytes in all (one row at least)."""
    for b in slices(batches, rows):
        values, start, held = b.column(column).to_pylist(), 0, 0
        for k, v in enumerate(values):
            if held and held + len(v or "") > most:
                yield b.slice(start, k - start), values[start:k]
                start, held = k, 0
            held += len(v or "")
        yield b.slice(start), values[start:]


def trimmed(run: Callable) -> Callable:
    """run, which gives free memory back to the system at the end of a task: its worker may stay idle for long."""

    @wraps(run)
    def out(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):  # other C libraries than glibc
            ctypes.CDLL(None).malloc_trim(0)

    return out


def added(b: pa.RecordBatch, schema: pa.Schema, *columns) -> pa.RecordBatch:
    n = len(schema) - len(columns)
    return batch_of(schema, *[b.column(k).cast(schema.field(k).type) for k in range(n)], *columns)


def arrow_schema(df: DataFrame, *more: tuple[str, pa.DataType]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    for name, kind in more:
        schema = schema.append(pa.field(name, kind))
    return schema


def spark_schema(df: DataFrame, *more: tuple[str, str]):
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    return StructType([*df.schema.fields, *[StructField(n, _parse_datatype_string(k)) for n, k in more]])
