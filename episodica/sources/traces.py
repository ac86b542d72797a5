"""Traces: files of lines that grow at their end, read from where the last read ended, and written exactly once.

`line_tail` is a source of (file, at, line) for batch and stream. A stream's
offset is how far each file has been read, always at a line's end: a line that is
still being written waits. Ranges are dealt in pieces of `bytesPerPartition`;
a line belongs to the piece that it starts in. Offsets can be replayed, since
files only grow: one that is shorter than its offset is an error. Deleted files
are an error when their range is still to be read.

`line_trace` is a stream's sink. Each task writes a file of JSON lines under
a name of its own; a batch's files count once its manifest `commits/<batch>.json`
is there, which is moved into place as a whole. A batch that comes again, after a restart,
finds its manifest and leaves no rows; files of attempts that didn't count are in no manifest.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from .files import listed, location

LINES = "file string, at bigint, line string"
_PIECE, _ROWS = 1 << 16, 4096


@dataclass
class Range(InputPartition):
    """Lines of a file that start in [begin, end); the first byte of the whole range begins a line."""

    path: str
    first: int
    begin: int
    end: int


def _whole(store, path: str, size: int) -> int:
    """Where the last whole line of the file's first `size` bytes ends."""
    with store.open_input_file(path) as f:
        at = size
        while at > 0:
            low = max(0, at - _PIECE)
            if (k := f.read_at(at - low, low).rfind(b"\n")) >= 0:
                return low + k + 1
            at = low
    return 0


class _Tail:
    """What batch and stream share."""

    def __init__(self, options: dict):
        self.path, self.most, self.suffix = options["path"], int(options.get("bytesperpartition", 32 << 20)), options.get("suffix", "")

    def ends(self) -> dict[str, int]:
        store, folder = location(self.path)
        return {f.path: _whole(store, f.path, f.size) for f in listed(store, folder, self.suffix)}

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        out = []
        for path, to in sorted(end.items()):
            first = start.get(path, 0)
            if to < first:
                raise ValueError(f"{path} was read up to {first} and has {to} bytes of lines")
            out += [Range(path, first, at, min(to, at + self.most)) for at in range(first, to, self.most)]
        return out

    def lines(self, r: Range) -> Iterator[pa.RecordBatch]:
        store, _ = location(self.path)
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("line", pa.string())])
        with io.BufferedReader(store.open_input_file(r.path), 1 << 20) as f:
            at = r.begin
            if r.begin > r.first:
                f.seek(r.begin - 1)
                at = r.begin - 1 + len(f.readline())
            f.seek(at)
            places, held = [], []
            while at < r.end:
                raw = f.readline()
                if not raw:
                    raise ValueError(f"{r.path} ends at {at}, before {r.end}")
                places.append(at)
                held.append(raw.rstrip(b"\r\n").decode())
                at += len(raw)
                if len(held) == _ROWS or at >= r.end:
                    yield pa.RecordBatch.from_arrays([pa.array([r.path] * len(held), pa.string()), pa.array(places, pa.int64()), pa.array(held, pa.string())], schema=schema)
                    places, held = [], []


class _BatchTail(DataSourceReader):
    def __init__(self, options: dict):
        self.tail = _Tail(options)

    def partitions(self) -> list[Range]:
        return self.tail.ranges({}, self.tail.ends())

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from self.tail.lines(partition)


class _StreamTail(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.tail = _Tail(options)

    def initialOffset(self) -> dict:
        return {"ends": "{}"}

    def latestOffset(self) -> dict:
        return {"ends": json.dumps(self.tail.ends(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.tail.ranges(json.loads(start["ends"]), json.loads(end["ends"]))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.tail.lines(partition)


class LineTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> _BatchTail:
        return _BatchTail(dict(self.options))

    def streamReader(self, schema: StructType) -> _StreamTail:
        return _StreamTail(dict(self.options))


@dataclass
class _File(WriterCommitMessage):
    name: str | None
    rows: int


def _plain(v):
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


class _TraceWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows) -> _File:
        store, folder = location(self.path)
        name, out, n = f"{uuid.uuid4().hex}.jsonl", None, 0
        for r in rows:
            if out is None:
                store.create_dir(f"{folder}/data", recursive=True)
                out = store.open_output_stream(f"{folder}/data/{name}")
            out.write((json.dumps(r.asDict(recursive=True), default=_plain, ensure_ascii=False) + "\n").encode())
            n += 1
        if out is None:
            return _File(None, 0)
        out.close()
        return _File(name, n)

    def _drop(self, messages) -> None:
        store, folder = location(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{folder}/data/{m.name}")

    def commit(self, messages, batchId: int) -> None:
        from pyarrow import fs

        store, folder = location(self.path)
        store.create_dir(f"{folder}/commits", recursive=True)
        target = f"{folder}/commits/{batchId:012d}.json"
        if store.get_file_info(target).type != fs.FileType.NotFound:
            self._drop(messages)
            return
        files = [{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.name]
        draft = f"{folder}/draft-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"batch": batchId, "files": files}).encode())
        store.move(draft, target)

    def abort(self, messages, batchId: int) -> None:
        self._drop(messages)


class LineTrace(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_trace"

    def schema(self) -> str:
        return LINES

    def streamWriter(self, schema: StructType, overwrite: bool) -> _TraceWriter:
        return _TraceWriter(dict(self.options))


def tail(spark: SparkSession, path: str, stream: bool = False, suffix: str = "", bytes_per_partition: int = 32 << 20) -> DataFrame:
    """(file, at, line) of the whole lines of files under path."""
    spark.dataSource.register(LineTail)
    reader = spark.readStream if stream else spark.read
    return reader.format("line_tail").option("suffix", suffix).option("bytesPerPartition", bytes_per_partition).load(path)


def append(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream that is written to the trace at path; still to be started."""
    df.sparkSession.dataSource.register(LineTrace)
    return df.writeStream.format("line_trace").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def trace(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of the batches that are committed."""
    store, folder = location(path)
    base, files = path.rstrip("/"), []
    for f in listed(store, f"{folder}/commits", ".json"):
        with store.open_input_stream(f.path) as x:
            files += [f"{base}/data/{m['name']}" for m in json.loads(x.read())["files"]]
    return spark.read.schema(schema).option("mode", "FAILFAST").json(files) if files else spark.createDataFrame([], schema)
