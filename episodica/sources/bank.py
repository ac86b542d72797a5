"""Token banks: NPZ archives with an episode's tokens and when each is valid, as a data source `token_bank`.

An archive has, for each episode, tok_<ep> (tokens x dimensions), tok_from_<ep>,
tok_until_<ep> (steps; a negative `until` has no end) and len_<ep> (its steps).
The driver reads the archives' directories only. Filters on `ep` leave out
members before anything is read; the others are dealt to partitions of some
`bytesPerPartition`, whose tasks read the members' byte ranges. Without the
option `vectors` (true by default) the tokens themselves are not read.

Written archives get a name of their own on each attempt of a task; those that
counted are listed in `_bank.json`, and a folder that has it is read by it.
Rows of an episode must be in one partition and in order of pos (write_bank
sees to it). Episodes without tokens are not written.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import listed, location

SCHEMA = "ep bigint, steps bigint, pos bigint, start bigint, until bigint, vector array<float>"
_LIST = "_bank.json"
_PARTS = ("tok", "tok_from", "tok_until", "len")


@dataclass
class Members(InputPartition):
    """(path, [(ep, {part: (offset, size, kind)})])."""

    path: str
    episodes: list


def _directory(store, path: str) -> dict[int, dict[str, tuple[int, int, int]]]:
    """Byte ranges of each episode's members."""
    out: dict[int, dict] = {}
    with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        for x in z.infolist():
            part, _, ep = x.filename.removesuffix(".npy").rpartition("_")
            if part in _PARTS and ep.isdigit():
                out.setdefault(int(ep), {})[part] = (x.header_offset, x.compress_size, x.compress_type)
    return out


def _member(f, offset: int, size: int, kind: int) -> np.ndarray:
    head = f.read_at(30, offset)
    name, extra = struct.unpack_from("<HH", head, 26)
    raw = f.read_at(size, offset + 30 + name + extra)
    if kind == zipfile.ZIP_DEFLATED:
        raw = zlib.decompress(raw, -15)
    elif kind != zipfile.ZIP_STORED:
        raise ValueError(f"compression {kind} is not read")
    return np.lib.format.read_array(io.BytesIO(raw), allow_pickle=False)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("bytespartition", options.get("bytesperpartition", 64 << 20)))
        self.vectors = str(options.get("vectors", "true")).lower() == "true"
        self.wanted: set[int] | None = None

    def pushFilters(self, filters):
        for f in filters:
            own = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if own is not None and tuple(f.attribute) == ("ep",):
                self.wanted = own if self.wanted is None else self.wanted & own
            else:
                yield f

    def partitions(self) -> list[Members]:
        store, folder = location(self.path)
        files = [f.path for f in listed(store, folder, ".npz")]
        known = [f.path for f in listed(store, folder, _LIST)] if files and files != [folder] else []
        if known:
            with store.open_input_stream(known[0]) as f:
                names = set(json.loads(f.read()))
            files = [f for f in files if f.rsplit("/", 1)[-1] in names]
        out = []
        for path in files:
            held, size = [], 0
            for ep, parts in sorted(_directory(store, path).items()):
                if "tok" not in parts or (self.wanted is not None and ep not in self.wanted):
                    continue
                own = sum(p[1] for k, p in parts.items() if self.vectors or k != "tok")
                if held and size + own > self.most:
                    out.append(Members(path, held))
                    held, size = [], 0
                held.append((ep, parts))
                size += own
            if held:
                out.append(Members(path, held))
        return out

    def read(self, partition: Members | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = location(self.path)
        with store.open_input_file(partition.path) as f:
            for ep, parts in partition.episodes:
                start, until, steps = (_member(f, *parts[k]).astype(np.int64).ravel() for k in ("tok_from", "tok_until", "len"))
                if not (n := len(start)):
                    continue
                columns = [np.full(n, ep, np.int64), np.full(n, steps[0], np.int64), np.arange(n), start, until]
                arrays = [pa.array(c, pa.int64()) for c in columns]
                names = ["ep", "steps", "pos", "start", "until"]
                if self.vectors:
                    tok = _member(f, *parts["tok"]).astype(np.float32).reshape(n, -1)
                    offsets = np.arange(n + 1, dtype=np.int32) * tok.shape[1]
                    arrays.append(pa.ListArray.from_arrays(offsets, tok.ravel()))
                    names.append("vector")
                yield pa.RecordBatch.from_arrays(arrays, names)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], np.dtype(options.get("dtype", "float32"))

    def write(self, rows) -> _Written:
        store, folder = location(self.path)
        name, archive, out, ep, held = f"part-{uuid.uuid4().hex}.npz", None, None, None, []

        def put(part: str, value: np.ndarray) -> None:
            with archive.open(f"{part}_{ep}.npy", "w", force_zip64=True) as f:
                np.lib.format.write_array(f, value, allow_pickle=False)

        def end() -> None:
            put("tok", np.array([r.vector for r in held], self.kind))
            put("tok_from", np.array([r.start for r in held], np.int32))
            put("tok_until", np.array([r.until for r in held], np.int32))
            put("len", np.array([held[0].steps], np.int64))

        for r in rows:
            if archive is None:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{name}")
                archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
            if held and r.ep != ep:
                end()
                held = []
            ep = r.ep
            held.append(r)
        if archive is None:
            return _Written(None)
        end()
        archive.close()
        out.close()
        return _Written(name)

    def commit(self, messages) -> None:
        store, folder = location(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{_LIST}") as f:
            f.write(json.dumps(sorted(m.name for m in messages if m is not None and m.name)).encode())

    def abort(self, messages) -> None:
        store, folder = location(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{folder}/{m.name}")


class TokenBank(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_bank"

    def schema(self) -> str:
        return SCHEMA if str(self.options.get("vectors", "true")).lower() == "true" else SCHEMA.rsplit(", ", 1)[0]

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def read_bank(spark: SparkSession, path: str, vectors: bool = True, bytes_per_partition: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(TokenBank)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("token_bank").option("vectors", str(vectors).lower()).option("bytesPerPartition", bytes_per_partition).load(path)


def write_bank(df: DataFrame, path: str, dtype: str = "float32") -> None:
    """df has the columns of SCHEMA; an episode's rows go to one archive, in order of pos."""
    df.sparkSession.dataSource.register(TokenBank)
    ordered = df.select("ep", "steps", "pos", "start", "until", F.col("vector").cast("array<float>")).repartition("ep").sortWithinPartitions("ep", "pos")
    ordered.write.format("token_bank").mode("append").option("dtype", dtype).save(path)
