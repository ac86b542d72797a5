"""WARC archives: write as one gzip stream, normalise to a member per record, read back.

`write` puts a record per page into one gzip stream a file. `normalise`
inflates such a stream once, rewrites every record as a gzip member of its
own, and writes a sidecar index with each member's offset and length.
`read` goes through the index and takes each record from its member.

Of the pages with equal payloads (SHA-1 and length) the one with the smallest
page_id is a response; the others are revisits, whose block has the HTTP
header only and which name the response. Payloads shorter than a bound are all
responses. A null payload is empty. Rows that repeat the smallest page_id are
all responses; pages with a null page_id refer to the smallest known id, and
are responses where there is none. Empty tables give no files. A very long
payload is one row, and passes the gzip stream in pieces. Further columns don't
count.

Ids and digests alone find the revisits; then the payloads are shuffled once,
by id and digest, to meet what was found. Files get a name of
their own on each attempt of a task; the next step is given the names of the
attempts that counted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, col, files_of, runs, shared_dir, table, text_or_empty

#: Bytes inflated and read at a time.
PIECE = 1 << 18


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(k, sha, size, refers_to) of the pages (k, payload) that revisit a smaller one."""
    keys = pages.select("k", F.sha1(F.col("payload").cast("binary")).alias("sha"), F.octet_length("payload").alias("size"))
    keys = keys.groupBy("k", "sha", "size").agg(F.count("*").alias("rows")).filter(F.col("size") >= least)
    first = keys.groupBy("sha", "size").agg(F.min("k").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return keys.drop("rows").join(first, ["sha", "size"]).filter(~F.col("k").eqNullSafe(F.col("refers_to"))).select("k", "sha", "size", "refers_to")


def decided(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """(k, url, payload, refers_to) of every page; refers_to is null for responses."""
    own = pages.select(col(pages, key).cast("bigint").alias("k"), col(pages, url).alias("url"), text_or_empty(col(pages, payload)).alias("payload"))
    found = revisits(own, least).withColumnsRenamed({"k": "k2", "sha": "sha2", "size": "size2"})
    keyed = own.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    return keyed.join(found, F.col("k").eqNullSafe(F.col("k2")) & (F.col("sha") == F.col("sha2")), "left").select("k", "url", "payload", "refers_to")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """A header's value; line ends and control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _name(key: int | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the length in its HTTP header and the digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(key)}", f"WARC-Target-URI: {_line(url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{_digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if revisit else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    """The header lines after the first, by their lower-case names."""
    lines = block.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines if x)}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of an inflated stream."""
    held, pieces = bytearray(), iter(pieces)

    def until(n: int) -> bool:
        while len(held) < n:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while until(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not until(len(held) + 1):
                raise ValueError("the stream ends inside a record's header")
        head = headers(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        if not until(size):
            raise ValueError("the stream ends inside a record")
        yield head, bytes(held[:size])
        del held[:size]


def inflate(file) -> Iterator[bytes]:
    """The contents of a gzip file of one member or many, piece by piece."""
    unzip = zlib.decompressobj(31)
    while data := file.read(PIECE):
        while data:
            yield unzip.decompress(data, PIECE)
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(31)
    yield unzip.flush()


def write(chosen: DataFrame, folder: str) -> list[str]:
    """The rows of decided() in files of one gzip stream each; their paths."""
    schema = pa.schema([("path", pa.string())])

    def run(batches):
        store, base = files_of(folder)
        path, out, zipped = f"{base}/whole-{uuid.uuid4().hex}.warc.gz", None, zlib.compressobj(6, zlib.DEFLATED, 31)
        for b, payloads in runs(batches, 2):
            for key, url, payload, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), payloads, b.column(3).to_pylist()):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                out.write(zipped.compress(record(key, url, payload.encode(), refers_to)))
        if out is not None:
            out.write(zipped.flush())
            out.close()
            yield batch_of(schema, [path])

    return [r.path for r in chosen.mapInArrow(run, "path string").collect()]


def normalise(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Each file again with a gzip member per record, and path.idx with their places."""
    schema = pa.schema([("path", pa.string())])

    def run(batches):
        store, base = files_of(folder)
        for b in batches:
            for source in b.column(0).to_pylist():
                store.create_dir(base, recursive=True)
                path, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                with store.open_input_stream(source, compression=None) as file, store.open_output_stream(path, compression=None) as out, store.open_output_stream(f"{path}.idx", compression=None) as index:
                    for head, whole in records(inflate(file)):
                        zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = zipped.compress(whole) + zipped.flush()
                        out.write(member)
                        entry = {"offset": at, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"], "url": head["warc-target-uri"]}
                        index.write(json.dumps(entry).encode() + b"\n")
                        at += len(member)
                yield batch_of(schema, [path])

    if not paths:
        return []
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return [r.path for r in files.mapInArrow(run, "path string").collect()]


def _key(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read(spark: SparkSession, paths: list[str], folder: str, payload: bool = False) -> DataFrame:
    """Per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to (, payload)."""
    names = ["page_id bigint", "payload_bytes bigint", "payload_digest string", "record_type string", "refers_to bigint", "url string", *["payload binary"] * payload]
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), *[("payload", pa.binary())] * payload])
    if not paths:
        return spark.createDataFrame([], ", ".join(names))

    def rows(store, path):
        with store.open_input_file(path) as file, store.open_input_stream(f"{path}.idx", compression=None) as index:
            for entry in _lines(index):
                entry = json.loads(entry)
                whole = zlib.decompress(file.read_at(entry["length"], entry["offset"]), 31)
                head, _, rest = whole.partition(b"\r\n\r\n")
                head = headers(head)
                http, _, body = rest[: int(head["content-length"])].partition(b"\r\n\r\n")
                if head["warc-type"] == "response":
                    size, digest, refers = len(body), _digest(body), None
                else:
                    size, digest, refers = int(headers(http)["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"), _key(head["warc-refers-to"])
                yield (_key(head["warc-record-id"]), size, digest, head["warc-type"], refers, head["warc-target-uri"], *[body] * payload)

    def run(batches):
        store, _ = files_of(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                held, size = [], 0
                for row in rows(store, path):
                    held.append(row)
                    size += row[1] * payload + 200
                    if size > 1 << 22:
                        yield batch_of(schema, *zip(*held))
                        held, size = [], 0
                if held:
                    yield batch_of(schema, *zip(*held))

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return files.mapInArrow(run, ", ".join(names))


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(PIECE):
        *lines, rest = (rest + data).split(b"\n")
        yield from lines
    if rest:
        yield rest


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = shared_dir(spark)
    whole = write(decided(table(spark, sf_dir, "pages")), f"{folder}/whole")
    return read(spark, normalise(spark, whole, f"{folder}/members"), folder).drop("url")


OP5_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as n, sha1(payload) as h from p),
f as (select *, min(page_id) over (partition by n, h) as first from d)
select page_id, n::bigint as payload_bytes,
  (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(lpad(h, 40, '0'), 1 + i * 10, 10))::bigint >> (35 - 5 * j) & 31)::int, 1), '' order by i, j)
   from range(4) as a(i), range(8) as b(j)) as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from f
"""
