"""Exact substring deduplication by prefix-partitioned suffix trees.

Texts are words between ASCII white space. Every word position with WINDOW
words from it on is a suffix; two documents repeat a passage of WINDOW words
if and only if suffixes of theirs meet in a node of the suffix tree that is
WINDOW words deep or deeper. The tree is never held whole:

1. Pruning. Each window's minimum hash of K words (its winnowing fingerprint)
   is looked up among those of all other documents. A window whose fingerprint
   stands in no other document can't lie below a node that deep, so its suffix
   is dropped.
2. Partitioning. Suffixes are counted by the hash of their first p words, for
   p = 1, 2, ... A suffix goes to the group of its shortest prefix that at
   most GROUP suffixes share (or of WINDOW words), so that all suffixes that
   meet in a deep node are in one group and a group fits in memory.
3. Subtrees. Each block of documents first merges its own equal paths, so a
   passage that stands in any number of documents has one leaf a block. Groups
   are packed into units of at most GROUP suffixes, and each unit's subtrees
   are built on their own: its suffixes are sorted by their path of words;
   neighbours that agree for WINDOW words are below one deep internal node,
   which tells the blocks that have a leaf there whether a smaller document id
   is below it.

The words below deep nodes that also start in a document with a smaller id
are removed. Between steps only hashes travel, packed by block and group; what
goes back to a block is a bit for each of its leaves. The input is first
written to the shared folder, as Arrow streams that later steps read whole,
each in one task; blocks are cut at BLOCK words in their order. So all steps
see the same blocks, however many executors there are by then.

Null and empty texts have no words. A null id counts as larger than all
others; rows that repeat an id don't remove each other's words. An empty table
gives an empty table. A document longer than a block is a block of its own.
Of further columns, those named as results are replaced and the others kept.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, arrow_schema, batch_of, col, files_of, shared_dir, spark_schema, table
from .pattern import Powers
from .words import BASE, LAST, grams, hashed, inside, mix, owners, sliding, starts, winnow

WINDOW, K = 13, 7
#: Words of a block; suffixes of a group; counters for each prefix length, and how many of them are added up in one group.
BLOCK, GROUP, CELLS, SLICE = 1_500_000, 1_000_000, 1 << 14, 1 << 10
#: Bytes of text of a batch in the stored streams.
BATCH = 1 << 20
NONE = np.iinfo(np.int64).max


class Block:
    """Consecutive documents of one stored stream, as arrays."""

    def __init__(self, number: int):
        self.number, self.batches, self.keys, self.hashed, self.lengths, self.check = number, [], [], [], [], 0

    def add(self, batch, keys: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> None:
        self.batches.append(batch)
        self.keys.append(keys)
        self.lengths.append(lengths)
        self.hashed.append(words)
        self.check = zlib.crc32(np.concatenate([lengths, keys]).astype(np.int64).tobytes(), self.check)

    def close(self) -> None:
        self.words, self.key, self.lengths = (np.concatenate(x) for x in (self.hashed, self.keys, self.lengths))
        self.owner = owners(self.lengths)
        self.valid = inside(self.owner, WINDOW)
        self.gram = grams(self.words, K)
        self.low, picked = winnow(self.gram, self.valid, WINDOW - K + 1)
        self.picked = np.flatnonzero(picked)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints in order, and which of them two documents of the block have."""
        h, d = self.gram[self.picked], self.owner[self.picked]
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        first = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1))) if len(h) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(h)) - 1
        return h[first], d[first] != d[last] if len(h) else np.zeros(0, bool)

    def counts(self) -> np.ndarray:
        """Suffixes by prefix length (1 to WINDOW - 1) and cell."""
        out, at = np.zeros((WINDOW - 1, CELLS), np.int64), np.flatnonzero(self.valid)
        for p, cell in enumerate(_cells(self.words, at)):
            out[p] = np.bincount(cell[0], minlength=CELLS)
        return out

    def leaves(self, shared: np.ndarray, heavy: np.ndarray):
        """The block's distinct paths below possibly deep nodes.

        shared: which of prints() stand in another document. Returns windows'
        positions and their leaf, and by leaf: group hash, path hash, word
        digits of the path, smallest document id.
        """
        known = self.prints()[0][shared]
        h = self.gram[self.picked]
        if len(known):
            h = np.where(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h, h, LAST)
        else:
            h = np.full(len(h), LAST)
        full = np.full(len(self.gram), LAST)
        full[self.picked] = h
        near = sliding(full, WINDOW - K + 1)
        at = np.flatnonzero(self.valid & (near[: len(self.valid)] == self.low[: len(self.valid)]) & (near[: len(self.valid)] != LAST)) if len(near) else np.zeros(0, np.int64)
        path = grams(self.words, WINDOW)[at] if len(at) else np.zeros(0, np.uint64)
        group, open_ = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
        for p, (cell, full_hash) in enumerate(_cells(self.words, at)):
            stop = open_ & ~heavy[p][cell]
            group[stop] = full_hash[stop] ^ np.uint64(p)
            open_ &= ~stop
        group[open_] = path[open_]
        group = mix(group)
        order = np.lexsort((self.key[self.owner[at]], path, group))
        same = np.diff(path[order], prepend=path[order[:1]] ^ np.uint64(1)) != 0 if len(at) else np.zeros(0, bool)
        first = order[np.flatnonzero(same)]
        leaf = np.zeros(len(at), np.int64)
        leaf[order] = np.cumsum(same) - 1
        digits = np.stack([(self.words[at[first] + j] >> np.uint64(56)).astype(np.uint8) for j in range(WINDOW)], axis=1) if len(first) else np.zeros((0, WINDOW), np.uint8)
        return at, leaf, group[first], path[first], digits, self.key[self.owner[at[first]]]


def _cells(words: np.ndarray, at: np.ndarray):
    """For p = 1 to WINDOW - 1: (counter cell, hash) of the first p words from each position."""
    h = np.zeros(len(at), np.uint64)
    for p in range(WINDOW - 1):
        h = h * BASE + words[at + p]
        full = mix(h)
        yield (full % np.uint64(CELLS)).astype(np.int64), full


def store(docs: DataFrame, folder: str, text: str) -> list[dict]:
    """Write docs as Arrow streams, one for each partition: their paths and bytes of text, in order.

    A stream gets a name of its own on each attempt of a task, and those of
    the attempts that counted are returned.
    """
    schema, at = arrow_schema(docs), docs.columns.index(text)

    def run(batches):
        from pyspark import TaskContext

        part, writer, out, size = TaskContext.get().partitionId(), None, None, 0
        fs, base = files_of(folder)
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex[:12]}.arrows"
        for b in batches:
            b = batch_of(schema, *[b.column(k).cast(f.type) for k, f in enumerate(schema)])
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < b.num_rows:
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(path)
                    writer = pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                held = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, held + BATCH, "right")))
                writer.write_batch(b.slice(start, stop - start))
                size, start = size + int(ends[stop - 1]) - held, stop
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "size": [size]})

    found = sorted(docs.mapInArrow(run, "part bigint, path string, size bigint").collect())
    return [{"path": r.path, "size": r.size} for r in found]


def _blocks(path: str, folder: str, number: int, key: int, text: int, powers: Powers):
    """A stream's blocks, in the order of its rows."""
    fs, _ = files_of(folder)
    block, held, n = None, 0, 0
    with fs.open_input_stream(path) as source, pa.ipc.open_stream(source) as stream:
        for b in stream:
            keys = pc.fill_null(b.column(key).cast(pa.int64()), NONE).to_numpy(zero_copy_only=False)
            words, lengths = hashed(b.column(text), powers)
            first, at = np.concatenate([[0], np.cumsum(lengths)]), 0
            while at < len(keys):
                if block is None:
                    block, held = Block(number << 24 | n), 0
                    n += 1
                # A block ends with the row that fills it.
                to = min(int(np.searchsorted(first, first[at] + BLOCK - held)), len(keys))
                to = max(to, at + 1)
                block.add(b.slice(at, to - at), keys[at:to], words[first[at] : first[to]], lengths[at:to])
                held, at = held + int(first[to] - first[at]), to
                if held >= BLOCK:
                    block.close()
                    yield block
                    block = None
    if block is not None:
        block.close()
        yield block


_PACK = pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("crc", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])
_PACK_DDL = "grp bigint, block bigint, crc bigint, a binary, b binary, c binary, d binary, e binary"
_BACK_DDL = "grp bigint, block bigint, crc bigint, a binary"
_BACK = pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("crc", pa.int64()), ("a", pa.binary())])


def _ranges(keys: np.ndarray, groups: int):
    """(group, from, to) for ascending hashes dealt by their range."""
    of = (keys >> np.uint64(32)).astype(np.int64) * groups >> 32
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return list(zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(of)]))


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


def _shared(table: pa.Table) -> pa.Table:
    """Of a group's fingerprints by block: which stand in another document; counts are added up."""
    if table.column("grp")[0].as_py() < 0:
        total = sum(np.frombuffer(x, "<i8") for x in table.column("a").to_pylist())
        return pa.table([table.column("grp").slice(0, 1), [-1], [0], [total.astype("<i8").tobytes()]], schema=_BACK)
    blobs = [np.frombuffer(x, "<u8") for x in table.column("a").to_pylist()]
    flags = [_unbits(x, len(h)) for x, h in zip(table.column("b").to_pylist(), blobs)]
    merged = np.sort(np.concatenate(blobs))
    twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
    out = []
    for h, f in zip(blobs, flags):
        if len(twice):
            f = f | (twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)
        out.append(_bits(f))
    return pa.table([table.column("grp"), table.column("block"), table.column("crc"), pa.array(out, pa.binary())], schema=_BACK)


def subtree(digits: np.ndarray, paths: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The smallest document id below each suffix's node WINDOW words deep, of one or more whole subtrees.

    Suffixes are sorted by their path of word digits (and its hash, which
    settles equal digits of different words). The depth that neighbours share
    gives the internal nodes; those WINDOW words deep end the runs.
    """
    order = np.lexsort((paths, *(digits[:, j] for j in range(WINDOW - 1, -1, -1))))
    d, p = digits[order], paths[order]
    depth = np.argmin(np.concatenate([d[1:] == d[:-1], np.zeros((max(len(d) - 1, 0), 1), bool)], axis=1), axis=1)
    new = np.concatenate([[True], (depth < WINDOW) | (p[1:] != p[:-1])])
    first = np.flatnonzero(new)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(keys[order], first), np.diff(np.append(first, len(keys))))
    return out


def units(group: np.ndarray, most: int):
    """Indices of whole groups, packed into units of at most `most` suffixes (a larger group is one of its own)."""
    order = np.argsort(group, kind="stable")
    first = np.append(np.flatnonzero(np.diff(group[order], prepend=group[order[:1]] ^ np.uint64(1))), len(order)) if len(order) else np.zeros(1, np.int64)
    at = 0
    while at < len(first) - 1:
        to = max(at + 1, int(np.searchsorted(first, first[at] + most, "right")) - 1)
        yield order[first[at] : first[to]]
        at = to


def _smaller(table: pa.Table) -> pa.Table:
    """For each leaf of the groups: does its deep node hold a smaller document id than its block's?"""
    column = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
    each = column("a", "<u8")
    paths, keys, digits = np.concatenate(each), np.concatenate(column("c", "<i8")), np.concatenate(column("b", np.uint8)).reshape(-1, WINDOW)
    group = np.concatenate([np.repeat(g, n) for g, n in zip(column("d", "<u8"), column("e", "<i4"))])
    less = np.zeros(len(keys), bool)
    for at in units(group, GROUP):
        less[at] = subtree(digits[at], paths[at], keys[at]) < keys[at]
    ends = np.cumsum([0, *map(len, each)])
    out = [_bits(less[a:b]) for a, b in zip(ends, ends[1:])]
    return pa.table([table.column("grp"), table.column("block"), table.column("crc"), pa.array(out, pa.binary())], schema=_BACK)


def _sent_back(found: DataFrame, folder: str) -> None:
    """A folder for each stored stream, stream=<number>."""
    found.withColumn("stream", F.shiftright("block", 24)).repartition("stream").write.partitionBy("stream").parquet(folder)


def _received(folder: str, number: int) -> dict[int, dict[int, tuple[int, bytes]]]:
    """What was sent back to the blocks of a stream: by block and group, its check and bits."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store_, base = files_of(f"{folder}/stream={number}")
    out = {}
    for f in store_.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.base_name.endswith(".parquet"):
            with store_.open_input_file(f.path) as file:
                found = pq.read_table(file)
            for n, g, crc, a in zip(*(found.column(c).to_pylist() for c in ("block", "grp", "crc", "a"))):
                out.setdefault(n, {})[g] = crc, a
    return out


def _flags(received: dict[int, tuple[int, bytes]], block: Block, hashes: np.ndarray, groups: int) -> np.ndarray:
    out = np.zeros(len(hashes), bool)
    for g, a, b in _ranges(hashes, groups):
        crc, bits = received[g]
        if crc != block.check:
            raise RuntimeError(f"block {block.number} is not the one of the step before")
        out[a:b] = _unbits(bits, b - a)
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, n_removed, kept (remaining words joined by a blank) and removed (spans of words)."""
    spark, names = docs.sparkSession, ("n_words", "n_removed", "kept", "removed")
    folder = shared_dir(spark)
    base = docs.select([col(docs, c) for c in docs.columns if c.lower() not in names])
    key_at, text_at = base.columns.index(key), base.columns.index(text)
    streams = store(base, f"{folder}/docs", text)
    more = (("n_words", "bigint"), ("n_removed", "bigint"), ("kept", "string"), ("removed", "array<struct<start:bigint,end:bigint>>"))
    schema = arrow_schema(base, ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
    if not streams:
        return spark.createDataFrame([], spark_schema(base, *more))
    groups = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), sum(x["size"] for x in streams) // 12_000_000)
    # One row a stream, of some hundred bytes; each stream is a task.
    listed = spark.createDataFrame([(n, x["path"]) for n, x in enumerate(streams)], "number bigint, path string").repartition(len(streams))

    def over(run, ddl):
        def task(batches):
            powers = Powers()
            for b in batches:
                for number, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield from run(number, _blocks(path, folder, number, key_at, text_at, powers))

        return listed.mapInArrow(task, ddl)

    def packed(g, block, *columns):
        return batch_of(_PACK, [g], [block.number], [block.check], *[[x] for x in columns], *[[None]] * (5 - len(columns)))

    def prints(number, blocks):
        total = np.zeros((WINDOW - 1, CELLS), np.int64)
        for block in blocks:
            h, twice = block.prints()
            total += block.counts()
            for g, a, b in _ranges(h, groups):
                yield packed(g, block, h[a:b].astype("<u8").tobytes(), _bits(twice[a:b]))
        # A group gets SLICE counters of each stream: 8 KB.
        for k, part in enumerate(total.reshape(-1, SLICE)):
            yield batch_of(_PACK, [-1 - k], [-1], [0], [part.astype("<i8").tobytes()], *[[None]] * 4)

    _sent_back(over(prints, _PACK_DDL).groupBy("grp").applyInArrow(_shared, _BACK_DDL), f"{folder}/shared")
    total = spark.read.schema("grp bigint, a binary").parquet(f"{folder}/shared/stream=-1").orderBy(F.desc("grp")).collect()
    # CELLS counters for each prefix length, whatever the size of the input.
    heavy = np.frombuffer(b"".join(r.a for r in total), "<i8").reshape(WINDOW - 1, CELLS) > GROUP

    def leaves(block: Block, received):
        return block.leaves(_flags(received.get(block.number, {}), block, block.prints()[0], groups), heavy)

    def paths(number, blocks):
        received = _received(f"{folder}/shared", number)
        for block in blocks:
            _, _, group, path, digits, least = leaves(block, received)
            for g, a, b in _ranges(group, groups):
                first = np.flatnonzero(np.diff(group[a:b], prepend=group[a] ^ np.uint64(1)))
                count = np.diff(np.append(first, b - a))
                yield packed(g, block, path[a:b].astype("<u8").tobytes(), digits[a:b].tobytes(), least[a:b].astype("<i8").tobytes(), group[a:b][first].astype("<u8").tobytes(), count.astype("<i4").tobytes())

    _sent_back(over(paths, _PACK_DDL).groupBy("grp").applyInArrow(_smaller, _BACK_DDL), f"{folder}/smaller")

    def remove(number, blocks):
        shared, smaller = _received(f"{folder}/shared", number), _received(f"{folder}/smaller", number)
        for block in blocks:
            at, leaf, group, _, _, least = leaves(block, shared)
            less = _flags(smaller.get(block.number, {}), block, group, groups)
            gone = at[less[leaf] | (block.key[block.owner[at]] > least[leaf])] if len(at) else at
            edge = np.zeros(len(block.words) + 1, np.int32)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + WINDOW, -1)
            mask, first, d = np.cumsum(edge)[:-1] > 0, starts(block.lengths.tolist()), 0
            touched = np.add.reduceat(np.append(mask, False), first[:-1], dtype=np.int64) * (block.lengths > 0) if len(first) > 1 else []
            for b in block.batches:
                columns = [[], [], [], []]
                for t in b.column(text_at).to_pylist():
                    n, cut, spans = int(block.lengths[d]), t.encode().split() if t else [], []
                    if touched[d]:
                        m = mask[first[d] : first[d + 1]]
                        edges = np.flatnonzero(np.diff(m.astype(np.int8), prepend=0, append=0)).tolist()
                        spans = [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])]
                        cut = [cut[i] for i in np.flatnonzero(~m).tolist()]
                    d += 1
                    for out, value in zip(columns, (n, n - len(cut), b" ".join(cut).decode(), spans)):
                        out.append(value)
                yield added(b, schema, *columns)

    return over(remove, spark_schema(base, *more))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as s from d, unnest(range(1, len(w) - {WINDOW - 2})) as r(i)),
f as (select s, min(doc_id) as m from win group by s),
g as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + {WINDOW})) as p from win join f using (s) where f.m < doc_id)),
k as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
x as (select k.doc_id, count(*) as n, count(g.p) as gone, string_agg(word, ' ' order by k.p) filter (g.p is null) as kept
  from k left join g on k.doc_id = g.doc_id and k.p = g.p group by k.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join x on d.doc_id = x.doc_id
"""
