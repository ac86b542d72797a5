"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file (one per range of document ids) holds, in this order: all ids as
little-endian unsigned integers of 2 bytes (4 where the vocabulary needs them);
an Elias-Fano sequence of the documents' end offsets; one of the document ids
less the smallest; a JSON footer; its length (8 bytes); the magic. A sequence
keeps the low bits of its values packed, and the high bits as a unary bit
vector with the position of every 256th one, so that select finds any value
without a table of 64-bit offsets.

Documents are in ascending order of an integer id, nulls first, repeated ids
by their text; a null text is empty. The start of a file is known from the
counts in the manifest, which has one line per file. Files get a name of their
own on each attempt of a task and the manifest lists those of the attempts
that counted, so lost executors and repeated tasks leave no double rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, batch_of, col, files_of, runs, shared_dir, table, text_or_empty
from .pattern import Splitter, joined

MAGIC, EVERY, BLOCK = b"EFTOK001", 256, 512
#: Entries of a worker's memo of words; texts that are encoded at a time, at most.
WORDS, ROWS = 500_000, 2048
#: Characters that \\s matches in some libraries only; words with no white space but a blank at their start.
_UNCLEAR = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
_PLAIN = re.compile(r" ?\S+\Z")


def ef_build(values: np.ndarray) -> bytes:
    """An Elias-Fano sequence of non-decreasing unsigned 64-bit values."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros((top >> low) + n + 1, np.uint8)
    high[ones] = 1
    parts = [np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::EVERY].astype("<u4").tobytes()]
    return struct.pack("<QB3Q", n, low, *map(len, parts)) + b"".join(parts)


class EliasFano:
    """Reads what ef_build made."""

    HEAD = struct.calcsize("<QB3Q")

    def __init__(self, data: bytes):
        self.n, self.low, a, b, c = struct.unpack_from("<QB3Q", data)
        at = self.HEAD
        self.lows, self.highs = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        self.samples = np.frombuffer(data, "<u4", c // 4, at + a + b)

    def slice(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, by select on the high bits from the sample before i."""
        if i >= j:
            return np.zeros(0, np.uint64)
        k = i // EVERY
        first = int(self.samples[k]) // 8
        past = (j - 1) // EVERY + 1
        last = int(self.samples[past]) // 8 + 1 if past < len(self.samples) else len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[first:last], bitorder="little")) + first * 8
        # The first byte may hold ones of values before the sampled one.
        skip = int(np.searchsorted(ones, int(self.samples[k]))) + i - k * EVERY
        high = (ones[skip : skip + j - i] - np.arange(i, j)).astype(np.uint64)
        if not self.low:
            return high
        start = i * self.low
        bits = np.unpackbits(self.lows[start // 8 : (j * self.low + 7) // 8], bitorder="little")
        bits = bits[start % 8 : start % 8 + (j - i) * self.low].reshape(j - i, self.low).astype(np.uint64)
        return high << np.uint64(self.low) | (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


class Encoder:
    """The tokenizer of one Python worker; repeated words are looked up.

    Texts are cut only where this kind of tokenizer surely cuts them too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.split, self.words = Splitter(sure=True).words, Memo(WORDS)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        form = json.loads(self.tokenizer.to_str())
        before = form.get("pre_tokenizer") or {}
        self.plain = form.get("normalizer") is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.blank = np.zeros(max(vocab.values()) + 1, bool)
        self.blank[[i for piece, i in vocab.items() if piece[0] == "\u0120"]] = True  # how these vocabularies write a blank
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _row(self, words: list[str], text: str, starts) -> list[bytes]:
        """Ids of words that make up one text; starts(ids) tells where those of each start."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")
        first, past = starts(ids)
        if len(first) != len(words):
            return self._each(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((first * self.width).tolist(), (past * self.width).tolist())]

    def _words(self, new: list[str]) -> list[bytes]:
        """Ids of words. Those without white space but a blank at their start are encoded as one text:
        its tokens that start with a blank start the words. Others without any are the lines of another text."""
        plain = list(map(_PLAIN.match, new))
        led = [w for w, m in zip(new, plain) if m and w[0] == " "]
        lines = [w for w, m in zip(new, plain) if m and w[0] != " "] if len(self.feed) == 1 else []

        def blanks(ids):
            first = np.flatnonzero(self.blank[ids])
            return first, np.append(first[1:], len(ids))

        def feeds(ids):
            at = np.flatnonzero(ids == self.feed[0])
            return np.append(0, at[:-1] + 1), at

        found = {}
        for words, end, starts in ((led, "", blanks), (lines, "\n", feeds)):
            for at in range(0, len(words), 5_000):
                part = words[at : at + 5_000]
                found.update(zip(part, self._row(part, end.join(part) + end, starts)))
        others = [w for w in new if w not in found]
        found.update(zip(others, self._each(others)))
        return list(map(found.__getitem__, new))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return self._each(texts)
        whole = {k for k, t in enumerate(texts) if _UNCLEAR.search(t) or any(x in t for x in self.special)}
        words, codes, ends = self.split(["" if k in whole else t for k, t in enumerate(texts)] if whole else texts)
        out = joined(self.words.values(words, self._words), codes, ends)
        for k in whole:
            (out[k],) = self._each([texts[k]])
        return out


_ENCODERS: dict = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, key: str = "doc_id", text: str = "text") -> list[dict]:
    """Write the texts' ids (and end_id after each) into files in the folder.

    Returns the manifest, which is also written: a dict per file, in order of
    the document ids, with path, n_docs, n_tokens and start. Its size is that
    of the number of files. docs need an integer key; other columns don't count.
    """
    chosen = docs.select(col(docs, key).cast("bigint").alias("k"), text_or_empty(col(docs, text)).alias("t"))
    ordered = chosen.repartitionByRange("k").sortWithinPartitions("k", "t")
    schema = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        encoder, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        end = b"" if end_id is None else end_id.to_bytes(encoder.width, "little")
        store, base = files_of(folder)
        path, out, lengths, keys, nulls = f"{base}/part-{part:06d}-{uuid.uuid4().hex[:12]}.tok", None, [], [], 0
        for b, texts in runs(batches, 1, rows=ROWS):
            if not texts:
                continue
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(path)
            ids = [x + end for x in encoder.encode(texts)]
            out.write(b"".join(ids))
            lengths.append(np.fromiter((len(x) // encoder.width for x in ids), np.int64, len(ids)))
            nulls += b.column(0).null_count
            keys.append(b.column(0).drop_null().to_numpy())
        if out is None:
            return
        ends, known = np.cumsum(np.concatenate(lengths)), np.concatenate(keys)
        least = int(known[0]) if len(known) else 0
        sections = [ef_build(ends.astype(np.uint64)), ef_build(known.astype(np.uint64) - np.uint64(least % (1 << 64)))]
        foot = json.dumps({"width": encoder.width, "n_docs": len(ends), "n_tokens": int(ends[-1]), "nulls": nulls, "least": least, "sections": [len(x) for x in sections]}).encode()
        out.write(b"".join([*sections, foot, struct.pack("<Q", len(foot)), MAGIC]))
        out.close()
        yield batch_of(schema, [part], [path], [len(ends)], [int(ends[-1])])

    found = sorted(ordered.mapInArrow(run, "part bigint, path string, n_docs bigint, n_tokens bigint").collect())
    manifest, start = [], 0
    for x in found:
        manifest.append({"path": x["path"], "n_docs": x["n_docs"], "n_tokens": x["n_tokens"], "start": start})
        start += x["n_tokens"]
    store, base = files_of(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class TokenFile:
    """Random access to one file."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        length, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        assert magic == MAGIC, path
        self.foot = json.loads(self.file.read_at(length, size - 16 - length))
        a, b = self.foot["sections"]
        data = self.file.read_at(a + b, size - 16 - length - a - b)
        self.ends, self.keys = EliasFano(data[:a]), EliasFano(data[a:])

    def blocks(self, most: int = BLOCK):
        """(keys, offsets, ids) of consecutive documents; offsets has one entry more."""
        n, nulls, least, width, i = (self.foot[k] for k in ("n_docs", "nulls", "least", "width", "n_tokens"))
        i = 0
        while i < n:
            j = min(n, i + most)
            ends = self.ends.slice(i, j).astype(np.int64)
            before = self.ends.select(i - 1) if i else 0
            # Long documents come in fewer at a time.
            j = i + max(1, int(np.searchsorted(ends - before, 1 << 22, "right"))) if ends[-1] - before > 1 << 22 else j
            ends = ends[: j - i]
            ids = np.frombuffer(self.file.read_at((int(ends[-1]) - before) * width, before * width), f"<u{width}")
            known = self.keys.slice(max(i - nulls, 0), max(j - nulls, 0)).astype(np.int64)
            keys = [None] * (j - i - len(known)) + (known + least).tolist()
            yield keys, np.concatenate([[before], ends]), ids
            i = j

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        a, b = self.ends.select(i - 1) if i else 0, self.ends.select(i)
        return np.frombuffer(self.file.read_at((b - a) * self.foot["width"], a * self.foot["width"]), f"<u{self.foot['width']}")


def read(spark: SparkSession, folder: str, manifest: list[dict], ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, and its ids if asked for."""
    shape = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * ids)
    if not manifest:
        return spark.createDataFrame([], shape)

    def run(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                store, _ = files_of(folder)
                for keys, offsets, found in TokenFile(store, path).blocks():
                    wide, at = found.astype("<u4"), (offsets - offsets[0]).tolist()
                    own = [wide[a:b] for a, b in zip(at, at[1:])]
                    yield batch_of(schema, keys, offsets[:-1] + start, np.diff(offsets), [zlib.crc32(x) for x in own], *[[x.astype(np.int32) for x in own]] * ids)

    files = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start bigint")
    return files.repartition(len(manifest)).mapInArrow(run, shape)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens (with the end id), ids_crc32."""
    import public_tokenizers

    folder = shared_dir(spark)
    manifest = write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read(spark, folder, manifest)
