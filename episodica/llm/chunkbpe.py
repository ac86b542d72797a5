"""BPE of whole texts from chunks that documents share.

A rolling hash over WINDOW characters cuts texts where its low BITS bits are
zero, wherever that is, so that equal passages give equal chunks whatever stands
before them (chunks over MOST characters are cut at that length from their
start). Equal chunks are encoded once while a worker remembers them. Tokens of a
chunk hold only up to its ends, so every join is repaired: what stands between
the last sure token end of the chunk before and the first one of the chunk after
is encoded anew. A token end is sure at white space after another character,
where no match of the split pattern can go on, if the chunk's own tokens end
there too; a chunk without such a place is part of the repair, which goes on
until both sides agree or the text ends. The tokens are those of the whole text.

Special tokens in a text are found first, as the library does; the parts between
them are texts of their own. Tokenizers of another kind than byte-level BPE
without normalizer (or whose special tokens take in white space) encode every
text as a whole.

Null and empty texts have no tokens; rows, ties and further columns are kept as
they are, columns named as the results are replaced; an empty table gives an
empty table. Very long texts are taken on their own, in arrays of some 40 bytes
a character. Nothing is shuffled, and a lost task starts anew.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, added, arrow_schema, batch_of, col, runs, spark_schema, table
from .pattern import SPACE, Distinct, Powers, spread
from .tokenfile import Encoder

#: Characters of the rolling hash (a power of two); a chunk has 2^BITS characters on average, MOST at most.
WINDOW, BITS, MOST = 16, 9, 2048
#: Chunks that a worker remembers; texts that are encoded at a time, at most.
CHUNKS, ROWS = 150_000, 2048
_ODD, _MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: White space and other characters on whose kind all libraries agree.
_BLANK = [32, *range(9, 14)]
_UNCLEAR = [*range(0x1C, 0x20), 0x85, 0x180E, 0x200B, 0xFEFF]


def cuts(chars: np.ndarray, edges: np.ndarray, window: int = WINDOW, bits: int = BITS, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the chunks of the parts between the edges (ascending, from 0 to the end)."""
    h = chars * _ODD
    h ^= h >> np.uint32(15)
    n = 1
    while n < window:
        h[n:] = h[n:] + h[:-n] * np.uint32(pow(int(_MIX), n, 1 << 32))
        n *= 2
    at = np.flatnonzero(((h ^ (h >> np.uint32(16))) & np.uint32((1 << bits) - 1)) == 0) + 1
    # The hash of a part's first characters looks back into another part.
    at = at[at - edges[np.searchsorted(edges, at - 1, "right") - 1] >= window]
    starts = np.unique(np.concatenate([edges[:-1], at[at < len(chars)]]))
    ends = np.append(starts[1:], len(chars))
    pieces = np.maximum(1, -(-(ends - starts) // most))
    if (pieces > 1).any():
        starts = np.repeat(starts, pieces) + spread(np.zeros(len(pieces), np.int64), pieces) * most
        ends = np.append(starts[1:], len(chars))
    return starts, ends


class ChunkCodec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        tokenizer = self.encoder.tokenizer
        form = json.loads(tokenizer.to_str())
        extra = form.get("added_tokens") or []
        after = form.get("post_processor") or {"type": "ByteLevel"}
        self.plain = self.encoder.plain and after["type"] == "ByteLevel" and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in extra)
        self.special = {t["content"]: t["id"] for t in extra}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if extra else None
        self.width, self.powers, self.known = self.encoder.width, Powers(), Memo(CHUNKS)
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        byte_of = _bytes_of_characters()
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.pieces[i] = bytes(map(byte_of.get, piece)) if all(c in byte_of for c in piece) else piece.encode()
        self.length = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.decimal = [b"%d," % i for i in range(len(self.pieces))]
        self.byte_level = (form.get("decoder") or {}).get("type") == "ByteLevel"
        blank, word = np.zeros(0x110000, bool), np.ones(0x110000, bool)
        blank[_BLANK] = True
        word[:] = self.encoder.split.__self__.classes[:-1] != SPACE
        word[_UNCLEAR + _BLANK] = False
        self.is_blank, self.is_word = blank, word

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned integers of `width` bytes."""
        if not self.plain:
            return self.encoder._each([t or "" for t in texts])
        parts, plan = [], []
        for t in texts:
            own = []
            for k, part in enumerate(self.parts.split(t) if t and self.parts and any(x in t for x in self.special) else [t or ""]):
                if k % 2:
                    own.append(self.special[part].to_bytes(self.width, "little"))
                elif part:
                    own.append(len(parts))
                    parts.append(part)
            plan.append(own)
        ids = self._encode(parts) if parts else []
        return [b"".join(x if isinstance(x, bytes) else ids[x] for x in own) for own in plan]

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; those that are remembered by a 128-bit digest are not encoded again."""
        keys = [hashlib.blake2b(c.encode(), digest_size=16).digest() for c in chunks]
        of = dict(zip(keys, chunks))
        return self.known.values(keys, lambda new: self.encoder.encode([of[k] for k in new]))

    def _encode(self, parts: list[str]) -> list[bytes]:
        whole = "".join(parts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        edges = np.cumsum([0, *map(len, parts)])
        starts, ends = cuts(chars, edges)
        own = Distinct(chars, starts, ends, self.powers)
        ids = self._chunk_ids([whole[a:b] for a, b in zip(own.starts.tolist(), own.ends.tolist())])
        flat = b"".join(ids)
        counts = np.fromiter((len(x) // self.width for x in ids), np.int64, len(ids))
        base = np.cumsum(counts) - counts
        token_ends = np.cumsum(self.length[np.frombuffer(flat, f"<u{self.width}")])
        # Token ends as (chunk, bytes from its start) in one number; positions of characters in bytes.
        chunk_bytes = np.concatenate([[0], token_ends])[base]
        token_keys = np.repeat(np.arange(len(ids)) << 32, counts) + token_ends - np.repeat(chunk_bytes, counts)
        at_byte = np.concatenate([[0], np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), dtype=np.int64)])
        sure = np.zeros(len(chars) + 1, bool)
        sure[1:-1] = self.is_word[chars[:-1]] & self.is_blank[chars[1:]]
        places = np.flatnonzero(sure)
        low = np.searchsorted(places, own.starts, "right")
        n = np.searchsorted(places, own.ends, "left") - low
        inner, chunk = places[spread(low, n)], np.repeat(np.arange(len(ids)), n)
        wanted = (chunk << 32) + at_byte[inner] - at_byte[own.starts[chunk]]
        agreed = token_keys[np.searchsorted(token_keys[:-1], wanted)] == wanted
        inner, chunk = inner[agreed] - own.starts[chunk[agreed]], chunk[agreed]
        first, past = np.searchsorted(chunk, np.arange(len(ids)), "left"), np.searchsorted(chunk, np.arange(len(ids)), "right")
        some = past > first
        # What each chunk's tokens are kept for, in characters of the whole.
        sure[edges] = True
        head, tail, code = sure[starts], sure[ends], own.codes
        use = some[code] | (head & tail)
        inner = np.append(inner, 0)
        a = np.where(head, starts, starts + inner[np.minimum(first, len(inner) - 1)][code])[use]
        b = np.where(tail, ends, starts + inner[np.maximum(past - 1, 0)][code])[use]
        code, begin = code[use], starts[use]
        filled = b > a
        a, b, code, begin = a[filled], b[filled], code[filled], begin[filled]
        # Gaps before kept ranges and at the ends of the parts.
        edge = np.searchsorted(edges, a, "right") - 1
        before = np.maximum(edges[edge], np.concatenate([[0], b[:-1]]))
        last = edges[:-1].copy()
        last[edge] = b  # the last range of each part counts
        gap_a, gap_b = np.concatenate([before, last]), np.concatenate([a, edges[1:]])
        open_ = gap_b > gap_a
        gap_a, gap_b = gap_a[open_], gap_b[open_]
        gaps = [whole[x:y] for x, y in zip(gap_a.tolist(), gap_b.tolist())]
        repaired = self.encoder.encode(gaps) if gaps else []
        from_ = np.searchsorted(token_keys, (code << 32) + at_byte[a] - at_byte[begin], "right")
        to = np.searchsorted(token_keys, (code << 32) + at_byte[b] - at_byte[begin], "right")
        kept = [flat[x:y] for x, y in zip((from_ * self.width).tolist(), (to * self.width).tolist())]
        all_ = np.empty(len(kept) + len(repaired), object)
        all_[:] = kept + repaired
        place = np.concatenate([a, gap_a])
        order = np.argsort(place)
        row, at = all_[order].tolist(), np.searchsorted(place[order], edges).tolist()
        return [b"".join(row[x:y]) for x, y in zip(at, at[1:])]

    def numbers(self, ids: bytes) -> list[int]:
        return np.frombuffer(ids, f"<u{self.width}").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included."""
        if not self.byte_level:
            return self.encoder.tokenizer.decode(ids, skip_special_tokens=False)
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")

    def listed(self, ids: list[int]) -> bytes:
        """Decimal ids, joined by commas."""
        return b"".join(map(self.decimal.__getitem__, ids))[:-1]


def _bytes_of_characters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on, in order."""
    printable = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


_CODECS: dict[str, ChunkCodec] = {}


def _codec(path: str) -> ChunkCodec:
    """The worker's codec: made once, used by all of its tasks."""
    if path not in _CODECS:
        _CODECS[path] = ChunkCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs and an array column of its texts' ids."""
    docs = docs.select([col(docs, c) for c in docs.columns if c == text or c.lower() != ids.lower()])
    schema, at = arrow_schema(docs, (ids, pa.list_(pa.int32()))), docs.columns.index(text)

    def run(batches):
        codec = _codec(tokenizer_path)
        for b, texts in runs(batches, at, rows=ROWS):
            yield added(b, schema, [np.frombuffer(x, f"<u{codec.width}").astype(np.int32) for x in codec.encode(texts)])

    return docs.mapInArrow(run, spark_schema(docs, (ids, "array<int>")))


def decode(docs: DataFrame, tokenizer_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs and a text column of what its ids stand for (null: an empty text)."""
    docs = docs.select([col(docs, c) for c in docs.columns if c == ids or c.lower() != decoded.lower()])
    schema, at = arrow_schema(docs, (decoded, pa.string())), docs.columns.index(ids)

    def run(batches):
        codec = _codec(tokenizer_path)
        for b, values in runs(batches, at, rows=ROWS):
            yield added(b, schema, [codec.decode(v or []) for v in values])

    return docs.mapInArrow(run, spark_schema(docs, (decoded, "string")))


def round_trip(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """docs without its text, with n_tokens, ids_sha256 (of decimal ids and commas) and decoded_sha256, in one pass."""
    names = {"n_tokens", "ids_sha256", "decoded_sha256"}
    kept = docs.select([col(docs, c) for c in docs.columns if c == text or c.lower() not in names])
    at = kept.columns.index(text)
    shape = kept.select([col(kept, c) for c in kept.columns if c != text])
    schema = arrow_schema(shape, ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))

    def run(batches):
        codec = _codec(tokenizer_path)
        for b, texts in runs(batches, at, rows=ROWS):
            n, of_ids, of_text = [], [], []
            for x in codec.encode(texts):
                ids = codec.numbers(x)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(codec.listed(ids)).hexdigest())
                of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            own = [b.column(k).cast(f.type) for k, f in zip([k for k in range(b.num_columns) if k != at], schema)]
            yield batch_of(schema, *own, n, of_ids, of_text)

    return kept.mapInArrow(run, spark_schema(shape, ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")))


def op12_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (null text: empty)."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
