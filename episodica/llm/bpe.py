"""Byte-level BPE, encoded and decoded by DuckDB queries inside each partition.

Encoding: every word (a match of the split pattern) starts as one token a
byte. A recursive query turns the words into (word, position, token) rows,
joins adjacent tokens with the merge table, and contracts each word's leftmost
pair of minimum rank, until no word has a pair in the table. Decoding: the
ids become (position, id) rows, join the vocabulary, and an ordered
aggregation concatenates the pieces, which are then cut by their lengths.

A word that is met again is looked up in a bounded memo. So is, in decoding, a
run of ids from one that starts with a blank to the next. Words longer than
LONG bytes take a form of the query that contracts all occurrences of the
minimum-rank pair at once where that can't change the result, and that runs
at most DEPTH rounds before it starts anew from the last state, so that it
keeps few states in memory.

Nulls and empty texts have no tokens; an empty table gives an empty table;
rows, ties and further columns are kept as they are. Very long texts are taken
on their own, in arrays of some 60 bytes a character.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, added, arrow_schema, batch_of, col, runs, spark_schema, table, trimmed
from .pattern import PATTERN, Distinct, Powers, Splitter, joined

LONG, DEPTH, BLOCK = 256, 16, 20_000
#: Entries of a worker's memos of words and of runs of ids.
WORDS, RUNS = 200_000, 100_000
#: Characters that are split at a time, if no text is longer; new words of many such parts are encoded together.
PART = 1 << 18
#: Texts that are taken at a time, at most.
ROWS = 2048

ENCODE = """
with recursive t(w, toks) as (
  select w, toks from words
  union all
  select t.w, list_concat(toks[:best & 1048575], [(best >> 20)::int], toks[(best & 1048575) + 3:])
  from t join (
    select w, min(r::bigint << 20 | i) as best
    from (select w, unnest(toks[:-2]) as a, unnest(toks[2:]) as b, unnest(range(len(toks) - 1)) as i from t)
    join merges on ab = a::bigint << 32 | b
    group by w) as m on t.w = m.w)
select w, arg_min(toks, len(toks)) as ids from t group by w
"""

ENCODE_LONG = """
with recursive t(step, w, i, tok) as (
  select 0, w, i, tok from state
  union all
  select step + 1, w, row_number() over (partition by w order by i) - 1, case when hit then r else tok end
  from (
    select *, coalesce(lag(hit) over (partition by w order by i), false) as eaten
    from (
      select step, w, i, tok, r, coalesce(r = best and case when multi then (i - run) % 2 = 0 else i = first end, false) as hit
      from (
        select *, min(case when r = best then i end) over (partition by w) as first,
          max(case when r is distinct from best then i + 1 else 0 end) over (partition by w order by i) as run
        from (
          select p.*, m.r, m.multi, min(m.r) over (partition by w) as best
          from (select *, lead(tok) over (partition by w order by i) as nxt from t where step < $depth) as p
          left join merges as m on ab = tok::bigint << 32 | nxt)
        where best is not null)))
  where not eaten)
select w, i, tok from t where (w, step) in (select w, max(step) from t group by w)
"""

DECODE = "select string_agg(piece, '' order by i) as text from flat join vocab using (id)"


def _parts(texts: list[str]):
    """Runs of the texts with up to PART characters in all (one text at least)."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and held + len(t) > PART:
            yield texts[start:k]
            start, held = k, 0
        held += len(t)
    if texts:
        yield texts[start:]


class Codec:
    """The encoder and decoder of one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.find, own = (None, Splitter()) if pattern == PATTERN else (regex.compile(pattern).findall, None)
        self.split = own.words if own else self._found
        self.words, self.runs, self.powers = Memo(WORDS), Memo(RUNS), own.powers if own else Powers()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        pairs, new, first = [], [], {}
        for x, r in ranks.items():
            for k in range(1, len(x)):
                if (p := ranks.get(x[:k])) is not None and (s := ranks.get(x[k:])) is not None:
                    pairs.append(p << 32 | s)
                    new.append(r)
                    for part in (p, s):
                        first[part] = min(first.get(part, r), r)
        # Contracting all occurrences at once is safe if no longer token holding the new one has a lower rank.
        merges = pa.table({"ab": pa.array(pairs, pa.int64()), "r": pa.array(new, pa.int32()), "multi": pa.array([first.get(r, r) >= r for r in new], pa.bool_())})
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "piece": [x.decode("latin-1") for x in ranks]})
        for name, data in (("merges", merges), ("vocab", vocab)):
            self.db.register("given", data)
            self.db.execute(f"create table {name} as from given")
            self.db.unregister("given")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.length, self.blank = np.zeros(max(ranks.values()) + 1, np.int32), np.zeros(max(ranks.values()) + 1, bool)
        self.length[list(ranks.values())] = list(map(len, ranks))
        self.blank[[r for x, r in ranks.items() if x[:1] == b" "]] = True

    def _found(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """As Splitter.words, for any pattern."""
        number, codes, ends = {}, [], []
        for t in texts:
            codes += [number.setdefault(w, len(number)) for w in self.find(t)]
            ends.append(len(codes))
        return list(number), np.array(codes, np.int64), np.array(ends, np.int64)

    def _query(self, name: str, data: pa.Table, sql: str, **values) -> pa.Table:
        self.db.register(name, data)
        try:
            return self.db.sql(sql, params=values or None).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _short(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        for at in range(0, len(words), BLOCK):
            part = words[at : at + BLOCK]
            ends = np.cumsum([0, *map(len, part)], dtype=np.int32)
            toks = pa.ListArray.from_arrays(ends, self.byte[np.frombuffer(b"".join(part), np.uint8)])
            found = self._query("words", pa.table({"w": np.arange(len(part), dtype=np.int32), "toks": toks}), ENCODE).combine_chunks()
            ids = found["ids"].combine_chunks()
            flat, offsets = ids.values.to_numpy().astype("<u4", copy=False).tobytes(), (ids.offsets.to_numpy() * 4).tolist()
            for k, w in enumerate(found["w"].to_pylist()):
                out[at + w] = flat[offsets[k] : offsets[k + 1]]
        return out

    def _long(self, word: bytes) -> bytes:
        toks, depth = self.byte[np.frombuffer(word, np.uint8)], DEPTH
        while True:
            n = len(toks)
            state = pa.table({"w": np.zeros(n, np.int32), "i": np.arange(n, dtype=np.int64), "tok": toks})
            found = self._query("state", state, ENCODE_LONG, depth=max(1, min(depth, 2_000_000 // n)))
            toks = found["tok"].to_numpy()[np.argsort(found["i"].to_numpy())].astype(np.int32)
            if len(toks) == n:
                return toks.astype("<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        short = [k for k, w in enumerate(raw) if len(w) <= LONG]
        out = [b"" if len(w) <= LONG else self._long(w) for w in raw]
        for k, ids in zip(short, self._short([raw[k] for k in short])):
            out[k] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        number, codes, ends, n = {}, [], [], 0
        for part in _parts([t or "" for t in texts]):
            words, own, upto = self.split(part)
            codes.append(np.array([number.setdefault(w, len(number)) for w in words], np.int64)[own])
            ends.append(upto + n)
            n += len(own)
        return joined(self.words.values(list(number), self.encode_words), np.concatenate(codes), np.concatenate(ends)) if codes else []

    def _decode_runs(self, keys: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(keys), "<u4").astype(np.int32)
        ends = np.cumsum(self.length[ids])[np.cumsum([len(k) // 4 for k in keys]) - 1].tolist()
        (text,) = self._query("flat", pa.table({"i": np.arange(len(ids)), "id": ids}), DECODE)["text"].to_pylist()
        raw = text.encode("latin-1")
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes behind each text's ids."""
        raw = b"".join(ids)
        flat, ends = np.frombuffer(raw, "<u4"), np.cumsum([len(x) // 4 for x in ids])
        start = self.blank[flat]
        start[[a for a in [0, *ends.tolist()] if a < len(flat)]] = True
        starts = np.flatnonzero(start)
        own = Distinct(flat, starts, np.append(starts[1:], len(flat))[: len(starts)], self.powers)
        keys = [raw[a:b] for a, b in zip((own.starts * 4).tolist(), (own.ends * 4).tolist())]
        return joined(self.runs.values(keys, self._decode_runs), own.codes, np.searchsorted(starts, ends))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_CODECS: dict = {}


def _codec(ranks_path: str, pattern: str) -> Codec:
    """The worker's codec: made once, used by all of its tasks."""
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = Codec(read_ranks(ranks_path), pattern)
    return _CODECS[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs and a binary column of its texts' ids (little-endian unsigned 32-bit)."""
    docs = docs.select([col(docs, c) for c in docs.columns if c == text or c.lower() != ids.lower()])
    schema, at = arrow_schema(docs, (ids, pa.binary())), docs.columns.index(text)

    def run(batches):
        codec = _codec(ranks_path, pattern)
        for b, texts in runs(batches, at, rows=ROWS):
            yield added(b, schema, codec.encode(texts))

    return docs.mapInArrow(trimmed(run), spark_schema(docs, (ids, "binary")))


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs and a binary column of the bytes that its ids stand for (null: none)."""
    docs = docs.select([col(docs, c) for c in docs.columns if c == ids or c.lower() != decoded.lower()])
    schema, at = arrow_schema(docs, (decoded, pa.binary())), docs.columns.index(ids)

    def run(batches):
        codec = _codec(ranks_path, pattern)
        for b, values in runs(batches, at, rows=ROWS):
            yield added(b, schema, codec.decode([v or b"" for v in values]))

    return docs.mapInArrow(trimmed(run), spark_schema(docs, (decoded, "binary")))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs without its text, with n_tokens, ids_sha256 and decoded_sha256.

    Both directions run in one pass: the texts' ids are hashed, decoded, and
    the decoded bytes hashed. Columns of docs with such names are replaced.
    """
    names = {"n_tokens", "ids_sha256", "decoded_sha256"}
    kept = docs.select([col(docs, c) for c in docs.columns if c == text or c.lower() not in names])
    at, rest = kept.columns.index(text), [c for c in kept.columns if c != text]
    shape = kept.select([col(kept, c) for c in rest])
    more = (("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"))
    schema = arrow_schema(shape, ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))

    def run(batches):
        codec = _codec(ranks_path, pattern)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for b, texts in runs(batches, at, rows=ROWS):
            ids = codec.encode(texts)
            raw = codec.decode(ids)
            own = [b.column(k) for k in range(b.num_columns) if k != at]
            own = [c.cast(f.type) for c, f in zip(own, schema)]
            yield batch_of(schema, *own, [len(x) // 4 for x in ids], list(map(digest, ids)), list(map(digest, raw)))

    return kept.mapInArrow(trimmed(run), spark_schema(shape, *more))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (null text: empty)."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
