"""Alignment of the tokens of two tokenizers over the same bytes.

A byte-level BPE (A) and a SentencePiece BPE (B, which writes a blank before the
text) give tokens of the same bytes. Where tokens of both end, a group of tokens
closes; tokens of A and B that share a byte are linked.

The groups come from a dangling-suffix transducer. Its state is the side that
leads and the bytes of that side's last token that the other side has not
matched yet; it reads the next token of the side behind (of A, if neither
leads), which is linked to the leading token, and closes the group when no
byte is left over. Transitions are remembered by side, residual and token.

Neither tokenizer has a token that goes on from a visible character to a blank
(this is looked up in B's vocabulary; A's pattern forbids it), so texts are cut
there. Equal units are tokenised and aligned once while a worker remembers
them; a document is a row of unit numbers. A block of some BLOCK bytes of texts
leaves one row with its unit numbers by document and its table of pairs of ids.
The pairs' counts are summed over all blocks, and each block gets the counts of
its own pairs back, so that no table of all pairs meets in one place. Blocks
are written once to the shared folder and read from it.

Texts that are null or empty, and those whose bytes the tokens of A or B don't
give back, have no tokens: zeros and an empty digest. Equal counts tie for the
best. Very long texts have a block of their own, in arrays of some 40 bytes a
character. Rows and further columns are kept, columns named as the results
are replaced; an empty table gives an empty table. B must not normalise texts.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunkbpe import _BLANK, _UNCLEAR, _bytes_of_characters
from .common import Memo, batch_of, col, free_name, runs, spark_schema, table, written
from .pattern import Distinct, Powers
from .tokenfile import Encoder

#: Characters of texts in a block; units, words of A and transitions that a worker remembers; texts taken at a time, at most.
BLOCK, UNITS, WORDS, STEPS, ROWS = 8 << 20, 400_000, 200_000, 400_000, 1024
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
_SPACE = "▁"  # how SentencePiece writes a blank
_LEAD_A, _LEAD_B = 0, 1


class State:
    """A side that leads, its unmatched bytes, and where tokens of the other side lead to."""

    __slots__ = ("lead", "rest", "next")

    def __init__(self, lead: int, rest: bytes):
        self.lead, self.rest, self.next = lead, rest, {}


class Transducer:
    """Groups and links of two token rows over the same bytes."""

    def __init__(self, a: list[bytes], b: list[bytes], most: int = STEPS):
        self.bytes, self.most, self.n = (a, b), most, 0
        self.states: dict[tuple[int, bytes], State] = {}

    def state(self, lead: int, rest: bytes) -> State:
        key = (lead, rest) if rest else (_LEAD_A, rest)
        if key not in self.states:
            self.states[key] = State(*key)
        return self.states[key]

    def step(self, s: State, token: int) -> State | None:
        """The state after the next token of the side behind; None if bytes differ."""
        x, rest = self.bytes[1 - s.lead][token], s.rest
        if rest.startswith(x):
            to = self.state(s.lead, rest[len(x) :])
        elif x.startswith(rest):
            to = self.state(1 - s.lead, x[len(rest) :])
        else:
            return None
        s.next[token] = to
        self.n += 1
        return to

    def align(self, a: list[int], b: list[int]) -> tuple[str, int, list[int]] | None:
        """(groups as text, their number, links as a << 32 | b) or None if the bytes differ."""
        if self.n > self.most:
            self.states.clear()
            self.n = 0
        i, j, n_a, n_b, links, groups, first = 0, 0, len(a), len(b), [], [], 0
        while i < n_a:
            start = i
            leading = a[i]
            s = self.state(_LEAD_A, self.bytes[0][leading])
            i += 1
            while s.rest:
                if s.lead:
                    if i == n_a:
                        return None
                    token = a[i]
                    i += 1
                    links.append(token << 32 | leading)
                else:
                    if j == n_b:
                        return None
                    token = b[j]
                    j += 1
                    links.append(leading << 32 | token)
                to = s.next.get(token) or self.step(s, token)
                if to is None:
                    return None
                if to.lead != s.lead:
                    leading = token
                s = to
            groups.append(f"{a[start]}|{b[first]}" if i - start == 1 == j - first else ",".join(map(str, a[start:i])) + "|" + ",".join(map(str, b[first:j])))
            first = j
        return (";".join(groups), len(groups), links) if j == n_b else None


class Aligner:
    """Both tokenizers and the transducer of one Python worker."""

    def __init__(self, a_path: str, b_path: str):
        import regex
        import sentencepiece

        self.encoder = Encoder(a_path)
        self.a = self.encoder.tokenizer
        self.a.encode_special_tokens, self.encoder.special, self.encoder.words = True, [], Memo(WORDS)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of, vocab = _bytes_of_characters(), self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            a_bytes[i] = bytes(map(byte_of.get, piece)) if all(c in byte_of for c in piece) else piece.encode()
        b_bytes, cut = [], True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode())
            cut &= _SPACE not in piece.lstrip(_SPACE)
        self.cut, self.pieces = cut, (a_bytes, b_bytes)
        self.blank = self.b.encode("\n")[0]  # the token of the blank that B writes first
        self.transducer, self.powers, self.known = Transducer(a_bytes, b_bytes), Powers(), Memo(UNITS)
        every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
        self.is_word = np.ones(0x110000, bool)
        self.is_word[[m.start() for m in regex.finditer(r"\s", every)] + _BLANK + _UNCLEAR] = False

    def _units(self, units: list[str]) -> list[tuple]:
        """(tokens of A, of B, groups, text of groups, links as bytes) of units, which start with a blank; () if bytes differ."""
        out, a_bytes, width = [], self.pieces[0], f"<u{self.encoder.width}"
        bs = self.b.encode([u[1:] for u in units], num_threads=1)
        raw = self.encoder.encode(units)
        flat, at = np.frombuffer(b"".join(raw), width).tolist(), 0
        for u, own, b in zip(units, raw, bs):
            end = at + len(own) // self.encoder.width
            a, at = flat[at:end], end
            if len(u) == 1:
                b = [self.blank]
            found = self.transducer.align(a, b) if b"".join(map(a_bytes.__getitem__, a)) == u.encode() else None
            out.append((len(a), len(b), found[1], found[0].encode(), array("Q", found[2]).tobytes()) if found else ())
        return out

    def units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct units, their numbers in order, how many units come before each text's end); texts start with a blank."""
        whole, edges = "".join(texts), np.cumsum([0, *map(len, texts)])
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        start = np.zeros(len(chars), bool)
        if self.cut:
            start[1:] = (chars[1:] == 32) & self.is_word[chars[:-1]]
        start[edges[:-1]] = True
        starts = np.flatnonzero(start)
        own = Distinct(chars, starts, np.append(starts[1:], len(chars)), self.powers)
        return [whole[x:y] for x, y in zip(own.starts.tolist(), own.ends.tolist())], own.codes, np.searchsorted(starts, edges[1:])


class Block:
    """Unit numbers of the documents of a block, and its units' pairs of ids."""

    def __init__(self):
        self.unit_of, self.units, self.bytes, self.rows = {}, [], 0, 0
        self.times = np.zeros(0, np.int64)

    def numbers(self, names: list[str], known: list[tuple]) -> np.ndarray:
        """Numbers of units in the block; those that don't fit are -1."""
        out = []
        for name, unit in zip(names, known):
            n = self.unit_of.setdefault(name, len(self.units)) if unit else -1
            if n == len(self.units):
                self.units.append(unit)
            out.append(n)
        return np.array(out, np.int64)

    def add(self, seen: np.ndarray) -> None:
        """Occurrences of each unit in further documents."""
        seen[: len(self.times)] += self.times
        self.times = seen

    def pairs(self) -> tuple[list[int], list[int], list[int], bytes, bytes]:
        """(a, b, links) of each pair of ids; pair numbers of the units' links in a row; how many each unit has."""
        sizes = np.array([len(u[4]) // 8 for u in self.units], np.int64)
        found, links = np.unique(np.frombuffer(b"".join(u[4] for u in self.units), np.uint64), return_inverse=True)
        n = np.zeros(len(found), np.int64)
        np.add.at(n, links, np.repeat(self.times, sizes))
        return (found >> np.uint64(32)).tolist(), (found & np.uint64(0xFFFFFFFF)).tolist(), n.tolist(), links.astype("<u4").tobytes(), sizes.astype("<u4").tobytes()


_ALIGNERS: dict = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


_OWN = (("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("groups_sha256", "string"), ("groups", "string"))
_BLOCK = (("block_", "string"), ("units_", "binary"), ("pairs_", "array<struct<a:int,b:int,n:bigint>>"), ("links_", "binary"), ("sizes_", "binary"))


def _aligned(docs: DataFrame, a_path: str, b_path: str, text: str, block: int, groups: bool) -> DataFrame:
    """A row for each document with its units, and one for each block with its pairs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    at = docs.columns.index(text)
    shape = docs.select([col(docs, c) for c in docs.columns if c != text])
    spark_shape = spark_schema(shape, *(_OWN if groups else _OWN[:-1]), *_BLOCK)
    for f in spark_shape.fields:
        f.nullable = True
    schema, others = to_arrow_schema(spark_shape), [k for k in range(len(docs.columns)) if k != at]
    n_own = len(others)

    def run(batches):
        from pyspark import TaskContext

        aligner, part, nth, now = _aligner(a_path, b_path), TaskContext.get().partitionId(), 0, Block()

        def closed():
            found = now.pairs()
            pairs = [{"a": a, "b": b, "n": n} for a, b, n in zip(*found[:3])]
            none = [pa.nulls(1, f.type) for f in list(schema)[: len(schema) - len(_BLOCK)]]
            return batch_of(schema, *none, [f"{part}-{nth}"], [None], [pairs], [found[3]], [found[4]])

        for b, texts in runs(batches, at, rows=ROWS):
            if not texts:
                continue
            size = sum(len(t or "") for t in texts)
            if now.rows and now.bytes + size > block:
                yield closed()
                nth, now = nth + 1, Block()
            now.bytes, now.rows = now.bytes + size, now.rows + len(texts)
            some = [k for k, t in enumerate(texts) if t]
            rows: list = [(0, 0, 0, 0, "", "", b"")] * len(texts)
            if some:
                names, codes, ends = aligner.units([" " + texts[k] for k in some])
                known = aligner.known.values(names, aligner._units)
                numbers = now.numbers(names, known)[codes]
                sizes, parts = np.array([u[:3] or (0, 0, 0) for u in known], np.int64).reshape(-1, 3)[codes], [u[3] if u else b"" for u in known]
                seen = np.zeros(len(now.units), np.int64)
                for k, x, y in zip(some, [0, *ends.tolist()], ends.tolist()):
                    if (own := numbers[x:y]).min() >= 0:
                        np.add.at(seen, own, 1)
                        n_a, n_b, n_groups = sizes[x:y].sum(axis=0).tolist()
                        joined = b";".join(map(parts.__getitem__, codes[x:y].tolist()))
                        rows[k] = (n_a, n_b, n_groups, n_a + n_b - n_groups, hashlib.sha256(joined).hexdigest(), joined.decode() if groups else "", own.astype("<u4").tobytes())
                now.add(seen)
            n = len(texts)
            found = [list(x) for x in zip(*rows)]
            own = [b.column(k).cast(schema.field(j).type) for j, k in enumerate(others)]
            results = found[:6] if groups else found[:5]
            yield batch_of(schema, *own, *results, [f"{part}-{nth}"] * n, found[6], *[pa.nulls(n, schema.field(n_own + len(results) + k).type) for k in (2, 3, 4)])
        if now.rows:
            yield closed()

    return docs.mapInArrow(run, spark_shape)


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", block: int = BLOCK, groups: bool = False) -> DataFrame:
    """docs without its text, with n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum; and groups, if asked for.

    A pair's count is how many links of all texts hold it. n_best are a
    document's links whose count is the highest of their B id; count_sum is
    the sum of its links' counts.
    """
    named = {n.lower() for n in RESULTS} | {"groups"} | {n for n, _ in _BLOCK}
    renamed, back = docs, {}
    for c in docs.columns:
        if c != text and c.lower() in {n for n, _ in _BLOCK}:
            new = free_name(renamed, f"own_{c}")
            renamed, back = renamed.withColumnRenamed(c, new), back | {new: c}
    kept = renamed.select([col(renamed, c) for c in renamed.columns if c == text or c.lower() not in named])
    found = written(_aligned(kept, a_path, b_path, text, block, groups))
    of_block = found.filter("units_ is null")
    pairs = of_block.select("block_", F.posexplode("pairs_").alias("at", "x")).select("block_", "at", "x.a", "x.b", "x.n")
    total = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    # A row for each id of B.
    best = total.groupBy("b").agg(F.max("count").alias("most"))
    scored = total.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    sent = pairs.select("block_", "at", "a", "b").join(scored, ["a", "b"]).select("block_", "at", "count", "best")
    tables = of_block.select("block_", "links_", "sizes_").unionByName(sent, allowMissingColumns=True)
    own = found.filter("units_ is not null").drop("pairs_", "links_", "sizes_")
    shape = own.drop("block_", "units_")
    out = spark_schema(shape, ("n_best", "bigint"), ("count_sum", "bigint"))
    for f in out.fields:
        f.nullable = True
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def run(key, docs_: pa.Table, table_: pa.Table) -> pa.Table:
        order = np.argsort((have := table_.filter(table_["at"].is_valid()))["at"].to_numpy())
        count, is_best = have["count"].to_numpy()[order], have["best"].to_numpy()[order].astype(np.int64)
        whole = table_.filter(table_["at"].is_null())
        links, sizes = (np.frombuffer(whole[c][0].as_py(), "<u4").astype(np.int64) for c in ("links_", "sizes_"))
        ends = np.cumsum(sizes)
        by_unit = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[np.concatenate([[0], ends])]) for x in (is_best, count)]
        raw = docs_["units_"].to_pylist()
        sums = [[int(x[np.frombuffer(u, "<u4")].sum()) for u in raw] for x in by_unit]
        return pa.Table.from_arrays([docs_[f.name] for f in list(schema)[:-2]] + [pa.array(x, pa.int64()) for x in sums], schema=schema)

    tables = tables.select(F.col("block_").alias("of_"), "links_", "sizes_", "at", "count", "best")
    joined = own.groupBy("block_").cogroup(tables.groupBy("of_")).applyInArrow(run, out)
    return joined.withColumnsRenamed(back)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    return found.select("doc_id", *RESULTS)
