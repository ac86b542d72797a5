"""Benchmark decontamination by winnowing.

Texts are words of letters, digits and characters beyond ASCII, with A-Z
lowered. Of every WINDOW consecutive words, the minimum hash of K consecutive
words is a fingerprint, on both sides; so two texts that share WINDOW words
share a fingerprint, which is extended word by word in both directions. A
document word is hit if it is inside WINDOW shared consecutive words (or
inside a whole item that is shorter; there, K and the window shrink with the
item's length).

A benchmark of up to `bound` bytes goes to every task; a larger one is joined
by fingerprints, and each document gets the items that it shares one with.

Null texts have no words. Items without words or without an id take no part,
rows that repeat an id count as one item, and items are listed in order of
their ids as text. A document is contaminated if n_hit > 0 and
20 * n_hit >= n_words. Columns of docs with the names of the results are
replaced; the others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, arrow_schema, batch_of, col, free_name, runs, spark_schema, table
from .words import Hashes, grams, inside, owners, starts, winnow

WINDOW, K = 13, 5
#: Bytes of item texts that are sent to every task; beyond, fingerprints are joined.
BOUND = 8 << 20
#: Bytes that separate words, as blanks; A-Z as a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def _shape(n: int) -> tuple[int, int]:
    """(k, hashes in a window) for items of n words."""
    k = min(K, n)
    return k, min(n, WINDOW) - k + 1


def fingerprints(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints for items of n words (WINDOW for longer ones)."""
    k, w = _shape(n)
    found = grams(words, k)
    _, picked = winnow(found, inside(owner, k + w - 1), w)
    at = np.flatnonzero(picked)
    return at, found[at] ^ np.uint64(n)  # another value for each length


class Items:
    """Benchmark items with their fingerprints."""

    def __init__(self, items: list[tuple[str, str]], hashes: Hashes):
        unique = dict.fromkeys((i, tuple(w)) for i, t in items if i is not None and (w := words_of(t)))
        self.ids, self.words = [i for i, _ in unique], [list(w) for _, w in unique]
        lengths = [len(w) for w in self.words]
        self.hashed = hashes.of([x for w in self.words for x in w])
        self.first, owner = starts(lengths), owners(lengths)
        self.lengths = sorted({min(n, WINDOW) for n in lengths})
        keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        of = np.minimum(np.array(lengths, np.int64), WINDOW)[owner] if lengths else owner
        for n in self.lengths:
            where, found = fingerprints(self.hashed, owner, n)
            own = of[where] == n
            at.append(where[own])
            keys.append(found[own])
        keys, at = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.owner = keys[order], at[order], owner

    def hits(self, docs: list[list[bytes]], hashes: Hashes):
        """For each document: (mask of hit words, indexes of the items)."""
        lengths = [len(w) for w in docs]
        hashed, first, owner = hashes.of([x for w in docs for x in w]), starts(lengths), owners(lengths)
        masks, found = [np.zeros(n, bool) for n in lengths], [set() for _ in docs]
        pairs = [np.zeros((0, 3), np.int64)]
        for n in self.lengths:
            at, keys = fingerprints(hashed, owner, n)
            low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            count = high - low
            if not count.any():
                continue
            doc_at = np.repeat(at, count)
            item_at = self.at[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
            d, i = owner[doc_at], self.owner[item_at]
            # Hits on one diagonal of a document and an item extend to the same spans.
            shift = doc_at - np.array(first)[d] - (item_at - np.array(self.first)[i])
            pairs.append(np.unique(np.stack([d, i, shift], axis=1), axis=0))
        for d, i, shift in np.unique(np.concatenate(pairs), axis=0).tolist():
            for a, b in self._spans(docs[d], i, shift, hashed[first[d] : first[d + 1]]):
                masks[d][a:b] = True
                found[d].add(i)
        return masks, found

    def _spans(self, doc: list[bytes], i: int, shift: int, hashed: np.ndarray):
        """Document spans on this diagonal of at least a window of the item."""
        item = self.words[i]
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        need = min(len(item), WINDOW)
        if b - a < need:
            return
        same = hashed[a + shift : b + shift] == self.hashed[self.first[i] + a : self.first[i] + b]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))).tolist()
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= need and doc[a + s + shift : a + e + shift] == item[a + s : a + e]:
                yield a + s + shift, a + e + shift


def _result(masks, found, items: Items | None):
    spans = []
    for mask in masks:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()
        spans.append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])])
    return [len(m) for m in masks], [int(m.sum()) for m in masks], [sorted({items.ids[i] for i in f}) if items else [] for f in found], spans


_MORE = (("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<string>"), ("spans", "array<struct<start:bigint,end:bigint>>"))
#: Columns that contamination() adds or replaces.
RESULTS = ("n_words", "n_hit", "items", "spans", "n_items", "contaminated")
_ARROW = (("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", bound: int = BOUND) -> DataFrame:
    """docs with n_words, n_hit, items (ids as text), spans (of hit words), n_items, contaminated."""
    names = {n for n, _ in _MORE} | {"n_items", "contaminated"}
    kept = docs.select([col(docs, c) for c in docs.columns if c == text or c.lower() not in names])
    items = benchmark.select(col(benchmark, item).cast("string").alias("i"), col(benchmark, item_text).alias("t")).filter("i is not null and t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0)).alias("n")).first().n
    out = _sent(kept, [(r.i, r.t) for r in items.collect()], text) if size <= bound else _joined(kept, items, text)
    return out.withColumn("n_items", F.size("items").cast("bigint")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _sent(docs: DataFrame, items: list[tuple[str, str]], text: str) -> DataFrame:
    schema, at = arrow_schema(docs, *_ARROW), docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most `bound` bytes

    def run(batches):
        hashes = Hashes()
        known = Items(shared.value, hashes)
        for b, texts in runs(batches, at):
            yield added(b, schema, *_result(*known.hits([words_of(t) for t in texts], hashes), known))

    return docs.mapInArrow(run, spark_schema(docs, *_MORE))


def _prints(df: DataFrame, lengths: list[int] | None) -> DataFrame:
    """(key, h) for rows (key, t): of items by their own length, of documents for all lengths."""
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64())])

    def run(batches):
        hashes = Hashes()
        for b, texts in runs(batches, 1):
            cut = [words_of(t) for t in texts]
            sizes = [len(w) for w in cut]
            hashed, owner = hashes.of([x for w in cut for x in w]), owners(sizes)
            keys = b.column(0).to_numpy()
            of = np.minimum(np.array(sizes, np.int64), WINDOW)
            for n in lengths or sorted({int(x) for x in of if x}):
                at, h = fingerprints(hashed, owner, n)
                d = owner[at]
                if lengths is None:
                    d, h = d[of[d] == n], h[of[d] == n]
                yield batch_of(schema, keys[d], h.view(np.int64))

    return df.mapInArrow(run, "key bigint, h bigint").distinct()


def _joined(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """Fingerprints joined; documents are identified by a hash of their words' text."""
    own, listed = free_name(docs, "key"), free_name(docs, "found")
    keyed = docs.withColumn(own, F.xxhash64(col(docs, text)))
    items = items.withColumn("key", F.xxhash64("i", "t"))
    sizes = [r.n for r in _lengths(items).distinct().collect()]  # WINDOW values at most
    pairs = _prints(keyed.select(own, text).dropDuplicates([own]), sizes).join(_prints(items.select("key", "t"), None).withColumnRenamed("key", "item"), "h").select("key", "item").distinct()
    lists = pairs.join(items.select(F.col("key").alias("item"), "i", "t"), "item").groupBy("key").agg(F.collect_set(F.struct("i", "t")).alias(listed)).withColumnRenamed("key", f"{own}_")
    joined = keyed.join(lists, keyed[own] == lists[f"{own}_"], "left").drop(own, f"{own}_")
    shape = joined.drop(listed)
    schema, at, last = arrow_schema(shape, *_ARROW), joined.columns.index(text), joined.columns.index(listed)

    def run(batches):
        hashes = Hashes()
        for b, texts in runs(batches, at):
            columns = [[], [], [], []]
            for t, given in zip(texts, b.column(last).to_pylist()):
                known = Items([(x["i"], x["t"]) for x in given or ()], hashes)
                for out, value in zip(columns, _result(*known.hits([words_of(t)], hashes), known)):
                    out += value
            yield added(b, schema, *columns)

    return joined.mapInArrow(run, spark_schema(shape, *_MORE))


def _lengths(items: DataFrame) -> DataFrame:
    schema = pa.schema([("n", pa.int64())])

    def run(batches):
        for _, texts in runs(batches, 0):
            yield batch_of(schema, sorted({min(n, WINDOW) for t in texts if (n := len(words_of(t)))}))

    return items.select("t").mapInArrow(run, "n bigint")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
n as (select item_id, w, least(len(w), {WINDOW}) as n from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s from n, unnest(range(1, len(w) - n + 2)) as r(i)),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s from d, (select distinct n from win), unnest(range(1, len(w) - n + 2)) as r(i)),
h as (select doc_id, i, dw.n, item_id from dw join win on win.s = dw.s and win.n = dw.n),
p as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join p on d.doc_id = p.doc_id left join t on d.doc_id = t.doc_id
"""
