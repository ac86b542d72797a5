"""Importance resampling towards a target: hashed n-grams, counted by suffix arrays of word ids.

Texts are words of letters, digits and characters beyond ASCII, with A-Z
lowered; features are all runs of 1 to DEPTH consecutive words, and a feature's
bucket is the CRC-32 of its words, joined by a blank, modulo BUCKETS. A bucket's
gain is floor(1000 ln) of how much likelier it is in the target than in the
documents (add-one smoothing), a document's weight the floored mean of its
features' gains. The weight and Gumbel noise from a hash of seed and id make
the score; the highest scores are a sample without replacement.

A task numbers the words of some texts at a time and sorts their suffixes by
the first DEPTH word ids. Neighbours' longest common prefixes of k words or more
are the runs of equal k-grams: each run is hashed once, and its bucket goes back
to the places where its n-gram occurs. Counts and scores read the texts apart;
nothing but counts (BUCKETS rows a task), ids and scores is shuffled.

Null and empty texts have no features and weight 0. A null id has no score and
takes no part in the draw. Equal scores go to the smaller id; repeated rows are
rows of their own. Very long texts are cut between words, each piece with
the DEPTH - 1 words after it, so that memory depends on PIECE (or on one word).
An empty table gives an empty table, an empty target one without features.
Other columns are kept, but for the text and those named as the results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, col, free_name, runs, spark_schema, table, written
from .pattern import Distinct, Powers

DEPTH, BUCKETS, SEED, PERCENT, LEAST_WORDS = 2, 10_000, 7, 25, 20
#: Bytes of a long text, or of some short ones, that are looked at together.
PIECE = 1 << 20
RESULTS = ("n_features", "weight", "score", "rank")

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NEXT = re.compile(rb"[^0-9a-z\x80-\xff]*[0-9a-z\x80-\xff]+")
_END = re.compile(rb"[0-9a-z\x80-\xff]*")


def pieces(text: str | None, depth: int, size: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, own): pieces of the lowered text; n-grams that start before `own` belong to the piece."""
    raw = (text or "").encode().translate(_LOWER)
    at = 0
    while at < len(raw):
        end = past = _END.match(raw, at + size).end() if at + size < len(raw) else len(raw)
        for _ in range(depth - 1):
            past = m.end() if (m := _NEXT.match(raw, past)) else len(raw)
        yield raw[at:past], end - at
        at = end


class Crc:
    """CRC-32 of joined strings from those of their parts."""

    LENGTHS = 64

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)  # fixed value: the reflected polynomial
        # shift[n, k, b]: what byte k of a checksum becomes when n zero bytes follow.
        self.shift = np.empty((self.LENGTHS + 1, 4, 256), np.uint32)
        self.shift[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for n in range(self.LENGTHS):
            self.shift[n + 1] = self.shift[n] >> 8 ^ step[self.shift[n] & 255]
        self.blank = np.uint32(zlib.crc32(b" "))

    def after(self, crc: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        out = self.shift[n, 0, crc & 255]
        for k in (1, 2, 3):
            out = out ^ self.shift[n, k, crc >> np.uint32(8 * k) & 255]
        return out

    def joined(self, left: np.ndarray, words: Words, which: np.ndarray) -> np.ndarray:
        """Checksums of left + blank + word."""
        left, length = self.after(left, 1) ^ self.blank, words.lengths[which]
        out = self.after(left, np.minimum(length, self.LENGTHS)) ^ words.crc[which]
        for k in np.flatnonzero(length > self.LENGTHS).tolist():
            out[k] = zlib.crc32(words.of(which[k]), int(left[k]))
        return out


class Words:
    """The distinct words of a piece of memory, and the word ids in order."""

    def __init__(self, raw: bytes, powers: Powers):
        self.raw, values = raw, np.frombuffer(raw, np.uint8)
        edge = np.diff(np.concatenate([[False], _WORD[values], [False]]).astype(np.int8))
        self.starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        own = Distinct(values, self.starts, ends, powers)
        self.ids, self.first, self.past = own.codes, own.starts.tolist(), own.ends.tolist()
        self.lengths = own.ends - own.starts
        self.crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(self.first, self.past)), np.uint32, len(self.first))

    def of(self, k: int) -> bytes:
        return self.raw[self.first[k] : self.past[k]]


def suffixes(ids: np.ndarray, owner: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, common prefix with the suffix before, columns) of word ids, both to `depth` words.

    A suffix ends with its owner; column j has the id after j words plus 1, or 0 past the end.
    """
    columns = [ids.astype(np.int64) + 1]
    for j in range(1, depth):
        x = np.zeros(len(ids), np.int64)
        x[:-j] = np.where(owner[j:] == owner[:-j], columns[0][j:], 0)
        columns.append(x)
    bits = int(columns[0].max()).bit_length() if len(ids) else 1
    if bits * depth <= 63:
        packed = columns[0]
        for x in columns[1:]:
            packed = packed << bits | x
        order = np.argsort(packed, kind="stable")
    else:
        order = np.lexsort(columns[::-1])
    common, same = np.zeros(len(ids), np.int32), np.ones(max(len(ids) - 1, 0), bool)
    for x in columns:
        x = x[order]
        same &= (x[1:] == x[:-1]) & (x[1:] > 0)
        common[1:] += same
    return order, common, columns


class Grams:
    """Buckets of the n-grams of texts, in one Python worker."""

    def __init__(self, depth: int, buckets: int, size: int):
        self.depth, self.buckets, self.size = depth, buckets, size
        self.crc, self.powers = Crc(), Powers()

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """(text of each n-gram, its bucket, words of each text) for pieces of texts."""
        held, total = [], 0
        for k, text in enumerate(texts):
            for raw, own in pieces(text, self.depth, self.size):
                if held and total + len(raw) > self.size:
                    yield self._block(held, len(texts))
                    held, total = [], 0
                held.append((k, raw, own))
                total += len(raw)
        if held:
            yield self._block(held, len(texts))

    def _block(self, held: list[tuple[int, bytes, int]], n_texts: int):
        words = Words(b" ".join(raw for _, raw, _ in held), self.powers)
        first = np.cumsum([0, *(len(raw) + 1 for _, raw, _ in held)])
        piece = np.searchsorted(first, words.starts, "right") - 1
        text = np.array([k for k, _, _ in held])[piece]
        own = words.starts < (first[:-1] + [o for _, _, o in held])[piece]
        order, common, columns = suffixes(words.ids, piece, self.depth)
        of, bucket = [], []
        for k in range(1, self.depth + 1):
            opens = common < k
            runs_ = order[opens]
            whole = columns[k - 1][runs_] > 0  # a run of suffixes with fewer words has no k-gram
            at = runs_[whole]
            crc = words.crc[words.ids[at]]
            for j in range(1, k):
                crc = self.crc.joined(crc, words, words.ids[at + j])
            found = np.full(len(runs_), -1, np.int64)
            found[whole] = crc % np.uint32(self.buckets)
            back = np.empty(len(order), np.int64)
            back[order] = found[np.cumsum(opens) - 1]
            kept = own & (back >= 0)
            of.append(text[kept])
            bucket.append(back[kept])
        return np.concatenate(of), np.concatenate(bucket), np.bincount(text[own], minlength=n_texts)


def counts(docs: DataFrame, text: str = "text", depth: int = DEPTH, buckets: int = BUCKETS, piece: int = PIECE) -> np.ndarray:
    """How many features of all texts are in each bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        grams, total = Grams(depth, buckets, piece), np.zeros(buckets, np.int64)
        for _, texts in runs(batches, 0):
            for _, bucket, _ in grams.blocks(texts):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield batch_of(schema, at.astype(np.int32), total[at])

    counted = docs.select(col(docs, text).alias("t")).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target's smoothed share / source's)) of each bucket."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, text: str = "text", depth: int = DEPTH, piece: int = PIECE, n_words: str = "n_words") -> DataFrame:
    """docs without its text, with n_features, weight and a column of the number of words."""
    names = {n_words.lower(), *RESULTS}
    kept = docs.select([col(docs, c) for c in docs.columns if c == text or c.lower() not in names])
    at = kept.columns.index(text)
    shape = kept.select([col(kept, c) for c in kept.columns if c != text])
    schema = arrow_schema(shape, ("n_features", pa.int64()), ("weight", pa.int64()), (n_words, pa.int64()))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # as many numbers as buckets

    def run(batches):
        gain = shared.value
        grams = Grams(depth, len(gain), piece)
        for b, texts in runs(batches, at):
            n, total, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for of, bucket, some in grams.blocks(texts):
                n += np.bincount(of, minlength=len(texts))
                np.add.at(total, of, gain[bucket])
                words += some
            own = [b.column(k).cast(f.type) for k, f in zip([k for k in range(b.num_columns) if k != at], schema)]
            yield batch_of(schema, *own, n, total // np.maximum(n, 1), words)

    return kept.mapInArrow(run, spark_schema(shape, ("n_features", "bigint"), ("weight", "bigint"), (n_words, "bigint")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", depth: int = DEPTH, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, piece: int = PIECE) -> DataFrame:
    """docs without its text, with n_features, weight, score and rank (from 1; null: not drawn).

    percent of the rows with least_words words or more are drawn, by their scores.
    """
    gain = gains(counts(docs, text, depth, buckets, piece), counts(target, target_text, depth, buckets, piece))
    n_words = free_name(docs, "n_words")
    weighed = weights(docs, gain, text, depth, piece, n_words)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), col(weighed, key).cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    scored = written(weighed.withColumn("score", F.col("weight") + noise))
    fits = free_name(scored, "fits_")
    scored = scored.withColumn(fits, F.coalesce((F.col(n_words) >= least_words) & F.col("score").isNotNull(), F.lit(False)))
    # Gains and noise lie between -90,000 and 90,000, so there are 360,000 different scores at most.
    above, many = free_name(scored, "above_"), free_name(scored, "many_")
    levels = scored.filter(F.col(fits)).groupBy("score").agg(F.count("*").alias(many))
    before = F.sum(many).over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    levels = levels.withColumn(above, F.coalesce(before, F.lit(0))).withColumnRenamed("score", "score_at_")
    total = scored.agg(F.count_if(fits).alias("n")).first().n
    joined = scored.join(F.broadcast(levels.select("score_at_", above)), (scored["score"] == levels["score_at_"]) & scored[fits], "left").drop("score_at_")
    place = F.row_number().over(Window.partitionBy("score", fits).orderBy(col(scored, key), "n_features", "weight")) + F.col(above)
    kept = [col(scored, c) for c in weighed.columns if c != n_words]
    return joined.select(*kept, "score", F.when(F.col(fits) & (place <= percent * total // 100), place).cast("bigint").alias("rank"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
with recursive d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
b as (select {_WORDS} as w from benchmark),
df as (
  select r, f, count(*) as n from (
    select r, unnest(w) as f from d
    union all select r, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) from d)
  group by r, f),
bf as (
  select f, count(*) as n from (
    select unnest(w) as f from b
    union all select unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) from b)
  group by f),
fs as materialized (select f, hex(encode(f)) as x from (select f from df union select f from bf)),
step(c, k, b) as (
  select b, 0, b from range(256) as r(b)
  union all select case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1, b from step where k < 8),
crc_of as materialized (select b, c from step where k = 8),
crc(f, x, c) as (
  select f, x, 4294967295::bigint from fs
  union all
  select f, x[3:], xor(crc.c >> 8, t.c) from crc join crc_of as t on t.b = xor(crc.c, ('0x' || x[:2])::bigint) & 255
  where x <> ''),
h as materialized (select f, xor(c, 4294967295) % {BUCKETS} as k from crc where x = ''),
s as (select k, sum(n) as s from df join h using (f) group by k),
t as (select k, sum(n) as t from bf join h using (f) group by k),
g as (
  select k, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + {BUCKETS})
    / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + {BUCKETS}))))::bigint as gain
  from range({BUCKETS}) as r(k) left join s using (k) left join t using (k)),
w as (
  select r, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight
  from df join h using (f) join g using (k) group by r),
v as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
  from d left join w using (r)),
o as (select doc_id, n_features, weight, score, n_words >= {LEAST_WORDS} as fits,
  row_number() over (partition by n_words >= {LEAST_WORDS} order by score desc, doc_id) as place from v)
select doc_id, n_features, weight, score, case when fits and place <= {PERCENT} * (select count(*) from o where fits) // 100 then place end::bigint as rank from o
"""
