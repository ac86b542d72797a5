"""Exact top-k search by MaxScore over sharded postings.

Terms are the vector components, weights are floor(64 * x); the score is the
integer inner product. Candidates are dealt into shards of about SHARD rows;
a shard keeps its postings by term. Queries come in blocks of QUERIES; every block meets
every shard by an equality join on the shard's number, so no side is ever
broadcast or collected.

In a shard, a term's score for a query lies between two bounds (its weight
times the least or greatest posting). Rows come in pieces. The k-th best score
so far is the one to beat: terms, widest bounds first, are essential until a
row that has the least of each of them can't reach it by the best of the
others. The essential postings are traversed for all rows of the piece, the
others are probed only for rows whose upper bound still reaches the score to
beat. It rises from piece to piece, and the terms are split anew. Shards give
their k best per query, which are merged.

Rows whose vector is null or has a null, NaN or infinite component take no
part; a shorter vector has zeros at its end. Ties go to the smaller id, null
ids take no part, and rows that repeat an id are ranked each. A query never
meets rows of its own id; equal queries count once, and an id that is asked
with several vectors gets a list for each. Scores that could leave 64-bit
integers are an error. Empty tables give an empty result. Further columns
don't count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, col, table

SCALE, SHARD, QUERIES = 64, 8192, 1024
#: Rows of the first two pieces, after which each is as long as all before it; terms that are probed at a time; a term is a list
#: if fewer than one in SPARSE rows have it.
PIECE, STEP, SPARSE = 1024, 8, 4


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, w): ids and integer weights of the rows that take part."""
    x = F.transform(col(df, vector), lambda v: v.cast("double"))
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = df.filter(col(df, key).isNotNull() & col(df, vector).isNotNull() & fine)
    whole = lambda v: F.when(F.abs(v) < float(1 << 56), F.floor(SCALE * v).cast("bigint")).otherwise(F.raise_error(F.lit("a component too large for 64-bit scores")).cast("bigint"))
    return kept.select(col(df, key).cast("bigint").alias("k"), F.transform(x, whole).alias("w"))


def _packed(df: DataFrame, block: str, size: int) -> DataFrame:
    """One row per block: ids and weights as arrays of bytes, and their width."""
    schema = pa.schema([(block, pa.int64()), ("ids", pa.binary()), ("weights", pa.binary()), ("width", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, lists = table.column("k").to_numpy(), table.column("w").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        width = int(lengths.max(initial=0))
        w = np.zeros((len(ids), width), np.int64)
        at = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)
        w[np.repeat(np.arange(len(ids)), lengths), at] = flat[offsets[0] : offsets[-1]]
        return pa.table([[table.column(block)[0].as_py()], [ids.astype("<i8").tobytes()], [w.astype("<i8").tobytes()], [width]], schema=schema)

    return df.groupBy(block).applyInArrow(run, f"{block} bigint, ids binary, weights binary, width bigint")


class Shard:
    """Postings of one shard, by term, in pieces of PIECE rows and more.

    A term that few rows have is a list of rows and weights; the others are
    arrays of the weights of all rows.
    """

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, whole = ids[order], np.ascontiguousarray(weights[order].T)
        self.low, self.high = whole.min(axis=1), whole.max(axis=1)
        self.listed = np.count_nonzero(whole, axis=1) * SPARSE < whole.shape[1]
        self.pieces, at = [], 0
        while at < len(ids):
            part = np.ascontiguousarray(whole[:, at : at + max(PIECE, at)])
            lists = {t: (rows := np.flatnonzero(part[t]), part[t, rows]) for t in np.flatnonzero(self.listed).tolist()}
            # Sums of up to 2**53 are exact as doubles; beyond that, integers are used.
            self.pieces.append((at, part, part.astype(np.float64), lists))
            at += part.shape[1]

    def _all(self, piece, terms: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        """Scores of all rows of a piece by the terms: arrays are multiplied, lists are walked."""
        _, whole, fast, lists = piece
        held = fast if exact else whole
        walked = self.listed[terms] if lists else None
        dense = terms if walked is None else terms[~walked]
        score = query[dense] @ held[dense]
        for t in terms[walked].tolist() if walked is not None else ():
            rows, weights = lists[t]
            score[rows] += query[t] * weights
        return score

    def top(self, key: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, best first."""
        n = min(len(query), len(self.low))
        q, low, high = query[:n], self.low[:n], self.high[:n]
        most = int(np.abs(q).astype(object).dot(np.maximum(np.abs(low), np.abs(high)).astype(object))) if n else 0
        if most >= 1 << 63:
            raise OverflowError("scores beyond 64-bit integers")
        exact = most < 1 << 53
        least, best = np.minimum(q * low, q * high), np.maximum(q * low, q * high)
        order = np.argsort(least - best, kind="stable")
        # What a row can reach that has the least of the first e terms: falls with e.
        reach = np.concatenate([[0], np.cumsum(least[order])]) + np.concatenate([np.cumsum(best[order][::-1])[::-1], [0]])
        rest = best[order][::-1].cumsum()[::-1].tolist() + [0]
        kind = np.float64 if exact else np.int64
        q = q.astype(kind)
        lo, hi = (int(np.searchsorted(self.ids, key, side)) for side in ("left", "right"))
        beat, scores, rows = None, np.zeros(0, kind), np.zeros(0, np.int64)
        for piece in self.pieces:
            start, held = piece[0], piece[2] if exact else piece[1]
            # As the score to beat rises, more of the terms can't lift a row over it on their own.
            e = n if beat is None else min(n, int(np.searchsorted(-reach, -beat, "right")))
            score = self._all(piece, order[:e], q, exact)
            keep = np.ones(len(score), bool) if beat is None else score + rest[e] >= beat
            keep[max(lo - start, 0) : max(hi - start, 0)] = False
            alive = np.flatnonzero(keep)
            score = score[alive]
            # The other terms are probed, the widest first, for rows that still compete.
            for at in range(e, n, STEP):
                if not len(alive):
                    break
                part = order[at : at + STEP]
                # While most rows compete, a product over all of them is cheaper than picking them out.
                many = 2 * len(alive) > held.shape[1]
                score = score + ((q[part] @ held[part])[alive] if many else q[part] @ held[part[:, None], alive])
                if beat is not None:
                    keep = score + rest[min(at + STEP, n)] >= beat
                    alive, score = alive[keep], score[keep]
            scores, rows = np.append(scores, score), np.append(rows, alive + start)
            if len(scores) >= k:
                first = np.lexsort((rows, -scores))[:k]
                scores, rows = scores[first], rows[first]
                beat = scores[-1] if k else None
        first = np.lexsort((rows, -scores))[:k]
        return self.ids[rows[first]], scores[first].astype(np.int64)


def search(candidates: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates of another id."""
    cands, asked = usable(candidates, key, vector), usable(queries, key, vector).distinct()
    counts = cands.agg(F.count("*").alias("n")).first().n, asked.agg(F.count("*").alias("n")).first().n
    shards, blocks = (max(1, -(-n // size)) for n, size in zip(counts, (SHARD, QUERIES)))
    deal = lambda n: F.pmod(F.xxhash64("k", "w"), F.lit(n)).cast("bigint")
    postings = _packed(cands.withColumn("shard", deal(shards)), "shard", SHARD)
    asked = _packed(asked.withColumn("block", deal(blocks)), "block", QUERIES)
    asked = asked.withColumnsRenamed({"ids": "query_ids", "weights": "query_weights", "width": "query_width"})
    paired = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(postings, "shard")
    schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        import xxhash

        def matrix(ids, weights, width):
            ids = np.frombuffer(ids, "<i8")
            return ids, np.frombuffer(weights, "<i8").reshape(len(ids), width)

        last, known = None, None
        for b in batches:
            for r in range(b.num_rows):
                x = {n: b.column(n)[r].as_py() for n in b.schema.names}
                if x["shard"] != last:
                    last, known = x["shard"], Shard(*matrix(x["ids"], x["weights"], x["width"]))
                ids, rows = matrix(x["query_ids"], x["query_weights"], x["query_width"])
                found = [known.top(i, q, k) for i, q in zip(ids.tolist(), rows)]
                each = [len(v) for v, _ in found]
                same = np.array([xxhash.xxh64_intdigest(np.trim_zeros(q, "b").tobytes()) for q in rows], np.uint64).view(np.int64)
                yield batch_of(schema, np.repeat(ids, each), np.repeat(same, each), np.concatenate([v for v, _ in found]), np.concatenate([s for _, s in found]))

    best = paired.mapInArrow(run, "query_id bigint, query bigint, vec_id bigint, score bigint")
    return merge(best, k)


def merge(best: DataFrame, k: int) -> DataFrame:
    """The k best of the shards' lists of each query."""
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: top 20 of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 20 = 0"), 20)


OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as w from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda x: x[1] * x[2]))::bigint as score
  from v as q join v as c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
