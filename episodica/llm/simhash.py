"""SimHash near-duplicates by anchor points of a covering code.

A document's fingerprint has 64 bits; two fingerprints link at MOST (4) or
fewer differing bits. The bits are split into three segments, so linked
fingerprints differ by at most one bit in one of them. A segment's anchors are
the words of the [15,11] Hamming code on 15 of its bits, one set for each value
of its other bits. The code has covering radius 1: every fingerprint has a
home anchor within one bit, and visits all anchors within radius plus
threshold (two bits on the code, or one of the other bits and one on the
code). The home fingerprints of an anchor are compared with all its visitors.

Equal fingerprints are one row before any of this. An anchor gives a spanning
forest of its links, not all pairs, where it has more links than rows, and
large-star / small-star rounds turn the links into components, with the edges
of a hub dealt to several parts. Nothing is collected; each round is cut in the
reliable checkpoint folder.

Text: A-Z lowered, words separated by ASCII white space, shingles of 4 words
joined by a blank, repeats included; fewer words make one shingle, none the
fingerprint zero, which links like any other. Nulls are empty texts. A null
document id never names a component unless all its ids are null. Every row has
a row of the result, however often it is repeated; an empty table gives an
empty one. Long texts are hashed in pieces of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, col, cut, free_name, runs, spark_schema, table, written

SHINGLE, SEED, MOST = 4, 42, 4
#: Parts that the edges of one node are dealt to.
SALTS = 16
#: (first bit, bits besides the 15 of the code) of each segment.
SEGMENTS = ((0, 6), (21, 6), (42, 7))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    import xxhash

    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if n > SHINGLE:
        starts, ends = starts[: n - SHINGLE + 1], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    one, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 14):
        part = [one(joined[a:b], SEED) for a, b in zip(starts[k : k + (1 << 14)].tolist(), ends[k : k + (1 << 14)].tolist())]
        total += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """docs without its text, with the fingerprint as a (signed) 64-bit integer."""
    at, rest = docs.columns.index(text), [c for c in docs.columns if c != text]
    shape = docs.select([col(docs, c) for c in rest])
    schema = arrow_schema(shape, (name, pa.int64()))

    def run(batches):
        for b, texts in runs(batches, at):
            own = [b.column(k).cast(f.type) for k, f in zip((k for k in range(b.num_columns) if k != at), schema)]
            yield batch_of(schema, *own, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.mapInArrow(run, spark_schema(shape, (name, "bigint")))


def code() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word: its nearest codeword, and the codewords within two bits (repeats fill up)."""
    words = np.arange(1 << 15, dtype=np.int64)
    syndrome = np.zeros_like(words)
    for bit in range(15):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    near = np.where(syndrome, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
    around = np.sort(np.stack([near, *[near[words ^ (1 << bit)] for bit in range(15)]], axis=1), axis=1)
    # A word off the code has 8 codewords within two bits, each reached twice; a codeword has itself.
    return near, around[:, ::2]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, home) rows: the home anchors and all visited ones."""
    near, around = code()
    x, out = fps.view(np.uint64), []
    for s, (first, free) in enumerate(SEGMENTS):
        part = (x >> np.uint64(first)).astype(np.int64) & ((1 << (15 + free)) - 1)
        u, f = part & 32767, part >> 15
        key = lambda c, f: (s << 40) | (f << 15) | c  # noqa: B023, E731
        out.append((key(near[u], f), x, np.ones(len(x), bool)))
        for j in range(around.shape[1]):
            c = around[u, j]
            new = (c != near[u]) & ((c != around[u, j - 1]) if j else True)
            out.append((key(c, f)[new], x[new], np.zeros(new.sum(), bool)))
        for bit in range(free):
            out.append((key(near[u], f ^ (1 << bit)), x, np.zeros(len(x), bool)))
    a, b, c = zip(*out)
    return np.concatenate(a), np.concatenate(b).view(np.int64), np.concatenate(c)


def _links(fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one anchor's rows, or a spanning forest if they are more than the rows."""
    x, at = fps.view(np.uint64), np.flatnonzero(home)
    step, found, label = max(1, (1 << 20) // len(x)), [], None
    for k in range(0, len(at), step):
        h, v = np.nonzero(np.bitwise_count(x[at[k : k + step], None] ^ x[None, :]) <= MOST)
        h = at[k : k + step][h]
        h, v = h[h != v], v[h != v]
        if label is None and sum(len(a) for a, _ in found) + len(h) <= len(x):
            found.append((h, v))
            continue
        label = np.arange(len(x)) if label is None else label
        for a, b in [*found, (h, v)]:
            label = _merge(label, a, b)
        found = []
    if label is not None:
        v = np.flatnonzero(label != np.arange(len(x)))
        found = [(label[v], v)]
    h, v = (np.concatenate(z) for z in zip(*found)) if found else (at[:0], at[:0])
    return fps[h], fps[v]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least member) after joining the sets of a[i] and b[i]."""
    while True:
        p, q = label[a], label[b]
        differ = p != q
        if not differ.any():
            return label
        a, b, p, q = a[differ], b[differ], p[differ], q[differ]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label != label[label]).any():
            label = label[label]


def links(fps: DataFrame, name: str = "fp") -> DataFrame:
    """(a, b), a < b: links that connect all fingerprints within MOST bits; fps are distinct."""
    spread = pa.schema([("anchor", pa.int64()), ("fp", pa.int64())])
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def emit(batches):
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                a, x, home = anchors(b.column(0).slice(k, 4096).to_numpy(zero_copy_only=False))
                yield batch_of(spread, a << 1 | home, x)

    def compare(batches):
        held_a, held_x = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            held_a, held_x = np.concatenate([held_a, b.column(0).to_numpy()]), np.concatenate([held_x, b.column(1).to_numpy()])
            whole = int(np.searchsorted(held_a >> 1, held_a[-1] >> 1)) if len(held_a) else 0
            if whole:
                yield batch_of(pair, *_runs_of(held_a[:whole], held_x[:whole]))
                held_a, held_x = held_a[whole:], held_x[whole:]
        yield batch_of(pair, *_runs_of(held_a, held_x))

    at = fps.select(F.col(name).alias("fp")).mapInArrow(emit, "anchor bigint, fp bigint")
    key = F.shiftright("anchor", 1)
    found = at.repartition(key).sortWithinPartitions("anchor").mapInArrow(compare, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _runs_of(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal anchors; small runs are compared together."""
    anchor, home = keys >> 1, (keys & 1).astype(bool)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    size = np.diff(np.append(first, len(keys)))
    homes = np.add.reduceat(home, first, dtype=np.int64) if len(first) else size
    out = [(fps[:0], fps[:0])]
    for r in np.flatnonzero((homes > 0) & (size > 64)).tolist():
        s = slice(first[r], first[r] + size[r])
        out.append(_links(fps[s], home[s]))
    run = np.repeat(np.arange(len(first)), size)
    at = np.flatnonzero(home & (size <= 64)[run])
    for k in range(0, len(at), 1 << 15):
        part = at[k : k + (1 << 15)]
        n = size[run[part]]
        h = np.repeat(part, n)
        v = np.repeat(first[run[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        near = np.bitwise_count(fps.view(np.uint64)[h] ^ fps.view(np.uint64)[v]) <= MOST
        near &= h != v
        out.append((fps[h[near]], fps[v[near]]))
    a, b = zip(*out)
    return np.concatenate(a), np.concatenate(b)


def _told(edges: DataFrame, least: DataFrame, node: str, other: str) -> DataFrame:
    """Edges with m, what least has for their node; the edges of one node are dealt to SALTS parts by its neighbours."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return dealt.join(least.select("*", salts), [node, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b) but the roots; the root is the component's least node."""
    edges, seen = cut(edges), None
    while True:
        # Large star: all larger neighbours of a node get its least neighbour.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _told(both, least, "a", "b").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        # Small star: a node and its smaller neighbours get the least of those.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = _told(large, least, "b", "a").select("b", "a", "m")
        small = small.select(F.col("m").alias("a"), "b").union(small.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = cut(small.filter("a <> b").distinct())
        state = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        if state == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", fp: str = "fp", component: str = "component_id") -> DataFrame:
    """(key, fp, component) of every row: the least key among all linked ones.

    A result whose name the key has already gets underscores after it.
    """
    own = docs.select(col(docs, key).alias("k"), col(docs, text).alias("t"))
    prints = written(fingerprints(own, "t", "print"))
    nodes = prints.groupBy("print").agg(F.min("k").alias("least"))
    roots = components(links(nodes.select("print"), "print"))
    of = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("top"))
    of = written(of)
    by_root = of.groupBy("top").agg(F.min("least").alias("name"))
    found = prints.join(of.join(by_root, "top").select("print", "name"), "print")
    out = found.select(F.col("k").alias(key))
    fp = free_name(out, fp)
    component = free_name(out.withColumn(fp, F.lit(0)), component)
    return found.select(F.col("k").alias(key), F.col("print").alias(fp), F.col("name").alias(component))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
