"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams, with the ends of
words marked. Document frequencies are counted over all documents that may be
learned from. The weights are fitted on at most PER_LABEL different documents
a label (the least by a hash of id and text) with follow-the-regularised-leader
updates and elastic-net penalties, and a temperature is then calibrated on a
part of the sample that the fit did not see.

A text that is null or has no letter gets label `und` and score 0, and so does
every text where there is nothing to learn from. Ties go to the smaller label.
Only the text decides a prediction; other columns are kept as they are, but
for those named as the results. Rows that repeat an id and a text count once in
the fit; an empty table gives an empty table. Long texts are taken in pieces of
PIECE characters. More than MOST_LABELS labels are an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import added, arrow_schema, batch_of, col, runs, spark_schema, table

#: Sampling bound for the fit, per label; n-grams have 1 to LENGTH characters; hash buckets of n-grams; labels.
PER_LABEL, LENGTH, BUCKETS, MOST_LABELS = 800, 3, 1 << 16, 1000
#: Characters that are looked at together, and a 32-bit odd multiplier.
PIECE, _MULTIPLIER = 1 << 18, np.uint32(0x9E3779B1)


def _letters() -> np.ndarray:
    """Which of the first 65,536 code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)


_LETTER: list[np.ndarray] = []


def grams(text: str | None):
    """Buckets of the text's n-grams, repeats included, in arrays; none if there is no letter.

    Characters are lowered; each run of other characters than letters, and
    each end of the text, counts as one boundary character.
    """
    if not text:
        return
    if not _LETTER:
        _LETTER.append(_letters())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[0][np.minimum(points, 0xFFFF)]
    for k in np.flatnonzero(points > 0xFFFF).tolist():
        letter[k] = chr(points[k]).isalpha()
    if not letter.any():
        return
    c = np.concatenate([[np.uint32(0)], np.where(letter, points, np.uint32(0)), [np.uint32(0)]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] | c[:-1]) != 0])]
    for k in range(0, len(c), PIECE):
        part = c[k : k + PIECE + LENGTH - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(LENGTH):
            h = (h[: len(part) - n] + part[n:] + np.uint32(n)) * _MULTIPLIER
            # The n-grams that start in this piece.
            yield ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))[:PIECE]


def frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """(documents, documents with the n-gram by bucket) over all of docs."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total, n, met = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, np.int8)
        for _, texts in runs(batches, 0):
            n += len(texts)
            for text in texts:
                met[:] = 0
                for part in grams(text):
                    met[part] = 1
                total += met
        at = np.flatnonzero(total)
        yield batch_of(schema, np.append(at, -1).astype(np.int32), np.append(total[at], n))

    counted = docs.select(col(docs, text).alias("text")).mapInArrow(run, "bucket int, n bigint")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    df, n = np.zeros(BUCKETS, np.int64), 0
    for r in found:
        if r.bucket < 0:
            n = r.n
        else:
            df[r.bucket] = r.n
    return n, df


def sample(docs: DataFrame, per_label: int, key: str, text: str, label: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of the per_label documents of each label that are least by a hash of id and text.

    Documents of equal id and text count once, so that no label is lost or
    outweighed by one that is repeated.
    """
    chosen = docs.select(col(docs, label).alias("label"), col(docs, text).alias("text"), F.xxhash64(col(docs, key), col(docs, text)).alias("h"))
    counts = {r.label: r.n for r in chosen.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counts:
        return []
    # A first cut by the hash, with room for the error of the counts, leaves few rows to rank.
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, 1.5 * per_label / max(n, 1)) if n > per_label // 2 else 1.0)) for k, n in counts.items()))
    near = chosen.filter(F.pmod("h", F.lit(1 << 30)) < share[F.col("label")] * (1 << 30))
    once = near.groupBy("label", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("label").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    picked = once.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_label).select("label", "text", "h")
    schema = pa.schema([("label", pa.string()), ("h", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for b, texts in runs(batches, 1):
            found = []
            for text in texts:
                counts = np.zeros(BUCKETS, np.int64)
                for part in grams(text):
                    counts += np.bincount(part, minlength=BUCKETS)
                at = np.flatnonzero(counts)
                found.append((at.astype("<i4").tobytes(), counts[at].astype("<i4").tobytes()))
            yield batch_of(schema, b.column(0), b.column(2), [x for x, _ in found], [x for _, x in found])

    # per_label rows a label at most.
    rows = picked.mapInArrow(run, "label string, h bigint, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r.h, r.label, r.buckets))
    return [(r.label, np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.counts, "<i4")) for r in rows if r.buckets]


@dataclass
class Model:
    """labels; per bucket the scaled idf times the weights; bias; temperature."""

    labels: list[str]
    table: np.ndarray  # BUCKETS rows, a column for each label
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str | None) -> np.ndarray | None:
        """None if the text has no letter."""
        total, n = np.zeros(len(self.labels)), 0
        for part in grams(text):
            total += self.table[part].sum(axis=0)
            n += len(part)
        return _softmax((total / n + self.bias) / self.temperature) if n else None


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows, n_docs: int, df: np.ndarray, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, scale: float = 30.0) -> Model | None:
    """Follow-the-regularised-leader with proximal elastic net, then the temperature."""
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    known = np.unique(np.concatenate([r[1] for r in rows]))
    slot = np.full(BUCKETS, len(known), np.int32)
    slot[known] = np.arange(len(known), dtype=np.int32)
    idf = np.log((1 + n_docs) / (1 + df[known])) + 1
    data = []
    for label, buckets, counts in rows:
        at = slot[buckets]
        data.append((labels.index(label), at, scale * counts / counts.sum() * idf[at]))
    # Every fifth row (in order of a hash) is for the temperature; a tiny sample serves for both.
    held, learn = data[::5], [x for k, x in enumerate(data) if k % 5] or data
    m, c = len(known), len(labels)
    z, n, w = np.zeros((m + 1, c)), np.zeros((m + 1, c)), np.zeros((m + 1, c))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(learn)):
            y, at, x = learn[k]
            at, x = np.append(at, m), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            ws = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
            ws[np.abs(zs) <= l1] = 0
            p = _softmax(x @ ws)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha
            z[at] = zs + g - sigma * ws
            n[at] = ns + g * g
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    w[np.abs(z) <= l1] = 0
    logits = np.array([x @ w[at] + w[m] for _, at, x in held])
    truth = np.array([y for y, _, _ in held])
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    table = np.zeros((BUCKETS, c), np.float32)
    table[known] = w[:m] * (scale * idf)[:, None]
    return Model(labels, table, w[m], temperature)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = PER_LABEL) -> Model | None:
    """A model from the rows of docs that have a label; None if there are none."""
    labelled = docs.filter(col(docs, label).isNotNull())
    rows = sample(labelled, per_label, key, text, label)
    return fit(rows, *frequencies(labelled, text)) if rows else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted label and its probability; columns of these names are replaced."""
    docs = docs.select([col(docs, c) for c in docs.columns if c == text or c.lower() not in (pred.lower(), score.lower())])
    schema = arrow_schema(docs, (pred, pa.string()), (score, pa.float64()))
    at = docs.columns.index(text)
    # The model has BUCKETS rows, a float for each label.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b, texts in runs(batches, at):
            found = [model.probabilities(t) if model else None for t in texts]
            best = [None if p is None else int(p.argmax()) for p in found]
            yield added(b, schema, ["und" if k is None else model.labels[k] for k in best], [0.0 if k is None else float(p[k]) for p, k in zip(found, best)])

    return docs.mapInArrow(run, spark_schema(docs, (pred, "string"), (score, "double")))


def held_out(key: Column) -> Column:
    """True for the fifth of the documents that is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
