"""The queries without SQL, on all rows of a small folder, against the libraries or brute force; robustness of the pipeline's stages."""

import hashlib
import zlib

import brute
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from episodica.llm import bpe, common, langid, maxscore, pii, registry, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def got(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, SF).collect())


def digest(x):
    return hashlib.sha256(x).hexdigest()


def test_op2_is_tiktoken(spark, rows):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for d, t in rows:
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        want.append((d, len(ids), digest(ids.tobytes()), digest((t or "").encode())))
    assert got(spark, "op2_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_op7_base_spans(spark, rows):
    want = []
    for d, t in rows:
        found = brute.pii(t)
        want.append((d, *[sum(x.startswith(f"{k}:") for x in found) for k in brute.PII], digest(",".join(found).encode())))
    assert got(spark, "op7_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want)
    for d, base, spans in got(spark, "op7_pii", "doc_id", "base_sha256", "spans"):
        kept = [x for x in spans.split(",") if x and not x.startswith("term:")]
        assert digest(",".join(kept).encode()) == base


def test_op8_components(spark, rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    ids = [d for d, _ in rows]
    want = [(d, f"{p:016x}", c) for d, p, c in zip(ids, prints, brute.components(prints, ids))]
    assert got(spark, "op8_simhash", "doc_id", "fingerprint", "component_id") == sorted(want)


def test_op9_is_the_library(spark, rows):
    from tokenizers import Tokenizer

    own, start, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for d, t in sorted(rows):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got(spark, "op9_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_op10_is_plain_ftrl():
    """The fit against updates of one weight at a time."""
    r = np.random.default_rng(1)
    rows = [("abc"[k % 3], np.unique(r.integers(0, 60, 9)) + 20 * (k % 3), None) for k in range(90)]
    rows = [(label, at, r.integers(1, 5, len(at))) for label, at, _ in rows]
    df = np.zeros(langid.BUCKETS, np.int64)
    for _, at, _ in rows:
        df[at] += 1
    model = langid.fit(rows, 90, df, epochs=2)
    alpha, beta, l1, l2, scale = 0.3, 1.0, 0.02, 0.02, 30.0
    z, n, bias = {}, {}, langid.BUCKETS

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - np.sign(z[k]) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2)

    learn, order = [x for k, x in enumerate(rows) if k % 5], np.random.default_rng(0)
    for _ in range(2):
        for k in order.permutation(len(learn)):
            label, at, counts = learn[k]
            x = {int(b): scale * c / counts.sum() * (np.log(91 / (1 + df[b])) + 1) for b, c in zip(at, counts)} | {bias: 1.0}
            score = np.array([sum(v * weight((b, c)) for b, v in x.items()) for c in range(3)])
            p = np.exp(score - score.max())
            p /= p.sum()
            p["abc".index(label)] -= 1
            for b, v in x.items():
                for c in range(3):
                    g, w, before = v * p[c], weight((b, c)), n.get((b, c), 0.0)
                    z[b, c] = z.get((b, c), 0.0) + g - (np.sqrt(before + g * g) - np.sqrt(before)) / alpha * w
                    n[b, c] = before + g * g
    for b in range(120):
        idf = np.log(91 / (1 + df[b])) + 1
        assert np.allclose(model.table[b], [weight((b, c)) * scale * idf for c in range(3)], atol=1e-4), b
    assert np.allclose(model.bias, [weight((bias, c)) for c in range(3)])


def test_language_sample_keeps_every_label(spark):
    rows = [(1, "the and of", "en")] * 3000 + [(10 + i, f"der und die {i}", "de") for i in range(900)] + [(2000 + i, f"le la les {i}", "fr") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    found = [x[0] for x in langid.sample(df, 50, "doc_id", "text", "lang")]
    assert {k: found.count(k) for k in set(found)} == {"en": 1, "de": 50, "fr": 50}
    assert langid.sample(df.limit(0), 50, "doc_id", "text", "lang") == []


def test_token_ids_of_long_words():
    codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    text = "x" * 70_000 + " y" * 3 + "\n" * 5000
    (ids,) = codec.encode([text])
    assert codec.decode([ids, b"", ids]) == [text.encode(), b"", text.encode()]
    other = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), r"\S+|\s+")
    assert other.decode(other.encode(["ab  cd", "", None])) == [b"ab  cd", b"", b""]


def test_maxscore_splits_anew(monkeypatch):
    """Few pieces or many, lists or arrays: the same rows."""
    r = np.random.default_rng(2)
    w = np.floor(64 * r.normal(size=(700, 24))).astype(np.int64)
    w[:, 12:][r.random((700, 12)) < 0.9] = 0
    w[40:60] = w[40]
    ids = r.permutation(5000)[:700].astype(np.int64)
    for piece in (7, 64, 10_000):
        monkeypatch.setattr(maxscore, "PIECE", piece)
        shard = maxscore.Shard(ids, w)
        assert shard.listed.any() and not shard.listed.all()
        for j in range(0, 60, 7):
            score = w @ w[j]
            want = [i for i in np.lexsort((ids, -score)) if i != j][:20]
            a, b = shard.top(int(ids[j]), w[j], 20)
            assert a.tolist() == ids[want].tolist() and b.tolist() == score[want].tolist()


def test_maxscore_probes_less_than_all():
    """Past the first piece, terms are left out for most rows."""
    r = np.random.default_rng(3)
    w = np.floor(64 * r.normal(size=(8192, 48))).astype(np.int64)
    shard, seen = maxscore.Shard(np.arange(8192), w), []
    inner = shard._all
    shard._all = lambda piece, terms, *a: seen.append(len(terms)) or inner(piece, terms, *a)
    shard.top(0, w[0], 20)
    assert seen[0] == 48 and max(seen[1:]) < 36


def test_maxscore_refuses_what_overflows(spark):
    df = spark.createDataFrame([(20, [1e30]), (21, [1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        maxscore.search(df, df, 5).collect()


def test_near_duplicates_take_any_names(spark):
    df = spark.createDataFrame([(1, "a b c d e", 7), (2, "a b c d e", 7), (3, None, 7)], "doc_id bigint, text string, fp int")
    wide = df.withColumns({c: F.lit(0) for c in ("root_", "least_", "a", "b", "node", "component_id", "anchor")})
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(wide).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert simhash.near_duplicates(df.select("fp", "text"), key="fp").count() == 3
    assert pii.detect(wide).count() == 3


def test_pipeline_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    extra = ["pred_", "score_", "lang_pred", "score", "n_lines", "n_removed", "N_WORDS", "n_hit", "items", "spans", "n_items", "contaminated", "fp", "key_", "row_a", "kept_", "k", "h", "salt"]
    words = {"en": "the house and the river", "de": "das haus und der fluss"}
    rows = [(i, f"{w} {i} {w}", lang, f"s{i}", 3) for i in range(20) for lang, w in words.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.withColumns({c: F.concat(F.lit(f"own {c} "), F.col("doc_id")) for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert all(r[c] == f"own {c} {r.doc_id}" for r in out.collect() for c in extra), name
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == len(rows)


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
