"""Importance resampling, chunked BPE and token alignment against plain versions and the libraries."""

import bisect
import collections
import hashlib
import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from episodica.llm import alignment, chunkbpe, importance, registry

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_resample(docs, target, depth, buckets, seed, percent, least):
    def features(t):
        w = brute.LETTERS.findall(brute.lower(t))
        return w, [" ".join(w[i : i + n]) for n in range(1, depth + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    n_s, n_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)}
    out, fits = [], []
    for k, (d, x) in enumerate(docs):
        w, f = features(x)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        score = None
        if d is not None:
            h = int(sha(f"{seed}:{d}")[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(w) >= least:
                fits.append((-score, d, len(f), weight, k))
        out.append([d, len(f), weight, score, None])
    for rank, x in enumerate(sorted(fits)[: percent * len(fits) // 100], 1):
        out[x[-1]][-1] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("depth,piece", [(2, 1 << 20), (1, 50), (3, 7), (4, 40)])
def test_resample(spark, depth, piece):
    r = random.Random(1)
    words = ["the", "The", "cat", "x1", "été", "日本語", "a" * 70, "b" * 200, "ÀB"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    docs = [(k, text(r.choice([0, 1, 5, 19, 20, 30, 200]))) for k in range(150)] + [(500, None), (501, ""), (502, "!!"), (None, text(30)), (9, text(25)), (3, "cat " * 40), (3, "cat " * 40)]
    target = [text(9), None, "", "cat the"]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit(5) for c in ("SCORE", "n_words", "bucket", "fits_", "above_")})
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, bench, depth=depth, buckets=97, seed=3, percent=40, least_words=20, piece=piece)
    assert {"n_words", "bucket", "fits_", "above_"} <= set(got.columns) and "text" not in got.columns
    rows = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()), key=repr)
    assert rows == plain_resample(docs, target, depth, 97, 3, 40, 20)


def test_resample_of_nothing(spark):
    df, bench = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([], "text string")
    assert importance.resample(df.limit(0), bench).collect() == []
    (row,) = importance.resample(df, bench, least_words=1, percent=100).collect()
    assert (row.n_features, row["rank"]) == (3, 1)


def test_runs_of_suffixes():
    ids, owner = np.array([1, 2, 1, 2, 1, 2]), np.array([0, 0, 0, 0, 1, 1])
    order, common, _ = importance.suffixes(ids, owner, 3)
    assert order.tolist() == [2, 4, 0, 3, 5, 1] and common.tolist() == [0, 2, 2, 0, 1, 1]


def hard_texts(seed):
    r = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "ll", "12", "é", "日本", "，", "<|endoftext|>", "<|endo", "</s>", "<0x41>", "▁", "　", "\x85", "\x1c", "​", " the", " don't", "\r\n", "🙂", "ﬁ", "\0", "\xa0", "﻿", "᠎"]
    texts = ["".join(r.choice(parts) for _ in range(r.choice([0, 1, 2, 5, 50, 400]))) for _ in range(250)]
    return [*texts, texts[7], texts[7], None, "", " ", "  ", "\n", "a ", "x" * 20_000, "日" * 700, " " * 3000, "ab, " * 2000]


def test_chunks_follow_content():
    """A passage gives the same chunks wherever it stands."""
    r = np.random.default_rng(1)
    same = r.integers(97, 123, 5000).astype(np.uint32)
    for before in (0, 1, 13, 300):
        chars = np.concatenate([r.integers(97, 123, before).astype(np.uint32), same])
        starts, ends = chunkbpe.cuts(chars, np.array([0, len(chars)]), bits=6)
        assert starts[0] == 0 and ends[-1] == len(chars) and (starts[1:] == ends[:-1]).all() and (ends - starts).max() <= chunkbpe.MOST
        found = {chars[a:b].tobytes() for a, b in zip(starts, ends)}
        known = found if before == 0 else known
        assert len(known & found) >= len(known) - 2
    starts, ends = chunkbpe.cuts(np.zeros(10_000, np.uint32), np.array([0, 10_000]), most=300)
    assert (ends - starts).max() <= 300 and ends[-1] == 10_000


@pytest.mark.parametrize("bits,most,window", [(9, 2048, 16), (3, 64, 4), (1, 8, 4), (0, 1, 1)])
def test_chunks_give_the_library_s_tokens(monkeypatch, bits, most, window):
    from tokenizers import Tokenizer

    cuts = chunkbpe.cuts
    monkeypatch.setattr(chunkbpe, "cuts", lambda chars, edges: cuts(chars, edges, window, bits, most))
    codec, own, texts = chunkbpe.ChunkCodec(A), Tokenizer.from_file(A), hard_texts(5)
    for found in (codec.encode(texts), codec.encode(texts)):
        want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [codec.numbers(x) for x in found] == want
    assert [codec.decode(w) for w in want] == [own.decode(w, skip_special_tokens=False) for w in want]


def test_chunks_of_other_tokenizers():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    codec, own = chunkbpe.ChunkCodec(path), Tokenizer.from_file(path)
    texts = ["The Cat sat<|endoftext|> on", "", None]
    want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not codec.plain and [codec.numbers(x) for x in codec.encode(texts)] == want
    assert [codec.decode(w) for w in want] == [own.decode(w, skip_special_tokens=False) for w in want]


def test_equal_chunks_are_encoded_once(monkeypatch):
    codec, seen = chunkbpe.ChunkCodec(A), []
    inner = codec.encoder.encode
    monkeypatch.setattr(codec.encoder, "encode", lambda texts: seen.extend(texts) or inner(texts))
    text = " ".join(f"word{k * 7919 % 1000}" for k in range(2000))
    codec.encode([text])
    first, long = len(seen), sum(map(len, seen))
    codec.encode(["Something else first. " + text])
    assert sum(map(len, seen[first:])) < long / 3


def test_op12_is_the_library(spark):
    from tokenizers import Tokenizer

    own, want = Tokenizer.from_file(A), []
    for x in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = own.encode(x.text or "", add_special_tokens=False).ids
        want.append((x.doc_id, len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(x) for x in registry.QUERIES["op12_chunk_bpe"](spark, SF).collect()) == sorted(want)


def test_chunked_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x"), (2, None, 6, "y")], "IDS bigint, text string, n_tokens int, decoded string")
    found = chunkbpe.encode(df, A)
    assert found.columns == ["text", "n_tokens", "decoded", "ids"] and [r.ids for r in found.orderBy("n_tokens").collect()] == [[64, 275], []]
    back = chunkbpe.decode(found, A)
    assert sorted(r.decoded for r in back.collect()) == ["", "a b"]
    assert sorted(r.n_tokens for r in chunkbpe.round_trip(df, A).collect()) == [0, 2]
    assert chunkbpe.round_trip(df.limit(0), A).count() == 0


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    own, other = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    own.encode_special_tokens = True
    byte_of = chunkbpe._bytes_of_characters()
    names = {i: p for p, i in own.get_vocab(with_added_tokens=True).items()}
    of_a = lambda i: bytes(byte_of[c] for c in names[i])
    of_b = lambda i: bytes([int(other.id_to_piece(i)[3:5], 16)]) if other.is_byte(i) else other.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for d, t in rows:
        a, b, raw = (own.encode(" " + t, add_special_tokens=False).ids, other.encode(t), (" " + t).encode()) if t else ([], [], b"")
        spans = [np.cumsum([0, *(len(f(i)) for i in ids)]).tolist() for f, ids in ((of_a, a), (of_b, b))]
        if not t or b"".join(map(of_a, a)) != raw or b"".join(map(of_b, b)) != raw:
            found.append((d, None))
            continue
        common = sorted(set(spans[0][1:]) & set(spans[1][1:]))
        groups = [[[], []] for _ in common]
        for side, ids in enumerate((a, b)):
            for k, i in enumerate(ids):
                groups[bisect.bisect_left(common, spans[side][k + 1])][side].append(str(i))
        links = [(i, j) for k, i in enumerate(a) for m in range(max(0, bisect.bisect_right(spans[1], spans[0][k]) - 1), len(b)) for j in [b[m]] if spans[1][m] < spans[0][k + 1]] if len(t) < 3000 else None
        if links is None:
            links, m = [], 0
            for k, i in enumerate(a):
                while spans[1][m + 1] <= spans[0][k]:
                    m += 1
                links += [(i, b[j]) for j in range(m, bisect.bisect_left(spans[1], spans[0][k + 1]))]
        found.append((d, (len(a), len(b), links, ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups), len(common))))
    n = collections.Counter(x for _, f in found if f for x in f[2])
    best = {}
    for (_, b), k in n.items():
        best[b] = max(best.get(b, 0), k)
    empty = (0, 0, 0, 0, 0, 0, "")
    return sorted(((d, *(empty if f is None else (f[0], f[1], f[4], len(f[2]), sum(n[x] == best[x[1]] for x in f[2]), sum(n[x] for x in f[2]), sha(f[3])))) for d, f in found), key=repr)


def test_op13_is_plain(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = registry.QUERIES["op13_token_alignment"](spark, SF)
    assert sorted((tuple(r[c] for c in ("doc_id", *alignment.RESULTS)) for r in got.collect()), key=repr) == plain_alignment(rows)


@pytest.mark.parametrize("block", [1500, 1 << 23])
def test_alignment_of_hard_texts(spark, block):
    rows = [(k, t) for k, t in enumerate(hard_texts(8)) if t is None or len(t) < 9000]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("block_", "units_", "N_A", "at", "count", "a")})
    got = alignment.align(df, A, B, block=block)
    found = got.collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in found for c in ("block_", "units_", "at", "count", "a"))
    assert sorted((tuple(r[c] for c in ("doc_id", *alignment.RESULTS)) for r in found), key=repr) == plain_alignment(rows)


def test_groups_are_texts(spark):
    df = spark.createDataFrame([(1, "tokenization"), (2, None)], "doc_id bigint, text string")
    one, two = alignment.align(df, A, B, groups=True).orderBy("doc_id").collect()
    assert sha(one.groups) == one.groups_sha256 and one.groups.count(";") + 1 == one.n_groups and (two.groups, two.groups_sha256) == ("", "")
    assert alignment.align(df.limit(0), A, B).count() == 0


def test_transducer_follows_the_leading_side():
    t = alignment.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"x"], most=2)
    assert t.align([0, 1], [0, 1]) == ("0,1|0,1", 1, [0 << 32 | 0, 0 << 32 | 1, 1 << 32 | 1])
    assert t.align([2, 2], [0, 1, 0, 1]) == ("2|0,1;2|0,1", 2, [2 << 32 | 0, 2 << 32 | 1] * 2)
    assert t.align([0], [2]) is None and t.align([0, 1], [0]) is None and t.align([0], [0]) is None and t.align([], [0]) is None
