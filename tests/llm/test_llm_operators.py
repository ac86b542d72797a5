"""Operators against brute force, with nulls, empty and long texts, ties, repeated rows, clashing names."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import bpe, decontaminate, langid, linededup, maxscore, pii, registry, simhash, substrings, tokenfile, warc

SF = "/root/testdata/sf0.001"
ALPHABET = "aab  \n\t\r'sté.,1234\x1c\x0b\xa0 漢字ا\x00"


def odd_texts(n, seed=0):
    r = random.Random(seed)
    return ["", "  ", " a", "a ", "a  b", "\n\n a\n", "x\x1c y", "it's", *["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def odd(docs):
    """Rows that every operator on documents has to take."""
    return [*docs, (None, docs[3][1]), (None, None), (7000, ""), (7001, None), (6000, " ".join(["a"] * 40)), (7002, docs[2][1]), (7002, docs[2][1]), (7003, "x y"), (-5, docs[50][1]), (7004, " ".join(f"w{i}" for i in range(30_000)))]


# Byte-level BPE


def test_bpe_is_tiktoken(spark, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, P.PATTERN)
    texts = [*odd_texts(600), "a" * 3000, "ab" * 2000, "ds" * 400, "lands" * 300, " " * 999, "x <|endoftext|> y"]
    ids = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [own.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def test_bpe_in_parts(monkeypatch):
    import public_tokenizers as P

    ranks, texts = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), ["", "a b" * 40, *odd_texts(300), "", "it's" * 30, "end"]
    for pattern in (P.PATTERN, r"\S+|\s+"):
        whole = bpe.Codec(ranks, pattern).encode(texts)
        monkeypatch.setattr(bpe, "PART", 50)
        split, codec = [], bpe.Codec(ranks, pattern)
        own = codec.split
        codec.split = lambda part: split.append(part) or own(part)  # noqa: B023
        assert codec.encode(texts) == whole and codec.encode([]) == []
        assert [t for part in split for t in part] == texts and all(len(part) == 1 or sum(map(len, part)) <= 50 for part in split)
        monkeypatch.undo()


def test_bpe_memory():
    """What a worker holds and keeps, over pieces of new words and words met again."""
    import os
    import subprocess
    import sys

    code = """
import random, re
import duckdb, numpy, pandas, public_tokenizers as P, pyarrow
from episodica.llm import bpe
own = lambda: sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10
before, r = own(), random.Random(0)
codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
for _ in range(6):
    texts = [" ".join("".join(r.choices("etaoinshrdlucmfw", k=6)) for _ in range(700)) for _ in range(200)]
    assert codec.decode(codec.encode(texts)) == [t.encode() for t in texts]
print(own() - before)
"""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": here}, cwd=here)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) < 230


def test_trimmed():
    """Memory that a task has freed between what its worker keeps goes back."""
    import os
    import subprocess
    import sys

    code = """
import re
from episodica.llm.common import trimmed
own = lambda: sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10
kept, before = [], own()
def run(batches):
    for b in batches:
        freed = []
        for _ in range(2000):
            freed.append(bytearray(50_000))
            kept.append(bytearray(600))
        yield b
assert list(trimmed(run)(iter([1, 2]))) == [1, 2] and len(kept) == 4000
print(own() - before)
"""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": here}, cwd=here)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) < 40


def test_bpe_frames(spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "hello hello", 7), (1, None, 8), (None, "", 9)], "doc_id int, text string, N_TOKENS int")
    got = bpe.round_trip(df, path, P.PATTERN).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2] and all(r.ids_sha256 for r in got)
    both = bpe.decode(bpe.encode(df.drop("N_TOKENS"), path, P.PATTERN), path, P.PATTERN).collect()
    assert {bytes(r.decoded) for r in both} == {b"hello hello", b""}
    assert bpe.round_trip(df.limit(0), path, P.PATTERN).count() == 0


# Token files


def test_elias_fano():
    r = np.random.default_rng(0)
    for n in (0, 1, 5, 255, 256, 257, 1000):
        for top in (1, 50, 10**12):
            v = np.sort(r.integers(0, top, n)).astype(np.uint64)
            e = tokenfile.EliasFano(tokenfile.ef_build(v))
            assert (e.slice(0, n) == v).all() and (e.slice(n // 3, n // 2) == v[n // 3 : n // 2]).all()
            assert [e.select(i) for i in range(0, n, 17)] == v[::17].tolist()
    assert len(tokenfile.ef_build(np.arange(0, 10**7, 1000, dtype=np.uint64))) < 10**4 * 2


def test_token_encoder_is_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own, e = Tokenizer.from_file(path), tokenfile.Encoder(path)
    texts = [*odd_texts(600, 1), "x <|endoftext|> y<|endoftext|> z"]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, docs, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own, rows = Tokenizer.from_file(path), odd(docs)
    manifest = tokenfile.write(frame(spark, rows).repartition(5), f"file://{tmp_path}", path, 2)
    got = sorted(tokenfile.read(spark, f"file://{tmp_path}", manifest, ids=True).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    ids = [own.encode(t or "", add_special_tokens=False).ids + [2] for _, t in want]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in got] == [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), x) for (d, _), x in zip(want, ids)]
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    store, _ = tokenfile.files_of(str(tmp_path))
    assert tokenfile.TokenFile(store, manifest[0]["path"]).document(1).tolist() == got[1].ids
    assert tokenfile.read(spark, "x", tokenfile.write(frame(spark, []), f"file://{tmp_path}/none", path, 2)).count() == 0


# Decontamination


@pytest.mark.parametrize("bound", [decontaminate.BOUND, 0])
def test_decontamination(spark, docs, bound):
    items = [(1, "the of"), (2, "and"), (3, "of the and in"), (4, None), (None, "x"), (5, " ".join(docs[5][1].split()[3:11])), (6, docs[7][1]), (6, "zz"), (7, "a " * 20), (8, "a a a"), (9, "")]
    rows = [*odd(docs), (9003, "a " * 50), (9004, "and"), (9005, "THE OF the of")]
    df = frame(spark, rows).withColumn("Items", F.lit(1)).withColumn("key", F.lit(2)).withColumn("found", F.lit(3))
    got = decontaminate.contamination(df, frame(spark, items, "item_id bigint, text string"), bound=bound)
    assert {"key", "found"} <= set(got.columns)
    found = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()), key=repr)
    assert found == sorted(brute.contamination(rows, items), key=repr)
    none = decontaminate.contamination(df, frame(spark, [], "item_id bigint, text string"), bound=bound)
    assert none.filter("n_hit > 0 or contaminated").count() == 0


# Substring deduplication


def test_substrings(spark, docs, monkeypatch):
    rows = odd(docs)
    for block, group in ((substrings.BLOCK, substrings.GROUP), (2000, 5)):
        monkeypatch.setattr(substrings, "BLOCK", block)
        monkeypatch.setattr(substrings, "GROUP", group)
        df = frame(spark, rows).repartition(3).withColumn("Kept", F.lit(1)).withColumn("k", F.lit(2))
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(df).collect()]
        assert sorted(got, key=repr) == sorted(brute.substrings(rows), key=repr)
    spans = substrings.dedup(frame(spark, rows[-2:] + [(60, rows[50][1])])).filter("n_removed > 0").first()
    assert sum(x.end - x.start for x in spans.removed) == spans.n_removed
    assert substrings.dedup(frame(spark, [])).count() == 0


def test_subtree_tells_words_apart_that_share_digits():
    same = np.zeros((3, substrings.WINDOW), np.uint16)
    assert substrings.subtree(same, np.array([1, 2, 1], np.uint64), np.array([9, 5, 7])).tolist() == [7, 5, 7]


# SimHash


def test_simhash(spark, docs):
    rows = odd(docs)
    df = frame(spark, rows).withColumn("fp", F.lit(1))
    got = {}
    for r in simhash.near_duplicates(df.drop("fp")).collect():
        got.setdefault(r.doc_id, set()).add((r.fp % (1 << 64), r.component_id))
    prints = [brute.fingerprint(t) for _, t in rows]
    want = {}
    for (d, _), p, c in zip(rows, prints, brute.components(prints, [d for d, _ in rows])):
        want.setdefault(d, set()).add((p, c))
    assert got == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_reach_every_pair_within_the_threshold(spark):
    r = random.Random(3)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    prints = {0}
    for _ in range(12):
        base = x = r.getrandbits(64)
        for _ in range(40):
            x = flip(x, r.randint(1, 6))
            prints |= {x, flip(base, 2)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    roots = {x.node: x.root for x in simhash.components(simhash.links(frame(spark, [(x,) for x in signed], "fp bigint"))).collect()}
    assert [roots.get(x, x) for x in signed] == brute.components(prints, signed)


def test_anchors_cover():
    near, around = simhash.code()
    words = np.arange(1 << 15)
    assert np.bitwise_count(near ^ words).max() == 1 and len(np.unique(near)) == 1 << 11
    assert np.bitwise_count(around ^ words[:, None]).max() == 2


# Personal data


def test_pii(spark, docs):
    texts = [t for _, t in odd(docs)] + ["a@b.c_d@e.f x@y", "😀 é@x a.b+c@d-e.fr.com.@z 1.2.3.4.5.6.7.8", "999.1.1.1 001.002.003.0255", "+1 (988) 555-2485 +12 +1-2 ++33 4567 8901.", "4111 1111 1111 1111, 4111-1111-1111-1112", "1" * 20_000, "a" * 20_000 + "@", "a@b." * 300 + "c", "x a@b.cd y " * 700]
    df = frame(spark, list(enumerate(texts))).withColumn("Spans", F.lit(1)).withColumn("k", F.lit(1)).withColumn("base", F.lit(1)).withColumn("terms_", F.lit(1)).withColumn("k_", F.lit(1))
    for r in pii.detect(df).collect():
        got = [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.spans if s.kind < len(pii.PATTERNS)]
        assert got == brute.pii(r.text), r.doc_id
    assert pii.detect(frame(spark, [])).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"w{i} lorem foo bar zorblax wrote to zed@site.com about thing number{i} words") for i in range(6)]
    rows += [(i, "the foo bar lorem wrote about words thing for all") for i in range(10, 600)]
    rows += [(i, "copied quintely text by joe@site.com") for i in range(700, 705)] + [(900, "Zorblax was here, zorblaxes not")]
    found = {r.doc_id: r for r in pii.detect(frame(spark, rows)).filter("size(spans) > 0").collect()}
    assert found[900].sanitised == "[TERM] was here, zorblaxes not"
    assert found[0].sanitised == "w0 lorem foo bar [TERM] wrote to [EMAIL] about thing number0 words"
    # Copies of one text are one context: no evidence.
    assert found[700].sanitised == "copied quintely text by [EMAIL]"


def test_disclosing_terms_anywhere(spark):
    far = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    # Far from the address; short names; CJK; near it in few documents; no name: in others' documents too.
    rows = [(i, f"Quandle Bo Xi\u4e00 \u738b\u4e94 common{i} {far(i)} so write to zed@site.com") for i in range(6)]
    rows += [(i, f"so to write common text {far(i)}") for i in range(10, 600)] + [(900, "quandle, Bo and \u738b\u4e94; to zed")]
    # An entity in a third of the documents.
    rows += [(1000 + i, f"Hotname {i} {far(i)} so write to often@site.com") for i in range(300)] + [(2000, "hotname")]
    # Three documents can't tell more than chance about a frequent entity.
    rows += [(3000 + i, f"Chancy {far(i)} so to write to often@site.com {i}") for i in range(3)]
    found = {r.doc_id: r for r in pii.detect(frame(spark, rows)).filter("size(spans) > 0").collect()}
    shown = lambda d: {s.value.lower() for s in found[d].spans if s.kind == len(pii.PATTERNS)} if d in found else set()
    assert shown(900) == {"quandle", "bo", "\u738b\u4e94"}
    assert shown(2000) == {"hotname"}
    assert shown(3000) == set() and shown(11) == set()


# Line deduplication


def test_line_dedup(spark, docs):
    rows = [(d, t, f"s{k % 4}" if k % 9 else None) for k, (d, t) in enumerate(odd(docs))]
    rows += [(8000 + i, f"menu\nhome {i % 2}\n \n \nbody {i}\nmenu", f"s{i % 5}") for i in range(20)] + [(8000, "menu", "s1"), (None, "menu\nbody 1", "s2")]
    df = frame(spark, rows, "doc_id bigint, text string, source string").withColumn("N_lines", F.lit(1)).withColumn("h", F.lit(1)).withColumn("pos", F.lit(1)).withColumn("gone_", F.lit(1)).withColumn("k_", F.lit(1))
    for least in (2, 3, 5):
        got = [(r.doc_id, r.text, r.n_removed) for r in linededup.dedup(df, min_sites=least).collect()]
        assert sorted(got, key=repr) == sorted(brute.line_dedup(rows, least), key=repr)
    assert linededup.dedup(df.limit(0)).count() == 0


# WARC


def test_warc(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"http://h/{i}\r\n☃", r.choice(["", "one", "two\r\n\r\nWARC/1.1", "x" * 300_000, f"own {i}", None])) for i in range(60)]
    rows += [(5, "http://again", rows[5][2]), (None, None, "one"), (None, "u", "alone")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("k", F.lit(1)).withColumn("payload", F.lit(1))
    whole = warc.write(warc.decided(df.repartition(3)), f"file://{tmp_path}/w")
    members = warc.normalise(spark, whole, f"file://{tmp_path}/m")
    got = warc.read(spark, members, f"file://{tmp_path}", payload=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    want = sorted(((i, len((t or "").encode()), None if (f := first.get(t or "")) is None or f == i else f) for i, _, t in rows), key=repr)
    assert sorted(((x.page_id, x.payload_bytes, x.refers_to) for x in got), key=repr) == want
    assert all((x.record_type == "revisit") == (x.refers_to is not None) for x in got)
    texts = {i: (t or "").encode() for i, _, t in rows if i is not None}
    assert all(bytes(x.payload) == (texts[x.page_id] if x.record_type == "response" else b"") for x in got if x.page_id is not None)
    assert all(x.url.endswith("%0D%0A☃") for x in got if x.url.startswith("http://h/"))
    short = warc.revisits(spark.createDataFrame([(1, ""), (2, "")], "k bigint, payload string"), least=1)
    assert short.count() == 0
    assert warc.read(spark, [], "x").count() == 0 and warc.write(warc.decided(df.limit(0)), f"file://{tmp_path}/n") == []


# Top-k search


def test_maxscore(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=12).astype(float).tolist()) for i in range(400)]
    rows += [(400, None), (401, [1.0, None]), (420, [float("nan")] * 12), (440, [float("inf")]), (460, [0.5, -0.5]), (480, []), (None, [1.0] * 12), (7, rows[7][1]), (20, rows[21][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("k", F.lit(1)).withColumn("w", F.lit(1))
    old, maxscore.SHARD = maxscore.SHARD, 64
    got = {}
    for x in maxscore.search(df, df.filter("vec_id % 20 = 0"), 5).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    maxscore.SHARD = old
    fine = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, v in fine:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:5]
            want.setdefault(q, []).extend((n + 1, i, -s) for n, (s, i) in enumerate(scored))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert maxscore.search(df, df.limit(0), 5).count() == 0 and maxscore.search(df.limit(0), df, 5).count() == 0


# Language ID


def test_language_id(spark):
    found = registry.QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = found.filter("held_out").join(truth, "doc_id")
    assert held.count() > 100 and held.filter("lang = lang_pred").count() / held.count() > 0.97


def test_language_id_odd_rows(spark, docs):
    rows = [(i, f"{'the and of' if i % 2 else 'der und die'} {i}", "en" if i % 2 else "de") for i in range(60)]
    model = langid.train(frame(spark, rows, "doc_id bigint, text string, lang string"))
    df = frame(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "der"), (5, "THE 漢"), (None, "🙂 𝒜"), (6, "und " * 200_000)]).withColumn("total", F.lit(1)).withColumn("Score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == got[6][0] == "de" and got[5][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.train(frame(spark, [(1, "x", None)], "doc_id bigint, text string, lang string")) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(name, against):
    against(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    recognised = {r.doc_id for r in stages["language ID"](spark, docs, SF).collect()}
    rows = sorted((r for r in rows if r["doc_id"] in recognised), key=lambda r: r["doc_id"])
    kept = brute.line_dedup([(r["doc_id"], r["text"], r["source"]) for r in rows], linededup.MIN_SITES)
    texts = {d: t for d, t, _ in kept}
    prints = [brute.fingerprint(texts[r["doc_id"]]) for r in rows]
    ids = [r["doc_id"] for r in rows]
    left = [d for d, c in zip(ids, brute.components(prints, ids)) if d == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [d for d, *_, bad in brute.contamination([(d, texts[d]) for d in left], items) if not bad]
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: brute.sha(texts[d] or "") for d in clean}


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "the cat sat", "en", "s", 11), (1, "the cat sat", "en", "s", 11), (None, None, None, None, None), (3, "", "en", None, 0)]
    for given in (rows, []):
        df = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= len(given)
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == len(given)


def test_near_dedup_with_repeated_ids(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    near = text(1) + " more"
    rows = [(1, text(0)), (2, text(0)), (2, text(1)), (3, near), (1, text(2)), (None, text(3)), (None, text(3)), (5, text(4)), (5, text(4) + " more"), (6, text(4)), (None, text(4))]
    df = frame(spark, rows).withColumn("lang", F.lit("en"))
    got = sorted(((r.doc_id, r.text.split()[0]) for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, df, SF).collect()), key=repr)
    assert got == sorted([(1, "word0x0"), (2, "word1x0"), (1, "word2x0"), (None, "word3x0"), (5, "word4x0")], key=repr)


def test_language_stage_keeps_what_has_letters(spark):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["language ID"]
    words = {"en": "the house and the river", "de": "das haus und der fluss", "fr": "la maison et le fleuve", "es": "la casa y el rio"}
    rows = [(i, f"{w} {i}", lang) for i in range(40) for lang, w in words.items()]
    odd_ = [(900, "the das la y", "en"), (901, "zzz", None), (902, "123 ...", None), (903, None, None)]
    schema = "doc_id bigint, text string, lang string"
    assert {r.doc_id for r in stage(spark, frame(spark, rows + odd_, schema), SF).collect()} == {*range(40), 900, 901}
    assert {r.doc_id for r in stage(spark, frame(spark, [(d, t, None) for d, t, _ in rows[:4] + odd_], schema), SF).collect()} == {0, 900, 901}
