"""Token banks, growing lines and traces: what is read, pruned, restarted and repeated."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.sources import bank, traces


def archive(path, episodes, dim=3, dtype=np.float16, compressed=True):
    parts = {}
    for ep, n in episodes.items():
        parts |= {f"tok_{ep}": np.arange(n * dim, dtype=dtype).reshape(n, dim) + ep, f"tok_from_{ep}": np.arange(n, dtype=np.int32), f"tok_until_{ep}": np.full(n, -1, np.int32), f"len_{ep}": np.array(10 * n)}
    (np.savez_compressed if compressed else np.savez)(path, **parts)


def test_bank_of_another_writer(spark, tmp_path):
    archive(tmp_path / "a.npz", {0: 2, 3: 1})
    archive(tmp_path / "b.npz", {7: 4, 12: 0}, compressed=False)
    rows = bank.read_bank(spark, str(tmp_path)).orderBy("ep", "pos").collect()
    assert [(r.ep, r.pos, r.steps, r.start, r.until) for r in rows] == [(0, 0, 20, 0, -1), (0, 1, 20, 1, -1), (3, 0, 10, 0, -1), *[(7, k, 40, k, -1) for k in range(4)]]
    assert rows[1].vector == [3.0, 4.0, 5.0] and rows[-1].vector == [16.0, 17.0, 18.0]
    assert bank.read_bank(spark, str(tmp_path / "a.npz"), vectors=False).columns == ["ep", "steps", "pos", "start", "until"]


def test_only_wanted_members_are_read(spark, tmp_path, monkeypatch):
    archive(tmp_path / "a.npz", {k: 5 for k in range(20)}, dim=400)
    found = bank.read_bank(spark, str(tmp_path), bytes_per_partition=1)
    assert found.rdd.getNumPartitions() == 20
    two = found.filter("ep in (3, 5) and pos > 1")
    assert two.rdd.getNumPartitions() == 2 and two.count() == 6
    assert found.filter("ep = 3").filter("ep = 5").count() == 0 and found.filter("ep > 17").count() == 10
    # The bytes that tasks read, by the offsets they read at.
    reader, seen = bank._Reader({"path": str(tmp_path), "vectors": "false"}), []
    reader.wanted = {4}
    member = bank._member
    monkeypatch.setattr(bank, "_member", lambda f, *at: seen.append(at) or member(f, *at))
    (part,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 5
    assert len(seen) == 3 and sum(size for _, size, _ in seen) < 600


def test_bank_is_written_whole(spark, tmp_path):
    rows = [(e, 50, p, p, -1 if p % 2 else p + 3, [float(e), p / 8]) for e in range(6) for p in range(4)]
    df = spark.createDataFrame(rows, "ep bigint, steps bigint, pos bigint, start bigint, until bigint, vector array<double>").orderBy(F.rand(1))
    bank.write_bank(df, str(tmp_path / "x"), "float16")
    assert sorted(tuple(r) for r in bank.read_bank(spark, str(tmp_path / "x")).collect()) == sorted(rows)
    name = next(f for f in os.listdir(tmp_path / "x") if f.endswith(".npz"))
    with np.load(tmp_path / "x" / name) as z:
        ep = next(k for k in z.files if k.startswith("len_"))[4:]
        assert z[f"tok_{ep}"].dtype == np.float16 and z[f"tok_{ep}"].shape == (4, 2)
    # What an attempt that didn't count has left isn't read.
    archive(tmp_path / "x" / "left.npz", {99: 2})
    assert bank.read_bank(spark, str(tmp_path / "x")).filter("ep = 99").count() == 0
    bank.write_bank(df.limit(0), str(tmp_path / "none"))
    assert bank.read_bank(spark, str(tmp_path / "none")).count() == 0


def test_lines_in_pieces(spark, tmp_path):
    texts = ["", "a", "é" * 40, "x" * 300, "  b\t", "last"]
    (tmp_path / "a.log").write_bytes("\n".join(texts).encode() + b"\nstill being writ")
    (tmp_path / "b.log").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"not this\n")
    for size in (1, 7, 64, 1 << 20):
        rows = traces.tail(spark, str(tmp_path), suffix=".log", bytes_per_partition=size).orderBy("at").collect()
        assert [r.line for r in rows] == texts
        assert [r.at for r in rows] == np.cumsum([0, *(len(t.encode()) + 1 for t in texts[:-1])]).tolist()


def run_once(spark, source, target, marks):
    lines = traces.tail(spark, source, stream=True)
    query = traces.append(lines.select(F.col("line").cast("bigint").alias("n")), target, marks).start()
    query.processAllAvailable()
    query.stop()


def test_restarts_lose_and_double_nothing(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    os.mkdir(source)
    n = 0
    for round_ in range(4):
        for name in ("a", "b")[: 1 + round_ % 2]:
            with open(f"{source}/{name}.log", "a") as f:
                for _ in range(50):
                    f.write(f"{n}\n")
                    n += 1
        with open(f"{source}/a.log", "a") as f:
            f.write("10")  # half a line
        run_once(spark, source, target, marks)
        got = sorted(r.n for r in traces.trace(spark, target, "n bigint").collect())
        assert got == sorted(got) and len(set(got)) == len(got) and set(range(n)) - set(got) == set()
        with open(f"{source}/a.log", "a") as f:
            f.write(f"{'0' * 3}{round_}\n")
    run_once(spark, source, target, marks)
    assert len(traces.trace(spark, target, "n bigint").collect()) == n + 4


def test_a_repeated_batch_leaves_no_rows(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    os.mkdir(source)
    with open(f"{source}/a.log", "w") as f:
        f.writelines(f"{k}\n" for k in range(30))
    run_once(spark, source, target, marks)
    # The driver was lost after the batch had been committed to the trace, but before Spark noted that.
    os.remove(f"{marks}/commits/0")
    if os.path.exists(f"{marks}/commits/.0.crc"):
        os.remove(f"{marks}/commits/.0.crc")
    run_once(spark, source, target, marks)
    assert sorted(r.n for r in traces.trace(spark, target, "n bigint").collect()) == list(range(30))
    assert len(os.listdir(f"{target}/commits")) == 1
    held = {m["name"] for c in os.listdir(f"{target}/commits") for m in json.load(open(f"{target}/commits/{c}"))["files"]}
    assert held == {f for f in os.listdir(f"{target}/data") if f.endswith(".jsonl")}


def test_files_only_grow(tmp_path):
    tail = traces._Tail({"path": str(tmp_path)})
    (tmp_path / "a").write_bytes(b"1\n2\n")
    before = tail.ends()
    (tmp_path / "a").write_bytes(b"1\n")
    with pytest.raises(ValueError, match="was read up to 4"):
        tail.ranges(before, tail.ends())


def test_a_trace_without_batches(spark, tmp_path):
    assert traces.trace(spark, str(tmp_path / "none"), "n bigint").count() == 0
