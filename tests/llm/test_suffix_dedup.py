import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from stacklight.llm import suffix_dedup as S


def brute(rows, t=100):
    """rows: (id, text) in order of ids."""
    first, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        lost = np.zeros(len(data), bool)
        for p in range(len(data) - t + 1):
            s = data[p : p + t]
            if s in first:
                lost[p : p + t] = True
            first.add(s)
        kept = bytes(b for b, x in zip(data, lost) if not x)
        runs = int(np.sum(lost & ~np.append(False, lost[:-1])))
        out.append((i, kept, len(data), int(lost.sum()), runs))
    return out


def told(df):
    return sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in df.collect()), key=repr)


def texts(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 4, 1 + int(rng.integers(0, 6)))) for _ in range(n))
    shared = [word(int(n)) for n in rng.integers(15, 90, 6)]
    out = [None, "", "x" * 99, "x" * 100, "x" * 101, "x" * 700, "ab" * 300, "é" * 120, word(400)]
    for _ in range(40):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            parts.append(word(int(rng.integers(0, 30))))
            s = shared[int(rng.integers(0, 6))]
            a = int(rng.integers(0, len(s) // 2))
            parts.append(s[a : a + int(rng.integers(90, 200))])
        out.append(" ".join(parts))
    return out + [out[-1], out[8], out[8] + "!", "?" + out[8], out[8][:300] + "changed" + out[8][300:]]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = [(3 * i, t) for i, t in enumerate(texts(seed))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("pos", "__id", "__own", "own", "hash", "gone", "kept", "n_spans")}).withColumn("th", F.lit("x")).repartition(5)
    got = S.drop_repeated_substrings(docs)
    assert {"pos", "th", "text", "__id", "__own", "gone"} < set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert told(got) == sorted(brute(rows), key=repr)


def test_pieces_of_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    long = "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 5000))
    parts = [bytes(x) for x in (long.encode(), b"", long.encode()[1200:4000], b"short")]
    whole = {}
    for piece in (1 << 21, 1000, 150):
        monkeypatch.setattr(S, "PIECE", piece)
        seen = set()
        for data, rows, starts, ends, base in S._laid(parts, 100):
            first, n, *_ = S.segments(data, starts, ends)
            k = np.searchsorted(starts, first, "right") - 1
            for r, p, m in zip(rows[k], first - starts[k] + base[k], n):
                new = {(int(r), int(q)) for q in range(p, p + m)}
                assert not new & seen
                seen |= new
        whole[piece] = seen
    assert whole[1 << 21] == whole[1000] == whole[150] == {(0, p) for p in range(4901)} | {(2, p) for p in range(2701)}


def test_repeated_and_nameless_rows(spark):
    rng = np.random.default_rng(2)
    a, b = ("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 150)) for _ in range(2))
    rows = [(4, a), (4, a), (None, a), (None, b), (2, b[:120]), (9, "z")]
    got = told(S.drop_repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")))
    by = {(r[0], r[2]): r for r in got}
    assert [r[3] for r in got if r[0] == 4] == [0, 0]
    assert by[(2, 120)][3] == 0
    assert sorted(r[3] for r in got if r[0] is None) == [120, 150]
    assert S.drop_repeated_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("period", [1, 7, 26, 60, 90, 130])
def test_texts_that_repeat_themselves(spark, period):
    rng = np.random.default_rng(period)
    unit = "".join(chr(97 + int(c)) for c in rng.integers(0, 26, period))
    rows = [(k, (unit * 20)[:n] + tail) for k, (n, tail) in enumerate([(150, ""), (101, ""), (230, "end"), (999, "")])]
    for some in ([r] for r in rows):
        assert told(S.drop_repeated_substrings(spark.createDataFrame(some, "doc_id long, text string"))) == brute(some)
    assert told(S.drop_repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = {i: (n, lost, runs, hashlib.sha256(kept).hexdigest()) for i, kept, n, lost, runs in brute([(r.doc_id, r.text) for r in docs])}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op10_suffix_dedup(spark, "/root/testdata/sf0.001").collect()} == want


def near_copies(n, size, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 123, size).astype(np.uint8)
    out = []
    for _ in range(n):
        base[rng.integers(0, size, 3)] = 48
        out.append(base.tobytes())
    return out


def batch_of(texts, **more):
    ids = np.arange(len(texts))
    return pa.RecordBatch.from_pydict({"id": pa.array(ids), "th": pa.array(ids), "t": pa.array(texts, pa.binary()), **more})


def with_runs(texts):
    """A batch as _parter() takes it, all runs of each text given."""
    runs = []
    for t in texts:
        first, n, *_ = S.segments(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))
        runs.append([{"pos": int(p), "n": int(m)} for p, m in zip(first, n)])
    packed = [zstandard.compress(t, 1) for t in texts]
    return batch_of(packed, runs=pa.array(runs, pa.list_(pa.struct([("pos", pa.int64()), ("n", pa.int32())]))))


def to_cut(texts):
    gone = pa.array([[{"pos": 10, "n": 100}, {"pos": 60, "n": 100}]] * len(texts), pa.list_(pa.struct([("pos", pa.int64()), ("n", pa.int32())])))
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(np.arange(len(texts))), "text": pa.array([zstandard.compress(t, 1) for t in texts], pa.binary()), "gone": gone})


def peak_mb(task, batch):
    tracemalloc.start()
    try:
        for _ in task([batch]):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("step", ["rank", "part", "cut"])
def test_a_task_needs_little_memory_for_near_copies(step):
    task, batch = {
        "rank": lambda: (S._ranker(100, 32), batch_of(near_copies(1000, 30_000))),
        "part": lambda: (S._parter(100, 32, 24), with_runs(near_copies(120, 30_000))),
        "cut": lambda: (S._cutter(1, 2), to_cut(near_copies(2000, 30_000))),
    }[step]()
    assert peak_mb(task, batch) < 100


def test_batches_told_in_portions(monkeypatch):
    texts = near_copies(12, 3000)
    ranked, parted, cut = batch_of(texts), with_runs(texts), to_cut([*texts, b"short" * 50])

    def covered(task, batch):
        out = set()
        for b in task([batch]):
            for r in b.to_pylist():
                out |= {(r["th"], x) for x in range(r["pos"], r["pos"] + r["n"] + (0 if r["kind"] == S.GONE else 99))}
        return out

    def told_all():
        rows = [tuple(r.values()) for b in S._cutter(1, 2)([cut]) for r in b.to_pylist()]
        return covered(S._ranker(100, 32), ranked), covered(S._parter(100, 32, 24), parted), rows

    whole = told_all()
    assert whole[0] == whole[1] == {(k, x) for k in range(12) for x in range(3000)} and [r[0] for r in whole[2]] == list(range(13))
    assert [r[2:] for r in whole[2]] == [(t[:10] + t[160:], len(t), 150, 1) for t in [*texts, b"short" * 50]]
    for piece, settled, told_at in ((1000, 80, 1), (150, 8, 5000)):
        monkeypatch.setattr(S, "PIECE", piece)
        monkeypatch.setattr(S, "SETTLED", settled)
        monkeypatch.setattr(S, "TOLD", told_at)
        assert told_all() == whole
