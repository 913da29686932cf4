import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight.llm import ann


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        out[q] = [int(i) for i in ids[np.lexsort((ids, -s))[:k]]]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
    want = brute(ids, x, ids[ids % 20 == 0])
    got = ann.op2_ann(spark, f"/root/testdata/{sf}").toPandas()
    at = dict(zip(ids.tolist(), x))
    found = []
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, len(part) + 1)) and q not in set(part.vec_id) and len(part) == 20
        assert np.allclose(part.score, [at[q] @ at[v] for v in part.vec_id], rtol=0, atol=1e-12)
        assert [tuple(r) for r in part[["score", "vec_id"]].assign(score=-part.score).to_numpy()] == sorted(tuple(r) for r in part[["score", "vec_id"]].assign(score=-part.score).to_numpy())
        found.append(len(set(part.vec_id) & set(want[q])) / 20)
    assert len(found) == len(want) and np.mean(found) >= 0.9


def test_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(1)
    v = [float(t) for t in rng.normal(size=8)]
    rows = [(k, v) for k in range(50)] + [(100, [-t for t in v]), (101, None), (102, [0.0] * 8), (103, [float("nan")] * 8), (104, [float("inf")] * 8), (105, [None] + v[1:]), (106, v[:4]), (None, v), (7, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("id", F.lit("x"))
    for group in (8192, 7):
        got = ann.nearest(df, df.where("vec_id in (0, 20, 101)"), k=5, group=group).collect()
        assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, k, k) for k in range(1, 6)] + [(20, k + 1, k) for k in range(5)]
        assert len({r.score for r in got}) == 1
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    c = ann.cells(x, 2, 3, 1)
    assert (ann.cells(2 * x, 2, 3, 1) == c).all() and (c < 32**2).all() and (ann.probed(x, 2, 3, 1, 7)[:, 0] == c).all()
    assert [sorted(r) for r in ann.probed(x, 1, 0, 1, 1 << 30).tolist()] == [list(range(32))] * 5


@pytest.mark.parametrize("n", [1, 5, 10, 21, 40])
def test_small_tables_give_all_candidates(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 6))
    df = spark.createDataFrame([(k, [float(t) for t in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df, tables=1, probes=1).toPandas()
    want = brute(np.arange(n), x, range(n))
    exact = n <= 21
    for q in range(n):
        found = got[got.query_id == q].sort_values("rank").vec_id.tolist()
        assert len(found) == min(20, n - 1) and (not exact or found == [i for i in want[q] if i != q])


@pytest.mark.parametrize("rotations", [1, 2, 3])
def test_recall_of_norms_that_differ(spark, rotations):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    df = spark.createDataFrame([(k, [float(t) for t in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), rotations=rotations, probes={1: 16, 2: 600, 3: 8000}[rotations]).toPandas()
    want = brute(np.arange(1500), x, range(0, 1500, 20))
    assert np.mean([len(set(p.vec_id) & set(want[q])) / 20 for q, p in got.groupby("query_id")]) >= 0.9
