import numpy as np
import pandas as pd
import pytest

from stacklight.operators import clusters as C


def plain(sizes, limit):
    """(cluster, blob) one after another."""
    out, k, n, fill = [], 0, 0, 0
    for s in sizes:
        if n and fill + s > limit:
            k, n, fill = k + 1, 0, 0
        out.append((k, n))
        n, fill = n + 1, fill + s
    return out


@pytest.mark.parametrize("sizes", [[7] * 200, [0] * 50, [0, 150, 0, 0, 90, 20, 0, 101] * 9, [1] * 300, [100] * 40], ids=["equal", "empty", "odd", "small", "full"])
def test_stretches_do_not_change_the_packing(spark, sizes):
    want = plain(sizes, 100)
    assert list(zip(*map(np.ndarray.tolist, C.greedy(np.array(sizes), 100)))) == want
    items = spark.createDataFrame(list(enumerate(sizes)), "nr long, size long")
    got = C.packed(items, "nr", "size", 100, 16).orderBy("nr").collect()
    assert [(r.cluster, r.blob) for r in got] == want


def test_chain_of_stretches_on_random_sizes():
    rng = np.random.default_rng(3)
    for case in range(300):
        sizes = rng.integers(0, int(rng.choice([3, 40, 130])), int(rng.integers(1, 300)))
        stretch = int(rng.integers(1, 40))
        rows = pd.concat([C._effects(sizes[i : i + stretch], 100).assign(stretch=i // stretch).sort_values("low", kind="stable") for i in range(0, len(sizes), stretch)])
        batch = int(rng.integers(1, 9))
        got = pd.concat(C._chained(rows.iloc[i : i + batch] for i in range(0, len(rows), batch)))
        want, fills = plain(sizes.tolist(), 100), []
        for i in range(0, len(sizes), stretch):
            k, n = (want[i - 1][0], want[i - 1][1] + 1) if i else (0, 0)
            fills.append((i // stretch, int(sizes[i - n : i].sum()), n, k))
        assert list(got.itertuples(index=False, name=None)) == fills


def test_no_rows(spark):
    assert C.packed(spark.createDataFrame([], "nr long, size long"), "nr", "size").count() == 0
