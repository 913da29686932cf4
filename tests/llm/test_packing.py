import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stacklight.llm import packing


def check(rows, texts, capacity):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        cuts = [c for c in cuts if c <= len(ids)]
        if cuts[-1] != len(ids):
            cuts.append(len(ids))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.setdefault((i, k), []).append((a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packing.op8_packing(spark, "/root/testdata/sf0.001").collect()
    n = check(rows, texts, 2048)
    counts = np.bincount([r.length for r in rows], minlength=2049)
    bound = packing.lower_bound(counts, 2048)
    assert bound <= n <= bound + 1


@pytest.mark.parametrize("capacity", [4, 16, 50])
def test_odd_texts_and_small_sequences(spark, capacity):
    texts = [(1, None), (2, ""), (3, "hello world " * 200), (3, "again"), (None, "no id"), (5, "<|endoftext|>"), (7, "hello <|endoftext|> world"), (8, "a  <|endoftext|><|endoftext|>  b\n <|endoftext"), (6, "é😀")] + [(10 + k, "w " * k) for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    check(packing.pack_documents(docs, capacity=capacity).collect(), texts, capacity)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_partitions_exchange_what_does_not_fill_up(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 900, 6000)
    items = spark.createDataFrame([(int(k), int(s)) for k, s in enumerate(sizes)], "k long, length long")
    got = packing.pack(items, 1000, per_task=300).toPandas()
    assert sorted(got.k) == list(range(6000)) and (got.groupby("sequence_id").length.sum() <= 1000).all()
    alone = sum(packing.best_fit(part, 1000).max() + 1 for part in np.array_split(sizes, 20))
    bound = packing.lower_bound(np.bincount(sizes, minlength=1001), 1000)
    assert bound <= got.sequence_id.nunique() < alone


def test_bounds_hold_and_see_large_items():
    assert packing.lower_bound(np.bincount([6] * 7, minlength=11), 10) == 7
    assert packing.lower_bound(np.bincount([4] * 10, minlength=11), 10) == 5
    assert packing.lower_bound(np.zeros(11, int), 10) == 0
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(1, 101, rng.integers(1, 200))
        bound = packing.lower_bound(np.bincount(sizes, minlength=101), 100)
        for bins in (packing.best_fit(sizes, 100), packing.filled(sizes, 100), packing.repacked(sizes, 100)):
            assert np.bincount(bins, weights=sizes).max() <= 100 and bound <= bins.max() + 1 == len(set(bins.tolist()))


def test_clashing_names_are_replaced_or_kept(spark):
    items = spark.createDataFrame([(k, 40, 1, 2, True) for k in range(20)], "part long, length long, sequence_id long, offset long, closed boolean")
    got = packing.pack(items, 100, per_task=5).toPandas()
    assert sorted(got.part) == list(range(20)) and got.closed.all() and 10 <= got.sequence_id.nunique() <= 13 and set(got.offset) == {0, 40}
