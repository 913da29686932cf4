import zlib

import numpy as np
from pyspark.sql import functions as F

from stacklight.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.op5_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.98
    assert np.mean([p for p, y in held if y]) > 0.99  # clean documents stay


def test_odd_tables(spark):
    rows = [(k, "Some plain words here, and then some more of them. " * 5 if k % 2 else "BUY!! BUY!! NOW!! ### $$$ " * 9) for k in range(60)] + [(None, "plain words"), (100, None), (101, ""), (102, "x " * 200000), (1, rows_text := "again plain words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("taken")).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None), (5, 1), (999, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.scored(docs, model, score_col="s").collect()
    assert len(out) == len(rows) and all(0 <= r.s <= 1 for r in out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(1, 60, 2)) <= ids and not ids & set(range(0, 60, 2))
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    blank = quality.train(docs, labels.limit(0))
    assert {r.s for r in quality.scored(docs, blank, score_col="s").collect()} == {0.5}


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = ("Plain words and !! marks | with lines\n" * 3000).encode()
    whole = quality.features(text)
    monkeypatch.setattr(quality, "PIECE", 1000)
    assert np.allclose(whole, quality.features(text))


def test_pairs_decide_the_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, quality.WIDTH))
    y = (x[:, 3] + 0.1 * rng.normal(size=400) > 0.8).astype(int)
    model = quality.fit(x, y)
    s = model.score(x)
    assert np.mean((s >= 0.5) == y) > 0.95
