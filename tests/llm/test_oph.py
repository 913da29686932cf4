import hashlib

import pytest
from pyspark.sql import functions as F

from stacklight.llm import oph


def brute_edits(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out[i] = (len(t), t[: len(t) - half] + nxt[:half], nxt)
    return out


def shingle_set(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = [None, "", "  ", "one", "One", "a b c d e", "A b c d e f", "é" * 7, "x y " * 4000, "😀😀😀", " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(40, 900))]


def test_edits_and_likeness(spark):
    rows = [(7 * i, t) for i, t in enumerate(TEXTS)] + [(10**15 + i, " ".join(f"v{i + j}" for j in range(300))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rng", F.lit(1)).withColumn("values", F.lit(2)).repartition(3)
    want = brute_edits(rows)
    got = oph.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        n, edited, nxt = want[r.doc_id]
        assert (r.n_chars, r.edited) == (n, edited)
        assert r.near_edited == pytest.approx(jaccard(texts[r.doc_id] or "", edited), abs=0.13)
        assert r.near_next == pytest.approx(jaccard(texts[r.doc_id] or "", nxt), abs=0.13)


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want, texts = brute_edits([(r.doc_id, r.text) for r in docs]), {r.doc_id: r.text for r in docs}
    got = {r.doc_id: r for r in oph.op3_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys()
    error, by_text = 0.0, {}
    for i, (n, edited, _) in want.items():
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(texts[i], got[i].fingerprint) == got[i].fingerprint
        assert len(got[i].fingerprint) == oph.BINS * oph.LOW // 4
        error += abs(got[i].near_edited - jaccard(texts[i], edited))
    assert error / len(want) < 0.03


def test_small_and_odd_tables(spark):
    assert oph.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = oph.edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert [(r.edited, r.near_next) for r in one] == [("abab", 1.0)]
    odd = oph.edited_fingerprints(spark.createDataFrame([(None, "abcd"), (3, "xy"), (3, "xy"), (3, None)], "doc_id long, text string")).collect()
    assert len(odd) == 4


def test_no_python_on_the_executors(spark):
    plan = oph.edited_fingerprints(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
