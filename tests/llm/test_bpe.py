import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from stacklight.llm import bpe, vocab

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n", "Hello  world's 123\n\n  x", "  lead", "trail  ", "日本語 テキスト", "naïve café élan", "áb", "\x1c\x1d\x1e\x1f a\x85b\xa0c d​e᠎f", "<|endoftext|> x",
    "😀😃 'LL 'll 're!!", "x" * 5000, "ab " * 20000, "\t\r\n \x0b\x0c", "\u0000 nul", "１２３ Ⅳ ½",
]


def encoder(path):
    with open(path, "rb") as f:
        return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks(f.read()), special_tokens={})


def check(spark, rows, path=MULTI):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = bpe.decode(bpe.encode(df, path), path).collect()
    enc = encoder(path)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=key)
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=key) == want


def test_matches_the_library(spark):
    check(spark, list(enumerate(TEXTS)) + [(None, "no id here"), (3, "same id"), (3, "same id")])


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), MULTI).count() == 0


def test_many_chunks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text) for r in docs])
    rng = np.random.default_rng(3)
    check(spark, [(k, " ".join(f"w{x}" for x in rng.integers(0, 40000, 60000))) for k in range(2)])


def test_query(spark):
    enc = encoder(MULTI)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in bpe.op7_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("top", [100, 200, 20000, 40_000_000])
def test_codes(top):
    codes = np.random.default_rng(0).integers(0, top, 5000)
    assert (bpe.unpack_codes(bpe.pack_codes(codes), 5000) == codes).all()


def test_the_two_vocabulary_formats_agree():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as a, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as b:
        assert vocab.ranks(a.read()) == vocab.ranks(b.read())


def test_ids_are_those_of_the_tokenizers_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    enc = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x for x in TEXTS if x is not None]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [enc.encode_ordinary(x) for x in texts]
