import numpy as np
from pyspark.sql import functions as F

from stacklight.llm import span_dedup as S


def brute(rows):
    """rows: (id, text) in order; the text that stays of each."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        ends = [0, *S.sentences(data)]
        sents = [data[a:b] for a, b in zip(ends, ends[1:])]
        words = [s.lower().split() for s in sents]
        lost = set()
        for a in range(len(sents)):
            if not words[a]:
                continue
            for b in range(a + S.SENTENCES, len(sents) + 1):
                if sum(map(len, words[a:b])) >= S.WORDS:
                    key = tuple(map(tuple, words[a:b]))
                    if key in seen:
                        lost |= set(range(a, b))
                    seen.add(key)
                    break
        out.append((i, b"".join(s for k, s in enumerate(sents) if k not in lost).decode(), len(sents), len(lost)))
    return out


def sentence(rng, n):
    return " ".join(f"{rng.choice(['ka', 'lo', 'mi', 'ru'])}{x}" for x in rng.integers(0, 3000, n)).capitalize() + str(rng.choice([".", "!", "?"])) + str(rng.choice([" ", "\n", "  "]))


def told(df):
    return sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in df.collect()), key=repr)


def test_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    passages = ["".join(sentence(rng, int(n)) for n in rng.integers(3, 14, 7)) for _ in range(5)]
    texts = [None, "", " \n ", "One.", "word " * 4000, "The same. " * 60, passages[0], passages[0] * 2, passages[0].upper()]
    for _ in range(60):
        parts = [sentence(rng, int(n)) for n in rng.integers(1, 15, 12)]
        parts.insert(int(rng.integers(0, 12)), passages[int(rng.integers(0, 5))])
        texts.append("".join(parts))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("pos", "gone", "__id", "__gone", "gone_id", "n_removed")}).repartition(4)
    got = S.drop_repeated_spans(docs)
    assert {"pos", "gone"} < set(got.columns)
    assert told(got) == sorted(brute(rows), key=repr)


def test_passages_go_and_clean_documents_stay(spark):
    rng = np.random.default_rng(6)
    passage = "".join(sentence(rng, 9) for _ in range(6))
    rows, clean = [], {}
    for k in range(60):
        words = "".join(sentence(rng, int(n)) for n in rng.integers(4, 20, 20)).split(" ")
        if k % 3:
            at = int(rng.integers(0, len(words)))
            rows.append((k, " ".join(words[:at]) + " " + passage + " ".join(words[at:])))
        else:
            clean[k] = " ".join(words)
            rows.append((k, clean[k]))
    got = {r.doc_id: r for r in S.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(60):
        assert (got[k].n_removed > 0) == (k % 3 > 0 and k > 1)
    assert all(got[k].text == t for k, t in clean.items())


def test_rows_that_repeat_an_id_or_have_none(spark):
    rng = np.random.default_rng(7)
    a = "".join(sentence(rng, 10) for _ in range(5))
    got = told(S.drop_repeated_spans(spark.createDataFrame([(3, a), (3, a), (None, a), (None, "Short. Text.")], "doc_id long, text string")))
    assert [(r[0], r[3]) for r in got] == [(3, 0), (3, 0), (None, 0), (None, 5)] or sorted((r[0] is None, r[3]) for r in got) == [(False, 0), (False, 0), (True, 0), (True, 5)]
    assert S.drop_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = {i: (text, n, lost) for i, text, n, lost in brute([(r.doc_id, r.text) for r in docs])}
    assert {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in S.op9_span_dedup(spark, "/root/testdata/sf0.001").collect()} == want


def long_sentence(rng, n):
    return " ".join(f"{rng.choice(['ka', 'lo', 'mi', 'ru'])}{x}" for x in rng.integers(0, 3000, n)) + "."


def test_passages_put_in_at_arbitrary_words_are_all_found(spark):
    """A passage of WORDS + 2 * WHOLE words or more loses words in each copy but the first: recall is 1, wherever it begins."""
    rng = np.random.default_rng(8)
    least = S.WORDS + 2 * S.WHOLE
    rows = []
    for k in range(150):
        n = int(rng.integers(least, 4 * least))
        passage = [long_sentence(rng, n)[:-1], long_sentence(rng, n // 2) + " " + long_sentence(rng, n - n // 2)[:-1]][k % 2]
        for copy in range(2):
            host = " ".join(long_sentence(rng, int(m)) for m in rng.integers(2, 60, 8)).split()
            at = int(rng.integers(0, len(host)))
            rows.append((2 * k + copy, " ".join([*host[:at], passage, *host[at:]])))
    got = {r.doc_id: r for r in S.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * k + 1].n_removed > 0 for k in range(150))
    assert found == 150
    assert all(got[2 * k].n_removed == 0 for k in range(150))
    lost = [len(t.split()) - len(got[i].text.split()) for i, t in rows if i % 2]
    assert min(lost) >= S.WORDS


def test_text_without_blanks(spark):
    rng = np.random.default_rng(9)
    han = lambda n: "".join(chr(x) for x in rng.integers(0x4E00, 0x9FA5, n))
    thai = lambda n: "".join(chr(x) for x in rng.integers(0x0E01, 0x0E2E, n))
    rows = []
    for k, make in enumerate([han] * 20 + [thai] * 20):
        passage = make(60 if make is han else 240)
        for copy in range(2):
            rows.append((2 * k + copy, make(int(rng.integers(0, 99))) + passage + make(int(rng.integers(1, 99))) + ("\u3002" if make is han else "")))
    got = {r.doc_id: r for r in S.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((got[i].n_removed > 0) == (i % 2 == 1) for i, _ in rows)
    assert all(len(got[i].text) <= len(t) - 25 for i, t in rows if i % 2)
    assert S.sentences("\u4e00\u3002\u4e8c\uff01".encode()) == [6, 12]
