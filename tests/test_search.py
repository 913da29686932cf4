import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stacklight.functions import detect as D
from stacklight.functions import text as T
from stacklight.functions.query import normalize_term, parse_query
from stacklight.functions.snippet import make_snippet
from stacklight.operators import clusters as C
from stacklight.operators import entries as E
from stacklight.operators import search as S

STEMS = {
    "agreed": "agree ", "feed": "feed", "running": "runn", "runs": "run", "classes": "class", "ponies": "poni", "uses": "uses", "happiness": "happiness", "nations": "nation", "action": "action",
    "replacement": "replac", "movement": "movem", "hopped": "hopp", "sings": "sing", "owing": "ow", "able": "abl", "ous": "ou", "hope": "hope", "file": "file", "rate": "rate", "cease": "ceas",
    "controlled": "controll", "wonderful": "wonder", "creative": "creativ", "generalize": "general", "physics": "physic", "testing": "test", "types": "type", "caresses": "caress", "dies": "di",
}


def test_stems(spark):
    rows = spark.createDataFrame([(w,) for w in STEMS], "w string")
    assert {r.w: r.s for r in rows.select("w", T.stem(F.col("w")).alias("s")).collect()} == STEMS


def test_tokens(spark):
    rows = spark.createDataFrame([("Hello wörld_1 日本語x foo-bar",), ("ÉCOLE ١٢٣ a.b",), ("",), (None,), ("カタカナ",)], "t string")
    got = [r.x for r in rows.select(T.tokens(F.col("t")).alias("x")).collect()]
    assert got == [["hello", "wörld_1", "日", "日本", "本", "本語", "語", "x", "foo", "bar"], ["école", "١٢٣", "a", "b"], [], [], ["カ", "カタ", "タ", "タカ", "カ", "カナ", "ナ"]]


DOCS = [(0, "the cat sat"), (1, "the dog"), (2, "cat cat fish"), (3, "")]


@pytest.mark.parametrize("terms, want", [(["cat"], {0: 0.575443, 2: 0.835575}), (["cat", "dog"], {0: 0.575443, 1: 1.203973, 2: 0.835575}), (["cat", "cat"], {0: 1.150886, 2: 1.671149}), ([], {}), (["bird"], {})])
def test_scores(spark, terms, want):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    for got in (S.scores(docs, terms, T.no_stem), S.index_scores(S.postings(docs, T.no_stem), S.doc_lengths(docs), terms)):
        assert {r.doc_id: round(r.score, 6) for r in got.collect()} == want


def test_stemmed_scores_equal_the_index(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["agreed on running classes", "agree to run", "physics physic", "hope hoped hoping", "ponies"])], "doc_id long, text string")
    posts, lengths = S.postings(docs), S.doc_lengths(docs)
    for terms in (["agree "], ["agre"], ["physic"], ["hop", "hope"], ["poni", "runn", "class"]):
        a, b = ({r.doc_id: round(r.score, 9) for r in x.collect()} for x in (S.scores(docs, terms), S.index_scores(posts, lengths, terms)))
        assert a == b and a


def test_pages(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    both = S.scores(docs, ["cat", "dog"], T.no_stem)
    assert [r.doc_id for r in S.top(both, 2).orderBy("rank").collect()] == [1, 2]
    assert [(r.rank, r.doc_id) for r in S.top(both, 2, 2).collect()] == [(3, 0)]
    assert S.top(both, 2, 9).count() == 0 and S.top(both, 0).count() == 3
    with pytest.raises(ValueError):
        S.top(both, 2, -1)
    tied = spark.createDataFrame([(k, 1.0) for k in (5, 3, 9)], "doc_id long, score double")
    assert [r.doc_id for r in S.top(tied, 2).orderBy("rank").collect()] == [3, 5]
    found = S.search(docs, "CAT -fish !", stemmer=T.no_stem, apply_not=True).collect()
    assert [(r.rank, r.doc_id, r.snippet, r.estimated) for r in found] == [(1, 0, "the **cat** sat", 1)]


def test_ranking_keeps_no_full_sort(spark):
    plan = S.top(S.scores(spark.createDataFrame(DOCS, "doc_id long, text string"), ["cat"]), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_queries():
    for typed, terms, not_terms in [("golang -python -ruby", ["golang"], ["python", "ruby"]), ("  hello   world  ", ["hello", "world"], []), ("hello. world! test?", ["hello", "world", "test"], []), ("--flag", ["flag"], []), ("", [], []), ('"New York" x', ["new", "york", "x"], []), ("foo*", ["foo"], []), ("foo !", ["foo"], []), ("-", [], [])]:
        q = parse_query(typed)
        assert (q.terms, q.phrases, q.not_terms) == (terms, [], not_terms)
    assert [normalize_term(t) for t in ("HELLO", "hello!", "", "!", "schön", "¿qué?")] == ["hello", "hello", "", "", "schön", "qué"]


def test_snippets():
    fox = "The quick brown fox jumps over the lazy dog."
    assert make_snippet(fox, ["fox", "dog"]) == "The quick brown **fox** jumps over the lazy **dog**."
    assert make_snippet("The Quick Brown Fox", ["fox"]) == "The Quick Brown **Fox**"
    assert make_snippet(fox, ["fox"], 0) == make_snippet(fox, ["fox"], 200) == make_snippet(fox, ["fox"], -1)
    assert make_snippet("a" * 300, ["zz"]) == "a" * 200 + "..." and make_snippet("short", []) == "short" and make_snippet(None, ["x"]) == ""
    end = make_snippet("x" * 50 + " fox", ["fox"], 10)
    assert end.startswith("...")  # the leftmost window in which the match begins
    start = make_snippet("fox " + "x" * 50, ["fox"], 10)
    assert start.endswith("...") and not start.startswith("...")
    assert make_snippet(fox, ["", "fox"]) == make_snippet(fox, ["fox"])


@given(st.text("ab ", max_size=60), st.lists(st.text("ab", min_size=1, max_size=3), min_size=1, max_size=3), st.integers(1, 30))
def test_snippet_windows_are_the_first_best(content, terms, width):
    starts = [k for t in terms for k in range(len(content)) if content.startswith(t, k)]
    disjoint = []
    for t in terms:
        at = content.find(t)
        while at >= 0:
            disjoint.append(at)
            at = content.find(t, at + len(t))
    if not starts:
        return
    counts = [sum(b <= p < b + width for p in disjoint) for b in range(len(content))]
    best = counts.index(max(counts))
    out = make_snippet(content, terms, width)
    assert out.removeprefix("...").removesuffix("...").replace("*", "") == content[best : best + width]


def test_scalar_accessors(spark):
    rows = spark.createDataFrame([("a.HTML", bytearray(b"\x89PNG\r\n")), ("js", bytearray(b"\xff\xd8\xff\xe0")), ("x.tar.gz", bytearray(b"\x1f\x8b\x08\x00")), ("", bytearray(b"<Html>")), ("y.svg", bytearray(b"GIF8")), ("z.", bytearray(b"abc")), ("p.jpeg", bytearray(b"\x28\xb5\x2f\xfd")), ("q.xml", bytearray(b"<!DOCTYPE html>")), ("r.txt", bytearray(b"\x01\x02\x03\x04\x05"))], "n string, b binary")
    got = rows.select(D.mime_by_name(F.col("n")).alias("m"), D.content_type(F.col("b")).alias("t"), D.is_compressible(D.mime_by_name(F.col("n"))).alias("c"), D.little_endian(F.substring("b", 1, 2)).alias("le")).collect()
    assert [r.m for r in got] == ["text/html", "application/javascript", "application/octet-stream", "application/octet-stream", "image/svg+xml", "application/octet-stream", "image/jpeg", "application/xml", "text/plain"]
    assert [r.t for r in got] == ["[PNG]", "[JPEG]", "[gzip]", "[HTML]", "[GIF]", "", "[zstd]", "[HTML]", "[01 02 03 04]"]
    assert [r.c for r in got] == [True, True, False, False, True, False, False, True, True]
    assert got[0].le == 0x5089
    urls = spark.createDataFrame([(u,) for u in ("http://x", "https://x", "mailto:a", "tel:1", "javascript:x", "data:x", "//x", "#x", "HTTP://x", "a/b", "../c")], "u string")
    assert [r[0] for r in urls.select(D.is_external_url(F.col("u"))).collect()] == [True] * 8 + [False] * 3
    info = spark.createDataFrame([(0x01,), (0x05,), (0x04,), (0x11,), (0x15,)], "i int")
    assert [tuple(r) for r in info.select(D.compression_of(F.col("i")), D.is_extended(F.col("i"))).collect()] == [(1, False), (5, False), (4, False), (1, True), (5, True)]


def test_numbering_and_chains(spark):
    rows = spark.createDataFrame([(f"k{k * 7919 % 5000:05d}", k) for k in range(3000)] + [(None, -1)], "key string, v long").repartition(7)
    got = [r.key for r in E.numbered(rows, ["key", "v"], "n").orderBy("n").collect()]
    assert got == [None] + sorted(k for k in got if k)
    assert [r.n for r in E.numbered(rows, ["key", "v"], "n").select("n").orderBy("n").collect()] == list(range(3001))
    chain = spark.createDataFrame([(k, k + 1) for k in range(100)], "src long, dst long")
    assert {(r.dst, r.looping) for r in E.final_targets(chain).collect()} == {(100, False)}
    assert E.loop_reports(chain).count() == 0


def test_greedy_clusters():
    import numpy as np

    cluster, blob = C.greedy(np.array([3, 3, 5, 20, 1, 1]), 8)
    assert cluster.tolist() == [0, 0, 1, 2, 3, 3] and blob.tolist() == [0, 1, 0, 0, 0, 1]
    assert math.isclose(C.greedy(np.array([]), 8)[0].sum(), 0)


def test_words_are_gathered_within_their_rows(spark):
    """Neither a word nor a text is shuffled, and stems of several words are one posting."""
    docs = spark.createDataFrame([(1, "Runs run ran RUN"), (2, ""), (3, None), (4, "ran")], "doc_id long, text string")
    assert sorted(tuple(r) for r in S.postings(docs).collect()) == [("ran", 1, 1, [2]), ("ran", 4, 1, [0]), ("run", 1, 3, [0, 1, 3])]
    assert sorted(tuple(r) for r in S.term_counts(docs).collect()) == [("ran", 1, 1), ("ran", 4, 1), ("run", 1, 3)]
    for df in (S.postings(docs), S.term_counts(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in S.postings(docs, terms=["run", "none"]).collect()) == [("run", 1, 3, [0, 1, 3])] and S.postings(docs, terms=[]).count() == 0
    again = docs.unionByName(spark.createDataFrame([(1, "run x"), (None, "x"), (None, "x x")], "doc_id long, text string"))
    assert sorted(map(repr, map(tuple, S.postings(again).collect()))) == sorted(map(repr, [("ran", 1, 1, [2]), ("ran", 4, 1, [0]), ("run", 1, 4, [0, 0, 1, 3]), ("x", 1, 1, [1]), ("x", None, 3, [0, 0, 1])]))


def test_texts_are_cut_alike_as_a_whole_and_word_by_word(spark):
    odd = ["ΑΣ ΣΑ aΣ", "İSTANBUL I", "ÀÉ \u2160\u24b6x Ǆ", "a\ua7cbB\ua7dcc", "\U00010400x K ſ", "Ünï_1 日本 AB"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    by_word = F.transform(F.regexp_extract_all("t", F.lit(f"({T.TOKEN_PATTERN})"), F.lit(1)), lambda w: F.lower(w))
    for r in rows.select("t", T.tokens(F.col("t")).alias("got"), by_word.alias("want")).collect():
        assert r.got == r.want or "日" in r.t, r.t
    assert T.SINGLE and rows.select(F.count_if(F.col("t").rlike(T.SINGLE)).alias("n")).first().n == 4


def test_scores_read_the_texts_once(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    ends = []
    plain = T.stem
    got = S.scores(docs, ["cat", "the", "cats"], lambda w: ends.append(1) or plain(w))
    assert len(ends) == 1 and {r.doc_id for r in got.collect()} == {0, 1, 2}
    left = S.without(S.scores(docs, ["the"]), docs, ["cats", "cat"])
    assert [r.doc_id for r in left.collect()] == [1]


def test_chains_and_loops_are_followed_no_further_than_they_differ(spark, monkeypatch):
    """Many small loops with long and short tails, long chains and a long loop, against a plain walk."""
    rng, edges = random.Random(4), {}
    for k in range(0, 900, 3):
        edges |= {k: k + 1, k + 1: k + 2, k + 2: k}
    edges |= {1000 + k: 1001 + k for k in range(70)} | {1070: 5} | {2000 + k: 2001 + k for k in range(45)} | {3000 + k: 3000 + (k * 7 + 1) % 50 for k in range(50)}
    edges |= {4000 + k: rng.choice([*range(4000, 4200), 9, 2010, 8888]) for k in range(150)}
    want, ends = {}, {}
    for a in edges:
        seen, at = [], a
        while at in edges and at not in seen:
            seen.append(at)
            at = edges[at]
        if at in edges:
            want[a] = sorted(seen[seen.index(at) :])
        else:
            ends[a] = at
    rows = spark.createDataFrame(list(edges.items()), "src long, dst long")
    writes, real = [], E.written
    monkeypatch.setattr(E, "written", lambda df, name: writes.append(name) or real(df, name))
    assert {r.entry_idx: r.loop for r in E.loop_reports(rows).collect()} == want
    assert {r.src: r.dst for r in E.final_targets(rows).where("not looping").collect()} == ends and {r.src for r in E.final_targets(rows).where("looping").collect()} == set(want)
    writes.clear()
    small = rows.where("src < 900")
    assert E.loop_reports(small).count() == 900 and len(writes) < 9
    writes.clear()
    assert E.final_targets(small).where("looping").count() == 900 and len(writes) < 4
