"""Ranked full-text search: postings, BM25, pages of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.session import written

K1, B = 1.2, 0.75


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, token) before stemming."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.tokens(F.col(text_col))).alias("pos", "token"))


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dl); documents without tokens stay with 0: they count in the averages."""
    return docs.select(F.col(id_col).alias("doc_id"), F.size(T.tokens(F.col(text_col))).cast("long").alias("dl"))


def stemmed(rows: DataFrame, stemmer: T.Stemmer = T.stem) -> DataFrame:
    """Adds `term`. Stems are computed once for each distinct token, not for each occurrence."""
    if stemmer is T.no_stem:
        return rows.withColumn("term", F.col("token"))
    vocab = rows.select("token").distinct().withColumn("term", stemmer(F.col("token")))
    return rows.join(vocab, "token")


def _runs(words: Column, word: Callable[[Column], Column], run: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """array<run> of the distinct words of a row: `words` are sorted, and equal neighbours are one run. word: of an element;
    run: what a run has, from the sorted elements, its word, where it begins and its length."""

    def of(s: Column) -> Column:
        n = F.size(s)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (word(F.get(s, i)) != word(F.get(s, i - 1))))
        each = lambda starts: F.transform(starts, lambda i, k: run(s, word(F.get(s, i)), i, F.coalesce(F.get(starts, k + 1), n) - i))
        return F.when(n > 0, F.flatten(F.transform(F.array(first), each)))

    return F.flatten(F.transform(F.array(F.sort_array(words)), of))  # lambdas over one element: each step is evaluated once


def _words(text_col: str, stemmer: T.Stemmer) -> Column:
    words = T.tokens(F.col(text_col))
    return words if stemmer is T.no_stem else F.transform(words, stemmer)


def _near(terms: list[str], stemmer: T.Stemmer) -> Callable[[Column], Column]:
    """Whether a word can be of one of the terms: stems begin like their words, but for the last letter, so only such words are stemmed."""
    if stemmer is T.no_stem:
        return lambda w: w.isin(*terms)
    heads = sorted({t[: max(1, len(t.rstrip()) - 1)] for t in terms})

    def near(word: Column) -> Column:
        out = F.lit(False)
        for h in heads:
            out = out | word.startswith(h)
        return out

    return near


def _asked(words: Column, terms: list[str], stemmer: T.Stemmer) -> Column:
    """The row's words that can be of one of the terms, as terms."""
    few = F.filter(words, _near(terms, stemmer))
    return few if stemmer is T.no_stem else F.transform(few, stemmer)


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether rows share an id; only ids are read and shuffled."""
    return not docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def postings(docs: DataFrame, stemmer: T.Stemmer = T.stem, id_col: str = "doc_id", text_col: str = "text", terms: list[str] | None = None) -> DataFrame:
    """(term, doc_id, tf, positions), positions in ascending order. Words are stemmed and gathered within their row, and not shuffled
    but where rows share an id. terms: the part of the index that these need; other words are left before they are stemmed or sorted."""
    placed = F.transform(T.tokens(F.col(text_col)), lambda w, i: F.struct(w.alias("w"), i.alias("pos")))
    if terms is not None:
        near = _near(terms, stemmer)
        placed = F.filter(placed, lambda x: near(x["w"]))
    placed = F.transform(placed, lambda x: F.struct(stemmer(x["w"]).alias("w"), x["pos"].alias("pos")))
    if terms is not None:
        placed = F.filter(placed, lambda x: x["w"].isin(*terms))
    run = lambda s, w, i, n: F.struct(w.alias("term"), n.cast("long").alias("tf"), F.slice(s, i + 1, n)["pos"].alias("positions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.inline(_runs(placed, lambda x: x["w"], run))).select("term", "doc_id", "tf", "positions")
    if _repeats(docs, id_col):
        rows = rows.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return rows


def term_counts(docs: DataFrame, stemmer: T.Stemmer = T.stem, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """postings() without positions."""
    run = lambda s, w, i, n: F.struct(w.alias("term"), n.cast("long").alias("tf"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.inline(_runs(_words(text_col, stemmer), lambda x: x, run))).select("term", "doc_id", "tf")
    return rows.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")) if _repeats(docs, id_col) else rows


def scores(docs: DataFrame, terms: list[str], stemmer: T.Stemmer = T.stem, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each document that holds one of the terms. A term given twice counts twice.

    One pass over the texts counts the terms within each row and writes a small table of lengths and counts, from which statistics and
    scores are taken. No text or word is shuffled.
    """
    weights: dict[str, int] = {}
    for t in terms:
        weights[t] = weights.get(t, 0) + 1
    base = docs.select(F.col(id_col).alias("doc_id"), T.tokens(F.col(text_col)).alias("t"))
    if not weights:
        return base.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    few = base.select("doc_id", F.size("t").cast("long").alias("dl"), _asked(F.col("t"), list(weights), stemmer).alias("t"))
    equals = lambda t: lambda w: w == t
    counts = [F.size(F.filter("t", equals(t))).cast("long").alias(f"tf{i}") for i, t in enumerate(weights)]
    per_doc = written(few.select("doc_id", "dl", *counts), "counts")
    stats = per_doc.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(weights))])
    joined = per_doc.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, k in enumerate(weights.values()):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        tf = F.col(f"tf{i}")
        score = score + k * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = F.lit(False)
    for i in range(len(weights)):
        hit = hit | (F.col(f"tf{i}") > 0)
    return joined.where(hit).select("doc_id", score.alias("score"))


def top(scored: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """(rank, doc_id, score): best first, equal scores by doc_id. A limit under 1 means 20; a negative offset is refused."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    limit = 20 if limit <= 0 else limit
    page = scored.orderBy(F.desc("score"), F.asc("doc_id")).offset(offset).limit(limit)
    w = Window.orderBy(F.desc("score"), F.asc("doc_id"))
    return page.select((F.row_number().over(w) + offset).cast("long").alias("rank"), "doc_id", "score")


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_count, total_len, avg_len), one row."""
    return doc_lengths(docs, id_col, text_col).agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"), F.avg("dl").alias("avg_len"))


def document_frequency(posts: DataFrame) -> DataFrame:
    """(term, df, cf) of postings."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(frequency: DataFrame, doc_count: DataFrame) -> DataFrame:
    n = F.col("doc_count")
    return frequency.crossJoin(F.broadcast(doc_count.select("doc_count"))).select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))  # one row


def index_scores(posts: DataFrame, lengths: DataFrame, terms: list[str]) -> DataFrame:
    """scores() from a stored index: only postings of the query's terms are read and joined with their documents' lengths."""
    spark = posts.sparkSession
    weights: dict[str, int] = {}
    for t in terms:
        weights[t] = weights.get(t, 0) + 1
    asked = spark.createDataFrame(list(weights.items()) or [("", 0)], "term string, k int")
    mine = written(posts.where(F.col("term").isin(*weights) if weights else F.lit(False)).select("term", "doc_id", "tf"), "hits")  # read twice
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    freq = mine.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(asked), "term")  # as many rows as terms
    rows = mine.join(F.broadcast(freq), "term").join(lengths, "doc_id").crossJoin(F.broadcast(stats))  # one row
    tf = F.col("tf")
    part = F.col("k") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("doc_id").agg(F.sum(part).alias("score"))


def without(scored: DataFrame, docs: DataFrame, not_terms: list[str], stemmer: T.Stemmer = T.stem, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`scored` less the documents that hold one of not_terms."""
    if not not_terms:
        return scored
    held = docs.select(F.col(id_col).alias("doc_id"), T.tokens(F.col(text_col)).alias("t"))
    held = held.where(F.exists(_asked(F.col("t"), not_terms, stemmer), lambda w: w.isin(*not_terms))).select("doc_id")
    return scored.join(held, "doc_id", "left_anti")


def search(docs: DataFrame, query: str, offset: int = 0, limit: int = 20, stem_query: bool = False, apply_not: bool = False, stemmer: T.Stemmer = T.stem, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rank, doc_id, score, snippet, estimated) of a page of results for a typed query.

    By default query words are not stemmed though the indexed ones are, and words to leave out are ignored. `estimated` is the
    number of hits up to the page's end. Texts join after the cut, so only a page of them is read for snippets.
    """
    from stacklight.functions.query import parse_query
    from stacklight.functions.snippet import snippet

    parsed = parse_query(query)
    terms = parsed.terms
    if stem_query and terms:
        spark = docs.sparkSession
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, t string")
        terms = [r.s for r in frame.select("i", stemmer(F.col("t")).alias("s")).orderBy("i").collect()]
    scored = scores(docs, terms, stemmer, id_col, text_col)
    if apply_not:
        scored = without(scored, docs, parsed.not_terms, stemmer, id_col, text_col)
    page = top(scored, limit, offset)
    estimated = scored.limit((20 if limit <= 0 else limit) + offset).agg(F.count("*").alias("estimated"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("content"))
    return texts.join(F.broadcast(page), "doc_id").select("rank", "doc_id", "score", snippet(F.col("content"), parsed.terms).alias("snippet")).crossJoin(F.broadcast(estimated)).orderBy("rank")  # a page; one row


def suggest(titles: DataFrame, prefix: str, limit: int = 10, title_col: str = "title", order_col: str = "pos") -> DataFrame:
    """The first titles, in index order, that begin with `prefix`, case aside."""
    return titles.where(F.lower(F.col(title_col)).startswith(prefix.lower())).orderBy(order_col).limit(10 if limit <= 0 else limit)
