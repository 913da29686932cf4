"""Queries of tokenizing, stemming, ranking and suggesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.functions.query import normalize_term, parse_query
from stacklight.functions.snippet import snippet
from stacklight.operators import search as S
from stacklight.plans.catalogue import query, table
from stacklight.plans.stem_sql import stem_sql
from stacklight.session import written

#: The words of the sample queries.
TERMS = ["hation", "the", "pathet"]

TOKENS = """tokens AS (SELECT doc_id, lower(t) AS token, pos FROM (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM
  (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{Nd}_]+') AS ts FROM documents)))"""
LENGTHS = """lengths AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{Nd}_]+')) AS BIGINT) AS dl FROM documents)"""
VOCAB = f"{TOKENS}, words AS (SELECT DISTINCT token FROM tokens), {stem_sql('words', 'token')}"
POSTS = f"{VOCAB}, posts AS (SELECT s.term, t.doc_id, count(*) AS tf, list(t.pos ORDER BY t.pos) AS positions FROM tokens t JOIN stems s ON t.token = s.token GROUP BY ALL)"


def bm25_sql(terms: list[str], where: str = "true") -> str:
    weights = ", ".join(f"('{t}', {terms.count(t)})" for t in dict.fromkeys(terms))
    return f"""WITH {POSTS}, {LENGTHS}, q(term, k) AS (VALUES {weights}), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
hits AS (SELECT p.doc_id, round(sum(q.k * ln((n.n - df.df + 0.5) / (df.df + 0.5) + 1) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / n.avgdl))), 6) AS score
  FROM posts p JOIN q USING (term) JOIN df USING (term) JOIN lengths l USING (doc_id), n GROUP BY p.doc_id)"""


@query("tokenize", f"WITH {TOKENS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, token FROM tokens")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return S.token_rows(table(spark, d, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


@query("token_counts", f"WITH {TOKENS} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tokens GROUP BY token")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.token_rows(table(spark, d, "documents")).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("tokenize_cjk", """SELECT * FROM (VALUES (0, 0, 'hello'), (0, 1, 'wörld_1'), (0, 2, '日'), (0, 3, '日本'), (0, 4, '本'), (0, 5, '本語'), (0, 6, '語'), (0, 7, 'x'),
  (0, 8, 'foo'), (0, 9, 'bar'), (1, 0, '한'), (1, 1, '한글'), (1, 2, '글'), (1, 3, 'カ'), (1, 4, 'ab')) t(doc_id, pos, token)""")
def tokenize_cjk(spark: SparkSession, d: str) -> DataFrame:
    return S.token_rows(spark.createDataFrame([(0, "Hello wörld_1 日本語x foo-bar"), (1, "한글 カ ab"), (2, None)], "doc_id int, text string")).select("doc_id", F.col("pos").cast("int").alias("pos"), "token")


@query("doc_length", f"WITH {LENGTHS} SELECT * FROM lengths")
def doc_length(spark: SparkSession, d: str) -> DataFrame:
    return S.doc_lengths(table(spark, d, "documents"))


@query("corpus_stats", f"WITH {LENGTHS} SELECT count(*) AS doc_count, CAST(sum(dl) AS BIGINT) AS total_len, round(avg(dl), 6) AS avg_len FROM lengths")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.corpus_stats(table(spark, d, "documents")).withColumn("avg_len", F.round("avg_len", 6))


@query("stem_vocab", f"WITH {VOCAB} SELECT token, term FROM stems")
def stem_vocab(spark: SparkSession, d: str) -> DataFrame:
    words = S.token_rows(table(spark, d, "documents")).select("token").distinct()
    return words.select("token", T.stem(F.col("token")).alias("term"))


@query("postings", f"WITH {POSTS} SELECT term, doc_id, tf, CAST(positions AS INTEGER[]) AS positions FROM posts")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(table(spark, d, "documents"))


@query("doc_freq", f"WITH {POSTS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM posts GROUP BY term")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return S.document_frequency(S.term_counts(table(spark, d, "documents")))


@query("idf", f"WITH {POSTS}, n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM posts GROUP BY term) SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM f, n")
def idf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return S.idf(S.document_frequency(S.term_counts(docs)), docs.agg(F.count("*").alias("doc_count"))).withColumn("idf", F.round("idf", 6))


@query("bm25_scores", f"{bm25_sql(TERMS)} SELECT doc_id, score FROM hits")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.scores(table(spark, d, "documents"), TERMS).withColumn("score", F.round("score", 6))


def _page(spark: SparkSession, d: str, terms: list[str], limit: int, offset: int) -> DataFrame:
    # equal scores are ordered by id: scores are rounded before they are compared, as sums differ in their last bits
    scored = S.scores(table(spark, d, "documents"), terms).withColumn("score", F.round("score", 6))
    return S.top(scored, limit, offset)


def _page_sql(terms: list[str], limit: int, offset: int) -> str:
    return f"{bm25_sql(terms)}, r AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM hits) SELECT * FROM r WHERE rank > {offset} AND rank <= {offset + limit}"


@query("bm25_search", _page_sql(TERMS, 20, 0))
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, TERMS, 20, 0)


@query("bm25_page2", _page_sql(TERMS, 10, 10))
def bm25_page2(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, TERMS, 10, 10)


@query("bm25_repeated_term", _page_sql(["the", "hation", "the"], 15, 0))
def bm25_repeated_term(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, ["the", "hation", "the"], 15, 0)


@query("bm25_index", f"{bm25_sql(TERMS)} SELECT doc_id, score FROM hits")
def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return S.index_scores(S.postings(docs, terms=TERMS), written(S.doc_lengths(docs), "lengths"), TERMS).withColumn("score", F.round("score", 6))


@query("bm25_multi_archive", """WITH everything AS (SELECT 0 AS part, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
toks AS (SELECT part, id, len(ts) AS dl, len(list_filter(ts, lambda x: lower(x) = 'the')) AS tf FROM (SELECT part, id, regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{Nd}_]+') AS ts FROM everything)),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf > 0) AS df FROM toks)
SELECT part, id, round(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM toks, n WHERE tf > 0""")
def bm25_multi_archive(spark: SparkSession, d: str) -> DataFrame:
    """Two archives under common statistics, with unstemmed terms."""
    both = table(spark, d, "documents").select(F.struct(F.lit(0).alias("part"), F.col("doc_id").alias("id")).alias("doc_id"), "text")
    both = both.unionByName(table(spark, d, "benchmark").select(F.struct(F.lit(1).alias("part"), F.col("item_id").alias("id")).alias("doc_id"), "text"))
    return S.scores(both, ["the"], T.no_stem).select("doc_id.part", "doc_id.id", F.round("score", 6).alias("score"))


@query("bm25_not_terms", f"{bm25_sql(['the'])} SELECT doc_id, score FROM hits WHERE doc_id NOT IN (SELECT doc_id FROM posts WHERE term = 'hation')")
def bm25_not_terms(spark: SparkSession, d: str) -> DataFrame:
    docs, parsed = table(spark, d, "documents"), parse_query("the -hation")
    return S.without(S.scores(docs, parsed.terms), docs, parsed.not_terms).withColumn("score", F.round("score", 6))


@query("search_with_snippets")
def search_with_snippets(spark: SparkSession, d: str) -> DataFrame:
    return S.search(table(spark, d, "documents"), '"Pathetic hation" the', stem_query=True).withColumn("score", F.round("score", 6))


_TYPED = ["golang -python -ruby", "  hello   world  ", "hello. world! test?", "--flag", "", '"New York" pizza', "foo*", "-", "!"]


@query("query_parse", """SELECT * FROM (VALUES (0, 0, 'golang', 'term'), (0, 0, 'python', 'not'), (0, 1, 'ruby', 'not'), (1, 0, 'hello', 'term'), (1, 1, 'world', 'term'),
  (2, 0, 'hello', 'term'), (2, 1, 'world', 'term'), (2, 2, 'test', 'term'), (3, 0, 'flag', 'term'), (5, 0, 'new', 'term'), (5, 1, 'york', 'term'), (5, 2, 'pizza', 'term'), (6, 0, 'foo', 'term')) t(nr, pos, word, kind)""")
def query_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, k, w, kind) for i, q in enumerate(_TYPED) for kind, ws in (("term", parse_query(q).terms), ("not", parse_query(q).not_terms)) for k, w in enumerate(ws)]
    return spark.createDataFrame(rows, "nr int, pos int, word string, kind string")


@query("normalize_term", "SELECT * FROM (VALUES ('HELLO', 'hello'), ('hello!', 'hello'), ('', ''), ('!', ''), ('«schön»', 'schön'), ('$5', '$5')) t(typed, term)")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, normalize_term(t)) for t in ("HELLO", "hello!", "", "!", "«schön»", "$5")], "typed string, term string")


@query("snippet", """SELECT doc_id, left(text, 60) || CASE WHEN length(text) > 60 THEN '...' ELSE '' END AS snippet FROM documents""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """No term matches: the beginnings of all texts."""
    return table(spark, d, "documents").select("doc_id", snippet(F.col("text"), ["zzzzqqqq"], 60).alias("snippet"))
