"""Queries that write archives, databases and codec frames from the tables and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.functions import codecs as K
from stacklight.functions import text as T
from stacklight.operators import clusters as C
from stacklight.operators import entries as E
from stacklight.operators import files
from stacklight.operators import integrity as I
from stacklight.operators import search as S
from stacklight.plans.catalogue import query, table
from stacklight.session import shared_dir
from stacklight.sources import glass, zim


def archive(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return zim.tables(spark, archive_file(spark, d))


def archive_file(spark: SparkSession, d: str) -> str:
    """`documents` as an archive: each a text entry with its first 20 characters as title, every tenth also behind a redirect."""
    docs = table(spark, d, "documents")
    items = docs.select(
        F.lit("C").alias("namespace"), F.concat(F.lit("doc/"), "doc_id").alias("path"), F.substring("text", 1, 20).alias("title"), F.lit("text/html").alias("mime"),
        F.col("text").cast("binary").alias("data"), F.lit(None).cast("string").alias("redirect_path"),
    )
    moved = docs.where("doc_id % 10 = 0").select(
        F.lit("C").alias("namespace"), F.concat(F.lit("old/"), "doc_id").alias("path"), F.lit("").alias("title"), F.lit(None).cast("string").alias("mime"),
        F.lit(None).cast("binary").alias("data"), F.concat(F.lit("doc/"), "doc_id").alias("redirect_path"),
    )
    meta = spark.createDataFrame([("M", "Language", "", "text/plain", bytearray(b"eng"), None), ("M", "Title", "", "text/plain", bytearray(b"Documents"), None)], items.schema)
    zim.register(spark)
    path = f"{shared_dir(spark).removeprefix('file://')}/documents-{uuid.uuid4().hex}.zim"
    items.unionByName(moved).unionByName(meta).write.format("zim").option("main_path", "doc/0").mode("append").save(path)
    return path


_ALL = """a AS (SELECT 'C' AS namespace, 'doc/' || doc_id AS path, left(text, 20) AS title, 'content' AS entry_type, 'text/html' AS mime, text FROM documents
UNION ALL SELECT 'C', 'old/' || doc_id, '', 'redirect', 'redirect', NULL FROM documents WHERE doc_id % 10 = 0
UNION ALL SELECT * FROM (VALUES ('M', 'Language', '', 'content', 'text/plain', 'eng'), ('M', 'Title', '', 'content', 'text/plain', 'Documents'))
UNION ALL SELECT 'X', 'listing/titleOrdered/v1', '', 'content', 'application/octet-stream+zimlisting', NULL),
e AS (SELECT *, row_number() OVER (ORDER BY namespace, path) - 1 AS entry_idx FROM a)"""


@query("zim_round_trip_entries", f"WITH {_ALL} SELECT entry_idx, namespace, path, title, entry_type, mime FROM e")
def zim_round_trip_entries(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d)["entries"].select("entry_idx", "namespace", "path", "title", "entry_type", "mime")


@query("zim_round_trip_blobs", f"WITH {_ALL} SELECT path, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5 FROM e WHERE text IS NOT NULL")
def zim_round_trip_blobs(spark: SparkSession, d: str) -> DataFrame:
    t = archive(spark, d)
    return E.items(t["entries"].where("namespace <> 'X'"), t["blobs"]).select("path", "size", F.md5("data").alias("md5"))


@query("zim_title_index", f"WITH {_ALL} SELECT row_number() OVER (ORDER BY title, path) - 1 AS pos, entry_idx, path FROM e WHERE namespace = 'C'")
def zim_title_index(spark: SparkSession, d: str) -> DataFrame:
    t = archive(spark, d)
    return t["title_index"].join(t["entries"], ["archive_id", "entry_idx"]).select("pos", "entry_idx", "path")


@query("article_media_counts", f"WITH {_ALL} SELECT count(*) FILTER (WHERE namespace = 'C') AS articles, count(*) FILTER (WHERE namespace <> 'C') AS media, count(*) AS entries FROM e")
def article_media_counts(spark: SparkSession, d: str) -> DataFrame:
    """Front articles, which the title index lists, against the rest."""
    return files.info(spark, archive_file(spark, d)).select("articles", "media", F.col("entry_count").alias("entries"))


@query("zim_redirects", "SELECT 'old/' || doc_id AS path, 'doc/' || doc_id AS target_path, 'ok' AS status FROM documents WHERE doc_id % 10 = 0")
def zim_redirects(spark: SparkSession, d: str) -> DataFrame:
    return E.resolved(archive(spark, d)["entries"]).select("path", "target_path", "status")


@query("metadata_map", "SELECT 'eng' AS language, 'Documents' AS title, 2 AS keys")
def metadata_map(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    return zim.metadata(spark, archive_file(spark, d)).select(m["Language"].alias("language"), m["Title"].alias("title"), F.size(m).alias("keys"))


@query("zim_archive_row", f"WITH {_ALL} SELECT 6 AS major, 1 AS minor, count(*) AS entry_count, min(CASE WHEN path = 'doc/0' THEN entry_idx END) AS main_page, true AS has_checksum, true AS new_namespace, true AS has_title_index, false AS multipart FROM e")
def zim_archive_row(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d)["archives"].select("major", "minor", "entry_count", "main_page", "has_checksum", "new_namespace", "has_title_index", "multipart")


@query("zim_clusters_cover_blobs", "SELECT count(*) + 3 AS blobs, true AS contiguous FROM documents")
def zim_clusters_cover_blobs(spark: SparkSession, d: str) -> DataFrame:
    t = archive(spark, d)
    again = C.with_sizes(t["clusters"].select("archive_id", "cluster", "offset", F.col("size").alias("read_size"), "blob_count"), t["archives"])
    return again.agg(F.sum("blob_count").alias("blobs"), F.bool_and(F.col("size") == F.col("read_size")).alias("contiguous"))


@query("zim_check_report", "SELECT CAST(0 AS BIGINT) AS redirect_loops, count(*) - count(DISTINCT md5(text)) AS redundant, true AS checksum_ok FROM documents")
def zim_check_report(spark: SparkSession, d: str) -> DataFrame:
    return I.report(archive(spark, d))["summary"].select("redirect_loops", "redundant", "checksum_ok")


def _round_trip(spark: SparkSession, d: str, there, back) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return docs.withColumn("data", back(there(F.col("data")))).select("doc_id", F.md5("data").alias("md5"))


_MD5 = "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents"


@query("zstd_round_trip", _MD5)
def zstd_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, K.zstd_compress, K.zstd_decompress)


@query("zstd_frames", "SELECT doc_id, md5(coalesce(text, '') || coalesce(text, '')) AS md5 FROM documents")
def zstd_frames(spark: SparkSession, d: str) -> DataFrame:
    """Two frames in each value."""
    return _round_trip(spark, d, lambda c: F.concat(K.zstd_compress(c), K.zstd_compress(c, "fastest", True)), K.zstd_decompress)


@query("xz_round_trip", _MD5)
def xz_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, lambda c: K.xz_compress(c, 1), K.xz_decompress)


@query("lzma_round_trip", _MD5)
def lzma_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, lambda c: K.lzma_compress(c, 1), K.lzma_decompress)


@query("lzma2_round_trip", _MD5)
def lzma2_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, K.lzma2_compress, K.lzma2_decompress)


@query("zstd_frame_sizes", "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents")
def zstd_frame_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return docs.select("doc_id", K.zstd_content_size(K.zstd_compress(F.col("data"), "fastest", True)).alias("size"))


@query("xxh64_hash")
def xxh64_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", K.xxh64(F.col("text").cast("binary")).alias("hash"))


@query("glass_varint", "SELECT o_orderkey AS n, o_orderkey AS back, CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 16384 THEN 2 WHEN o_orderkey < 2097152 THEN 3 ELSE 4 END AS size FROM orders")
def glass_varint(spark: SparkSession, d: str) -> DataFrame:
    def run(batches):
        for b in batches:
            packed = [glass.pack_uint(n) for n in b["n"].tolist()]
            yield b.assign(back=[glass.unpack_uint(p)[0] for p in packed], size=[len(p) for p in packed])

    return table(spark, d, "orders").select(F.col("o_orderkey").alias("n")).mapInPandas(run, "n long, back long, size int")


@query("glass_sort_key_order", "SELECT k, row_number() OVER (ORDER BY k) - 1 AS rank FROM (SELECT DISTINCT o_orderkey * o_custkey * 7919 AS k FROM orders)")
def glass_sort_key_order(spark: SparkSession, d: str) -> DataFrame:
    """Numbers ranked by the order of their packed bytes."""

    def run(batches):
        for b in batches:
            yield b.assign(packed=[glass.pack_uint_sorted(n).hex() for n in b["k"].tolist()])

    keys = table(spark, d, "orders").select((F.col("o_orderkey") * F.col("o_custkey") * 7919).alias("k")).distinct().mapInPandas(run, "k long, packed string")
    return E.numbered(keys, ["packed"], "rank").select("k", "rank")


_COUNTS = """SELECT lower(t) AS term, doc_id, count(*) AS wdf FROM (SELECT doc_id + 1 AS doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{Nd}_]+')) AS t FROM documents) GROUP BY ALL"""


def counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select((F.col("doc_id") + 1).alias("doc_id"), "text")
    return S.term_counts(docs, T.no_stem).withColumnRenamed("tf", "wdf")


@query("glass_postings", _COUNTS)
def glass_postings(spark: SparkSession, d: str) -> DataFrame:
    """Posting lists encoded into chunks, and decoded again."""
    return glass.decoded_postings(glass.encoded_postings(counts(spark, d)))


@query("glass_term_stats", f"WITH c AS ({_COUNTS}) SELECT term, count(*) AS term_freq, CAST(sum(wdf) AS BIGINT) AS coll_freq FROM c GROUP BY term")
def glass_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return glass.term_stats(counts(spark, d))


@query("glass_valuesmap", "SELECT * FROM (VALUES ('title:0;wordcount:1;geo.position:2', 'geo.position', 2), ('title:0;wordcount:1;geo.position:2', 'title', 0), ('title:0;wordcount:1;geo.position:2', 'wordcount', 1)) t(text, name, slot)")
def glass_valuesmap(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t, k, v) for t in ("title:0;wordcount:1;geo.position:2", "title;wordcount:notanum", "") for k, v in glass.parse_values_map(t).items()]
    return spark.createDataFrame(rows, "text string, name string, slot int")
