"""Queries of the directory, its links, redirects and checks, over `pages`, `documents` and `orders` seen as archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stacklight.functions import detect as D
from stacklight.operators import clusters as C
from stacklight.operators import entries as E
from stacklight.operators import integrity as I
from stacklight.operators import search as S
from stacklight.plans.catalogue import query, table

#: Of a page: its path (the URL without scheme, host, query and fragment), its title, and a cluster of 16 pages.
PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/?', ''), '[?#].*$', '')"
ENTRIES = f"""e AS (SELECT *, row_number() OVER (ORDER BY path, page_id) - 1 AS entry_idx FROM
  (SELECT page_id, html, 'C' AS namespace, {PATH} AS path, coalesce(regexp_extract(html, '<title>(.*?)</title>', 1), '') AS title,
   'text/html' AS mime, CAST(floor(page_id / 16) AS BIGINT) AS cluster, page_id % 16 AS blob, CAST(strlen(html) AS BIGINT) AS size FROM pages))"""
TITLES = f"{ENTRIES}, t AS (SELECT *, row_number() OVER (ORDER BY title, namespace, path, entry_idx) - 1 AS pos FROM e)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """`pages` as entries of one archive."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+/?", ""), "[?#].*$", "")
    return table(spark, d, "pages").select(
        F.lit("pages").alias("archive_id"), "page_id", "html", F.lit("C").alias("namespace"), path.alias("path"),
        F.coalesce(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit("")).alias("title"), F.lit("content").alias("entry_type"), F.lit("text/html").alias("mime"),
        F.floor(F.col("page_id") / 16).alias("cluster"), (F.col("page_id") % 16).alias("blob"), F.octet_length("html").cast("long").alias("size"),
    )


def entries(spark: SparkSession, d: str) -> DataFrame:
    return E.numbered(pages(spark, d), ["path", "page_id"], "entry_idx")


_SHOWN = ["entry_idx", "page_id", "namespace", "path", "title", "mime", "size"]
_SELECT = f"WITH {ENTRIES} SELECT {', '.join(_SHOWN)} FROM e"


@query("scan_entries", _SELECT)
def scan_entries(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select(*_SHOWN)


@query("entry_by_path", f"{_SELECT} WHERE namespace = 'C' AND path = 'en/685'")
def entry_by_path(spark: SparkSession, d: str) -> DataFrame:
    return E.by_path(entries(spark, d), "C/en/685").select(*_SHOWN)


@query("entry_by_title", f"WITH {ENTRIES} SELECT {', '.join(_SHOWN)} FROM e WHERE title = (SELECT min(title) FROM e) ORDER BY entry_idx LIMIT 1")
def entry_by_title(spark: SparkSession, d: str) -> DataFrame:
    all_ = entries(spark, d)
    return E.by_title(all_, all_.agg(F.min("title")).first()[0]).select(*_SHOWN)


@query("entry_by_index", f"{_SELECT} WHERE entry_idx = 7")
def entry_by_index(spark: SparkSession, d: str) -> DataFrame:
    return E.by_index(entries(spark, d), 7).select(*_SHOWN)


@query("has_entry", f"WITH {ENTRIES}, asked(namespace, path) AS (VALUES ('C', 'en/685'), ('C', 'nowhere'), ('M', 'en/685')) SELECT * FROM asked a WHERE EXISTS (SELECT 1 FROM e WHERE e.namespace = a.namespace AND e.path = a.path)")
def has_entry(spark: SparkSession, d: str) -> DataFrame:
    return E.having(pages(spark, d), spark.createDataFrame([("C", "en/685"), ("C", "nowhere"), ("M", "en/685")], "namespace string, path string"))


@query("find_by_path_prefix", f"{_SELECT} WHERE starts_with(path, 'en/')")
def find_by_path_prefix(spark: SparkSession, d: str) -> DataFrame:
    return E.with_prefix(entries(spark, d), "en/").select(*_SHOWN)


@query("iterate_by_path", f"WITH {ENTRIES} SELECT entry_idx AS rank, page_id FROM e")
def iterate_by_path(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select(F.col("entry_idx").alias("rank"), "page_id")


@query("iterate_by_title", f"WITH {ENTRIES} SELECT row_number() OVER (ORDER BY title, namespace, path, page_id) - 1 AS rank, page_id FROM e")
def iterate_by_title(spark: SparkSession, d: str) -> DataFrame:
    return E.numbered(pages(spark, d), ["title", "namespace", "path", "page_id"], "rank").select("rank", "page_id")


@query("iterate_by_cluster_order", f"WITH {ENTRIES} SELECT row_number() OVER (ORDER BY cluster, blob, page_id) - 1 AS rank, page_id, cluster, blob FROM e")
def iterate_by_cluster_order(spark: SparkSession, d: str) -> DataFrame:
    return E.cluster_order(pages(spark, d).withColumn("entry_idx", F.col("page_id")), "rank").select("rank", "page_id", "cluster", "blob")


@query("suggest", f"""WITH {ENTRIES}, t AS (SELECT *, row_number() OVER (ORDER BY title, namespace, path, page_id) - 1 AS pos FROM e)
SELECT pos, title, path FROM t WHERE starts_with(lower(title), 'th') ORDER BY pos LIMIT 10""")
def suggest(spark: SparkSession, d: str) -> DataFrame:
    return S.suggest(E.numbered(pages(spark, d), ["title", "namespace", "path", "page_id"], "pos"), "Th").select("pos", "title", "path")


@query("namespace_counts", """SELECT ns, CASE ns WHEN 'C' THEN 'content (new scheme)' WHEN 'A' THEN 'article (old scheme)' WHEN 'I' THEN 'image (old scheme)' WHEN 'M' THEN 'metadata' WHEN 'Q' THEN 'namespace Q' ELSE 'unknown (0x31)' END AS kind,
  ns IN ('C', 'A', 'I', 'J', '-') AS user_content, count(*) AS n FROM (SELECT substring('CAIMQ1', CAST(doc_id % 6 + 1 AS INTEGER), 1) AS ns FROM documents) GROUP BY ns""")
def namespace_counts(spark: SparkSession, d: str) -> DataFrame:
    ns = F.substring(F.lit("CAIMQ1"), (F.col("doc_id") % 6 + 1).cast("int"), F.lit(1))
    rows = table(spark, d, "documents").select(ns.alias("ns")).groupBy("ns").agg(F.count("*").alias("n"))
    return rows.select("ns", D.describe_namespace(F.col("ns")).alias("kind"), D.is_user_content(F.col("ns")).alias("user_content"), "n")


@query("detect_mime_type", """SELECT page_id, CASE WHEN ext IN ('html', 'htm') THEN 'text/html' ELSE 'application/octet-stream' END AS mime, ext IN ('html', 'htm') AS compressible
  FROM (SELECT page_id, lower(string_split(url, '.')[-1]) AS ext FROM pages)""")
def detect_mime_type(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", D.mime_by_name(F.col("url")).alias("mime"))
    return rows.withColumn("compressible", D.is_compressible(F.col("mime")))


@query("mime_counts", "SELECT CASE WHEN regexp_matches(url, '\\.html?$') THEN 'text/html' ELSE 'application/octet-stream' END AS mime, count(*) AS n FROM pages GROUP BY 1")
def mime_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(D.mime_by_name(F.col("url")).alias("mime")).agg(F.count("*").alias("n"))


@query("detect_content_type", """WITH b AS (SELECT 'd' || doc_id AS id, hex(encode(left(text, 9))) AS h, strlen(text) AS n FROM documents UNION ALL SELECT 'p' || page_id, hex(encode(left(html, 9))), strlen(html) FROM pages)
SELECT id, CASE WHEN n < 4 THEN '' WHEN starts_with(h, '474946') THEN '[GIF]' WHEN starts_with(h, '3C21444F4354595045') OR (n >= 5 AND left(h, 4) IN ('3C68', '3C48')) THEN '[HTML]'
  ELSE regexp_replace(left(h, 8), '(..)(..)(..)(..)', '[\\1 \\2 \\3 \\4]') END AS type FROM b""")
def detect_content_type(spark: SparkSession, d: str) -> DataFrame:
    """All documents and pages; no valid text begins with the other signatures."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").cast("binary").alias("b"))
    web = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").cast("binary").alias("b"))
    return docs.unionByName(web).select("id", D.content_type(F.col("b")).alias("type"))


@query("uuid_format", """SELECT doc_id, left(m, 8) || '-' || substring(m, 9, 4) || '-' || substring(m, 13, 4) || '-' || substring(m, 17, 4) || '-' || substring(m, 21, 12) AS uuid, upper(left(m, 2)) || ' ' || upper(substring(m, 3, 2)) AS hex
  FROM (SELECT doc_id, md5(text) AS m FROM documents)""")
def uuid_format(spark: SparkSession, d: str) -> DataFrame:
    m = F.md5(F.col("text").cast("binary"))
    return table(spark, d, "documents").select("doc_id", D.parse_uuid(F.upper(m)).alias("uuid"), D.spaced_hex(F.unhex(F.substring(m, 1, 4))).alias("hex"))


@query("uuid_parse", "SELECT * FROM (VALUES (0, '12345678-9abc-def0-1234-56789abcdef0'), (1, '12345678-9abc-def0-1234-56789abcdef0'), (2, '00000000-0000-0000-0000-000000000000'), (3, NULL), (4, NULL)) t(nr, uuid)")
def uuid_parse(spark: SparkSession, d: str) -> DataFrame:
    typed = ["12345678-9abc-def0-1234-56789abcdef0", "123456789abcdef0123456789ABCDEF0", "", "zz345678-9abc-def0-1234-56789abcdef0", "1234"]
    return spark.createDataFrame(list(enumerate(typed)), "nr int, typed string").select("nr", D.parse_uuid(F.col("typed")).alias("uuid"))


@query("blob_range", """WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents)
SELECT doc_id, CASE WHEN length(h) >= 10 THEN substring(h, 11, 10) END AS part, CASE WHEN length(h) >= 20 THEN md5(substring(h, 21)) END AS rest FROM h""")
def blob_range(spark: SparkSession, d: str) -> DataFrame:
    """Bytes 5 to 9 of each text as hex digits, and a digest of those of the bytes from 10 on."""
    rows = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    return rows.select("doc_id", F.hex(E.blob_range(F.col("b"), 5, 5)).alias("part"), F.md5(F.hex(E.blob_range(F.col("b"), 10))).alias("rest"))


@query("md5_content", "SELECT doc_id, md5(coalesce(text, '')) AS md5, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents")
def md5_content(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.md5(text.cast("binary")).alias("md5"), F.octet_length(text).cast("long").alias("size"))


LINKS = """l AS (SELECT page_id, unnest(ms) AS link, unnest(range(len(ms))) AS nr FROM (SELECT page_id, list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1), regexp_extract_all(html, 'src="([^"]*)"', 1)) AS ms FROM pages))"""
_EXT = "regexp_matches(link, '^(https?://|mailto:|tel:|javascript:|data:|//|#)')"


@query("extract_links", f"WITH {LINKS} SELECT page_id, CAST(nr AS BIGINT) AS nr, link FROM l")
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    return I.links(table(spark, d, "pages"), "page_id").select("page_id", "nr", "link")


@query("external_links", f"WITH {LINKS} SELECT page_id, count(*) FILTER (WHERE {_EXT}) AS external, count(*) FILTER (WHERE NOT {_EXT}) AS internal FROM l GROUP BY page_id")
def external_links(spark: SparkSession, d: str) -> DataFrame:
    ext = D.is_external_url(F.col("link"))
    return I.links(table(spark, d, "pages"), "page_id").groupBy("page_id").agg(F.count_if(ext).alias("external"), F.count_if(~ext).alias("internal"))


@query("broken_links", f"""WITH {LINKS}, {ENTRIES}, n AS (SELECT *, CASE WHEN regexp_matches(link, '^[AIJMXCW-]/') THEN left(link, 1) ELSE 'C' END AS ns, CASE WHEN regexp_matches(link, '^[AIJMXCW-]/') THEN substring(link, 3) ELSE link END AS target FROM l WHERE NOT {_EXT} AND link <> '')
SELECT page_id, CAST(nr AS BIGINT) AS nr, link FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.namespace = n.ns AND e.path = n.target)""")
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    return I.broken_links(table(spark, d, "pages"), pages(spark, d), "page_id")


@query("broken_links_archives", f"""WITH {LINKS}, {ENTRIES}, n AS (SELECT *, CASE WHEN regexp_matches(link, '^[AIJMXCW-]/') THEN left(link, 1) ELSE 'C' END AS ns, CASE WHEN regexp_matches(link, '^[AIJMXCW-]/') THEN substring(link, 3) ELSE link END AS target FROM l WHERE NOT {_EXT} AND link <> '')
SELECT 'a' || page_id % 2 AS archive_id, page_id, CAST(nr AS BIGINT) AS nr, link FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page_id % 2 = n.page_id % 2 AND e.namespace = n.ns AND e.path = n.target)""")
def broken_links_archives(spark: SparkSession, d: str) -> DataFrame:
    """Even and odd pages as two archives: what only the other one has is missing."""
    rows = pages(spark, d).withColumn("archive_id", F.concat(F.lit("a"), F.col("page_id") % 2))
    return I.broken_links(rows, rows, "page_id")


@query("broken_links_corpus", """WITH w AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS link FROM pages), v AS (SELECT DISTINCT title FROM (SELECT regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages))
SELECT link, count(*) AS n, count(DISTINCT page_id) AS pages FROM w WHERE link NOT IN (SELECT title FROM v) GROUP BY link""")
def broken_links_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Root-relative links that are no page's title, by target."""
    all_ = table(spark, d, "pages")
    titles = all_.select(F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("link")).distinct()
    rooted = I.links(all_, "page_id").where("startswith(link, '/') and not startswith(link, '//')").select("page_id", F.substring(F.col("link"), F.lit(2), F.length("link")).alias("link"))
    return rooted.join(titles, "link", "left_anti").groupBy("link").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


#: Redirects among the orders: entry k of n leads to (7 k + 3) mod n; multiples of five are content.
REDIRECTS = """o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders),
g AS (SELECT k, n, k % 5 = 0 AS content, (7 * k + 3) % n AS dst FROM o)"""


def redirect_entries(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey")
    n = orders.count()
    k = F.col("entry_idx")
    rows = E.numbered(orders, ["o_orderkey"], "entry_idx")
    return rows.select(
        F.lit("orders").alias("archive_id"), "entry_idx", F.lit("C").alias("namespace"), F.concat(F.lit("order/"), k).alias("path"),
        F.when(k % 5 == 0, "content").otherwise("redirect").alias("entry_type"), F.when(k % 5 != 0, (7 * k + 3) % n).alias("redirect_idx"),
    )


@query("redirect_resolve", f"WITH {REDIRECTS} SELECT a.k AS entry_idx, a.dst AS target_idx, 'order/' || a.dst AS target_path, CASE WHEN b.content THEN 'content' ELSE 'redirect' END AS target_type FROM g a JOIN g b ON a.dst = b.k WHERE NOT a.content")
def redirect_resolve(spark: SparkSession, d: str) -> DataFrame:
    return E.redirect_targets(redirect_entries(spark, d)).select("entry_idx", "target_idx", "target_path", "target_type")


@query("redirect_one_hop_errors", f"WITH {REDIRECTS} SELECT CASE WHEN b.content THEN 'ok' ELSE 'redirect' END AS status, count(*) AS n FROM g a JOIN g b ON a.dst = b.k WHERE NOT a.content GROUP BY 1")
def redirect_one_hop_errors(spark: SparkSession, d: str) -> DataFrame:
    return E.resolved(redirect_entries(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("redirect_final_targets", f"""WITH RECURSIVE {REDIRECTS}, walk(src, here, hops) AS (SELECT k, dst, 1 FROM g WHERE NOT content UNION ALL
  SELECT src, g.dst, hops + 1 FROM walk JOIN g ON walk.here = g.k WHERE NOT g.content AND hops < 400)
SELECT src, max(here) AS dst FROM walk JOIN g ON walk.here = g.k WHERE g.content GROUP BY src""")
def redirect_final_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = redirect_entries(spark, d).where("entry_type = 'redirect'").select(F.col("entry_idx").alias("src"), F.col("redirect_idx").alias("dst"))
    return E.final_targets(rows).where("not looping").select("src", "dst")


@query("redirect_loops", f"""WITH RECURSIVE {REDIRECTS}, walk(src, here, hops) AS (SELECT k, dst, 1 FROM g WHERE NOT content UNION ALL
  SELECT src, g.dst, hops + 1 FROM walk JOIN g ON walk.here = g.k WHERE NOT g.content AND hops < 400)
SELECT k AS entry_idx FROM g WHERE NOT content AND k NOT IN (SELECT src FROM walk JOIN g ON walk.here = g.k WHERE g.content)""")
def redirect_loops(spark: SparkSession, d: str) -> DataFrame:
    rows = redirect_entries(spark, d).where("entry_type = 'redirect'").select(F.col("entry_idx").alias("src"), F.col("redirect_idx").alias("dst"))
    return E.loop_reports(rows).select("entry_idx")


@query("redirect_loops_archives", f"""WITH RECURSIVE {REDIRECTS}, walk(src, here, hops) AS (SELECT k, dst, 1 FROM g WHERE NOT content UNION ALL
  SELECT src, g.dst, hops + 1 FROM walk JOIN g ON walk.here = g.k WHERE NOT g.content AND hops < 400)
SELECT archive_id, k AS entry_idx FROM g, (VALUES ('x'), ('y')) v(archive_id) WHERE NOT content AND k NOT IN (SELECT src FROM walk JOIN g ON walk.here = g.k WHERE g.content)""")
def redirect_loops_archives(spark: SparkSession, d: str) -> DataFrame:
    """Two archives with the same indices and loops."""
    rows = redirect_entries(spark, d).where("entry_type = 'redirect'")
    rows = rows.drop("archive_id").crossJoin(F.broadcast(spark.createDataFrame([("x",), ("y",)], "archive_id string")))  # two rows
    found = E.loop_reports(rows.select(F.struct("archive_id", "entry_idx").alias("src"), F.struct("archive_id", F.col("redirect_idx").alias("entry_idx")).alias("dst")))
    return found.select("entry_idx.archive_id", "entry_idx.entry_idx")


@query("redirect_loop_members", "SELECT * FROM (VALUES (1, [2, 3]), (2, [2, 3]), (3, [2, 3]), (5, [5]), (8, [5]), (9, [2, 3])) t(entry_idx, loop)")
def redirect_loop_members(spark: SparkSession, d: str) -> DataFrame:
    """A tail into a pair, a self-loop with a tail, chains that end, one that leads nowhere."""
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (5, 5), (8, 5), (9, 1), (6, 7), (10, 6), (11, 99)], "src long, dst long")
    return E.loop_reports(rows).select(F.col("entry_idx").cast("int"), F.col("loop").cast("array<int>"))


@query("redundant_pairs", "WITH m AS (SELECT doc_id, md5(coalesce(text, '')) AS md5, min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS first FROM documents) SELECT first, doc_id AS later, md5 FROM m WHERE doc_id <> first")
def redundant_pairs(spark: SparkSession, d: str) -> DataFrame:
    return I.redundant(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")


@query("redundant_archives", "WITH m AS (SELECT doc_id, md5(coalesce(text, '')) AS md5, min(doc_id) OVER (PARTITION BY doc_id % 2, md5(coalesce(text, ''))) AS first FROM documents) SELECT doc_id % 2 AS archive_id, first, doc_id AS later, md5 FROM m WHERE doc_id <> first")
def redundant_archives(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select((F.col("doc_id") % 2).alias("archive_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return I.redundant(docs, "doc_id", "text")


@query("empty_entries", "SELECT doc_id AS entry_idx, 'dirent ' || doc_id || ' (\"doc/' || doc_id || '\"): empty content' AS message FROM documents WHERE length(trim(regexp_replace(text, '[^%]', '', 'g'))) = 0")
def empty_entries(spark: SparkSession, d: str) -> DataFrame:
    """Content measured by its percent signs, since no document is empty."""
    docs = table(spark, d, "documents").select(F.lit("docs").alias("archive_id"), F.col("doc_id").alias("entry_idx"), F.concat(F.lit("doc/"), "doc_id").alias("path"), F.length(F.regexp_replace("text", "[^%]", "")).alias("size"))
    return I.empty_entries(docs).select("entry_idx", "message")


@query("dirent_order", """WITH o AS (SELECT page_id, url, lag(url) OVER (ORDER BY page_id) AS before FROM pages) SELECT page_id AS entry_idx, 'dirent ' || page_id || ': paths out of order ("' || url || '" < "' || before || '")' AS message FROM o WHERE url < before""")
def dirent_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(F.lit("pages").alias("archive_id"), F.col("page_id").alias("entry_idx"), F.lit("C").alias("namespace"), F.col("url").alias("path"))
    return I.out_of_order(rows).select("entry_idx", "message")


@query("offset_monotonic", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS off, lag(o_custkey) OVER (ORDER BY o_orderkey) AS before FROM orders) SELECT k AS entry_idx, 'dirent ' || k || ': offset ' || off || ' not monotonically increasing' AS message FROM o WHERE off <= before""")
def offset_monotonic(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.lit("orders").alias("archive_id"), F.col("o_orderkey").alias("entry_idx"), F.col("o_custkey").alias("dirent_offset"))
    return I.offset_errors(rows).select("entry_idx", "message")


@query("unknown_mimes", "SELECT l_orderkey AS entry_idx, 'dirent ' || l_orderkey || ': unknown MIME index ' || l_linenumber AS message FROM lineitem WHERE l_linenumber NOT IN (1, 2, 3, 4)")
def unknown_mimes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.lit("a").alias("archive_id"), F.col("l_orderkey").alias("entry_idx"), F.col("l_linenumber").alias("mime_idx"))
    return I.unknown_mimes(rows, spark.createDataFrame([("a", k) for k in (1, 2, 3, 4)], "archive_id string, idx int")).select("entry_idx", "message")


@query("cluster_sizes", """SELECT page_id, lead(page_id, 1, 1000000) OVER (ORDER BY page_id) - page_id AS size FROM pages""")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(F.lit("a").alias("archive_id"), F.col("page_id"), F.col("page_id").alias("offset"))
    archive = spark.createDataFrame([("a", True, 1_000_000, 1_000_016)], "archive_id string, has_checksum boolean, checksum_pos long, size long")
    return C.with_sizes(rows, archive).select("page_id", "size")


_PACKING = """WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents),
p(k, doc_id, cluster, blob, filled) AS (SELECT k, doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), size FROM s WHERE k = 0 UNION ALL
  SELECT s.k, s.doc_id, CASE WHEN p.filled + s.size > 65536 THEN p.cluster + 1 ELSE p.cluster END, CASE WHEN p.filled + s.size > 65536 THEN 0 ELSE p.blob + 1 END, CASE WHEN p.filled + s.size > 65536 THEN s.size ELSE p.filled + s.size END FROM p JOIN s ON s.k = p.k + 1)
SELECT doc_id, cluster, blob FROM p"""


@query("cluster_packing", _PACKING)
def cluster_packing(spark: SparkSession, d: str) -> DataFrame:
    rows = E.numbered(table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size")), ["doc_id"], "k")
    return C.packed(rows, "k", "size", 65536).select("doc_id", "cluster", "blob")


@query("cluster_packing_stretches", _PACKING)
def cluster_packing_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The same packing, with a task for each hundred documents."""
    rows = E.numbered(table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size")), ["doc_id"], "k")
    return C.packed(rows, "k", "size", 65536, stretch=100).select("doc_id", "cluster", "blob")


@query("cluster_stats", "SELECT CAST(floor(page_id / 16) AS BIGINT) AS cluster, count(*) AS blobs, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.cluster_stats(pages(spark, d), "size")


@query("random_entry")
def random_entry(spark: SparkSession, d: str) -> DataFrame:
    return E.random_entry(pages(spark, d), 1).select("page_id", "path")


@query("result_rank", "SELECT page_id, row_number() OVER (PARTITION BY length(url) ORDER BY url, page_id) AS rank FROM pages")
def result_rank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.row_number().over(Window.partitionBy(F.length("url")).orderBy("url", "page_id")).cast("long").alias("rank"))
