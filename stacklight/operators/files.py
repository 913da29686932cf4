"""Folders to archives and back, and views of an archive for people."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.functions import detect as D
from stacklight.operators import entries as E
from stacklight.operators import integrity as I
from stacklight.sources import zim


def pack_folder(spark: SparkSession, folder: str, path: str, main: str = "index.html", **options: str) -> None:
    """The files of a folder, not of those within it, as an archive; titles are the files' names."""
    zim.register(spark)
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*")
    files = files.where(F.regexp_replace("path", "/[^/]*$", "").endswith(folder.split(":", 1)[-1].rstrip("/")))
    name = F.element_at(F.split("path", "/"), -1)
    name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    items = files.select(name.alias("path"), name.alias("title"), D.mime_by_name(name).alias("mime"), F.col("content").alias("data"))
    items.write.format("zim").options(main_path=main, **options).mode("append").save(path)


def unpack(spark: SparkSession, path: str, folder: str, namespace: str = "C") -> DataFrame:
    """Writes the content of a namespace as files below a shared folder; (path, size, error) of each entry. Paths that lead out
    of the folder are refused."""
    t = zim.tables(spark, path)
    base = os.path.realpath(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = []
            for p, data in zip(b["path"], b["data"]):
                to = os.path.realpath(os.path.join(base, p.lstrip("/")))
                if not to.startswith(base + os.sep):
                    errors.append("leads out of the folder")
                    continue
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(to, "wb") as f:
                    f.write(data)
                errors.append(None)
            yield pd.DataFrame({"path": b["path"], "size": b["size"], "error": pd.Series(errors, dtype=object)})

    rows = E.items(t["entries"].where(F.col("namespace") == namespace), t["blobs"]).select("path", "size", "data")
    return rows.mapInPandas(run, "path string, size bigint, error string")


def info(spark: SparkSession, path: str) -> DataFrame:
    """A row for each archive: version, identifier, counts of entries, articles, media and clusters, what it has."""
    t = zim.tables(spark, path)
    front = t["title_index"].groupBy("archive_id").agg(F.count("*").alias("articles"))
    text = t["entries"].where("namespace = 'X' and path like 'fulltext/%'").select("archive_id").distinct().withColumn("has_fulltext_index", F.lit(True))
    heads = t["archives"].join(front, "archive_id", "left").join(text, "archive_id", "left")
    return heads.select(
        "archive_id", "size", "major", "minor", "uuid", "entry_count", F.coalesce("articles", F.lit(0)).alias("articles"), (F.col("entry_count") - F.coalesce("articles", F.lit(0))).alias("media"),
        "cluster_count", "main_page", "has_checksum", "checksum_hex", "has_title_index", F.coalesce("has_fulltext_index", F.lit(False)).alias("has_fulltext_index"), "new_namespace", "multipart",
    )


def dump(spark: SparkSession, path: str, namespace: str | None = None) -> DataFrame:
    """Live entries with their kind and, of redirects, their target."""
    entries = E.live(zim.tables(spark, path)["entries"])
    if namespace:
        entries = entries.where(F.col("namespace") == namespace)
    targets = E.redirect_targets(entries).select("archive_id", "entry_idx", "target_path")
    return entries.join(targets, ["archive_id", "entry_idx"], "left").select("archive_id", "entry_idx", F.concat("namespace", F.lit("/"), "path").alias("path"), "title", "entry_type", "mime", "target_path").orderBy("archive_id", "entry_idx")


#: Rows that the sections of a trace show at most (fixed values).
SHOWN = {"entries": 40, "url_pointers": 30, "title_index": 20, "cluster_pointers": 10, "clusters": 10, "blobs": 5, "links": 10, "errors": 10}


def trace(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sections of an archive's structure, each cut to what a person reads."""
    t = zim.tables(spark, path)
    report = I.report(t)
    ns, entries = F.col("namespace"), t["entries"]
    return {
        "header": t["archives"],
        "mime_types": t["mime_types"],
        "url_pointers": entries.select("archive_id", "entry_idx", "dirent_offset").orderBy("archive_id", "entry_idx").limit(SHOWN["url_pointers"]),
        "entries": entries.withColumn("kind", D.describe_namespace(ns)).withColumn("title", D.short_string(F.col("title"), 40)).orderBy("archive_id", "entry_idx").limit(SHOWN["entries"]),
        "title_index": t["title_index"].join(entries.select("archive_id", "entry_idx", "title"), ["archive_id", "entry_idx"], "left").orderBy("archive_id", "pos").limit(SHOWN["title_index"]),
        "cluster_pointers": t["clusters"].select("archive_id", "cluster", "offset").orderBy("archive_id", "cluster").limit(SHOWN["cluster_pointers"]),
        "clusters": t["clusters"].withColumn("compression", D.describe_compression(F.col("compression"))).orderBy("archive_id", "cluster").limit(SHOWN["clusters"]),
        "blobs": t["blobs"].select("archive_id", "cluster", "blob", "size", D.content_type(F.col("data")).alias("type"), D.spaced_hex(F.substring("data", 1, 16)).alias("begins")).orderBy("archive_id", "cluster", "blob").limit(SHOWN["blobs"]),
        "checksum": report["checksum"],
        "links": report["broken_links"].limit(SHOWN["links"]),
        "errors": report["errors"].limit(SHOWN["errors"]),
        "summary": report["summary"],
    }
