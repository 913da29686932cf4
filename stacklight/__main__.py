"""python -m stacklight info|dump|search|suggest|check|trace|pack|unpack ARCHIVE .."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stacklight.operators import entries as E
from stacklight.operators import files, integrity
from stacklight.operators import search as S
from stacklight.sources import zim


def corpus(spark: SparkSession, path: str):
    """What is searched: content as it is stored, redirects, metadata and indexes left out."""
    t = zim.tables(spark, path)
    rows = E.items(t["entries"].where("namespace not in ('M', 'X')"), t["blobs"])
    return rows.select("archive_id", F.col("entry_idx").alias("doc_id"), "path", "title", F.make_valid_utf8(F.col("data").cast("string")).alias("text"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="stacklight")
    sub = p.add_subparsers(dest="command", required=True)
    for name, more in {"info": [], "dump": ["--ns"], "search": ["query", "--limit", "--offset"], "suggest": ["prefix", "--limit"], "check": [], "trace": [], "pack": ["folder", "--main"], "unpack": ["folder", "--ns"]}.items():
        c = sub.add_parser(name)
        c.add_argument("archive")
        for a in more:
            c.add_argument(a, **({"type": int} if a in ("--limit", "--offset") else {}))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("stacklight").getOrCreate()
    if a.command == "info":
        files.info(spark, a.archive).show(truncate=False, vertical=True)
    elif a.command == "dump":
        files.dump(spark, a.archive, a.ns).show(10_000, truncate=False)
    elif a.command == "search":
        docs = corpus(spark, a.archive)
        found = S.search(docs, a.query, a.offset or 0, a.limit or 20)
        found.join(docs.select("doc_id", "path", "title"), "doc_id").orderBy("rank").select("rank", "path", "title", "score", "snippet").show(a.limit or 20, truncate=False)
    elif a.command == "suggest":
        t = zim.tables(spark, a.archive)
        titles = t["title_index"].join(t["entries"].select("archive_id", "entry_idx", "title", "path"), ["archive_id", "entry_idx"])
        S.suggest(titles, a.prefix, a.limit or 10).select("title", "path").show(truncate=False)
    elif a.command == "check":
        for name, df in integrity.report(zim.tables(spark, a.archive)).items():
            print(name)
            df.show(50, truncate=False)
    elif a.command == "trace":
        for name, df in files.trace(spark, a.archive).items():
            print(name)
            df.show(50, truncate=False)
    elif a.command == "pack":
        files.pack_folder(spark, a.folder, a.archive, a.main or "index.html")
    else:
        files.unpack(spark, a.archive, a.folder, a.ns or "C").where("error is not null").show(50, truncate=False)


if __name__ == "__main__":
    main()
