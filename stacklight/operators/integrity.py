"""Integrity analytics: links, loops, copies, order, empty entries, checksums; each check is a DataFrame of its own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.functions import detect
from stacklight.operators import entries as E


def link_array(html: Column) -> Column:
    """array<string>: values of href= and then of src=, found as plain strings, so `data-src=` counts too. Quoted values may be
    empty, others end at a blank or `>`; an unclosed quote ends the search for its attribute."""

    def of(attr: str) -> Column:
        found = F.regexp_extract_all(html, F.lit(f"(?s)({attr}=(?=..)(?:\"[^\"]*\"|'[^']*'|[\"']|[^ \\t\\n\\r>\"'][^ \\t\\n\\r>]*|))"), F.lit(1))
        tail = F.transform(found, lambda m: F.substring(m, len(attr) + 2, 2**31 - 1))
        open_ = F.array_position(F.transform(tail, lambda v: v.isin('"', "'")), True)
        return F.when(open_ > 0, F.slice(tail, F.lit(1), (open_ - 1).cast("int"))).otherwise(tail)

    return F.concat(of("href"), of("src"))


def archive(*frames: DataFrame) -> list[str]:
    """The key that tells archives apart, where all tables have it."""
    return ["archive_id"] if all("archive_id" in f.columns for f in frames) else []


def links(pages: DataFrame, id_col: str = "entry_idx", html_col: str = "html") -> DataFrame:
    """([archive_id,] id_col, nr, link, quoted) of each link of HTML content, in the order in which they are searched."""
    rows = pages.select(*archive(pages), id_col, F.posexplode(link_array(F.col(html_col))).alias("nr", "raw"))
    quoted = F.substring("raw", 1, 1).isin('"', "'")
    return rows.select(*archive(pages), id_col, F.col("nr").cast("long").alias("nr"), F.when(quoted, F.substring(F.col("raw"), F.lit(2), F.length("raw") - 2)).otherwise(F.col("raw")).alias("link"), quoted.alias("quoted"))


def internal(found: DataFrame) -> DataFrame:
    """Links to entries: not external, not an empty quoted value; as (.., namespace, path)."""
    rows = found.where(~detect.is_external_url(F.col("link")) & ~(F.col("quoted") & (F.col("link") == "")))
    named = F.col("link").rlike(f"^[{E.LETTERS.replace('-', '')}-]/")
    return rows.withColumns({"namespace": F.when(named, F.substring("link", 1, 1)).otherwise("C"), "path": F.when(named, F.substring(F.col("link"), F.lit(3), F.length("link"))).otherwise(F.col("link"))})


def broken_links(pages: DataFrame, entries: DataFrame, id_col: str = "entry_idx", html_col: str = "html") -> DataFrame:
    """Links of `pages` that no entry of the same archive answers: a left anti join by archive, namespace and path."""
    own = archive(pages, entries)
    found = internal(links(pages, id_col, html_col)).join(entries.select(*own, "namespace", "path"), [*own, "namespace", "path"], "left_anti")
    return found.select(*archive(pages), id_col, "nr", "link")


def redundant(contents: DataFrame, id_col: str = "entry_idx", data_col: str = "data") -> DataFrame:
    """([archive_id,] first, later, md5): entries of one archive with equal content, compared by MD5; only digests are shuffled."""
    own = archive(contents)
    keyed = contents.select(*own, F.col(id_col).alias("later"), F.md5(F.col(data_col).cast("binary")).alias("md5"))
    first = keyed.groupBy(*own, "md5").agg(F.min("later").alias("first"), F.count("*").alias("n")).where("n > 1").select(*own, "md5", "first")
    return keyed.join(first, [*own, "md5"]).where("later <> first").select(*own, "first", "later", "md5")


def out_of_order(entries: DataFrame, by_namespace: bool = False) -> DataFrame:
    """(archive_id, entry_idx, message) of entries whose path sorts before the one ahead of them."""
    rows = E.preceded(entries, ["archive_id"], F.col("entry_idx"), {"before": "path", "ns": "namespace"}, ["entry_idx", "namespace", "path"])
    wrong = F.col("path") < F.col("before")
    if by_namespace:
        wrong = (F.col("namespace") < F.col("ns")) | ((F.col("namespace") == F.col("ns")) & wrong)
    return rows.where(wrong).select("archive_id", "entry_idx", F.format_string('dirent %d: paths out of order ("%s" < "%s")', "entry_idx", "path", "before").alias("message"))


def offset_errors(entries: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """(archive_id, entry_idx, message): directory offsets beyond the file or not above the one ahead of them."""
    rows = E.preceded(entries, ["archive_id"], F.col("entry_idx"), {"before": "dirent_offset"}, ["entry_idx", "dirent_offset"])
    out = rows.where("dirent_offset <= before").select("archive_id", "entry_idx", F.format_string("dirent %d: offset %d not monotonically increasing", "entry_idx", "dirent_offset").alias("message"))
    if archives is None:
        return out
    far = rows.join(archives.select("archive_id", F.col("size").alias("file_size")), "archive_id").where("dirent_offset >= file_size")
    return far.select("archive_id", "entry_idx", F.format_string("dirent %d: offset %d exceeds file size", "entry_idx", "dirent_offset").alias("message")).unionByName(out)


def unknown_mimes(entries: DataFrame, mimes: DataFrame) -> DataFrame:
    """Entries whose MIME index is neither in their archive's list nor a sentinel."""
    rows = entries.where("mime_idx < 65533").join(mimes.select("archive_id", F.col("idx").alias("mime_idx")), ["archive_id", "mime_idx"], "left_anti")
    return rows.select("archive_id", "entry_idx", F.format_string("dirent %d: unknown MIME index %d", "entry_idx", "mime_idx").alias("message"))


def empty_entries(contents: DataFrame, size_col: str = "size") -> DataFrame:
    return contents.where(F.col(size_col) == 0).select("archive_id", "entry_idx", F.format_string('dirent %d ("%s"): empty content', "entry_idx", "path").alias("message"))


def title_index_errors(title_index: DataFrame, entries: DataFrame) -> DataFrame:
    """Additional check: title index rows without an entry, or whose titles are not in order."""
    rows = title_index.join(entries.select("archive_id", "entry_idx", "title"), ["archive_id", "entry_idx"], "left")
    return E.preceded(rows, ["archive_id", "version"], F.col("pos"), {"before": "title"}, ["pos", "entry_idx", "title"]).where("title is null or title < before").select("archive_id", "entry_idx", F.format_string("title index %d: out of order or without entry", "pos").alias("message"))


def cluster_errors(clusters: DataFrame, archives: DataFrame) -> DataFrame:
    """Additional check: cluster offsets beyond the file or not above the one before."""
    rows = clusters.join(archives.select("archive_id", F.col("size").alias("file_size")), "archive_id")
    rows = E.preceded(rows, ["archive_id"], F.col("cluster"), {"before": "offset"}, ["cluster", "offset", "file_size"])
    return rows.where("offset >= file_size or offset <= before").select("archive_id", F.col("cluster").alias("entry_idx"), F.format_string("cluster %d: bad offset %d", "cluster", "offset").alias("message"))


def checksums(archives: DataFrame) -> DataFrame:
    """(archive_id, stored, computed, ok): MD5 of all bytes before the stored one, one task for each archive; ok without one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from stacklight.sources.multipart import open_parts

        for b in batches:
            got = []
            for file, pos, has in zip(b["file"], b["checksum_pos"], b["has_checksum"]):
                if not has:
                    got.append(None)
                    continue
                digest, left, at = hashlib.md5(), int(pos), 0
                with open_parts(file) as f:
                    while left:
                        part = f.read_at(at, min(left, 1 << 20))
                        if not part:
                            break
                        digest.update(part)
                        at, left = at + len(part), left - len(part)
                got.append(digest.hexdigest())
            yield pd.DataFrame({"archive_id": b["archive_id"], "stored": b["checksum_hex"], "computed": got})

    out = archives.select("archive_id", "file", "checksum_pos", "has_checksum", "checksum_hex").mapInPandas(run, "archive_id string, stored string, computed string")
    return out.withColumn("ok", F.col("computed").isNull() | (F.col("computed") == F.col("stored")))


def report(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All checks over the tables of archives: checksum, broken_links, redirect_loops, redundant, errors, summary (a row for each archive)."""
    entries, mimes, archives = tables["entries"], tables["mime_types"], tables["archives"]
    contents = E.items(entries, tables["blobs"])
    html = contents.where("mime like 'text/html%'").withColumn("html", F.make_valid_utf8(F.col("data").cast("string")))
    broken = broken_links(html, entries)
    node = lambda c: F.struct("archive_id", F.col(c).alias("entry_idx"))
    loops = E.loop_reports(entries.where("entry_type = 'redirect' and redirect_idx is not null").select(node("entry_idx").alias("src"), node("redirect_idx").alias("dst")))
    loops = loops.select("entry_idx.archive_id", "entry_idx.entry_idx", F.transform("loop", lambda x: x["entry_idx"]).alias("loop"))
    same = redundant(contents)
    errors = None
    for name, df in {"dirent_ptrs": offset_errors(entries, archives), "dirent_order": out_of_order(entries), "mime_types": unknown_mimes(entries, mimes), "empty": empty_entries(contents), "title_index": title_index_errors(tables["title_index"], entries), "clusters": cluster_errors(tables["clusters"], archives)}.items():
        df = df.select(F.lit(name).alias("check"), "archive_id", "entry_idx", "message")
        errors = df if errors is None else errors.unionByName(df)
    sums = checksums(archives)
    summary = archives.select("archive_id")
    for name, df in {"broken_links": broken, "redirect_loops": loops, "redundant": same, "errors": errors}.items():
        summary = summary.join(df.groupBy("archive_id").agg(F.count("*").alias(name)), "archive_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    summary = summary.join(sums.select("archive_id", F.col("ok").alias("checksum_ok")), "archive_id")
    return {"checksum": sums, "broken_links": broken, "redirect_loops": loops, "redundant": same, "errors": errors, "summary": summary}
