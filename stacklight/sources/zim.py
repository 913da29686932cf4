"""Spark data source "zim": archives as tables, and tables as archives.

    register(spark)
    spark.read.format("zim").option("table", "entries").load("/data/*.zim")
    items.write.format("zim").option("main_path", "index.html").mode("append").save("/data/new.zim")

Reading: tables of stacklight.sources.container.SCHEMAS. A partition is a range of the directory or of the clusters, so each
cluster is decompressed once, and directory tables never touch content. The options namespace, path_is, path_starts, entry_idx,
cluster and archive_id narrow what is read, by binary search where the directory's order allows it; they leave a superset, so
queries keep their own filters. (Spark's filter push-down is not used: a pushed filter would stay with the source for
later queries on the same DataFrame.) Writing: items have path and data, and optionally
namespace, title, mime and redirect_path. Tasks compress clusters into files beside the target; the driver then writes
the sorted directory and streams the clusters behind it, with their MD5. The target's folder must be shared.
"""

from __future__ import annotations

import glob
import hashlib
import os
import shutil
import struct
import uuid as uuid_
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from stacklight.functions.detect import COMPRESSIBLE, MIME_BY_EXTENSION
from stacklight.operators import entries as E
from stacklight.sources import container as C
from stacklight.sources.multipart import SUFFIXES

ENTRIES_PER_TASK, CLUSTERS_PER_TASK = 50_000, 64
CLUSTER_SIZE = 2 << 20
_CODES = {"none": C.PLAIN, "zstd": C.ZSTD, "xz": C.XZ}


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class ZimDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zim"

    def schema(self) -> str:
        return C.SCHEMAS[self.options.get("table", "entries")]

    def reader(self, schema: StructType) -> ZimReader:
        return ZimReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ZimWriter:
        return ZimWriter(dict(self.options), schema, overwrite)


def archive_files(pattern: str) -> list[str]:
    """The archives of a path or pattern, commas between several; parts count as one archive."""
    out = []
    for p in pattern.split(","):
        p = p.strip().removeprefix("file://")
        if any(c in p for c in "*?["):
            whole = glob.glob(p)
            parts = {f[:-2] for f in glob.glob(p + "??") if f[-2:] in SUFFIXES and not os.path.exists(f[:-2])}
            out += sorted({*whole, *parts})
        elif os.path.isdir(p):
            out += sorted(glob.glob(f"{p}/*.zim"))
        else:
            out.append(p)
    if not out:
        raise FileNotFoundError(pattern)
    return out


class ZimReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.table = options.get("table", "entries")
        self.files = archive_files(options["path"])
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.wanted = {k: [options[k]] for k in ("archive_id", "namespace", "path_is") if k in options}
        self.wanted |= {k: [int(x) for x in options[k].split(",")] for k in ("entry_idx", "cluster") if k in options}
        self.prefix: str | None = options.get("path_starts")

    def partitions(self) -> list[Range]:
        out = []
        for path in self.files:
            if "archive_id" in self.wanted and path.rsplit("/", 1)[-1] not in self.wanted["archive_id"]:
                continue
            try:
                a = C.Archive.open(path)
            except (C.ContainerError, OSError):
                if self.permissive:
                    continue
                raise
            with a.parts:
                if self.table == "entries":
                    start, end = self._directory(a)
                    step = ENTRIES_PER_TASK
                elif self.table in ("clusters", "blobs"):
                    out += self._runs(path, a.header.cluster_count)
                    continue
                else:
                    start, end, step = 0, 1, 1
                out += [Range(path, s, min(s + step, end)) for s in range(start, end, step)]
        return out or [Range("", 0, 0)]

    def _span(self, column: str, count: int) -> tuple[int, int]:
        asked = self.wanted.get(column)
        return (max(0, min(asked)), min(count, max(asked) + 1)) if asked else (0, count)

    def _runs(self, path: str, count: int) -> list[Range]:
        """The clusters asked for, else all, as runs without those between."""
        out: list[Range] = []
        for c in sorted({c for c in self.wanted["cluster"] if 0 <= c < count}) if "cluster" in self.wanted else range(count):
            if out and out[-1].end == c and c - out[-1].start < CLUSTERS_PER_TASK:
                out[-1] = Range(path, out[-1].start, c + 1)
            else:
                out.append(Range(path, c, c + 1))
        return out

    def _directory(self, a: C.Archive) -> tuple[int, int]:
        start, end = self._span("entry_idx", a.header.entry_count)
        spaces = self.wanted.get("namespace")
        if spaces:
            paths = self.wanted.get("path_is") or ([self.prefix] if self.prefix else [""])
            exact = "path_is" in self.wanted
            lo = a.find(min(spaces), min(paths) if len(spaces) == 1 else "")
            hi = a.find(max(spaces), max(paths) + "\0" if exact else max(paths) + "\U0010ffff") if len(spaces) == 1 else a.find(chr(ord(max(spaces)) + 1), "")
            start, end = max(start, lo), min(end, hi)
        return start, end

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        a = C.Archive.open(partition.path)
        with a.parts:
            yield from getattr(self, f"_{self.table}")(a, partition)

    def _archives(self, a: C.Archive, p: Range) -> Iterator[tuple]:
        yield a.row()

    def _mime_types(self, a: C.Archive, p: Range) -> Iterator[tuple]:
        for k, m in enumerate(a.mimes):
            yield a.archive_id, k, m

    def _entries(self, a: C.Archive, p: Range) -> Iterator[tuple]:
        for k, offset, d in a.entries(p.start, p.end):
            yield a.archive_id, k, offset, d.namespace, d.path, d.title, d.entry_type, d.mime_idx, C.mime_of(d.mime_idx, a.mimes), d.version, d.cluster, d.blob, d.redirect_idx, d.extra

    def _raw_clusters(self, a: C.Archive, p: Range) -> Iterator[tuple[int, int, int, bytes]]:
        for k, (offset, size) in enumerate(a.cluster_ends()[p.start : p.end], p.start):
            yield k, offset, size, a.parts.read_at(offset, size)

    def _clusters(self, a: C.Archive, p: Range) -> Iterator[tuple]:
        for k, offset, size, raw in self._raw_clusters(a, p):
            yield a.archive_id, k, offset, size, raw[0] & 15, bool(raw[0] & 16), len(C.parse_cluster(raw))

    def _blobs(self, a: C.Archive, p: Range) -> Iterator[pa.RecordBatch]:
        """A batch for each cluster, so a task holds no more than one and its columns, whatever its blobs' sizes."""
        for k, _, _, raw in self._raw_clusters(a, p):
            try:
                blobs = C.parse_cluster(raw)
            except C.ContainerError:
                if self.permissive:
                    continue
                raise
            if blobs:
                n = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array([a.archive_id] * n), pa.array([k] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([len(b) for b in blobs], pa.int64()), pa.array(blobs, pa.binary())], ["archive_id", "cluster", "blob", "size", "data"])

    def _title_index(self, a: C.Archive, p: Range) -> Iterator[tuple]:
        found = a.titles()
        for k, index in enumerate(found[1] if found else ()):
            yield a.archive_id, found[0], k, index


@dataclass
class Written(WriterCommitMessage):
    """A task's clusters (file, sizes in order) and items (namespace, path, title, mime, cluster of the task, blob, redirect)."""

    file: str
    sizes: list
    items: list


class ZimWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        if os.path.exists(self.path) and not overwrite and options.get("replace", "false") != "true":
            raise FileExistsError(self.path)
        self.code = _CODES[options.get("compression", "zstd")]
        self.limit = int(options.get("cluster_size", CLUSTER_SIZE))
        self.main = options.get("main_path")
        self.uuid = options.get("uuid")
        self.names = schema.names
        self.parts = f"{self.path}.parts-{uuid_.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.parts, exist_ok=True)
        file = f"{self.parts}/{uuid_.uuid4().hex}"
        sizes: list[int] = []
        items: list[tuple] = []
        # compressible and other content are gathered side by side
        held: dict[int, list] = {self.code: [], C.PLAIN: []}
        filled = {self.code: 0, C.PLAIN: 0}
        with open(file, "wb") as out:

            def flush(code: int) -> None:
                if held[code]:
                    raw = C.encode_cluster([data for _, data in held[code]], code)
                    items.extend((*item, len(sizes), k, None) for k, (item, _) in enumerate(held[code]))
                    sizes.append(len(raw))
                    out.write(raw)
                    held[code], filled[code] = [], 0

            for row in rows:
                r = dict(zip(self.names, row))
                ns, path, title = r.get("namespace") or "C", r["path"], r.get("title") or ""
                if r.get("redirect_path"):
                    items.append((ns, path, title, None, None, None, r["redirect_path"]))
                    continue
                mime = r.get("mime") or MIME_BY_EXTENSION.get(path.rsplit(".", 1)[-1].lower(), "application/octet-stream")
                data = bytes(r.get("data") or b"")
                code = self.code if mime.startswith(COMPRESSIBLE) else C.PLAIN
                if held[code] and filled[code] + len(data) > self.limit:
                    flush(code)
                held[code].append(((ns, path, title, mime), data))
                filled[code] += len(data)
            for code in list(held):
                flush(code)
        return Written(file, sizes, items)

    def commit(self, messages: list) -> None:
        """Sorts the directory, resolves redirects by path and streams the clusters behind it, in the order of their first paths."""
        done = sorted((m for m in messages if m is not None), key=lambda m: min(((i[0], i[1]) for i in m.items), default=("", "")))
        base, items, sizes = 0, [], []
        for m in done:
            items += [(*i[:4], None if i[4] is None else i[4] + base, i[5], i[6]) for i in m.items]
            sizes += m.sizes
            base += len(m.sizes)
        keys = [(i[0].encode("latin-1"), i[1].encode()) for i in items]
        if len(set(keys)) != len(keys):
            raise C.FormatError("two entries have the same namespace and path")
        items.append((*C.TITLES_V1, "", "application/octet-stream+zimlisting", len(sizes), 0, None))
        items.sort(key=lambda i: (i[0].encode("latin-1"), i[1].encode()))
        place = {(i[0], i[1]): k for k, i in enumerate(items)}
        mimes = list(dict.fromkeys(i[3] for i in items if i[3] is not None))
        number = {m: k for k, m in enumerate(mimes)}
        entries = []
        for ns, path, title, mime, cluster, blob, target in items:
            if target is None:
                entries.append(C.Dirent(number[mime], ns, path, title, cluster, blob))
                continue
            to = place.get((target[0], target[2:])) if target[1:2] == "/" else None
            to = place.get((ns, target), place.get(("C", target))) if to is None else to
            if to is None:
                raise C.FormatError(f"redirect {ns}/{path} leads to {target}, which is no entry")
            entries.append(C.Dirent(C.REDIRECT, ns, path, title, redirect_idx=to))
        front = sorted((k for k, i in enumerate(items) if i[0] == "C" and (i[6] is not None or i[3].startswith("text/html"))), key=lambda k: (items[k][2].encode(), items[k][1].encode()))
        titles = C.encode_cluster([struct.pack(f"<{len(front)}I", *front)], C.PLAIN)
        main = min((k for (_, p), k in place.items() if p == self.main), default=None) if self.main else None
        uuid = C.parse_uuid(self.uuid) if self.uuid else hashlib.md5(repr([i[:4] for i in items]).encode()).digest()
        head, _ = C.assemble(entries, [*sizes, len(titles)], mimes, uuid, main)
        digest = hashlib.md5()
        with open(f"{self.parts}/whole", "wb") as out:

            def put(data: bytes) -> None:
                digest.update(data)
                out.write(data)

            put(head)
            for m in done:
                with open(m.file, "rb") as f:
                    while data := f.read(1 << 20):
                        put(data)
            put(titles)
            out.write(digest.digest())
        os.replace(f"{self.parts}/whole", self.path)
        shutil.rmtree(self.parts)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


def register(spark: SparkSession) -> None:
    """Makes the source known."""
    spark.dataSource.register(ZimDataSource)


def tables(spark: SparkSession, path: str, **options: str) -> dict:
    """All tables of the archives of a path."""
    register(spark)
    return {t: spark.read.format("zim").options(table=t, **options).load(path) for t in C.SCHEMAS}


def lookup(spark: SparkSession, path: str, entry: str, strict: bool = False) -> DataFrame:
    """The entry of a path, found by binary search: only its row of the directory is read."""
    register(spark)
    at = E.resolve(entry, strict)
    found = spark.read.format("zim").options(table="entries", **({"namespace": at[0], "path_is": at[1]} if at else {})).load(path)
    return E.by_path(found, entry, strict)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """entries.metadata() of the archives of a path; only the M namespace's rows of the directory and its items' clusters are read."""
    register(spark)
    found = spark.read.format("zim").options(table="entries", namespace="M").load(path)
    clusters = sorted(r.cluster for r in found.where("namespace = 'M' and entry_type = 'content'").select("cluster").distinct().collect())  # numbers only
    blobs = spark.read.format("zim").options(table="blobs", cluster=",".join(map(str, clusters)) or "-1").load(path)
    return E.metadata(found, blobs)


def read_item(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """The entry with its data; of the archive only the one cluster is decompressed."""
    found = lookup(spark, path, entry).where("entry_type = 'content'")
    clusters = sorted({r.cluster for r in found.select("cluster").collect()})
    blobs = spark.read.format("zim").options(table="blobs", **({"cluster": ",".join(map(str, clusters))} if clusters else {})).load(path)
    return E.items(found, blobs)
