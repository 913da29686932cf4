"""The archive container: header, MIME list, directory entries, clusters, as plain Python codecs without Spark.

All numbers are little-endian. Malformed input raises FormatError; nothing is read beyond a bound that was checked.
"""

from __future__ import annotations

import lzma
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import zstandard

from stacklight.functions.codecs import inflate

from stacklight.sources.multipart import Parts

MAGIC = 0x044D495A
HEADER = struct.Struct("<IHH16sIIQQQQIIQ")
NONE32, NONE64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF
#: MIME indexes that mark other kinds of entries (fixed values).
REDIRECT, LINKTARGET, DELETED = 0xFFFF, 0xFFFE, 0xFFFD
TYPES = {REDIRECT: "redirect", LINKTARGET: "linktarget", DELETED: "deleted"}
#: Compression codes (fixed values).
PLAIN, XZ, ZSTD = 1, 4, 5
TITLES_V1 = ("X", "listing/titleOrdered/v1")
MAX_CLUSTER = 256 << 20

SCHEMAS = {
    "archives": "archive_id string, file string, size bigint, major int, minor int, uuid string, entry_count bigint, cluster_count bigint, url_ptr_pos bigint, title_idx_pos bigint, cluster_ptr_pos bigint, mime_list_pos bigint, main_page bigint, layout_page bigint, checksum_pos bigint, checksum_hex string, has_checksum boolean, new_namespace boolean, has_title_index boolean, multipart boolean",
    "mime_types": "archive_id string, idx int, mime string",
    "entries": "archive_id string, entry_idx bigint, dirent_offset bigint, namespace string, path string, title string, entry_type string, mime_idx int, mime string, version bigint, cluster bigint, blob bigint, redirect_idx bigint, extra binary",
    "clusters": "archive_id string, cluster bigint, offset bigint, size bigint, compression int, extended boolean, blob_count bigint",
    "blobs": "archive_id string, cluster bigint, blob bigint, size bigint, data binary",
    "title_index": "archive_id string, version string, pos bigint, entry_idx bigint",
}


class ContainerError(ValueError):
    """What is wrong with an archive."""


class FormatError(ContainerError):
    """Bytes that the format does not allow."""


class UnsupportedVersion(ContainerError):
    """A major version other than 5 or 6."""


class UnsupportedCompression(ContainerError):
    """A cluster type that is not none, xz or zstd."""


@dataclass(frozen=True)
class Header:
    major: int
    minor: int
    uuid: bytes
    entry_count: int
    cluster_count: int
    url_ptr_pos: int
    title_idx_pos: int | None
    cluster_ptr_pos: int
    mime_list_pos: int
    main_page: int | None
    layout_page: int | None
    checksum_pos: int

    @classmethod
    def parse(cls, data: bytes) -> Header:
        if len(data) < HEADER.size:
            raise FormatError("header too short")
        magic, major, minor, uuid, entries, clusters, urls, titles, cluster_ptrs, mimes, main, layout, checksum = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise FormatError(f"bad magic {magic:#x}")
        if major not in (5, 6):
            raise UnsupportedVersion(f"major version {major}")
        optional = lambda v, none: None if v == none else v
        return cls(major, minor, uuid, entries, clusters, urls, optional(titles, NONE64), cluster_ptrs, mimes, optional(main, NONE32), optional(layout, NONE32), checksum)

    def encode(self) -> bytes:
        given = lambda v, none: none if v is None else v
        return HEADER.pack(MAGIC, self.major, self.minor, self.uuid, self.entry_count, self.cluster_count, self.url_ptr_pos, given(self.title_idx_pos, NONE64), self.cluster_ptr_pos, self.mime_list_pos, given(self.main_page, NONE32), given(self.layout_page, NONE32), self.checksum_pos)

    def problems(self, size: int) -> list[str]:
        out = []
        if not self.entry_count:
            out.append("no entries")
        if not self.cluster_count:
            out.append("no clusters")
        for name in ("url_ptr_pos", "title_idx_pos", "cluster_ptr_pos", "mime_list_pos", "checksum_pos"):
            if (v := getattr(self, name)) is not None and v >= size:
                out.append(f"{name} {v} beyond the file's {size} bytes")
        for name in ("main_page", "layout_page"):
            if (v := getattr(self, name)) is not None and v >= self.entry_count:
                out.append(f"{name} {v} beyond the {self.entry_count} entries")
        return out

    def validate(self, size: int) -> None:
        if found := self.problems(size):
            raise FormatError("; ".join(found))

    @property
    def new_namespace(self) -> bool:
        return self.major >= 6 and self.minor >= 1

    @property
    def has_checksum(self) -> bool:
        return self.checksum_pos != 0


def parse_uuid(text: str) -> bytes:
    plain = text.replace("-", "")
    if plain and not re.fullmatch("[0-9a-fA-F]{32}", plain):
        raise FormatError(f"bad identifier {text!r}")
    return bytes.fromhex(plain) or bytes(16)


def format_uuid(data: bytes) -> str:
    h = data.hex()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def parse_mime_list(data: bytes) -> list[str]:
    """NUL-terminated names up to the first empty one."""
    out = []
    for part in data.split(b"\0"):
        if not part:
            break
        out.append(part.decode("utf-8", "replace"))
    return out


def encode_mime_list(mimes: list[str]) -> bytes:
    return b"".join(m.encode() + b"\0" for m in mimes) + b"\0"


def mime_of(index: int, mimes: list[str]) -> str:
    return TYPES.get(index) or (mimes[index] if index < len(mimes) else "")


@dataclass(frozen=True)
class Dirent:
    mime_idx: int
    namespace: str
    path: str
    title: str = ""
    cluster: int | None = None
    blob: int | None = None
    redirect_idx: int | None = None
    version: int = 0
    extra: bytes = b""

    @property
    def entry_type(self) -> str:
        return TYPES.get(self.mime_idx, "content")

    @classmethod
    def parse(cls, data: bytes, at: int = 0) -> tuple[Dirent, int]:
        """The entry at `at`, and its length in bytes."""
        if len(data) - at < 12:
            raise FormatError("directory entry too short")
        mime, extra_len, ns, version, first = struct.unpack_from("<HBBII", data, at)
        here, blob = at + 12, None
        if mime != REDIRECT:
            if len(data) - at < 16:
                raise FormatError("directory entry too short")
            blob = struct.unpack_from("<I", data, here)[0]
            here += 4
        texts = []
        for name in ("path", "title"):
            end = data.find(b"\0", here)
            if end < 0:
                raise FormatError(f"{name} has no end")
            texts.append(data[here:end].decode("utf-8", "surrogateescape").encode("utf-8", "surrogateescape").decode("utf-8", "replace"))
            here = end + 1
        if len(data) < here + extra_len:
            raise FormatError("extra bytes are cut short")
        extra = data[here : here + extra_len]
        place = {"redirect_idx": first} if mime == REDIRECT else {"cluster": first, "blob": blob}
        return cls(mime, chr(ns), texts[0], texts[1], version=version, extra=extra, **place), here + extra_len - at

    def encode(self) -> bytes:
        head = struct.pack("<HBBI", self.mime_idx, len(self.extra), ord(self.namespace), self.version)
        place = struct.pack("<I", self.redirect_idx) if self.mime_idx == REDIRECT else struct.pack("<II", self.cluster or 0, self.blob or 0)
        return head + place + self.path.encode() + b"\0" + self.title.encode() + b"\0" + self.extra


def decompress(code: int, data: bytes, most: int = MAX_CLUSTER) -> bytes:
    if code in (0, PLAIN):
        return data
    try:
        if code == ZSTD:
            return inflate(data, most, trailing=True)
        if code == XZ:
            stream = lzma.LZMADecompressor()
            out = stream.decompress(data, most + 1)
            if len(out) > most or not stream.eof:
                raise ValueError("larger than allowed, or cut short")
            return out
    except (zstandard.ZstdError, lzma.LZMAError, ValueError) as e:
        raise FormatError(f"cluster cannot be decompressed: {e}") from e
    raise UnsupportedCompression(f"cluster type {code}")


def compress(code: int, data: bytes, level: int | None = None) -> bytes:
    if code == PLAIN:
        return data
    if code == ZSTD:
        return zstandard.ZstdCompressor(level=level or 3).compress(data)
    if code == XZ:
        return lzma.compress(data, preset=level if level is not None else 6)
    raise UnsupportedCompression(f"cluster type {code}")


def parse_cluster(data: bytes) -> list[bytes]:
    """The cluster's blobs. Bounds are checked before anything is cut."""
    if len(data) < 2:
        raise FormatError("cluster too short")
    body = decompress(data[0] & 15, data[1:])
    width = 8 if data[0] & 16 else 4
    if len(body) < width:
        raise FormatError("cluster without offsets")
    first = int.from_bytes(body[:width], "little")
    if first % width or first < width or first > len(body):
        raise FormatError("bad first offset")
    offsets = struct.unpack_from(f"<{first // width}{'Q' if width == 8 else 'I'}", body)
    if any(a > b for a, b in zip(offsets, offsets[1:])) or offsets[-1] > len(body):
        raise FormatError("bad blob offsets")
    return [body[a:b] for a, b in zip(offsets, offsets[1:])]


def encode_cluster(blobs: list[bytes], code: int = ZSTD, level: int | None = None) -> bytes:
    total = sum(map(len, blobs))
    wide = total + 4 * (len(blobs) + 1) > NONE32
    width = 8 if wide else 4
    offsets, at = [], width * (len(blobs) + 1)
    for b in [*blobs, b""]:
        offsets.append(at)
        at += len(b)
    table = struct.pack(f"<{len(offsets)}{'Q' if wide else 'I'}", *offsets)
    return bytes([code | (16 if wide else 0)]) + compress(code, table + b"".join(blobs), level)


@dataclass
class Archive:
    """An opened archive: header, MIME list and pointers; entries and clusters are read when asked for."""

    path: str
    parts: Parts
    header: Header
    mimes: list[str]
    _ptrs: dict = field(default_factory=dict)

    @classmethod
    def open(cls, path: str) -> Archive:
        parts = Parts(path)
        header = Header.parse(parts.read_at(0, HEADER.size))
        header.validate(parts.size)
        bounds = [p for p in (header.url_ptr_pos, header.cluster_ptr_pos, header.title_idx_pos) if p is not None and p > header.mime_list_pos]
        mimes = parse_mime_list(parts.read_at(header.mime_list_pos, min([*bounds, header.mime_list_pos + (1 << 20)]) - header.mime_list_pos))
        return cls(path, parts, header, mimes)

    @property
    def archive_id(self) -> str:
        """The path, as two folders may hold files of one name."""
        return self.path

    def pointers(self, kind: str, start: int = 0, end: int | None = None) -> tuple[int, ...]:
        pos, count = (self.header.url_ptr_pos, self.header.entry_count) if kind == "entry" else (self.header.cluster_ptr_pos, self.header.cluster_count)
        end = count if end is None else min(end, count)
        raw = self.parts.read_at(pos + 8 * start, 8 * (end - start))
        if len(raw) < 8 * (end - start):
            raise FormatError(f"{kind} pointers are cut short")
        return struct.unpack(f"<{end - start}Q", raw)

    def dirent(self, offset: int) -> Dirent:
        size = 512
        while True:  # titles have no bound of their own
            data = self.parts.read_at(offset, size)
            try:
                return Dirent.parse(data)[0]
            except FormatError:
                if len(data) < size or size > 1 << 20:
                    raise
                size *= 4

    def entries(self, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, Dirent]]:
        """(index, offset, entry) of a range of the directory."""
        for k, offset in enumerate(self.pointers("entry", start, end), start):
            yield k, offset, self.dirent(offset)

    def find(self, namespace: str, path: str, prefix: bool = False) -> int:
        """The first index whose (namespace, path) is not before the one asked for: binary search over the pointers."""
        want, lo, hi = (namespace.encode(), path.encode()), 0, self.header.entry_count
        while lo < hi:
            mid = (lo + hi) // 2
            d = self.dirent(self.pointers("entry", mid, mid + 1)[0])
            lo, hi = (mid + 1, hi) if (d.namespace.encode("latin-1"), d.path.encode()) < want else (lo, mid)
        return lo

    def cluster_ends(self) -> list[tuple[int, int]]:
        """(offset, size) of each cluster; a cluster ends where the next one in the file begins."""
        offsets = self.pointers("cluster")
        end = self.header.checksum_pos if self.header.has_checksum else self.parts.size
        order = sorted({*offsets, end})
        after = dict(zip(order, order[1:]))
        out = []
        for o in offsets:
            size = after.get(o, end) - o
            if size <= 0 or size > MAX_CLUSTER:
                raise FormatError(f"cluster at {o} has {size} bytes")
            out.append((o, size))
        return out

    def titles(self) -> tuple[str, list[int]] | None:
        """(version, entry indexes in title order), or None."""
        at = self.find(*TITLES_V1)
        if at < self.header.entry_count:
            d = self.dirent(self.pointers("entry", at, at + 1)[0])
            if (d.namespace, d.path) == TITLES_V1 and d.entry_type == "content":
                offset, size = self.cluster_ends()[d.cluster]
                blob = parse_cluster(self.parts.read_at(offset, size))[d.blob]
                if len(blob) % 4:
                    raise FormatError("title listing is not a list of indexes")
                return "v1", list(struct.unpack(f"<{len(blob) // 4}I", blob))
        if self.header.title_idx_pos is None:
            return None
        raw = self.parts.read_at(self.header.title_idx_pos, 4 * self.header.entry_count)
        return ("v0", list(struct.unpack(f"<{len(raw) // 4}I", raw))) if len(raw) == 4 * self.header.entry_count else None

    def row(self) -> tuple:
        h = self.header
        stored = self.parts.read_at(h.checksum_pos, 16).hex() if h.has_checksum else None
        return (
            self.archive_id, self.path, self.parts.size, h.major, h.minor, format_uuid(h.uuid), h.entry_count, h.cluster_count, h.url_ptr_pos, h.title_idx_pos, h.cluster_ptr_pos,
            h.mime_list_pos, h.main_page, h.layout_page, h.checksum_pos, stored, h.has_checksum, h.new_namespace, self.titles() is not None, self.parts.multipart,
        )


def assemble(entries: list[Dirent], clusters: list[int], mimes: list[str], uuid: bytes, main_page: int | None) -> tuple[bytes, Header]:
    """All bytes ahead of the clusters, for clusters of the given sizes, and the header: entries must be sorted by
    (namespace, path)."""
    mime_bytes = encode_mime_list(mimes)
    url_pos = HEADER.size + len(mime_bytes)
    encoded = [d.encode() for d in entries]
    at = url_pos + 8 * len(entries)
    offsets = []
    for e in encoded:
        offsets.append(at)
        at += len(e)
    cluster_pos = at
    at += 8 * len(clusters)
    cluster_offsets = []
    for size in clusters:
        cluster_offsets.append(at)
        at += size
    header = Header(6, 1, uuid, len(entries), len(clusters), url_pos, None, cluster_pos, HEADER.size, main_page, None, at)
    return b"".join([header.encode(), mime_bytes, struct.pack(f"<{len(offsets)}Q", *offsets), *encoded, struct.pack(f"<{len(cluster_offsets)}Q", *cluster_offsets)]), replace(header)
