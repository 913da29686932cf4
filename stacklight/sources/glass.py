"""The search database that archives may embed: number and string packings, posting chunks, blocks, version header, and the
whole database as tables.

Keys of the postlist table hold four logical tables: term chunks, values (0x00 0xD8), metadata (0x00 0x00) and document
lengths (0x00 0xE0). Trees are written in one pass from sorted rows; reading scans all leaves.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, DIRECTORY, CHUNK = 8192, 11, 2000
#: From so many postings, or bytes, on, numbers are packed all at once.
MANY = 32
MAGIC = b"\x0f\x0dXapian Glass"
FORMAT = 0x046E
#: The tables in the order of their root records, and from how many bytes on their tags are compressed (0: never).
TABLES = {"postlist": 0, "docdata": 18, "termlist": 18, "position": 0, "spelling": 18, "synonym": 18}
COMPRESSED, LAST, FIRST = 0x8000, 0x4000, 0x2000
VALUES, METADATA, LENGTHS = b"\x00\xd8", b"\x00\x00", b"\x00\xe0"


class GlassError(ValueError):
    """Bytes that are no such database."""


def pack_uint(n: int) -> bytes:
    """Seven bits to a byte, lowest first, the high bit set on all but the last."""
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def unpack_uint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, the place behind it)."""
    value = shift = 0
    while at < len(data) and shift < 64:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at
    raise GlassError("number is cut short or too long")


def pack_uints(numbers: np.ndarray) -> bytes:
    """pack_uint() of each number, all under 2**56, in a row."""
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 8):
        size += numbers >= 1 << 7 * k
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    more = (place < np.repeat(size, size) - 1) << 7
    return (np.repeat(numbers, size) >> 7 * place & 127 | more).astype(np.uint8).tobytes()


def unpack_uints(data: bytes) -> np.ndarray | None:
    """The numbers that fill `data`; None if one is cut short or has over eight bytes."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if not len(ends) or ends[-1] != len(raw) - 1:
        return None
    starts = np.concatenate([[0], ends[:-1] + 1])
    if (ends - starts).max() >= 8:
        return None
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts)


def pack_uint_sorted(n: int) -> bytes:
    """2 to 9 bytes whose order is that of the numbers: as many leading ones as there are bytes beyond two, a zero, the number."""
    for size in range(2, 9):
        if n < 1 << (7 * size + 1):
            ones = size - 2
            return (((1 << ones) - 1) << (8 * size - ones) | n).to_bytes(size, "big")
    return b"\xfe" + n.to_bytes(8, "big")


def unpack_uint_sorted(data: bytes, at: int = 0) -> tuple[int, int]:
    if len(data) - at < 2:
        raise GlassError("sorted number is cut short")
    ones = 8 - (data[at] ^ 255).bit_length()
    size = min(ones, 7) + 2
    if len(data) - at < size:
        raise GlassError("sorted number is cut short")
    raw = int.from_bytes(data[at : at + size], "big")
    return raw & ((1 << (64 if size == 9 else 7 * size + 1)) - 1), at + size


def pack_string_sorted(s: bytes, end: bool = True) -> bytes:
    return s.replace(b"\0", b"\0\xff") + (b"\0" if end else b"")


def unpack_string_sorted(data: bytes, at: int = 0) -> tuple[bytes, int]:
    out = bytearray()
    while at < len(data):
        if data[at] == 0:
            if data[at + 1 : at + 2] != b"\xff":
                return bytes(out), at + 1
            at += 1
            out.append(0)
        else:
            out.append(data[at])
        at += 1
    return bytes(out), at


def encode_chunk(postings: list[tuple[int, int]], last: bool, totals: tuple[int, int] | None = None) -> bytes:
    """A chunk of (document, count) pairs by ascending document. The first chunk of a term has its totals, documents and
    count, and leaves the first count to be found from them; a later one states its first count."""
    first = postings[0][0]
    head = pack_uint(totals[0]) + pack_uint(totals[1]) + pack_uint(first - 1) if totals else b""
    body = [head, b"\1" if last else b"\0", pack_uint(postings[-1][0] - first)]
    if not totals:
        body.append(pack_uint(postings[0][1]))
    if len(postings) >= MANY and postings[-1][0] < 1 << 56 and max(n for _, n in postings) < 1 << 56:
        both = np.array(postings, np.int64)
        return b"".join(body) + pack_uints(np.column_stack([np.diff(both[:, 0]) - 1, both[1:, 1]]).ravel())
    for (before, _), (doc, n) in zip(postings, postings[1:]):
        body += [pack_uint(doc - before - 1), pack_uint(n)]
    return b"".join(body)


def decode_chunk(data: bytes, first: int | None = None, rest: int | None = None) -> tuple[list[tuple[int, int]], bool, tuple[int, int] | None]:
    """(pairs, whether it is the last, totals). first: of a later chunk, its first document, from its key."""
    totals, at = None, 0
    if first is None:
        docs, at = unpack_uint(data)
        count, at = unpack_uint(data, at)
        first, at = unpack_uint(data, at)
        first, totals = first + 1, (docs, count)
    if at >= len(data):
        raise GlassError("chunk is cut short")
    last = data[at] != 0
    _, at = unpack_uint(data, at + 1)
    head = None
    if totals is None:
        head, at = unpack_uint(data, at)
    pairs, doc = [], first
    many = unpack_uints(data[at:]) if len(data) - at >= MANY else None
    if many is not None and len(many) % 2 == 0:
        pairs, at = list(zip((doc + np.cumsum(many[::2] + 1)).tolist(), many[1::2].tolist())), len(data)
    while at < len(data):
        step, at = unpack_uint(data, at)
        n, at = unpack_uint(data, at)
        doc += step + 1
        pairs.append((doc, n))
    if head is None:
        head = totals[1] - sum(n for _, n in pairs) - (rest or 0)
    return [(first, head), *pairs], last, totals


def term_chunks(term: bytes, postings: list[tuple[int, int]], most: int = CHUNK) -> Iterator[tuple[bytes, bytes]]:
    """(key, tag) of a term's posting list, in chunks of about `most` bytes."""
    groups, size = [[]], 0
    for p in sorted(postings):
        cost = 3 if p[1] < 128 else 2 + len(pack_uint(p[1]))
        if groups[-1] and size + cost > most:
            groups.append([])
            size = 0
        groups[-1].append(p)
        size += cost
    totals = (len(postings), sum(n for _, n in postings))
    for k, g in enumerate(groups):
        key = pack_string_sorted(term) + (pack_uint_sorted(g[0][0]) if k else b"")
        yield key, encode_chunk(g, k == len(groups) - 1, totals if k == 0 else None)


def read_postings(rows: Iterable[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, int, int]]:
    """(term, document, count) from the term rows of a postlist table in key order."""
    split = lambda r: unpack_string_sorted(r[0])
    for term, chunks in groupby(rows, lambda r: split(r)[0]):
        head, later = None, []
        for key, tag in chunks:
            at = split((key, tag))[1]
            if at >= len(key):
                head = tag
            else:
                later += decode_chunk(tag, unpack_uint_sorted(key, at)[0])[0]
        if head is not None:
            yield from ((term, d, n) for d, n in decode_chunk(head, rest=sum(n for _, n in later))[0])
        yield from ((term, d, n) for d, n in later)


def parse_values_map(text: str) -> dict[str, int]:
    """`name:slot;..`; parts without a slot number are left out."""
    pairs = (p.split(":", 1) for p in text.split(";") if ":" in p)
    return {name: int(slot) for name, slot in pairs if slot.isdecimal() and int(slot) < 1 << 32}


def format_values_map(slots: dict[str, int]) -> str:
    return ";".join(f"{k}:{v}" for k, v in sorted(slots.items(), key=lambda x: x[1]))


def encode_block(items: list[bytes], level: int, revision: int = 1) -> bytes:
    """A block whose items lie at its end, the last in front; the directory lists where they begin."""
    out, at, where = bytearray(BLOCK), BLOCK, []
    for item in items:
        at -= len(item)
        out[at : at + len(item)] = item
        where.append(at)
    end = DIRECTORY + 2 * len(items)
    if at < end:
        raise GlassError("items exceed the block")
    struct.pack_into(f">IBHHH{len(where)}H", out, 0, revision, level, at - end, at - end, end, *where)
    return bytes(out)


def leaf_items(block: bytes) -> tuple[int, list[tuple[bytes, bytes, int, int]]]:
    """(level, [(key, tag, flags, component)]) of a block; items of branches have no tag but their block's number."""
    if len(block) < DIRECTORY:
        raise GlassError("block too short")
    _, level, _, _, end = struct.unpack_from(">IBHHH", block)
    if end > len(block) or end and end < DIRECTORY:
        raise GlassError("directory exceeds the block")
    out = []
    for at in struct.unpack_from(f">{max(0, end - DIRECTORY) // 2}H", block, DIRECTORY):
        if at < DIRECTORY or at + 3 > len(block):
            raise GlassError("item outside the block")
        if level:
            number, n = struct.unpack_from(">IB", block, at)
            out.append((block[at + 5 : at + 5 + n], struct.pack(">I", number), 0, 0))
            continue
        head, n = struct.unpack_from(">HB", block, at)
        stop = at + (head & 0x1FFF) + 3
        here = at + 3 + n
        if stop > len(block) or here > stop:
            raise GlassError("item exceeds the block")
        component = 0
        if not head & FIRST:
            component = struct.unpack_from(">H", block, here)[0]
            here += 2
        out.append((block[at + 3 : at + 3 + n], block[here:stop], head & 0xE000, component))
    return level, out


@dataclass
class Root:
    block: int = 0
    level: int = 0
    entries: int = 0
    block_size: int = BLOCK
    compress_min: int = 0
    free: bytes = b""


@dataclass
class Version:
    uuid: bytes = bytes(16)
    revision: int = 1
    roots: list[Root] = field(default_factory=lambda: [Root(compress_min=c) for c in TABLES.values()])
    #: documents, last id, shortest, largest count, longest, oldest changeset, total length, spelling bound
    stats: list[int] = field(default_factory=lambda: [0] * 8)

    def encode(self) -> bytes:
        out = [MAGIC, struct.pack("<H", FORMAT), self.uuid, pack_uint(self.revision)]
        for r in self.roots:
            out += [*map(pack_uint, (r.block, r.level << 2, r.entries, r.block_size >> 11, r.compress_min, len(r.free))), r.free]
        return b"".join([*out, *map(pack_uint, self.stats)])

    @classmethod
    def parse(cls, data: bytes) -> tuple[Version, int]:
        """(header, its length)."""
        start = len(MAGIC) + 2
        if len(data) < start + 16 or not data.startswith(MAGIC):
            raise GlassError("no version header")
        revision, at = unpack_uint(data, start + 16)
        roots = []
        for _ in TABLES:
            numbers = []
            for _ in range(6):
                v, at = unpack_uint(data, at)
                numbers.append(v)
            free, at = data[at : at + numbers[5]], at + numbers[5]
            roots.append(Root(numbers[0], numbers[1] >> 2, numbers[2], numbers[3] << 11, numbers[4], free))
        stats = []
        for _ in range(8):
            v, at = unpack_uint(data, at)
            stats.append(v)
        return cls(data[start : start + 16], revision, roots, stats), at


def build_table(rows: Iterable[tuple[bytes, bytes]], compress_min: int) -> tuple[bytes, Root]:
    """Blocks of a tree over (key, tag) rows in key order: leaves from block 1 on, then each level above, the root last.
    Tags that would fill over a quarter of a block are cut into components."""
    most = (BLOCK - DIRECTORY) // 4 - 2
    blocks, entries = [bytes(BLOCK)], 0

    def flush(items: list[bytes], level: int) -> int:
        blocks.append(encode_block(items, level))
        return len(blocks) - 1

    def level_of(items: Iterable[tuple[bytes, bytes]], level: int) -> list[tuple[bytes, int]]:
        above, held, first, size = [], [], b"", DIRECTORY
        for key, item in items:
            if held and size + len(item) + 2 > BLOCK:
                above.append((first, flush(held, level)))
                held, size = [], DIRECTORY
            if not held:
                first = key
            held.append(item)
            size += len(item) + 2
        if held:
            above.append((first, flush(held, level)))
        return above

    def leaves() -> Iterator[tuple[bytes, bytes]]:
        nonlocal entries
        for key, tag in rows:
            entries += 1
            squeezed = zlib.compress(tag) if compress_min and len(tag) >= compress_min else tag
            flag = COMPRESSED if len(squeezed) < len(tag) else 0
            tag = squeezed if flag else tag
            room = most - 5 - len(key)
            parts = [tag[k : k + room] for k in range(0, len(tag), room)] or [b""]
            for k, part in enumerate(parts):
                flags = flag | (FIRST if k == 0 else 0) | (LAST if k == len(parts) - 1 else 0)
                body = bytes([len(key)]) + key + (struct.pack(">H", k + 1) if k else b"") + part
                yield key, struct.pack(">H", flags | len(body) - 1) + body

    above, level = level_of(leaves(), 0), 0
    if not above:
        return b"", Root(compress_min=compress_min)
    while len(above) > 1:
        level += 1
        above = level_of(((k, struct.pack(">IB", n, len(k)) + k + struct.pack(">H", 1)) for k, n in above), level)
    return b"".join(blocks), Root(above[0][1], level, entries, BLOCK, compress_min)


def scan_table(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, tag) of all leaves, by key; components are joined and tags decompressed."""
    found: list[tuple[bytes, int, bytes, int]] = []
    for at in range(BLOCK, len(data) - BLOCK + 1, BLOCK):
        level, items = leaf_items(data[at : at + BLOCK])
        if level == 0:
            found += [(k, c or 1, t, f) for k, t, f, c in items]
    found.sort(key=lambda x: x[:2])
    for key, parts in groupby(found, lambda x: x[0]):
        parts = list(parts)
        tag = b"".join(p[2] for p in parts)
        yield key, zlib.decompress(tag) if parts[0][3] & COMPRESSED else tag


def build_database(postings: Iterable[tuple[str, int, int]], docdata: dict[int, str], values: Iterable[tuple[int, int, str]] = (), metadata: dict[str, str] | None = None, uuid: bytes = bytes(16)) -> bytes:
    """A database of postings (term, document, count), data by document, values (slot, document, text) and metadata."""
    by_term: dict[bytes, list] = {}
    total, largest, lengths = 0, 0, dict.fromkeys(docdata, 0)
    for term, doc, n in postings:
        by_term.setdefault(term.encode(), []).append((doc, n))
        total, largest = total + n, max(largest, n)
        lengths[doc] = lengths.get(doc, 0) + n
    rows = [row for t, ps in by_term.items() for row in term_chunks(t, ps)]
    rows += [(VALUES + pack_uint(s) + pack_uint_sorted(d), pack_uint(0) + pack_uint(1) + v.encode()) for s, d, v in values]
    rows += [(METADATA + k.encode(), v.encode()) for k, v in (metadata or {}).items()]
    post, post_root = build_table(sorted(rows), TABLES["postlist"])
    docs, docs_root = build_table(sorted((pack_uint_sorted(d), v.encode()) for d, v in docdata.items()), TABLES["docdata"])
    version = Version(uuid)
    version.roots[0], version.roots[1] = post_root, docs_root
    version.stats = [len(lengths), max(lengths, default=0), min(lengths.values(), default=0), largest, max(lengths.values(), default=0), 0, total, 0]
    return version.encode() + post + docs


@dataclass
class Database:
    version: Version
    postings: list[tuple[str, int, int]]
    docdata: list[tuple[int, str]]
    values: list[tuple[int, int, str]]
    metadata: list[tuple[str, str]]


def open_database(data: bytes) -> Database:
    version, at = Version.parse(data)
    post_size = (version.roots[0].block + 1) * BLOCK if version.roots[0].block else 0
    docs_size = (version.roots[1].block + 1) * BLOCK if version.roots[1].block else 0
    terms, values, metadata = [], [], []
    for key, tag in scan_table(data[at : at + post_size]):
        if key.startswith(VALUES):
            slot, here = unpack_uint(key, 2)
            _, start = unpack_uint(tag)
            _, start = unpack_uint(tag, start)
            values.append((slot, unpack_uint_sorted(key, here)[0], tag[start:].decode()))
        elif key.startswith(METADATA):
            metadata.append((key[2:].decode(), tag.decode()))
        elif not key.startswith(LENGTHS):
            terms.append((key, tag))
    docs = [(unpack_uint_sorted(k)[0], t.decode()) for k, t in scan_table(data[at + post_size : at + post_size + docs_size])]
    return Database(version, [(t.decode(), d, n) for t, d, n in read_postings(terms)], docs, values, metadata)


SCHEMAS = {
    "postings": "archive_id string, term string, doc_id bigint, wdf bigint",
    "docdata": "archive_id string, doc_id bigint, data string",
    "values": "archive_id string, slot int, doc_id bigint, value string",
    "metadata": "archive_id string, key string, value string",
    "version": "archive_id string, uuid string, revision bigint, doc_count bigint, last_doc_id bigint, total_doc_len bigint",
}


def embedded(entries: DataFrame, blobs: DataFrame, path: str = "fulltext/xapian") -> DataFrame:
    """(archive_id, data) of the databases that archives hold under X/path."""
    at = entries.where((F.col("namespace") == "X") & (F.col("path") == path) & (F.col("entry_type") == "content")).select("archive_id", "cluster", "blob")
    return at.join(blobs, ["archive_id", "cluster", "blob"]).select("archive_id", "data")


def table(blobs: DataFrame, name: str) -> DataFrame:
    """One of SCHEMAS' tables from rows (archive_id, data) of embedded databases; each is read by one task."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        for b in batches:
            for archive, data in zip(b["archive_id"], b["data"]):
                db = open_database(bytes(data))
                if name == "version":
                    s = db.version.stats
                    rows = [(db.version.uuid.hex(), db.version.revision, s[0], s[1], s[6])]
                else:
                    rows = getattr(db, name)
                yield pd.DataFrame([(archive, *r) for r in rows], columns=columns)

    return blobs.select("archive_id", "data").mapInPandas(run, SCHEMAS[name])


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("term_freq"), F.sum("wdf").alias("coll_freq"))


def _frames(rows: Iterable[tuple], columns: list[str], most: int = 10_000) -> Iterator[pd.DataFrame]:
    rows = iter(rows)
    while part := list(islice(rows, most)):
        yield pd.DataFrame(dict(zip(columns, map(list, zip(*part)))))


def encoded_postings(postings: DataFrame) -> DataFrame:
    """(key, tag) rows of the posting lists of `postings` (term, doc_id, wdf): terms are encoded where the shuffle brings their
    postings together, one list at a time."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = (r for b in batches for r in zip(b["term"], b["doc_id"].tolist(), b["wdf"].tolist()))
        chunks = (c for t, rows in groupby(flat, lambda r: r[0]) for c in term_chunks(t.encode(), [r[1:] for r in rows]))
        return _frames(chunks, ["key", "tag"])

    return postings.select("term", "doc_id", "wdf").repartition("term").sortWithinPartitions("term", "doc_id").mapInPandas(run, "key binary, tag binary")


def decoded_postings(rows: DataFrame) -> DataFrame:
    """(term, doc_id, wdf) of encoded_postings() rows."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = ((bytes(k), bytes(t)) for b in batches for k, t in zip(b["key"], b["tag"]))
        return _frames(((t.decode(), d, n) for t, d, n in read_postings(flat)), ["term", "doc_id", "wdf"])

    # a key's term ends at its first zero byte that no 0xFF follows
    ends = F.regexp_extract(F.hex("key"), "^((?:..)*?)00(?!FF)", 1)
    return rows.select(ends.alias("of"), "key", "tag").repartition("of").sortWithinPartitions("key").drop("of").mapInPandas(run, "term string, doc_id bigint, wdf bigint")
