"""Byte-level BPE: each distinct word of the corpus is encoded once, and its ids are joined back by position."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.llm import vocab
from stacklight.llm.common import table

#: A chunk of documents has about so many characters; a block of one so many documents.
CHUNK, BLOCK = 32_000_000, 256
#: Words of a chunk that get short codes, the most frequent first: 128 of one byte, the others of two.
SHORT = 128 + (1 << 14)
#: Words travel in so many groups for each shuffle partition; a task holds one group's distinct words at a time.
GROUPS = 8
_WORDS, _TOP, _DOCS = 0, 1, 2
_MOVED = "key long, chunk long, kind int, part long, n long, body binary"


def _row(*columns: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "chunk", "kind", "part", "n", "body"])


def _joined(parts: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, parts), "<u4", len(parts))
    return zstandard.ZstdCompressor(level=6).compress(len(parts).to_bytes(4, "little") + lengths.tobytes() + b"".join(parts))


def _parted(body: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()
    at = 4 + 4 * n
    return [raw[at + s : at + e] for s, e in zip([0, *ends], ends)]


def pack_codes(codes: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: 1 byte for codes under 128, 2 for those under SHORT, else 4."""
    two, four = (codes >= 128) & (codes < SHORT), codes >= SHORT
    c2, c4 = np.where(two, codes - 128, 0), np.where(four, codes - SHORT, 0)
    lead = np.where(two, 128 | c2 >> 8, np.where(four, 192 | c4 >> 24, codes)).astype(np.uint8)
    rest = [(c4[four] >> 8 * k & 255).astype(np.uint8).tobytes() for k in (2, 1, 0)]
    return b"".join([lead.tobytes(), (c2[two] & 255).astype(np.uint8).tobytes(), *rest])


def unpack_codes(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    out = raw[:n].copy()
    two, four = (out >= 128) & (out < 192), out >= 192
    at = n + int(two.sum())
    out[two] = ((out[two] & 63) << 8 | raw[n:at]) + 128
    value = (out[four] & 63) << 24
    for k in (2, 1, 0):
        value |= raw[at : at + len(value)] << 8 * k
        at += len(value)
    out[four] = value + SHORT
    return out


def _split(groups: int, pattern: str):
    """Rows of each chunk: its distinct words by group, the short codes, and its documents as codes of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        task, serial = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        texts: list[str] = []
        held = 0
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist()):
                ids.append(i)
                texts.append(t or "")
                held += len(texts[-1])
                if held >= CHUNK:
                    yield from _chunk(task + serial, ids, texts, find, groups)
                    ids, texts, held, serial = [], [], 0, serial + 1
        if ids:
            yield from _chunk(task + serial, ids, texts, find, groups)

    return run


def _chunk(chunk: int, ids: list, texts: list[str], find, groups: int) -> Iterator[pa.RecordBatch]:
    number: dict[str, int] = {}
    docs: list[np.ndarray] = []
    for t in texts:
        found = find(t)
        docs.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
    words = [w.encode() for w in number]
    group = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % groups
    # words are numbered anew: by group, and sorted within, which packs them better
    groupwise = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(group[groupwise]) != 0)) if len(words) else np.empty(0, np.int64)
    order = np.array([k for part in np.split(groupwise, cuts[1:]) for k in sorted(part.tolist(), key=words.__getitem__)], np.int64)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    times = np.zeros(len(words), np.int64)
    for d in docs:
        times += np.bincount(d, minlength=len(words)) if len(d) * 8 > len(words) else 0
        if len(d) * 8 <= len(words):
            np.add.at(times, d, 1)
    top = np.argsort(-times, kind="stable")[: min(SHORT, len(words))]
    code = place + SHORT
    code[top] = np.arange(len(top))
    out: list[list] = [[], [], [], [], [], []]

    def put(*row) -> None:
        for column, v in zip(out, row):
            column.append(v)

    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(words)]):
        put(int(group[order[s]]), chunk, _WORDS, int(group[order[s]]), int(e - s), _joined([words[k] for k in order[s:e]]))
    # what need not be encoded goes anywhere: the key spreads it
    put(chunk * 31 % groups, chunk, _TOP, len(words), 0, place[top].astype("<u4").tobytes())
    squeeze = zstandard.ZstdCompressor(level=9).compress
    for at in range(0, len(ids), BLOCK):
        part = docs[at : at + BLOCK]
        codes = code[np.concatenate(part)] if part else np.empty(0, np.int64)
        packed = pack_codes(codes)
        known = np.array([i is not None for i in ids[at : at + BLOCK]], "u1")
        head = np.array([i or 0 for i in ids[at : at + BLOCK]], "<i8").tobytes() + np.array([len(d) for d in part], "<i8").tobytes() + known.tobytes()
        put((chunk * 31 + at) % groups, chunk, _DOCS, at, len(part), squeeze(head + packed))
    yield _row(*out)


def _encode(shipped: Broadcast):
    """Word groups become their ids; each distinct word of a group is encoded once. Other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, width = vocab.encoding(shipped)._encode_single_piece, _width(shipped)
        now, known = None, {}
        for b in batches:
            bodies = b.column("body").to_pylist()
            for k, (key, kind) in enumerate(zip(b.column("key").to_pylist(), b.column("kind").to_pylist())):
                if kind == _WORDS:
                    if key != now:
                        now, known = key, {}
                    parts = []
                    for w in _parted(bodies[k]):
                        ids = known.get(w)
                        if ids is None:
                            ids = known[w] = np.array(one(w), width).tobytes()
                        parts.append(ids)
                    bodies[k] = _joined(parts)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bodies, pa.binary())], b.schema.names)

    return run


def _width(shipped: Broadcast) -> str:
    return "<u2" if max(shipped.value[0].values()) < 1 << 16 else "<u4"


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces `at` of flat (piece k: lengths[k] items from starts[k]), joined, and the pieces' ends."""
    n = lengths[at]
    ends = np.cumsum(n)
    index = np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    return flat[index], ends


def _assemble(shipped: Broadcast):
    """(id, ids) of each document, from its chunk's encoded words (which come first), short codes and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(_width(shipped))
        chunk, parts, flat, starts, lengths, top = None, [], None, None, None, None
        for b in batches:
            for c, kind, part, n, body in zip(*(b.column(x).to_pylist() for x in ("chunk", "kind", "part", "n", "body"))):
                if c != chunk:
                    chunk, parts, flat = c, [], None
                if kind == _WORDS:
                    parts.append(_parted(body))
                elif kind == _TOP:
                    words = list(chain.from_iterable(parts))
                    if len(words) != part:
                        raise ValueError("a chunk's words are not all there")
                    lengths = np.fromiter(map(len, words), np.int64, len(words)) // width.itemsize
                    starts = np.cumsum(lengths) - lengths
                    flat, top, parts = np.frombuffer(b"".join(words), width).astype(np.int32), np.frombuffer(body, "<u4").astype(np.int64), []
                else:
                    raw = zstandard.ZstdDecompressor().decompress(body)
                    count = np.frombuffer(raw, "<i8", n, 8 * n)
                    codes = unpack_codes(raw[17 * n :], int(count.sum())) if count.sum() else np.empty(0, np.int64)
                    place = np.where(codes < SHORT, top[np.minimum(codes, len(top) - 1)], codes - SHORT) if len(codes) else codes
                    ids, ends = _gather(flat, starts, lengths, place)
                    offsets = np.append(0, np.append(0, ends)[np.cumsum(count)]).astype(np.int32)
                    known = np.frombuffer(raw, "u1", n, 16 * n).astype(bool)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, "<i8", n), pa.int64(), mask=~known), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["id", "ids"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id_col, ids array<int>) of each row of `docs`; a null text is empty and has no ids.

    Texts are split into words by `pattern`; of each chunk of documents the distinct words go, in groups by a hash, to the
    tasks that encode every distinct word of the corpus once; their ids come back to the chunk, where the documents' words
    are looked up by position. A chunk has about CHUNK characters or one longer text; a very frequent word sends one row
    for each chunk. Rows that repeat an id, or have none, keep their row. Other columns are not read.
    """
    spark = docs.sparkSession
    shipped = vocab.ship(spark, path)
    groups = GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    moved = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(_split(groups, pattern), _MOVED)
    encoded = moved.repartition("key").sortWithinPartitions("key").mapInArrow(_encode(shipped), _MOVED).drop("key")
    whole = encoded.repartition("chunk").sortWithinPartitions("chunk", "kind", "part")
    return whole.mapInArrow(_assemble(shipped), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`encoded` with out_col (binary): the bytes of its ids, joined from the token-byte table, which is as large as the vocabulary."""
    shipped = vocab.ship(encoded.sparkSession, path)
    at = encoded.columns.index(ids_col)
    schema = ", ".join(f"`{n}` {t}" for n, t in [*encoded.dtypes, (out_col, "binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [b""] * (max(shipped.value[0].values()) + 1)
        for t, i in shipped.value[0].items():
            tokens[i] = t
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(tokens), np.uint8)
        for whole in batches:
            for row in range(0, whole.num_rows, BLOCK):
                b = whole.slice(row, BLOCK)
                lists = b.column(at)
                data, ends = _gather(flat, starts, lengths, lists.flatten().to_numpy().astype(np.int64))
                count = np.nan_to_num(np.array(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), float)).astype(np.int64)
                offsets = np.append(0, np.append(0, ends)[np.cumsum(count)]).astype(np.int64)
                out = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*b.columns, out.cast(pa.binary())], [*b.schema.names, out_col])

    return encoded.mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
