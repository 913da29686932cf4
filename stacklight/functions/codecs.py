"""Compression of binary columns, value by value: a worker holds a few values at a time, not an Arrow batch of thousands with what is made of them."""

from __future__ import annotations

import lzma

import xxhash
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a frame begins with, and a frame that holds no content (its lowest four bits are free); bytes that are handed to the decoder at once.
MAGIC, SKIPPED, STEP = 0xFD2FB528, 0x184D2A50, 4096
LEVELS = {"fastest": 1, "default": 3, "better": 7, "best": 19}


def _each(f, kind: str = "binary"):
    return F.udf(lambda x: None if x is None else f(bytes(x)), kind, useArrow=False)


def zstd_compress(data: Column, level: str | int = "default", checksum: bool = False, dictionary: bytes | None = None) -> Column:
    n = LEVELS[level] if isinstance(level, str) else level

    def one(x: bytes) -> bytes:
        more = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        return zstandard.ZstdCompressor(level=n, write_checksum=checksum, **more).compress(x)

    return _each(one)(data)


def is_zstd(data: bytes) -> bool:
    """Whether a frame begins here."""
    number = int.from_bytes(data[:4], "little")
    return number == MAGIC or number & ~15 == SKIPPED


def inflate(data: bytes, most: int = 1 << 30, dictionary: bytes | None = None, trailing: bool = False) -> bytes:
    """The content of all frames, one after the other, at most `most` bytes: input is taken in small steps, and the limit holds after each.
    A frame that is cut short is an error, and so are other bytes behind the last one, unless `trailing` allows them."""
    more = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    parts, size, at = [], 0, 0
    while at < len(data) or not at:
        frame = zstandard.ZstdDecompressor(**more).decompressobj()
        while not frame.eof:
            if at >= len(data):
                raise ValueError("a zstd frame is cut short")
            parts.append(frame.decompress(data[at : at + STEP]))
            size, at = size + len(parts[-1]), at + STEP
            if size > most:
                raise ValueError(f"more than {most} bytes")
        at = min(at, len(data)) - len(frame.unused_data)
        if trailing and not is_zstd(data[at : at + 4]):
            break
    return b"".join(parts)


def zstd_decompress(data: Column, most: int = 1 << 30, dictionary: bytes | None = None) -> Column:
    """All frames of a value, with or without a stated size; see inflate()."""
    return _each(lambda x: inflate(x, most, dictionary))(data)


def zstd_content_size(data: Column) -> Column:
    """The size that a frame's header states, -1 if none."""

    def one(x: bytes) -> int:
        size = zstandard.get_frame_parameters(x).content_size
        return -1 if size == zstandard.CONTENTSIZE_UNKNOWN else size

    return _each(one, "long")(data)


def dictionary_id(data: Column) -> Column:
    """The number of the dictionary that a frame asks for, 0 if none."""
    return _each(lambda x: zstandard.get_frame_parameters(x).dict_id, "long")(data)


def train_dictionary(samples: list[bytes], size: int = 16 << 10) -> bytes:
    return zstandard.train_dictionary(size, samples).as_bytes()


def xz_compress(data: Column, preset: int = 6, check: int = lzma.CHECK_CRC64) -> Column:
    return _each(lambda x: lzma.compress(x, lzma.FORMAT_XZ, check, preset))(data)


def xz_decompress(data: Column) -> Column:
    return _each(lambda x: lzma.decompress(x, lzma.FORMAT_XZ))(data)


def lzma_compress(data: Column, preset: int = 6) -> Column:
    return _each(lambda x: lzma.compress(x, lzma.FORMAT_ALONE, preset=preset))(data)


def lzma_decompress(data: Column) -> Column:
    return _each(lambda x: lzma.decompress(x, lzma.FORMAT_ALONE))(data)


_LZMA2 = [{"id": lzma.FILTER_LZMA2, "preset": 6}]


def lzma2_compress(data: Column) -> Column:
    return _each(lambda x: lzma.compress(x, lzma.FORMAT_RAW, filters=_LZMA2))(data)


def lzma2_decompress(data: Column) -> Column:
    return _each(lambda x: lzma.decompress(x, lzma.FORMAT_RAW, filters=_LZMA2))(data)


def xxh64(data: Column, seed: int = 0) -> Column:
    """XXH64 as hex; Spark's own xxhash64() has the seed 42."""
    return _each(lambda x: f"{xxhash.xxh64_intdigest(x, seed):016x}", "string")(data)
