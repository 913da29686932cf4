"""Substring deduplication by sliding spans of consecutive sentences, long ones in pieces whose ends the words around them define."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stacklight.llm.common import fresh, table, written

#: A span is the shortest run of at least so many sentences that has at least so many words.
SENTENCES, WORDS = 2, 25
#: Sentences of more words are cut before each word that is the smallest, by a hash of it and the word before, among WINDOW
#: consecutive ones. A cut depends on the words around it alone, so a passage is cut alike wherever it begins: at most
#: WHOLE words at either end of a repeated run are cut in another way, and any run of WORDS + 2 * WHOLE words holds a span.
WHOLE, WINDOW = 12, 6
#: Documents whose repeats among each other are settled before the shuffle.
TOGETHER = 2000

_END = re.compile(rb"(?:[.!?]+[\x20\x09-\x0d]+|\xe3\x80\x82[\x20\x09-\x0d]*|\xef\xbc[\x81\x9f][\x20\x09-\x0d]*|[\x20\x09-\x0d]*\n[\x20\x09-\x0d]*)")
#: Characters of scripts without blanks: Chinese and Japanese, each a word; Thai, Lao, Burmese and Khmer, of which FOUR are one.
_HAN = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}|\xf0[\xa0-\xbf][\x80-\xbf]{2}")
_THAI = re.compile(rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1(?:[\x80-\x82]|[\x9e\x9f])[\x80-\xbf]")
_WIDE = re.compile(rb"[\xe0\xe1\xe3-\xe9\xf0]")
FOUR = 4

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_POWERS = np.ones(1, np.uint32)
_ODD, _ODD_INVERSE = 0x9E3779B1, pow(0x9E3779B1, -1, 1 << 32)


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts in bytes, quarters of a word) of the words."""
    raw = np.frombuffer(text, np.uint8)
    begins = ~_BLANK[raw]
    begins[1:] &= _BLANK[raw[:-1]]
    quarters = None
    if _WIDE.search(text):
        quarters = np.full(len(raw) + 1, FOUR, np.int8)
        solid = np.append(~_BLANK[raw], False)
        for kind, worth in ((_HAN, FOUR), (_THAI, 1)):
            for m in kind.finditer(text):
                begins[m.start()] = True
                quarters[m.start()] = worth
                if solid[m.end()]:
                    begins[m.end()] = True
    at = np.flatnonzero(begins)
    return at, np.full(len(at), FOUR, np.int64) if quarters is None else quarters[at].astype(np.int64)


def _powers(n: int) -> np.ndarray:
    """Rows of _ODD ** i and _ODD_INVERSE ** i."""
    global _POWERS
    if _POWERS.ndim == 1 or _POWERS.shape[1] < n:
        size = max(1 << 16, 2 * n)
        _POWERS = np.stack([np.cumprod(np.append(np.uint32(1), np.full(size - 1, x, np.uint32)), dtype=np.uint32) for x in (_ODD, _ODD_INVERSE)])
    return _POWERS


def _word_hashes(text: bytes, starts: np.ndarray) -> np.ndarray:
    """uint32 of each word; blanks and the case of A-Z do not count."""
    raw = np.frombuffer(text.lower(), np.uint8)
    powers = _powers(len(raw))
    sums = np.append(np.uint32(0), np.cumsum(np.where(_BLANK[raw], np.uint32(0), (raw + np.uint32(1)) * powers[0, : len(raw)]), dtype=np.uint32))
    h = (sums[np.append(starts[1:], len(raw))] - sums[starts]) * powers[1, starts]
    return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def _pieces(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ends in bytes, quarters of a word before each) of the sentences and the pieces of long ones."""
    ends = np.array([m.end() for m in _END.finditer(text)], np.int64)
    if len(text) and (not len(ends) or ends[-1] < len(text)):
        ends = np.append(ends, len(text))
    starts, quarters = _words(text)
    total = np.append(0, np.cumsum(quarters))
    to = np.searchsorted(starts, ends)  # words before each end
    length = np.diff(to, prepend=0)
    if (length > WHOLE).any():
        h = _word_hashes(text, starts)
        key = _mixed(np.append(np.uint32(0), h[:-1]) * np.uint32(0x2C1B3C6D) + h)
        sentence = np.repeat(np.arange(len(ends)), length)
        # a window holds no first word of a sentence, before which there is a cut anyway
        windows = np.lib.stride_tricks.sliding_window_view(key, WINDOW)
        least = windows.min(1)
        first = np.append(True, sentence[1:] != sentence[:-1])[: len(least)]
        whole = (length[sentence] > WHOLE)[: len(least)] & ~first & (sentence[: len(least)] == sentence[WINDOW - 1 :])
        cut = np.zeros(len(key), bool)
        for j in range(WINDOW):
            cut[j : j + len(least)] |= whole & (windows[:, j] == least)
        ends = np.union1d(ends, starts[cut])
        to = np.searchsorted(starts, ends)
    return ends, total[to]


def sentences(text: bytes) -> list[int]:
    """Ends of the sentences and of the pieces of long ones, in bytes; each takes the blanks after it, and together they are the whole text."""
    return _pieces(text)[0].tolist()


def spans(text: bytes, min_sentences: int = SENTENCES, min_words: int = WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, sentences, 128-bit hash) of the span that begins at each sentence. Blanks and the case of A-Z do not count."""
    ends, quarters = _pieces(text)
    before = np.append(0, quarters)
    to = np.maximum(np.searchsorted(before, before[:-1] + FOUR * min_words), np.arange(len(ends)) + min_sentences)
    if not len(to) or to[0] > len(ends):
        return
    lower, at, hashes = text.lower(), 0, []
    for end in ends.tolist():
        hashes.append(xxhash.xxh3_128_digest(b" ".join(lower[at:end].split())))
        at = end
    joined = b"".join(hashes)
    for i, (last, some) in enumerate(zip(to.tolist(), (before[1:] > before[:-1]).tolist())):
        if last > len(hashes):
            return
        if some:
            yield i, last - i, xxhash.xxh3_128_digest(joined[16 * i : 16 * last])


def _span_rows(min_sentences: int, min_words: int):
    """Of each span hash the first place among TOGETHER documents; runs of sentences that a later place covers are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                docs = sorted(zip(part.column("id").to_pylist(), part.column("th").to_pylist(), part.column("t").to_pylist()), key=lambda d: (d[0] is None, d[0] or 0, d[1]))
                first: dict[bytes, tuple] = {}
                rows: list[tuple] = []
                for doc_id, th, text in docs:
                    lo = hi = -1
                    for i, n, h in spans(text or b"", min_sentences, min_words):
                        if first.setdefault(h, here := (doc_id, th, i, n)) == here:
                            continue
                        if i > hi:
                            if hi > lo:
                                rows.append((hash((doc_id, lo)), th, doc_id, th, lo, hi - lo, True))
                            lo = i
                        hi = max(hi, i + n)
                    if hi > lo:
                        rows.append((hash((doc_id, lo)), th, doc_id, th, lo, hi - lo, True))
                keys = np.frombuffer(b"".join(first), "<i8").reshape(-1, 2)
                cols = [list(x) for x in zip(*first.values())] or [[]] * 4
                yield _rows(keys[:, 0], keys[:, 1], *cols, np.zeros(len(keys), bool))
                if rows:
                    yield _rows(*zip(*rows))

    return run


_NAMES = ["h1", "h2", "id", "th", "pos", "n", "settled"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
_SCHEMA = "h1 long, h2 long, id long, th long, pos int, n int, settled boolean"


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _cutter(text_at: int, gone_at: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, removed = [], [], []
            for text, gone in zip(b.column(text_at).cast(pa.large_binary()).to_pylist(), b.column(gone_at).to_pylist()):
                text = text or b""
                ends = [0, *sentences(text)]
                lost = np.zeros(len(ends) - 1, bool)
                for g in gone or ():
                    lost[g["pos"] : g["pos"] + g["n"]] = True
                total.append(len(lost))
                removed.append(int(lost.sum()))
                texts.append((text if not lost.any() else b"".join(text[s:e] for s, e, x in zip(ends, ends[1:], lost.tolist()) if not x)).decode())
            columns = [pa.array(texts, pa.string()) if k == text_at else c for k, c in enumerate(b.columns) if k != gone_at]
            names = [n for k, n in enumerate(b.schema.names) if k != gone_at]
            numbers = [pa.array(total, pa.int64()), pa.array(removed, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays([*columns, *numbers], [*names, *(["n_sentences", "n_removed"] if counts else [])])

    return run


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = SENTENCES, min_words: int = WORDS, counts: bool = True) -> DataFrame:
    """`docs` with text_col cut to the sentences that stay, and with n_sentences and n_removed in place of columns of these names (`counts`: else without).

    Sentences of more than WHOLE words are cut into pieces, which count as sentences here. The span that begins at a sentence is
    the shortest run of at least min_sentences sentences with min_words words; any run of min_words + 2 * WHOLE words holds one. Each
    occurrence of a span but the first, by id and place, loses its sentences. Repeats among a batch's documents are
    settled before the shuffle, so a passage that a third of all documents share sends one row for each batch.
    Null and empty texts have no sentences and become empty. Rows without an id yield to all others; equal rows are one
    document. Very long texts take time in proportion. Other columns are kept as they are; an empty table stays empty.
    """
    docs = docs.drop(*[c for c in ("n_sentences", "n_removed") if counts and c not in (id_col, text_col)])
    text, ids = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    rows = docs.select(ids.alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("t")).mapInArrow(_span_rows(min_sentences, min_words), _SCHEMA)
    w = Window.partitionBy("h1", "h2").orderBy("settled", F.col("id").asc_nulls_last(), "th", "pos")
    later = rows.withColumn("r", F.dense_rank().over(w)).where("settled or r > 1")
    gone = written(later.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "n")).alias("gone")), "spans")
    gone_id, gone_th, spans_ = fresh(docs, "gone_id", "gone_th", "gone")
    gone = gone.select(F.col("id").alias(gone_id), F.col("th").alias(gone_th), F.col("gone").alias(spans_))
    joined = docs.join(gone, ids.eqNullSafe(F.col(gone_id)) & (F.xxhash64(text) == F.col(gone_th)), "left").drop(gone_id, gone_th)
    more = [("n_sentences", "bigint"), ("n_removed", "bigint")] if counts else []
    schema = ", ".join(f"`{n}` {t}" for n, t in [*docs.dtypes, *more])
    return joined.mapInArrow(_cutter(docs.columns.index(text_col), len(docs.columns), counts), schema)


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text")
