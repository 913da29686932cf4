"""Best-fit packing of token pieces into sequences, certified by dual-feasible lower bounds and repacked where there are gaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stacklight.llm import vocab
from stacklight.llm.common import fresh, table, written

CAPACITY = 2048
#: Pieces that one task packs, about; rounds of exchange at most; empty tokens that a closed sequence may have before the last round.
PER_TASK, ROUNDS, SLACK = 50_000, 6, 0
#: Share of one sequence that a certified partition may leave empty in all without others getting it.
TRIFLE = 0.02


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each row's token ids, the id `end` last. Ids over `capacity` are cut so that
    only the first piece is shorter. Null texts are empty. The file's special tokens are taken out of a text first, as its library does."""
    shipped = vocab.ship(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocab.encoding(shipped)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*enc.encode(text or "", allowed_special="all"), end], "<u4")
                at, to, k = 0, len(ids) % capacity or min(capacity, len(ids)), 0
                while at < len(ids):
                    for column, v in zip(out, (i, k, at, to - at, zlib.crc32(ids[at:to].tobytes()))):
                        column.append(v)
                    at, to, k = to, to + capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing: the bin of each item. Open bins lie in stacks by the room they have left; the bits of `room`
    tell which stacks have any, so the best fit is the lowest bit from the item's length on."""
    bins = np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    room = used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := room >> n:
            left = n + (fits & -fits).bit_length() - 1
            k = stacks[left].pop()
            if not stacks[left]:
                room &= ~(1 << left)
        else:
            left, k, used = capacity, used, used + 1
        bins[i] = k
        if left := left - n:
            stacks[left].append(k)
            room |= 1 << left
    return bins


def filled(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item when each bin takes the longest item left and then the lengths whose sum comes closest to the room,
    longer ones first. Bits of `reach` are the sums that can be had; its values before each length tell which were used."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths.tolist()):
        stacks[n].append(i)
    left = sum(1 << n for n, s in enumerate(stacks) if s)
    bins, k = np.empty(len(lengths), np.int64), 0

    def take(n: int) -> None:
        nonlocal left
        bins[stacks[n].pop()] = k
        if not stacks[n]:
            left ^= 1 << n

    while left:
        n = left.bit_length() - 1
        take(n)
        room = capacity - n
        all_ = (1 << (room + 1)) - 1
        reach, steps, sizes = 1, [], left & all_
        while sizes and not reach >> room & 1:
            n = sizes.bit_length() - 1
            sizes ^= 1 << n
            for _ in range(min(len(stacks[n]), room // n)):
                more = (reach | reach << n) & all_
                if more == reach:
                    break
                steps.append((n, reach))
                reach = more
        want = reach.bit_length() - 1
        for n, before in reversed(steps):
            if not before >> want & 1:
                take(n)
                want -= n
        k += 1
    return bins


def repacked(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing; where it misses the lower bound, filled() too, and the better of both."""
    best = best_fit(lengths, capacity)
    if not len(best) or best.max() + 1 <= lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity):
        return best
    again = filled(lengths, capacity)
    return again if again.max() < best.max() else best


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that items need at least; counts[x]: items of length x. The largest bound of two families of dual-feasible
    functions: thresholds (large items count as a whole bin, small ones as nothing) and roundings by k."""
    x = np.arange(capacity + 1)
    best = -(-int(counts @ x) // capacity)
    n_from = np.append(np.cumsum(counts[::-1])[::-1], 0)
    mass = np.append(0, np.cumsum(counts * x))
    for e in range(1, capacity // 2 + 1):
        whole = int(n_from[capacity - e + 1])
        middle = int(mass[capacity - e + 1] - mass[e])
        best = max(best, -(-(whole * capacity + middle) // capacity))
    for k in range(1, 51):
        scaled = x * (k + 1)
        # in units of 1 / (k * capacity) of a bin
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int(counts @ value) // (k * capacity)))
    return best


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK, rounds: int = ROUNDS) -> DataFrame:
    """`items` (length long from 1 to capacity, other columns) with sequence_id and offset, in place of columns of these names.

    Each round packs partitions of about per_task items by best-fit decreasing. A partition whose sequences could not be fewer,
    by its lower bound, is certified; if all its empty tokens make no more than TRIFLE of one, it is left alone. Others have gaps
    and close their full sequences only. What is not closed is exchanged, over fewer partitions, and packed again, until one partition holds the rest,
    the total meets the bound of all items, or the rounds are over. All items keep their row.
    """
    items = written(items.drop("sequence_id", "offset"), "items")
    part, closed_col = fresh(items, "part", "closed")
    cols, done, left, open_bins = items.columns, None, items, None
    bound = lower_bound_of(items, capacity)
    closed = 0
    n = items.count()
    for r in range(rounds):
        parts = max(1, -(-n // per_task))
        last = r == rounds - 1 or parts == 1
        dealt = left.withColumn(part, F.pmod(F.xxhash64(F.lit(r), F.monotonically_increasing_id()), F.lit(parts)).cast("long"))
        schema = StructType(items.schema.fields[:]).add("sequence_id", "long").add("offset", "long").add(closed_col, "boolean")
        packed = written(dealt.groupBy(part).applyInPandas(_packer(cols, capacity, r, closed_col), schema), "packed")
        full, rest = packed.where(F.col(closed_col)), packed.where(~F.col(closed_col))
        n_full = full.select("sequence_id").distinct().count()
        now = rest.agg(F.count_distinct("sequence_id"), F.count("*")).first()
        if last or closed + n_full + now[0] <= bound or (open_bins is not None and now[0] >= open_bins):
            done = packed if done is None else done.unionByName(packed)
            break
        done = full if done is None else done.unionByName(full)
        closed, open_bins, n, left = closed + n_full, now[0], now[1], rest.select(*[F.col(f"`{c}`") for c in cols])
    return done.drop(closed_col)


def _packer(cols: list[str], capacity: int, r: int, closed_col: str):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = group[cols].reset_index(drop=True)
        lengths = out["length"].to_numpy(np.int64)
        bins = repacked(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.flatnonzero(np.append(True, bins[order][1:] != bins[order][:-1]))
        offset = np.empty(len(out), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(out))))
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        stays = fill >= capacity - SLACK
        if len(fill) * capacity - fill.sum() <= capacity * TRIFLE and len(fill) <= lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity):
            stays[:] = True  # certified, and its empty tokens are no gain for others
        out["sequence_id"] = (r << 56) + (int(key[0]) << 24) + bins
        out["offset"] = offset
        out[closed_col] = stays[bins]
        return out

    return run


def lower_bound_of(items: DataFrame, capacity: int = CAPACITY) -> int:
    """The lower bound of all items, from their at most `capacity` distinct lengths."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in items.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return lower_bound(counts, capacity)


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each row of `docs`.

    Null and empty texts are the end id alone. Rows that repeat an id, or have none, are packed like any other. Very long texts
    are many pieces. Equal lengths are packed in any order. An empty table gives an empty result. Other columns are not read.
    """
    return pack(pieces(docs, id_col, text_col, path or public_tokenizers.path("byte_bpe_50k.json"), capacity), capacity).withColumnRenamed("id", id_col)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
