"""Substring deduplication over bytes by distributed prefix doubling.

Two filters come first, for most positions begin no repeated string and most others lie in long runs. Of any THRESHOLD bytes the smallest
GRAM-byte name within leads a run of positions; runs whose lead is met nowhere else are left out, and of runs that are equal as a whole all but the
first are settled. What shares its lead with other runs is cut into parts, filtered in the same way. The positions that are
left are ranked by doubling: Spark sorts the pairs (rank of the first bytes, rank at the offset behind them), numbers the distinct ones, drops
positions whose rank is unique, brings the new ranks back to the order of places, and goes on at a larger offset until ranks cover the threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.llm.common import fresh, remove, table, written, written_at

THRESHOLD = 100
#: Bytes of the rank that leads a segment (a power of two), and positions of a part of a segment in the second sort.
GRAM, PART = 32, 24
#: Bytes that are ranked at once, for ranking takes about a hundred bytes for each; longer texts are taken in pieces that overlap.
PIECE = 1 << 18
#: Runs or parts of a batch that are settled together, and bytes of texts that are told together.
SETTLED, TOLD = 200_000, 1 << 23

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)


def _pair(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """The name of the string that is named a in its first part and b in its second."""
    h = a * _MIX[level % 7]
    h ^= h >> np.uint64(29)
    h += b
    h *= _MIX[(level + 3) % 7]
    h ^= h >> np.uint64(32)
    return h


def names(data: np.ndarray, length: int, level: int = 0) -> list[np.ndarray]:
    """Names of the strings of 8, 16, .. bytes at each position, up to the largest power of two within `length`; doubled from pairs."""
    n = len(data) - 7
    if n <= 0:
        return []
    eight = np.empty(n, np.uint64)
    for k in range(8):
        part = data[k : k + (len(data) - k) // 8 * 8].view("<u8")
        eight[k::8] = part[: len(eight[k::8])]
    out, size = [_pair(eight, eight >> np.uint64(7), level)], 8
    while size * 2 <= length and len(out[-1]) > size:
        last = out[-1]
        out.append(_pair(last[:-size], last[size:], level + len(out)))
        size *= 2
    return out


def name_of(doubled: list[np.ndarray], length: int, at: np.ndarray, level: int = 5) -> np.ndarray:
    """Names of the strings of `length` bytes at the positions `at`: two overlapping strings of the largest power of two."""
    k = min(len(doubled) - 1, length.bit_length() - 4)
    return _pair(doubled[k][at], doubled[k][at + (length - (8 << k))], level)


def _lowest(g: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[: len(g) - (width - size)], g[width - size :]) if width > size else g


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int = THRESHOLD, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first position, positions, lead, content, whether it may hold a string twice) of the runs of positions, within the texts starts..ends of data, whose
    strings of `threshold` bytes have the same smallest rank of `gram` bytes. content names all bytes that the run's strings cover."""
    empty = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(data) < threshold:
        return empty
    doubled = names(data, threshold)
    width = threshold - gram + 1
    g = doubled[gram.bit_length() - 4]
    lead = _lowest(g, width)
    n = len(lead)
    fits = np.zeros(n + 1, np.int64)
    long_ = ends - starts >= threshold
    np.add.at(fits, starts[long_], 1)
    np.add.at(fits, ends[long_] - threshold + 1, -1)
    fits = np.cumsum(fits[:n]) > 0
    new = np.append(True, lead[1:] != lead[:-1]) & fits
    new[1:] |= fits[1:] & ~fits[:-1]
    new[starts[long_]] = True
    # no run is longer than the strings that can share a rank, but for texts that repeat themselves: there it is cut
    first = np.flatnonzero(new)
    stops = np.append(np.flatnonzero(new | ~fits), n)
    last = stops[np.searchsorted(stops, first, "right")]
    size = last - first
    if (size > width).any():
        pieces = -(-size // width)
        first = np.repeat(first, pieces) + width * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(width, np.repeat(last, pieces) - first)
    whole = name_of(doubled, threshold, np.arange(n))
    tail = first + size - 1
    content = _pair(_pair(whole[first], whole[tail], 2), whole[first + size // 2] + size.astype(np.uint64), 4)
    # a run holds a string twice only if a string holds its lead twice
    rim = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(g == ~_lowest(~np.concatenate([rim, lead, rim]), width))
    twice = np.flatnonzero((g[places[1:]] == g[places[:-1]]) & (np.diff(places) < width))
    marked = np.zeros(len(first) + 1, np.int64)
    if len(first) and len(twice):
        np.add.at(marked, np.maximum(np.searchsorted(first, places[twice + 1] - width + 1, "right") - 1, 0), 1)
        np.add.at(marked, np.searchsorted(first, places[twice], "right"), -1)
    return first, size, lead[first], content, np.cumsum(marked[:-1]) > 0


def _laid(texts: Iterable[bytes], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, rows, starts, ends, base) of about PIECE bytes at a time: text rows[k], from its byte base[k] on, lies at starts[k]..ends[k].
    Pieces of one text overlap so that each string of `threshold` bytes is in just one as a whole beginning."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        at = 0
        while True:
            part = text[at : at + PIECE + threshold - 1]
            held.append((row, at, part))
            size += len(part)
            at += PIECE
            if size >= PIECE:
                yield _lay(held)
                held, size = [], 0
            if at + threshold > len(text):
                break
    if held:
        yield _lay(held)


def _lay(held: list[tuple[int, int, bytes]]):
    lengths = np.array([len(p) for _, _, p in held], np.int64)
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join(p for _, _, p in held), np.uint8), np.array([r for r, _, _ in held]), ends - lengths, ends, np.array([a for _, a, _ in held], np.int64)


_FOUND = "lead long, content long, id long, th long, pos long, n int, kind int, piece binary"
_NAMES = ["lead", "content", "id", "th", "pos", "n", "kind", "piece"]
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
#: Kinds of rows: a run of positions to compare, bytes that are known to repeat, a run that needs longer strings, one that may
#: hold a string twice and so needs them in any case.
RUN, GONE, FINER, TWICE = 0, 1, 2, 3
#: Bits of a length in a shuffled row; longer stretches of repeated bytes are told in several rows.
N_BITS = 26


def _batch(lead, content, place: tuple, pos, n, kind: int | np.ndarray, piece=None) -> pa.RecordBatch:
    id_, known, th = place
    columns = [lead, content, id_, th, pos, n, np.broadcast_to(kind, len(pos)), piece if piece is not None else pa.nulls(len(pos), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t, mask=~known) if k == 2 else pa.array(c, t) for k, (c, t) in enumerate(zip(columns, _TYPES))], _NAMES)


def _places(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, whether there is one, hash of the text) of each row."""
    ids = b.column("id")
    return ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), b.column("th").to_numpy()


def _differ(*columns: np.ndarray) -> np.ndarray:
    """Whether each row but the first differs from the one before."""
    return np.any([c[1:] != c[:-1] for c in columns], axis=0)


def _settled_here(lead: np.ndarray, content: np.ndarray, place: tuple, pos: np.ndarray, n: np.ndarray, threshold: int, piece: pa.Array | None = None, kind: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Of equal runs of a batch only the first place goes on; the bytes of the others are known to repeat."""
    if not len(pos):
        return
    id_, known, th = place
    order = np.lexsort((pos, th, id_, ~known, n, content, lead))
    head = np.append(True, _differ(lead[order], content[order], n[order]))
    first = order[head][np.cumsum(head) - 1]
    # an equal row of the same id and text is the same place, not an earlier one
    twin = (id_[order] == id_[first]) & (known[order] == known[first]) & (th[order] == th[first]) & (pos[order] == pos[first])
    keep, gone = np.sort(order[head]), order[~head & ~twin]  # in the order of the texts, which packs better
    at = lambda k: (id_[k], known[k], th[k])
    yield _batch(lead[keep].view(np.int64), content[keep].view(np.int64), at(keep), pos[keep], n[keep], RUN if kind is None else kind[keep], piece.take(pa.array(keep)) if piece is not None else None)
    if len(gone):
        docs, of = np.unique(np.stack([id_[gone], known[gone].astype(np.int64), th[gone]], 1), axis=0, return_inverse=True)
        r, start, length = _merged(of.reshape(-1), pos[gone], n[gone] + np.int64(threshold - 1))
        most = (1 << N_BITS) - 1
        if (parts := -(-length // most)).max() > 1:
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            r, end = np.repeat(r, parts), np.repeat(start + length, parts)
            start = np.repeat(start, parts) + step * most
            length = np.minimum(most, end - start)
        yield _batch(start * 7919 + docs[r, 2], docs[r, 2], (docs[r, 0], docs[r, 1] == 1, docs[r, 2]), start, length, GONE)


def _merged(row: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals pos..pos+n of each row, those that touch joined."""
    order = np.lexsort((pos, row))
    row, pos, end = row[order].astype(np.int64), pos[order].astype(np.int64), (pos + n)[order].astype(np.int64)
    span = int(end.max()) + 2
    far = np.maximum.accumulate(row * span + end)  # the furthest end so far; rows do not mix
    at = np.flatnonzero(np.append(True, row[1:] * span + pos[1:] > far[:-1]))
    last = np.append(at[1:], len(row)) - 1
    return row[at], pos[at], far[last] - row[at] * span - pos[at]


def _ranker(threshold: int, gram: int):
    """Runs of positions of a batch of texts that share the smallest rank of `gram` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_, known, th = _places(b)

            def told(found: list[tuple]) -> Iterator[pa.RecordBatch]:
                row, pos, n, lead, content, kind = (np.concatenate(x) for x in zip(*found))
                yield from _settled_here(lead, content, (id_[row], known[row], th[row]), pos, n, threshold, kind=kind)  # noqa: B023

            found: list[tuple] = []
            runs = 0
            for data, rows, starts, ends, base in _laid((t.as_py() or b"" for t in b.column("t")), threshold):
                first, n, lead, content, twice = segments(data, starts, ends, threshold, gram)
                k = np.searchsorted(starts, first, "right") - 1
                found.append((rows[k], first - starts[k] + base[k], n, lead, content, np.where(twice, TWICE, RUN).astype(np.int32)))
                runs += len(first)
                if runs >= SETTLED:
                    yield from told(found)
                    found, runs = [], 0
            if found:
                yield from told(found)

    return run


def _settler(threshold: int):
    """Rows sorted by lead, content and place. Of equal runs all but the first place lose their bytes; the first of each
    goes on if its lead has other contents too, or if it may hold a string twice. A lead with one content only is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the head of the run of equals that the last batch ended in
        alone = False  # it has met no other content, and has not been told
        for b in batches:
            kind = b.column("kind").to_numpy()
            if (done := kind == GONE).any():
                yield b.filter(pa.array(done))
                b = b.filter(pa.array(~done))
            if not b.num_rows:
                continue
            new = last is None
            if last is not None:
                b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            lead, content, n, pos = (b.column(c).to_numpy() for c in ("lead", "content", "n", "pos"))
            id_, known, th = _places(b)
            leads = np.append(True, lead[1:] != lead[:-1])
            heads = leads | np.append(True, _differ(content, n))
            at = np.flatnonzero(heads)
            head = at[np.cumsum(heads) - 1]
            twin = (id_ == id_[head]) & (known == known[head]) & (th == th[head]) & (pos == pos[head])
            contents = np.bincount(np.cumsum(leads) - 1, weights=heads)[np.cumsum(leads) - 1]
            told = np.zeros(len(heads), bool)
            told[0] = not new and not alone  # the row that was carried over
            first_again = np.zeros(len(heads), bool)
            if not new and not alone:  # its lead has met others before: all heads of that lead go on
                first_again = np.cumsum(leads) == 1
            finer = heads & ((contents > 1) | first_again | (b.column("kind").to_numpy() == TWICE)) & ~told
            gone = ~heads & ~twin
            if not new:
                gone[0] = False
            if gone.any():
                k = np.flatnonzero(gone)
                yield _batch(lead[k], content[k], (id_[k], known[k], th[k]), pos[k], n[k] + threshold - 1, GONE)
            if finer.any():
                k = np.flatnonzero(finer)
                yield _batch(lead[k], content[k], (id_[k], known[k], th[k]), pos[k], n[k], FINER, b.column("piece").take(pa.array(k)))
            h = int(head[-1])
            alone = not (finer[h] or told[h])
            last = b.slice(h, 1)

    return run


def _parter(threshold: int, gram: int, part: int):
    """Parts of a text's runs. The strings of a part see the run's lead first at the same place and begin at most `part` bytes
    apart, in steps that are counted from that place: so two strings that are equal are in parts that are led by the same
    bytes, those that all strings of such a part must share, wherever their runs begin."""

    def parts(bytes_: list[bytes], of: list[int], pos: list[int]) -> tuple:
        """(core, content, row, position, positions, bytes) of the parts of runs: bytes_[k] from position pos[k] of row of[k] on."""
        joined = b"".join(bytes_)
        of, pos, size = np.array(of), np.array(pos, np.int64), np.array([len(x) for x in bytes_], np.int64)
        n = size - (threshold - 1)
        start = np.cumsum(size) - size
        doubled = names(np.frombuffer(joined, np.uint8), threshold)
        g = doubled[gram.bit_length() - 4]
        lead = _lowest(g, threshold - gram + 1)[start]
        seen = np.flatnonzero(g == np.repeat(lead, size)[: len(g)])
        row = np.repeat(np.arange(len(n)), n)
        p = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(row))
        q = seen[np.searchsorted(seen, p)]
        j = (q - p) // part
        head = np.flatnonzero(np.append(True, _differ(row, q, j)))
        m = np.diff(np.append(head, len(row)))
        p, q, j, row = p[head], q[head], j[head], row[head]
        core = _pair(name_of(doubled, threshold - part + 1, q - j * part), j.astype(np.uint64), 3)
        content = _pair(name_of(doubled, threshold, p), name_of(doubled, threshold, p + m - 1) + m.astype(np.uint64), 2)
        pieces = pa.array([joined[x:y] for x, y in zip(p.tolist(), (p + m + threshold - 1).tolist())], pa.binary())
        return core, content, of[row], pos[row] + p - start[row], m, pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = _places(b)

            def told(found: list[tuple]) -> Iterator[pa.RecordBatch]:
                *numbers, pieces = zip(*found)
                core, content, row, pos, m = (np.concatenate(x) for x in numbers)
                yield from _settled_here(core, content, tuple(x[row] for x in places), pos, m, threshold, pa.concat_arrays(pieces))  # noqa: B023

            found: list[tuple] = []
            bytes_, of, pos, size, made = [], [], [], 0, 0
            for k in range(b.num_rows):
                text = _full([b.column("t")[k].as_py()])[0]
                for s in b.column("runs")[k].as_py():
                    bytes_.append(text[s["pos"] : s["pos"] + s["n"] + threshold - 1])
                    of.append(k)
                    pos.append(s["pos"])
                    size += len(bytes_[-1])
                    if size >= PIECE:
                        found.append(parts(bytes_, of, pos))
                        made += len(found[-1][0])
                        bytes_, of, pos, size = [], [], [], 0
                    if made >= SETTLED // 4:  # a part carries its bytes
                        yield from told(found)
                        found, made = [], 0
            if bytes_:
                found.append(parts(bytes_, of, pos))
            if found:
                yield from told(found)

    return run


#: Of a ranked position: one that is only looked up at an offset, one that may begin a repeated string, one that is known to begin one.
AHEAD, START, KNOWN = 0, 1, 2


def _starter(threshold: int, first: int):
    """(id, th, pos, kind, a, b) of the positions of the parts and of those at the later offset, a and b the names of the `first` bytes there and
    of as many behind them. Of strings that are equal as a whole and lie in one batch only the first place goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                n = b.column("n").to_numpy().astype(np.int64)
                size = n + threshold - 1
                doubled = names(np.frombuffer(b"".join(b.column("piece").to_pylist()), np.uint8), threshold)
                row = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(np.cumsum(size) - size, n) + step
                pos = b.column("pos").to_numpy()[row] + step
                id_, known, th = (x[row] for x in _places(b))
                string, other = name_of(doubled, threshold, start), name_of(doubled, threshold, start, 6)
                order = np.lexsort((pos, th, id_, ~known, other, string))
                head = np.append(True, _differ(string[order], other[order]))
                lead = order[head][np.cumsum(head) - 1]
                twin = ~np.any([x[order] != x[lead] for x in (id_, known, th, pos)], axis=0)
                later, go = order[~head & ~twin], np.sort(order[head])
                spread = (pos[later] * 7919 + th[later]).view(np.uint64)
                yield _positions(b, row[later], pos[later], KNOWN, spread, spread)
                beyond = threshold - 2 * first
                p, r, q = np.append(start[go], start[go] + beyond), np.tile(row[go], 2), np.append(pos[go], pos[go] + beyond)
                kind = np.repeat([START, AHEAD], len(go))
                order = np.lexsort((-kind, p))
                once = order[np.append(True, p[order][1:] != p[order][:-1])]
                yield _positions(b, r[once], q[once], kind[once], name_of(doubled, first, p[once]), name_of(doubled, first, p[once] + first))

    return run


_PLACED, _PLACED_NAMES = "id long, th long, pos long, kind int, a long, b long", ["id", "th", "pos", "kind", "a", "b"]
_RANKED, _RANKED_NAMES = "id long, th long, pos long, kind int, rank long", ["id", "th", "pos", "kind", "rank"]


def _positions(of: pa.RecordBatch, row: np.ndarray, pos: np.ndarray, kind, *numbers: np.ndarray) -> pa.RecordBatch:
    take = pa.array(row)
    kinds = pa.array(np.broadcast_to(np.asarray(kind, np.int32), len(row)))
    columns = [of.column("id").take(take), of.column("th").take(take), pa.array(pos), kinds, *(pa.array(x.view(np.int64)) for x in numbers)]
    return pa.RecordBatch.from_arrays(columns, _RANKED_NAMES if len(numbers) == 1 else _PLACED_NAMES)


def _reranker(last: bool):
    """Rows sorted by (a, b) and place. Positions whose pair is unique are left out; others get the number of their pair as rank. `last`: the
    pair covers the threshold, and all places of it but the first are told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held, seen = None, False  # the last place so far, whose pair may go on; whether a place before it has the pair
        for b in batches:
            settled = b.column("kind").to_numpy() == KNOWN
            if settled.any():
                some = np.flatnonzero(settled)
                yield _positions(b, some, b.column("pos").to_numpy()[some], KNOWN, np.zeros(len(some), np.int64))
                b = b.filter(pa.array(~settled))
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            x, y, pos, kind = (b.column(c).to_numpy() for c in ("a", "b", "pos", "kind"))
            same = np.append(False, ~_differ(x, y))
            twin = same & np.append(False, ~_differ(*_places(b), pos))  # one place, told by two parts
            k = np.flatnonzero(~twin)
            same = same[k]
            rank = number + np.cumsum(~same)
            before = same.copy()
            before[0] = seen
            told = before if last else before | np.append(same[1:], False)
            some = np.flatnonzero(told[:-1])
            yield _positions(b, k[some], pos[k[some]], kind[k[some]], rank[some])
            held, seen, number = b.slice(int(k[-1]), 1), bool(before[-1]), int(rank[-1]) - 1
        if held is not None and seen:
            yield _positions(held, np.array([0]), held.column("pos").to_numpy(), held.column("kind").to_numpy(), np.array([number + 1]))

    return run


def _pairer(offset: int):
    """Rows sorted by place: each start with its rank and the rank at the offset behind it; without that one its string is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def paired(b: pa.RecordBatch, upto: int | None) -> tuple[pa.RecordBatch, int]:
            pos, rank, kind = (b.column(c).to_numpy() for c in ("pos", "rank", "kind"))
            text = np.append(0, np.cumsum(_differ(*_places(b))))
            key = (text << 40) | pos
            open_ = int(np.searchsorted(key, key[-1] - offset, "right")) if upto is None else upto
            open_ = max(open_, int(np.searchsorted(text, text[-1]))) if upto is None else upto
            at = np.minimum(np.searchsorted(key, key[:open_] + offset), len(key) - 1)
            k = np.flatnonzero((key[at] == key[:open_] + offset) & (kind[:open_] == START))
            return _positions(b, k, pos[k], START, rank[k], rank[at[k]]), open_

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            told, done = paired(b, None)
            yield told
            held = b.slice(done)
        if held is not None and held.num_rows:
            yield paired(held, held.num_rows)[0]

    return run


def _squeezer(at: int):
    """Column `at` compressed: texts cross a shuffle at little over half the size that Spark's own compression leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            done = pa.array([None if (t := x.as_py()) is None else squeeze(t) for x in b.column(at).cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([done if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return run


def _full(texts: list[bytes | None]) -> list[bytes | None]:
    expand = zstandard.ZstdDecompressor().decompress
    return [None if t is None else expand(t) for t in texts]


def _cutter(text_at: int, gone_at: int):
    def told(b: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        kept, total, removed, runs = [], [], [], []
        for text, gone in zip(texts, b.column(gone_at).to_pylist()):
            text = text or b""
            spans: list[list[int]] = []
            for s, e in sorted((g["pos"], g["pos"] + g["n"]) for g in gone or ()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            cuts = [0, *(x for span in spans for x in span), len(text)]
            kept.append(b"".join(text[s:e] for s, e in zip(cuts[::2], cuts[1::2])))
            total.append(len(text))
            removed.append(sum(e - s for s, e in spans))
            runs.append(len(spans))
        names_ = [x for k, x in enumerate(b.schema.names) if k != gone_at]
        given = pa.array([None if t is None else t.decode() for t in texts], pa.string())
        columns = [given if k == text_at else c for k, c in enumerate(b.columns) if k != gone_at]
        return pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, removed, runs))], [*names_, "kept", "n_bytes", "n_removed", "n_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, size, done = [], 0, 0
            for k in range(b.num_rows):
                texts += _full([b.column(text_at)[k].as_py()])
                size += len(texts[-1] or b"")
                if size >= TOLD or k + 1 == b.num_rows:
                    yield told(b.slice(done, len(texts)), texts)
                    texts, size, done = [], 0, k + 1

    return run


def _doubled(parts: DataFrame, threshold: int) -> DataFrame:
    """(id, th, pos, n) of the positions of `parts` whose strings of `threshold` bytes begin at an earlier place too."""
    first = -(-threshold // 4)
    spark, place = parts.sparkSession, [F.col("id").asc_nulls_last(), "th", "pos"]

    def ranked(pairs: DataFrame, last: bool) -> tuple[DataFrame, str]:
        rows = pairs.repartition("a", "b").sortWithinPartitions("a", "b", *place, F.desc("kind"))
        return written_at(rows.mapInArrow(_reranker(last), _RANKED), "ranks")

    half, path = ranked(parts.mapInArrow(_starter(threshold, first), _PLACED), False)
    met = half.where(F.col("kind") != KNOWN).repartition("id", "th").sortWithinPartitions(*place)
    full, _ = ranked(met.mapInArrow(_pairer(threshold - 2 * first), _PLACED), True)
    known, _ = written_at(half.where(F.col("kind") == KNOWN), "ranks")
    remove(spark, path)
    return full.unionByName(known).select("id", "th", "pos", F.lit(threshold).alias("n"))


def drop_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """`docs` with kept (binary: the bytes that stay), n_bytes, n_removed and n_spans (runs of removed bytes), in place of columns of these names.

    A byte goes if a string of `threshold` bytes of its own text covers it that also starts earlier: at a smaller id, or
    earlier in the same text. Strings are those of the given texts, not of what is left, and never cross texts. Null and empty texts have no bytes.
    Rows without an id come last; rows that repeat an id are ordered by a hash of their text, and equal rows are one
    document. Very long texts are taken in pieces that overlap. An empty table stays empty; other columns are kept. Strings are equal if two
    64-bit names of theirs are.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in ("kept", "n_bytes", "n_removed", "n_spans") if c not in (id_col, text_col)])
    text, ids = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    base = docs.select(ids.alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("t"))

    def settled(rows: DataFrame, *more: str) -> tuple[DataFrame, str]:
        # place, length and kind travel in one number; content names the length too
        packed = rows.select("lead", "content", "id", "th", (F.shiftleft("pos", N_BITS + 2) + F.shiftleft(F.col("n").cast("long"), 2) + F.col("kind")).alias("meta"), *more)
        packed = packed.repartition("lead").sortWithinPartitions("lead", "content", F.col("id").asc_nulls_last(), "th", "meta")
        bits = lambda from_, n: F.shiftright("meta", from_).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
        rest = [F.col(m) for m in more] or [F.lit(None).cast("binary").alias("piece")]
        rows = packed.select("lead", "content", "id", "th", F.shiftright("meta", N_BITS + 2).alias("pos"), bits(2, N_BITS).alias("n"), bits(0, 2).alias("kind"), *rest)
        return written_at(rows.mapInArrow(_settler(threshold), _FOUND), "runs")

    first, first_path = settled(base.mapInArrow(_ranker(threshold, gram), _FOUND))
    runs = first.where(F.col("kind") == FINER).groupBy("id", "th").agg(F.collect_list(F.struct("pos", "n")).alias("runs"))
    runs = runs.withColumnsRenamed({"id": "id2", "th": "th2"})
    small = base.mapInArrow(_squeezer(2), "id long, th long, t binary")
    held = small.join(runs, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))).select("id", "th", "t", "runs")
    second, second_path = settled(held.mapInArrow(_parter(threshold, gram, PART), _FOUND), "piece")
    third = _doubled(second.where(F.col("kind") == FINER).select("id", "th", "pos", "n", "piece"), threshold)
    gone = first.unionByName(second).where(F.col("kind") == GONE).select("id", "th", "pos", "n").unionByName(third)
    gone = written(gone.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "n")).alias("gone")), "gone")
    remove(spark, first_path)
    remove(spark, second_path)
    own, hash_, gone_id, gone_th, spans = fresh(docs, "own", "hash", "gone_id", "gone_th", "gone")
    gone = gone.select(F.col("id").alias(gone_id), F.col("th").alias(gone_th), F.col("gone").alias(spans))
    at = docs.columns.index(text_col)
    told = docs.withColumns({own: ids, hash_: F.xxhash64(text)})
    kinds = ", ".join(f"`{n}` {'binary' if k == at else t}" for k, (n, t) in enumerate(told.dtypes))
    joined = told.mapInArrow(_squeezer(at), kinds).join(gone, F.col(own).eqNullSafe(F.col(gone_id)) & (F.col(hash_) == F.col(gone_th)), "left").drop(own, hash_, gone_id, gone_th)
    schema = ", ".join(f"`{n}` {t}" for n, t in [*docs.dtypes, ("kept", "binary"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint")])
    return joined.mapInArrow(_cutter(at, len(docs.columns)), schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
