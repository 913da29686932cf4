"""Hamming neighbours among fingerprints of equal width, bit-sliced: 64 distances at a time."""

from __future__ import annotations

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Work items (query, word of 64 lanes) that are held at once.
CHUNK = 1 << 15
#: Distances within so many bits count as equally close.
STEP = 4


class Planes:
    """Bit planes of n fingerprints: plane b holds bit b of all of them, 64 lanes to a word."""

    def __init__(self, fps: np.ndarray):
        """fps: (n, bytes) uint8."""
        self.n, self.width = fps.shape[0], fps.shape[1] * 8
        self.words = -(-self.n // 64)
        self.bits = np.unpackbits(fps, axis=1)
        lanes = np.zeros((self.width, self.words * 64), np.uint8)
        lanes[:, : self.n] = self.bits.T
        self.planes = np.packbits(lanes, axis=1, bitorder="little").view("<u8")

    def within(self, query: np.ndarray, word: np.ndarray, mask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, lane) at a distance of at most radius, and their distances, for work items (query, word) and the lanes in mask."""
        counter = [np.zeros(len(query), np.uint64) for _ in range(radius.bit_length())]
        over = np.zeros(len(query), np.uint64)
        alive = mask.copy()
        for b in range(self.width):
            carry = self.planes[b, word] ^ (np.uint64(0) - self.bits[query, b].astype(np.uint64))
            for k, c in enumerate(counter):  # carry-save: the counter's planes take one more bit each
                counter[k] = c ^ carry
                carry = c & carry
            over |= carry
            if b % 8 == 7 and b >= radius:
                alive &= ~(over | _above(counter, radius))
                keep = alive != 0
                left = np.count_nonzero(keep)
                if not left:
                    return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
                if left < 0.8 * len(keep):  # blocks whose lanes are all beyond the radius are abandoned
                    query, word, alive, over = query[keep], word[keep], alive[keep], over[keep]
                    counter = [c[keep] for c in counter]
        hit = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(hit)
        distance = sum(((c[at] >> lane.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k for k, c in enumerate(counter)) if counter else np.zeros(len(at), np.int64)
        return query[at].astype(np.int64), word[at].astype(np.int64) * 64 + lane, distance


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray | np.uint64:
    """Lanes whose counter is larger than radius."""
    above, equal = np.uint64(0), ONES
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above = above | (equal & counter[k])
            equal = equal & ~counter[k]
    return above


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i] in label, which maps each lane to its class's smallest lane."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        x, y, a, b = x[differ], y[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray, distance: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Joins classes as _union() does, close pairs first, and adds the pairs that did so to `links`: a forest of direct pairs."""
    other = label[a] != label[b]
    a, b, step = a[other], b[other], distance[other] // STEP
    for level in np.unique(step):
        x, y = a[step == level], b[step == level]
        while True:
            p, q = label[x], label[y]
            differ = p != q
            if not differ.any():
                break
            x, y, p, q = x[differ], y[differ], p[differ], q[differ]
            high, at = np.unique(np.maximum(p, q), return_index=True)
            links.append((x[at], y[at]))
            label[high] = np.minimum(p, q)[at]
            while not np.array_equal(up := label[label], label):
                label[:] = up


def classes(start: np.ndarray, fps: np.ndarray, radius: int, wide: int = 512) -> np.ndarray:
    """For rows sorted by bucket (start: the first row of each bucket), each row's class: the smallest row of its bucket
    that it reaches by links of at most radius bits. Rows of different buckets are never compared."""
    label = np.arange(len(fps))
    _search(label, start, fps, radius, radius, wide, None)
    return label


def forest(start: np.ndarray, fps: np.ndarray, radius: int, sure: int, wide: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that differ in at most radius bits and hold the classes() together, close ones chosen before far ones.
    `sure`: a distance within which a pair is near beyond doubt, so that it may stand for others."""
    links: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2]
    _search(np.arange(len(fps)), start, fps, radius, sure, wide, links)
    return tuple(np.concatenate(x) for x in zip(*links))


def _search(label: np.ndarray, start: np.ndarray, fps: np.ndarray, radius: int, sure: int, wide: int, links: list | None) -> None:
    """In a bucket of over `wide` rows some pivots are compared with all rows first, for distances within `sure`; rows that share the largest class
    found so far need no comparison with each other, so a large tight group costs as many steps as it has rows."""
    n = len(fps)
    if n < 2:
        return
    planes = Planes(fps)
    end = np.append(start[1:], n)
    size = end - start
    for s, e in zip(start[size > wide].tolist(), end[size > wide].tolist()):
        for p in range(s, e, max(1, (e - s) // 16)):
            _compare(planes, label, np.array([p]), s, e, sure, links)
        rows, counts = np.unique(label[s:e], return_counts=True)
        rest = np.nonzero(label[s:e] != rows[counts.argmax()])[0] + s
        _compare(planes, label, rest, s, e, radius, links)
    small = np.repeat((size > 1) & (size <= wide), size)
    q = np.nonzero(small)[0]
    if len(q):
        last = np.repeat(end, size)[q]
        _compare(planes, label, q, q + 1, last, radius, links)


def _compare(planes: Planes, label: np.ndarray, q: np.ndarray, lo, hi, radius: int, links: list | None) -> None:
    """Links each query row q with the rows lo..hi of its bucket."""
    lo, hi = np.broadcast_to(lo, q.shape), np.broadcast_to(hi, q.shape)
    some = hi > lo
    q, lo, hi = q[some], lo[some], hi[some]
    first, count = lo // 64, (hi - 1) // 64 - lo // 64 + 1
    done = np.cumsum(count)
    at = 0
    while at < len(q):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CHUNK, "right")))
        c = count[at:upto]
        i = np.repeat(np.arange(at, upto), c)
        w = np.repeat(first[at:upto] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        from_bit, to_bit = np.clip(lo[i] - w * 64, 0, 64), np.clip(hi[i] - w * 64, 0, 64)
        mask = _below(to_bit) & ~_below(from_bit)
        a, b, distance = planes.within(q[i], w, mask, radius)
        if links is None:
            _union(label, a, b)
        else:
            _join(label, a, b, distance, links)
        at = upto


def _below(k: np.ndarray) -> np.ndarray:
    """Words whose k lowest bits are set, k from 0 to 64."""
    return np.where(k >= 64, ONES, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
