"""Approximate nearest neighbours by cross-polytope hashing, with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stacklight.llm.common import table, written

#: Hash tables; rounds of signs and Hadamard transform of a pseudo-rotation.
TABLES, ROUNDS = 12, 3
#: A cell is named by the nearest axes of one, two or three pseudo-rotations: of one below the first of these numbers of vectors, and so on.
MORE_ROTATIONS = (1 << 13, 1 << 19)
#: Cells of each table that a query looks into, by rotations; axes of each rotation that they are drawn from.
PROBES, AXES = {1: 8, 2: 250, 3: 3000}, 24
#: Points of a group of cells, and queries, that one task compares; larger groups are split.
GROUP = 8192
#: Pairs that are scored at once.
BLOCK = 1 << 16
#: Candidates of a query that are reranked exactly, as a multiple of k.
RERANKED = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in n log n steps, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def axes(x: np.ndarray, table: int, rotation: int, seed: int) -> np.ndarray:
    """(rows, 2 n): how near each signed axis is to the pseudo-rotated row, n the next power of two of the row's length."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    rng = np.random.default_rng([seed, table, rotation])
    for _ in range(ROUNDS):
        y = hadamard(y * rng.choice([-1.0, 1.0], n))
    return np.concatenate([y, -y], 1)


def cells(x: np.ndarray, rotations: int, table: int, seed: int) -> np.ndarray:
    """The cell of each row: its nearest axis in each rotation, as digits of one number."""
    code = np.zeros(len(x), np.int64)
    for r in range(rotations):
        y = axes(x, table, r, seed)
        code = code * y.shape[1] + y.argmax(1)
    return code


def probed(x: np.ndarray, rotations: int, table: int, seed: int, probes: int) -> np.ndarray:
    """(rows, probes): the likeliest cells of near rows, by how much further their axes are than the nearest ones."""
    code, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for r in range(rotations):
        y = axes(x, table, r, seed)
        best = np.argsort(-y, axis=1, kind="stable")[:, : AXES if probes < y.shape[1] or rotations > 1 else None]
        near = np.take_along_axis(y, best, 1)
        more = near[:, :1] ** 2 - near**2
        code = (code[:, :, None] * y.shape[1] + best[:, None, :]).reshape(len(x), -1)
        cost = (cost[:, :, None] + more[:, None, :]).reshape(len(x), -1)
        if cost.shape[1] > probes:
            kept = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            code, cost = np.take_along_axis(code, kept, 1), np.take_along_axis(cost, kept, 1)
    return code


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _directions(x: np.ndarray, longest: float, is_query: bool) -> np.ndarray:
    """Rows of length 1 whose angles follow the inner product: if norms differ (longest > 0), points get a coordinate that fills
    their length up to that of the longest, and queries a zero."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    if not longest:
        return x / size
    if is_query:
        return np.hstack([x / size, np.zeros((len(x), 1))])
    return np.hstack([x / longest, np.sqrt(np.maximum(0, 1 - (size / longest) ** 2))])


_DEALT = "cell long, id long, last binary, scale float, code binary"


def _rows(cell: np.ndarray, ids: pa.Array, last: list[bytes], x: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Vectors travel as bytes of a step each, which is enough to choose the candidates that are then reranked."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    take = pa.array(at)
    code = pa.array([c.tobytes() for c in codes], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(cell), ids.take(take), pa.array(last, pa.binary()), pa.array(scale.astype(np.float32)).take(take), code.take(take)], ["cell", "id", "last", "scale", "code"])


def _bare(cell: np.ndarray) -> pa.RecordBatch:
    n = len(cell)
    return pa.RecordBatch.from_arrays([pa.array(cell), *(pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.float32(), pa.binary()))], ["cell", "id", "last", "scale", "code"])


def _point_dealer(tables: int, rotations: int, seed: int, longest: float, lean: bool = False):
    """A row for each table: the cells that share all axes but the last are one group; `last` is the last axis. `lean`: the groups only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _vectors(part.column("v"))
                u = _directions(x, longest, False)
                wide = 2 << max(1, (u.shape[1] - 1).bit_length())
                shift = np.arange(tables) * wide ** (rotations - 1)
                if lean:
                    yield _bare((np.stack([cells(u, rotations - 1, t, seed) for t in range(tables)], 1) + shift).ravel())
                    continue
                code = np.stack([cells(u, rotations, t, seed) for t in range(tables)], 1)
                group, last = code // wide + shift, (code % wide).astype("<u2")
                yield _rows(group.ravel(), part.column("id"), [v.tobytes() for v in last.ravel()], x, np.repeat(np.arange(len(x)), tables))

    return run


def _query_dealer(tables: int, rotations: int, seed: int, longest: float, probes: int, lean: bool = False):
    """A row for each group that a query looks into; `last` has a bit for each last axis that it looks for there. `lean`: the groups only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = _vectors(part.column("v"))
                u = _directions(x, longest, True)
                wide = 2 << max(1, (u.shape[1] - 1).bit_length())
                found, row = [], []
                for t in range(tables):
                    code = probed(u, rotations, t, seed, probes) + t * wide**rotations
                    found.append(code.ravel())
                    row.append(np.repeat(np.arange(len(x)), code.shape[1]))
                code, row = np.concatenate(found), np.concatenate(row)
                order = np.lexsort((code, row))
                code, row = code[order], row[order]
                group, last = code // wide, code % wide
                head = np.append(True, (group[1:] != group[:-1]) | (row[1:] != row[:-1]))
                if lean:
                    yield _bare(group[head])
                    continue
                mask = np.zeros((int(head.sum()), wide), np.uint8)
                mask[np.cumsum(head) - 1, last] = 1
                yield _rows(group[head], part.column("id"), [m.tobytes() for m in np.packbits(mask, axis=1)], x, row[head])

    return run


def _top(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int, repeated: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` best rows of each q, best first, ties to smaller ids, each id once; `repeated`: an id may come twice for a q."""
    if not len(q):
        return q, ids, scores
    order = np.argsort(ids, kind="stable")
    if repeated:
        order = order[np.argsort(q[order], kind="stable")]
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (q[1:] != q[:-1])))
        q, ids, scores = q[first], ids[first], np.maximum.reduceat(scores, first)
    else:
        q, ids, scores = q[order], ids[order], scores[order]
    bits = scores.view(np.uint32)
    falling = np.where(bits >> np.uint32(31), bits, ~bits & np.uint32(0x7FFFFFFF))  # larger scores are smaller numbers
    number = np.unique(q, return_inverse=True)[1] if repeated else q
    order = np.argsort((number.astype(np.uint64) << np.uint64(32)) | falling, kind="stable")
    first = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1]))
    order = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < most]
    return q[order], ids[order], scores[order]


class _Group:
    """The queries of a group, as they came, and their best points so far."""

    def __init__(self, most: int):
        self.most, self.parts = most, []
        self.q, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        self.looks = None

    def ask(self, ids, last, x) -> None:
        self.parts.append((ids, np.unpackbits(np.frombuffer(b"".join(last), np.uint8).reshape(len(last), -1), axis=1), x))

    def meet(self, ids, last, x) -> None:
        if not self.parts:
            return
        if self.looks is None:
            self.q_ids, mask, self.q_x = (np.concatenate(p) for p in zip(*self.parts))
            axis, self.by_axis = np.nonzero(mask.T)
            self.looks = np.searchsorted(axis, np.arange(mask.shape[1] + 1))
        axis = np.frombuffer(b"".join(last), "<u2").astype(np.int64)
        self.seen = np.append(self.seen, ids) if len(self.ids) else ids
        twice = len(np.unique(self.seen)) < len(self.seen)
        n = self.looks[axis + 1] - self.looks[axis]
        done = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + BLOCK, "right")))
            m = n[at:to]
            p = np.repeat(np.arange(at, to), m)
            q = self.by_axis[np.repeat(self.looks[axis[at:to]] - (np.cumsum(m) - m), m) + np.arange(len(p))]
            other = self.q_ids[q] != ids[p]
            p, q = p[other], q[other]
            score = np.einsum("ij,ij->i", self.q_x[q], x[p])
            q, i, s = np.append(self.q, q), np.append(self.ids, ids[p]), np.append(self.scores, score)
            self.q, self.ids, self.scores = _top(q, i, s, self.most, twice)
            at = to

    def told(self) -> Iterator[pa.RecordBatch]:
        if len(self.q):
            yield _lists(self.q_ids[self.q], self.ids, self.scores)


def _lists(q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """Rows (query_id, ids, scores) of rows that are sorted by query."""
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    offsets = pa.array(np.append(first, len(q)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(q[first]), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(scores.astype(np.float32)))], ["query_id", "ids", "scores"])


_FOUND = "query_id long, ids array<long>, scores array<float>"


def _comparer(most: int):
    """The best points of each query (kind 0, which come first) in each group, of the cells that it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, _Group(most)
        for b in batches:
            if not b.num_rows:
                continue
            k, kind, ids, scale = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "kind", "id", "scale"))
            x = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(len(k), -1).astype(np.float32) * scale[:, None]
            last = b.column("last").to_pylist()
            starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (kind[1:] != kind[:-1])))
            for s, e in zip(starts.tolist(), np.append(starts[1:], len(k)).tolist()):
                if k[s] != key:
                    yield from group.told()
                    key, group = k[s], _Group(most)
                (group.meet if kind[s] else group.ask)(ids[s:e], last[s:e], x[s:e])
        yield from group.told()

    return run


def _merger(most: int):
    """The best of each query over all groups, from rows sorted by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        for b in batches:
            if not b.num_rows:
                continue
            n = np.diff(b.column("ids").offsets.to_numpy())
            q = np.append(q, np.repeat(b.column("query_id").to_numpy(), n))
            ids, scores = np.append(ids, b.column("ids").flatten().to_numpy()), np.append(scores, b.column("scores").flatten().to_numpy())
            q, ids, scores = _top(q, ids, scores, most)
            whole = q != q[-1]  # the last query may go on
            if whole.any():
                yield _lists(q[whole], ids[whole], scores[whole])
            q, ids, scores = q[~whole], ids[~whole], scores[~whole]
        if len(q):
            yield _lists(q, ids, scores)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, v array<double>) of the rows that take part: with an id, of the most frequent length, not zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("v", sound) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _large(points: DataFrame, asked: DataFrame, group: int) -> DataFrame:
    """(cell, p_parts, q_parts) of the groups with so many points or queries that they are split."""
    many = points.groupBy("cell").count().join(asked.groupBy("cell").agg(F.count("*").alias("q")), "cell")
    return many.where((F.col("count") > group) | (F.col("q") > group)).select("cell", F.ceil(F.col("count") / group).alias("p_parts"), F.ceil(F.col("q") / group).alias("q_parts"))


def _candidates(points: DataFrame, asked: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(query_id, ids, scores) of the dealt rows that share a cell. Groups with many points or queries are split, and every two
    splits meet in a task of their own; only these groups are in the table of sizes."""
    many = written(sizes, "groups")
    one = F.lit(1).cast("long")

    def split(rows: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        rows = rows.join(many, "cell", "left").withColumns({own: F.coalesce(own, one), other: F.coalesce(other, one)})
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), own)).withColumn("its", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        place = ("mine", "its") if kind else ("its", "mine")
        return rows.select(F.xxhash64("cell", *place).alias("key"), F.lit(kind).alias("kind"), "id", "last", "scale", "code")

    met = split(asked, "q_parts", "p_parts", 0).unionByName(split(points, "p_parts", "q_parts", 1))
    found = met.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(_comparer(k + k // 4), _FOUND)
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merger(max(RERANKED * k, k + 16)), _FOUND)


def _reranked(found: DataFrame, points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) by the exact inner product of the given vectors, summed in their order."""
    pairs = found.select("query_id", F.explode("ids").alias("vec_id"))
    pairs = pairs.join(points.select(F.col("id").alias("vec_id"), F.col("v").alias("p")), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    exact = F.aggregate(F.zip_with("q", "p", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_id", "vec_id", exact.alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # RERANKED * k rows at most
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, rotations: int | None = None, probes: int | None = None, seed: int = 11, group: int = GROUP
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k nearest rows of `vectors` by inner product, of those in the cells
    that it looks into; other ids than its own, nearest first, ties to smaller ids. A query that finds fewer looks into all
    cells of a table, so it gets k rows, or all there are.

    Cells are named by more rotations the more vectors there are. Null, zero and non-finite vectors, rows without an id and vectors
    of another length than most take no part. Rows that repeat an id count as their best. Empty tables give an empty result.
    Other columns are not read. A group of cells that very many equal vectors share is split among tasks.
    """
    spark = vectors.sparkSession
    points, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, low, high = points.agg(F.count("*"), F.min(norm), F.max(norm)).first()
    rotations = rotations or 1 + sum(n >= m for m in MORE_ROTATIONS)
    longest = float(high) if n and high > low * 1.001 else 0.0  # of equal norms the coordinate is zero

    def found(asked: DataFrame, tables: int, rotations: int, probes: int) -> DataFrame:
        deal = lambda lean: (points.mapInArrow(_point_dealer(tables, rotations, seed, longest, lean), _DEALT), asked.mapInArrow(_query_dealer(tables, rotations, seed, longest, probes, lean), _DEALT))
        sizes = _large(*deal(True), group) if max(n, asked.count()) > group else spark.createDataFrame([], "cell long, p_parts long, q_parts long")
        return _reranked(_candidates(*deal(False), sizes, k), points, asked, k)

    out = written(found(asked, tables, rotations, probes or PROBES[rotations]), "nearest")
    few = written(asked.join(out.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti"), "few")
    if few.isEmpty():
        return out
    return out.join(few.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(found(few, 1, 1, 1 << 30))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
