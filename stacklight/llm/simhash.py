"""SimHash near-duplicate groups, by bit-sliced comparison inside blocks of candidate fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.llm import bitslice
from stacklight.llm.common import fresh, table, written
from stacklight.llm.components import connected_components

#: Distinct fingerprints of a block that one task compares. Larger blocks are cut, and every two cuts are compared in a task of their own.
BLOCK = 32768
#: Shingles that are hashed at once, whatever a text's length.
STEP = 1 << 15


def fingerprint(text: bytes | None, ngram: int = 3, seeds: tuple[int, ...] = (42,)) -> bytes:
    """64 bits for each seed: a bit is set if over half of the shingles' XXH64 have it. Null and blank texts: all zero."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII blanks part words
    grams = zip(*(islice(words, i, None) for i in range(ngram))) if len(words) >= ngram else iter([words] if words else [])
    n, ones = 0, np.zeros(64 * len(seeds), np.int64)
    while part := list(map(b" ".join, islice(grams, STEP))):
        n += len(part)
        for k, seed in enumerate(seeds):
            h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), np.uint64, len(part))
            ones[64 * k : 64 * k + 64] += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes() if n else bytes(8 * len(seeds))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, ngram: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(id, th, fp binary); th, a hash of the text, tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array([fingerprint(t, ngram, seeds) for t in b.column("t").to_pylist()], pa.binary())], ["id", "th", "fp"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("t")).mapInArrow(run, "id long, th long, fp binary")


def pigeonhole_keys(radius: int) -> Column:
    """array<long> of a 64-bit `fp`: it is cut into radius + 2 parts, and fingerprints at a distance of at most radius agree
    in two parts or more, so in one key or more. No pair within the radius is lost."""
    value = F.conv(F.hex("fp"), 16, -10).cast("long")
    parts, cuts = radius + 2, [64 * i // (radius + 2) for i in range(radius + 3)]
    piece = [F.shiftrightunsigned(value, 64 - cuts[i + 1]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(parts)]
    return F.array(*[F.xxhash64(F.lit(k), piece[i], piece[j]) for k, (i, j) in enumerate(combinations(range(parts), 2))])


def pigeonhole(fps: DataFrame, radius: int) -> DataFrame:
    """`fps` (node, fp) with each of its pigeonhole_keys() as `key`."""
    return fps.select("node", "fp", F.explode(F.array_distinct(pigeonhole_keys(radius))).alias("key"))


def links(keyed: DataFrame, radius: int, block: int = BLOCK, sure: int | None = None) -> DataFrame:
    """Links (a, b) between the nodes of `keyed` (node long, fp binary, key long; each fp has one node) whose fp differ in at
    most radius bits and share a key; of each block only as many links as keep its groups connected. With `sure` (see
    bitslice.forest()) both ends of each link are themselves so close, else one end stands for its group."""
    # only large blocks are looked up, from a table whose size is known, so that fingerprints are shuffled once
    large = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "blocks")
    cuts = F.coalesce(F.ceil(F.col("n") / block), F.lit(1))
    rows = keyed.join(large, "key", "left").select("key", "node", "fp", cuts.cast("int").alias("cuts"), F.pmod(F.xxhash64("node"), cuts).cast("int").alias("cut"))
    # every two cuts of a block meet: a row of cut c goes to the pairs (min(c, d), max(c, d))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("cut", "other"), F.greatest("cut", "other")).alias("key"), "node", "fp")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(radius, sure), "a long, b long")


def _linker(radius: int, sure: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, fp in _whole_blocks(batches):
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            if sure is None:
                label = bitslice.classes(start, fp, radius)
                a = np.flatnonzero(label != np.arange(len(label)))
                b = label[a]
            else:
                a, b = bitslice.forest(start, fp, radius, sure)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return run


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, node, fp) of rows sorted by key, so dealt that no block is torn."""
    held: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = (b.column("key").to_numpy(), b.column("node").to_numpy(), np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1))
        if held:
            now = tuple(np.concatenate(x) for x in zip(held, now))
        last = int(np.flatnonzero(np.append(True, now[0][1:] != now[0][:-1]))[-1])  # the last block may go on
        if last:
            yield tuple(x[:last] for x in now)
        held = tuple(x[last:] for x in now)
    if held:
        yield held


def _grouped(fp: DataFrame, keyed, radius: int) -> DataFrame:
    """`fp` (id, fp) with component_id."""
    distinct = fp.groupBy("fp").agg(F.min("id").alias("node"))
    found = connected_components(links(keyed(distinct.where("node is not null")), radius))
    named = distinct.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fp.join(named, "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, radius: int = 2) -> DataFrame:
    """(id_col, fingerprint, component_id) of each row of `docs`.

    Fingerprints of 64 bits over word shingles link at `radius` or fewer differing bits; component_id is the
    smallest id reachable. Only distinct fingerprints are compared, so copies cost nothing. Null, empty and blank texts
    have the zero fingerprint and are linked like any other. A row without an id gets its fingerprint, and the component of the
    rows that share or reach it (null if none has an id). Repeated ids each keep their row. Other columns are not read.
    """
    fp = written(fingerprints(docs, id_col, text_col, ngram), "simhash")
    out = _grouped(fp, lambda d: pigeonhole(d, radius), radius)
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Of near_duplicates(): the resemblance; bits of a fingerprint; bits that candidates may differ in, which at a resemblance of 0.8 holds for
#: 99.8 % of pairs (256 * acos(2 * 0.8 / 1.8) / pi = 38.8 are expected, 5.7 is their deviation); bits within which a pair is near beyond doubt.
ALIKE, WIDE, WIDE_RADIUS, SURE = 0.8, 256, 56, 22
#: Block keys of a text, and minima that a key names: at a resemblance of 0.8 all keys differ with probability (1 - 0.8 ** 6) ** 24 = 0.0007.
KEYS, MINIMA = 24, 6
_MIX = np.random.default_rng(7).integers(0, 1 << 63, (2, KEYS * MINIMA), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, ngram: int = 5) -> np.ndarray:
    """The distinct XXH64 of the word shingles, sorted; of fewer words than ngram the whole sequence is one; none: empty."""
    words = (text or b"").lower().split()
    grams = zip(*(islice(words, i, None) for i in range(ngram))) if len(words) >= ngram else iter([words] if words else [])
    parts = [np.empty(0, np.uint64)]
    while part := list(map(b" ".join, islice(grams, STEP))):
        parts.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, part), np.uint64, len(part))))
    return np.unique(np.concatenate(parts)) if len(parts) > 2 else parts[-1]


def set_fingerprint(shingles: np.ndarray, width: int = WIDE) -> bytes:
    """A bit is set if over half of the shingles' mixed hashes have it."""
    ones = np.zeros(width, np.int64)
    for at in range(0, len(shingles), STEP):
        part = shingles[at : at + STEP]
        for k in range(width // 64):  # further bits by the finalizer of splitmix64
            h = part + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            ones[64 * k : 64 * k + 64] += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(shingles)).tobytes()


def block_keys(shingles: np.ndarray) -> np.ndarray:
    """KEYS names of MINIMA minima each of the shingles under random orders; the empty set has zeros."""
    low = np.full(KEYS * MINIMA, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), STEP >> 4):
        mixed = shingles[at : at + (STEP >> 4), None] * _MIX[0] + _MIX[1]
        low = np.minimum(low, mixed.min(0))
    keys = np.zeros(KEYS, np.uint64)
    for k in range(MINIMA if len(shingles) else 0):
        keys = (keys ^ (keys >> np.uint64(29)) ^ low[k * KEYS : (k + 1) * KEYS]) * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(32))


def _set_fingerprints(docs: DataFrame, id_col: str, text_col: str, ngram: int) -> DataFrame:
    """(id, th, fp, sh, keys): sh names the set of shingles, so that equal sets are one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, ngram) for t in b.column("t").to_pylist()]
            sh = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = np.concatenate([np.empty(0, np.uint64), *map(block_keys, sets)]).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * KEYS, pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array([set_fingerprint(s) for s in sets], pa.binary()), pa.array(sh), keys], ["id", "th", "fp", "sh", "keys"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("t")).mapInArrow(run, "id long, th long, fp binary, sh long, keys array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, ngram: int, nodes: DataFrame) -> DataFrame:
    """(node, s array<long>) of the documents of `nodes` (node, th)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, ngram).view(np.int64) for t in b.column("t").to_pylist()]
            offsets = pa.array(np.append(0, np.cumsum([len(s) for s in sets])), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *sets])))], ["node", "s"])

    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("t"))
    return rows.join(nodes, ["node", "th"], "left_semi").dropDuplicates(["node", "th"]).mapInArrow(run, "node long, s array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5) -> DataFrame:
    """(id_col, th, component_id) of each row of `docs`, th a hash of its text, for sets of word shingles that resemble each other by ALIKE or more.

    At that resemblance 64 bits differ too widely to be searched exactly, so fingerprints have WIDE bits, candidates share one of KEYS names of
    minima of their shingles, and every two in a block are compared in full, bit-sliced. Of each block the closest pairs that hold it together go
    on (where all pairs' distances are right, no threshold parts what they leave together), and their resemblance is confirmed by their sets.
    Null, empty and blank texts have the empty set and are one group; equal sets are one node; repeated rows: as in simhash_groups().
    Very long texts take time in proportion. An empty table gives an empty result. Other columns are not read.
    """
    fp = written(_set_fingerprints(docs, id_col, text_col, ngram), "simhash")
    first = F.min(F.struct("id", "th", "keys")).alias("first")
    nodes = fp.where("id is not null").groupBy("fp", "sh").agg(first).select("fp", "sh", F.col("first.id").alias("node"), F.col("first.th").alias("node_th"), "first.keys")
    nodes = written(nodes, "nodes")
    keyed = nodes.select("node", "fp", F.posexplode("keys").alias("k", "key")).select("node", "fp", F.xxhash64("k", "key").alias("key"))
    found = links(keyed, WIDE_RADIUS, sure=SURE).where("a <> b")
    pairs = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(_sets(docs, id_col, text_col, ngram, nodes.join(ends, "node").select("node", F.col("node_th").alias("th"))), "sets")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    sure = met.where(both >= ALIKE * (F.size("x") + F.size("y") - both)).select("a", "b")
    named = nodes.join(connected_components(sure), "node", "left").select("fp", "sh", F.coalesce("root", "node").alias("component_id"))
    return fp.join(named, ["fp", "sh"], "left").select(F.col("id").alias(id_col), "th", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are the smallest id of their near-duplicate group, with their columns. Rows without an id
    stay unless some row with an id has their shingles; rows that repeat an id are one document. An empty table stays empty."""
    gone, gone_th = fresh(docs, "gone", "gone_th")
    lost = near_duplicates(docs, id_col, text_col).where(f"not (`{id_col}` <=> component_id)").where("component_id is not null").select(F.col(id_col).alias(gone), F.col("th").alias(gone_th)).distinct()
    return docs.join(lost, F.col(id_col).cast("long").eqNullSafe(F.col(gone)) & (F.xxhash64(text_col) == F.col(gone_th)), "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
