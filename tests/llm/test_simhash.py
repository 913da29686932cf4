import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stacklight.llm import bitslice, simhash
from stacklight.llm.components import connected_components


def brute_fingerprint(text, n=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=2):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, f"{fps[i]:016x}", find(i)) for i in ids}


TEXTS = [None, "", " \t\n ", "One", "one", "One two", "A b c", "a B c", "a b d", "É à ü", "x" * 5000, "w " * 3000, "a b c d", "a b c a b c a b c"]


def test_matches_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(f"w{j % 7}" for j in range(i))) for i in range(40)]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("fp", F.lit(2)))
    assert {tuple(r) for r in got.collect()} == brute_groups(rows)


def test_empty_and_missing_ids(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = simhash.simhash_groups(spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "z y x w")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id is None, r.component_id or 0) for r in got) == [(False, False, 7), (False, False, 7), (True, False, 7), (True, True, 0)]


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in simhash.op1_simhash(spark, "/root/testdata/sf0.001").collect()} == brute_groups(rows)


@pytest.mark.parametrize("block", [8, 10**6])
def test_close_fingerprints(spark, block):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12)
    fps = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) ^ ((1 << int(z)) if z < 60 else 0) for b in base for x, y, z in rng.integers(0, 64, (60, 3))})
    ids = list(range(len(fps)))
    df = spark.createDataFrame([(i, f.to_bytes(8, "big")) for i, f in zip(ids, fps)], "node long, fp binary")
    pairs = simhash.links(simhash.pigeonhole(df, 2), 2, block)
    got = {r.node: r.root for r in connected_components(pairs).collect()}
    root = ids[:]
    for i in ids:
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert [got.get(i, i) for i in ids] == root


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 12])
def test_bitsliced_classes(radius):
    rng = np.random.default_rng(radius)
    fps = np.packbits(rng.random((700, 64)) < 0.12, axis=1)
    start = np.array([0, 1, 3, 40, 41, 120])
    got = bitslice.classes(start, fps, radius, wide=100)
    bits = np.unpackbits(fps, axis=1).astype(int)
    label = np.arange(700)
    for s, e in zip(start, [*start[1:], 700]):
        near = np.abs(bits[s:e, None] - bits[None, s:e]).sum(2) <= radius
        for i, j in zip(*np.nonzero(near)):
            a, b = label[s + i], label[s + j]
            label[np.isin(label, [a, b])] = min(a, b)
    assert (got == label).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_by_five_words(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for g in range(25):
        words = [f"v{x}" for x in rng.integers(0, 5000, 400)]
        rows.append((n, " ".join(words)))
        for _ in range(3):
            copy = list(words)
            for k in rng.integers(0, 400, 5):  # about 25 of 396 shingles change
                copy[k] = "edited"
            n += 1
            rows.append((n, " ".join(copy)))
        n += 1
    rows += [(1000, None), (1001, " "), (None, rows[0][1]), (None, "nothing like it at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("component_id", "__id", "__th", "gone", "gone_th", "th")})
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 4 * g) for g in range(25)] + [(False, 1000), (True, 0)]
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def word_sets(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return sets


def alike_pairs(sets, least):
    """(resemblance, a, b) of all pairs that share a shingle and resemble each other so much; pairs of empty sets count as equal."""
    where = {}
    for i, s in sets.items():
        for g in s or {None}:
            where.setdefault(g, []).append(i)
    pairs = {(a, b) for g in where.values() for k, b in enumerate(sorted(g)) for a in sorted(g)[:k]}
    out = []
    for a, b in pairs:
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
        if j >= least:
            out.append((j, a, b))
    return out


def brute_near(texts):
    """The smallest id of each group that links at 0.8 or more."""
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for _, a, b in alike_pairs(word_sets(texts), 0.8):
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i for i in texts if top(i) == i}


def test_near_duplicates_against_all_pairs(spark):
    """Of each band of true pairs at least 0.97 are in one group, and groups are those of all pairs but for such losses."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    group = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    pairs = alike_pairs(word_sets(texts), 0.5)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        met = [group[a] == group[b] for j, a, b in pairs if low <= j < high]
        assert sum(met) >= 0.97 * len(met)
    truly = brute_near(texts)
    assert truly <= {i for i in texts if group[i] == i}  # what no pair of 0.8 reaches stays
    met = [group[a] == group[b] for j, a, b in pairs if j < 0.75]
    assert sum(met) <= 0.05 * len(met)  # by way of others


@pytest.mark.parametrize("radius", [3, 8])
def test_forest_holds_classes_together(radius):
    rng = np.random.default_rng(radius)
    fps = np.packbits(rng.random((700, 64)) < 0.12, axis=1)
    start = np.array([0, 1, 3, 40, 41, 120])
    a, b = bitslice.forest(start, fps, radius, radius - 2, wide=100)
    bits = np.unpackbits(fps, axis=1).astype(int)
    assert (np.abs(bits[a] - bits[b]).sum(1) <= radius).all()
    want = bitslice.classes(start, fps, radius, wide=100)
    label = np.arange(700)
    bitslice._union(label, a, b)
    assert (label == want).all() and len(a) == 700 - len(set(want.tolist()))
