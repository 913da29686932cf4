import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from stacklight.sources import glass as G

NUMBERS = [0, 1, 127, 128, 255, 256, 16383, 16384, 65535, 2**20 - 1, 2**20 + 1, 2**30 - 1, 2**40 + 1, 2**57 - 1, 2**57, 2**64 - 1]


@pytest.mark.parametrize("n", NUMBERS)
def test_numbers(n):
    assert G.unpack_uint(b"x" + G.pack_uint(n), 1)[0] == n
    packed = G.pack_uint_sorted(n)
    assert G.unpack_uint_sorted(packed) == (n, len(packed))
    for cut in (G.pack_uint(n)[:-1], ):
        with pytest.raises(G.GlassError):
            G.unpack_uint(cut)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=2))
def test_sorted_numbers_keep_their_order(ns):
    assert sorted(ns) == [G.unpack_uint_sorted(p)[0] for p in sorted(map(G.pack_uint_sorted, ns))]


@given(st.binary(), st.binary())
def test_strings(a, b):
    data = G.pack_string_sorted(a) + b"\x01"
    assert G.unpack_string_sorted(data) == (a, len(data) - 1)
    assert (G.pack_string_sorted(a) < G.pack_string_sorted(b)) == (a < b)


def test_known_chunk():
    pairs = [(1, 3), (3, 2), (5, 4), (10, 1)]
    data = G.encode_chunk(pairs, True, (4, 10))
    assert data.hex(" ").upper() == "04 0A 00 01 09 01 02 01 04 04 01"
    assert G.decode_chunk(data) == (pairs, True, (4, 10))


def test_long_posting_lists_are_cut_into_chunks():
    rng = random.Random(1)
    pairs = [(d, rng.randint(1, 9)) for d in sorted(rng.sample(range(1, 10**6), 5000))]
    rows = list(G.term_chunks(b"te\0rm", pairs))
    assert len(rows) > 3 and max(len(t) for _, t in rows) < 2 * G.CHUNK and [k for k, _ in rows] == sorted(k for k, _ in rows)
    assert list(G.read_postings(rows)) == [(b"te\0rm", d, n) for d, n in pairs]


def test_numbers_are_packed_all_at_once_and_one_by_one_alike():
    rng = random.Random(5)
    numbers = [rng.randrange(1 << rng.randint(1, 56)) for _ in range(500)] + [0, 127, 128, 2**56 - 1]
    data = b"".join(map(G.pack_uint, numbers))
    assert G.pack_uints(np.array(numbers)) == data and G.unpack_uints(data).tolist() == numbers
    assert G.unpack_uints(data[:-1]) is None and G.unpack_uints(G.pack_uint(1 << 56)) is None
    for top in (50, 1 << 40, 1 << 60):
        pairs = [(d, rng.randint(1, top)) for d in sorted(rng.sample(range(1, 10**6), 300))]
        chunk = G.encode_chunk(pairs, False)
        assert G.decode_chunk(chunk, pairs[0][0])[0] == pairs
        with pytest.raises(G.GlassError):
            G.decode_chunk(chunk[:-1], pairs[0][0])


def test_values_map():
    assert G.parse_values_map("title:0;wordcount:1;geo.position:2") == {"title": 0, "wordcount": 1, "geo.position": 2}
    assert G.parse_values_map("title;wordcount:notanum") == {} == G.parse_values_map("")
    assert G.format_values_map({"b": 1, "a": 0}) == "a:0;b:1"


def test_version():
    v = G.Version(bytes(range(16)), 1)
    v.stats[0], v.stats[6] = 5, 12345
    v.roots[2] = G.Root(7, 2, 20, 8192, 4, b"free")
    assert G.Version.parse(v.encode() + b"rest") == (v, len(v.encode()))
    for bad in (b"invalid", b"", v.encode()[:20]):
        with pytest.raises(G.GlassError):
            G.Version.parse(bad)


def test_one_document():
    data = G.build_database([("hello", 1, 3), ("world", 1, 2)], {1: "C/article.html"}, [(0, 1, "Article")], {"valuesmap": "title:0", "language": "eng"})
    db = G.open_database(data)
    assert db.postings == [("hello", 1, 3), ("world", 1, 2)] and db.docdata == [(1, "C/article.html")]
    assert db.values == [(0, 1, "Article")] and dict(db.metadata) == {"valuesmap": "title:0", "language": "eng"}
    assert db.version.stats[0] == 1 and db.version.stats[6] == 5
    assert G.open_database(G.build_database([], {})).postings == []


def test_trees_of_several_levels_and_long_tags():
    rng = random.Random(2)
    posts = sorted({(f"t{rng.randint(0, 4000)}", d): rng.randint(1, 5) for d in range(1, 400) for _ in range(40)}.items())
    posts = [(t, d, n) for (t, d), n in posts]
    docs = {d: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 30, 9000]))) for d in range(1, 400)}
    data = G.build_database(posts, docs)
    db = G.open_database(data)
    assert sorted(db.postings) == posts and dict(db.docdata) == docs
    assert db.version.roots[0].level >= 1
    with pytest.raises(G.GlassError):
        G.leaf_items(b"\0" * 5)


def test_tables(spark):
    data = G.build_database([("hello", 1, 3), ("hello", 2, 1)], {1: "C/a", 2: "C/b"}, metadata={"kind": "full"})
    blobs = spark.createDataFrame([("x.zim", bytearray(data))], "archive_id string, data binary")
    assert [(r.term, r.doc_id, r.wdf) for r in G.table(blobs, "postings").collect()] == [("hello", 1, 3), ("hello", 2, 1)]
    assert [tuple(r) for r in G.table(blobs, "docdata").collect()] == [("x.zim", 1, "C/a"), ("x.zim", 2, "C/b")]
    assert G.table(blobs, "metadata").first().value == "full" and G.table(blobs, "version").first().total_doc_len == 4
    assert G.term_stats(G.table(blobs, "postings")).first().coll_freq == 4


def test_database_embedded_in_an_archive(spark, tmp_path):
    from tests.test_container import archive

    data = G.build_database([("hello", 1, 3)], {1: "C/a.html"})
    t = archive(spark, tmp_path / "x.zim", [("C", "a.html", "a", "text/html", b"hello", None), ("X", "fulltext/xapian", "", "application/octet-stream+xapian", data, None)])
    found = G.embedded(t["entries"], t["blobs"])
    assert [tuple(r) for r in G.table(found, "postings").collect()] == [(str(tmp_path / "x.zim"), "hello", 1, 3)]
    assert [tuple(r) for r in G.table(found, "docdata").collect()] == [(str(tmp_path / "x.zim"), 1, "C/a.html")]
