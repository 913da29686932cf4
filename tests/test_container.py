import os
import random
import re
import struct

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stacklight.functions import codecs as K
from stacklight.operators import entries as E
from stacklight.operators import integrity as I
from stacklight.sources import container as C
from stacklight.sources import zim
from stacklight.sources.multipart import part_files

HEADER = C.Header(6, 3, bytes(16), 100, 5, 1024, None, 2048, 80, None, None, 5000)


def test_header_round_trip_and_errors():
    assert C.Header.parse(HEADER.encode()) == HEADER
    assert len(HEADER.encode()) == 80
    HEADER.validate(10_000)
    with pytest.raises(C.FormatError):
        C.Header.parse(b"\xef\xbe\xad\xde" + HEADER.encode()[4:])
    with pytest.raises(C.UnsupportedVersion):
        C.Header.parse(HEADER.encode()[:4] + struct.pack("<H", 3) + HEADER.encode()[6:])
    with pytest.raises(C.FormatError):
        C.Header.parse(b"ZIM")
    for change in ({"entry_count": 0}, {"cluster_count": 0}, {"url_ptr_pos": 20_000}, {"main_page": 200}):
        assert C.Header(**{**HEADER.__dict__, **change}).problems(10_000)


@pytest.mark.parametrize(
    "d",
    [
        C.Dirent(0, "C", "index.html", "Home Page", 3, 7), C.Dirent(C.REDIRECT, "C", "old_page", "Old Page", redirect_idx=42),
        C.Dirent(C.LINKTARGET, "C", "x", "", 1, 0xFFFFFFFF), C.Dirent(C.DELETED, "C", "gone", "", 0, 0), C.Dirent(2, "A", "é", "ü" * 3000, 1, 1, extra=b"\1\2\3"),
    ],
)
def test_dirents(d):
    data = b"head" + d.encode() + b"tail"
    assert C.Dirent.parse(data, 4) == (d, len(data) - 8)
    for cut in (5, 11, len(d.encode()) - 1):
        with pytest.raises(C.FormatError):
            C.Dirent.parse(d.encode()[:cut])


def test_mime_list_and_uuid():
    assert C.parse_mime_list(b"") == []
    mimes = ["text/html", "image/png", "text/css", "text/plain"]
    assert C.parse_mime_list(C.encode_mime_list(mimes) + b"more\0") == mimes
    assert [C.mime_of(k, mimes) for k in (0, 10, C.REDIRECT, C.LINKTARGET, C.DELETED)] == ["text/html", "", "redirect", "linktarget", "deleted"]
    text = "12345678-9abc-def0-1234-56789abcdef0"
    assert C.format_uuid(C.parse_uuid(text)) == C.format_uuid(C.parse_uuid(text.replace("-", ""))) == text
    assert C.parse_uuid("") == bytes(16)
    for bad in ("zz345678-9abc-def0-1234-56789abcdef0", "1234"):
        with pytest.raises(C.FormatError):
            C.parse_uuid(bad)


@pytest.mark.parametrize("code", [C.PLAIN, C.ZSTD, C.XZ])
def test_clusters(code):
    blobs = [b"hello", b"", b" world", b"the quick brown fox " * 100]
    raw = C.encode_cluster(blobs, code)
    assert raw[0] & 15 == code and C.parse_cluster(raw) == blobs


def test_bad_clusters():
    for raw in (b"", b"\1", b"\1\3\0\0\0", b"\1" + struct.pack("<II", 8, 99), b"\1" + struct.pack("<III", 12, 4, 12), b"\5not zstd"):
        with pytest.raises(C.FormatError):
            C.parse_cluster(raw)
    with pytest.raises(C.UnsupportedCompression):
        C.parse_cluster(b"\2xxxxxxxx")
    wide = bytes([C.PLAIN | 16]) + struct.pack("<QQ", 16, 18) + b"ab"
    assert C.parse_cluster(wide) == [b"ab"]


GOOD = [
    ("C", "main.html", "Test archive - Main page", "text/html", b"<html><a href='article1.html'>x</a><a href=\"http://x.org\">y</a></html>" * 3, None),
    ("C", "article1.html", "Test archive - Article 1", "text/html", b'<a href="main.html">' + b"x" * 200, None), ("C", "favicon.png", "", "image/png", b"\x89PNG" + bytes(1200), None),
    ("M", "Title", "", "text/plain", b"Test", None), ("M", "Language", "", "text/plain", b"eng", None), ("M", "Illustration_48x48@1", "", "image/png", b"\x89PNG", None),
    ("W", "mainPage", "", None, None, "C/main.html"), ("C", "über", "Übersicht", None, None, "main.html"),
]
SCHEMA = "namespace string, path string, title string, mime string, data binary, redirect_path string"


def archive(spark, path, rows, **options):
    zim.register(spark)
    writer = spark.createDataFrame(rows, SCHEMA).repartition(2).write.format("zim").mode("append")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save(str(path))
    return zim.tables(spark, str(path))


@pytest.fixture(scope="module")
def good(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("zim") / "good.zim"
    return path, archive(spark, path, GOOD, main_path="main.html")


def test_round_trip(spark, good):
    path, t = good
    head = t["archives"].first()
    assert (head.entry_count, head.new_namespace, head.has_checksum, head.has_title_index, head.multipart) == (9, True, True, True, False)
    contents = {(r.namespace, r.path): (r.title, r.mime, bytes(r.data)) for r in E.items(t["entries"], t["blobs"]).collect() if r.namespace != "X"}
    assert contents == {(n, p): (title, m, d) for n, p, title, m, d, to in GOOD if to is None}
    order = [(r.namespace, r.path) for r in t["entries"].orderBy("entry_idx").collect()]
    assert order == sorted(order, key=lambda k: (k[0], k[1].encode()))
    assert {(r.path, r.target_path, r.status) for r in E.resolved(t["entries"]).collect()} == {("mainPage", "main.html", "ok"), ("über", "main.html", "ok")}
    assert E.main_entry(t["archives"], t["entries"]).first().path == "main.html"
    assert E.metadata(t["entries"], t["blobs"]).first().metadata["Language"] == "eng"
    assert E.illustration(t["entries"], 48).count() == 1 and E.illustration(t["entries"], 96).count() == 0
    index = t["title_index"].join(t["entries"], ["archive_id", "entry_idx"]).orderBy("pos").collect()
    assert [r.title for r in index] == ["Test archive - Article 1", "Test archive - Main page", "Übersicht"]
    assert not os.path.exists(str(path) + ".parts") and len(os.listdir(path.parent)) == 1


def test_lookups(spark, good):
    _, t = good
    one = E.by_path(t["entries"], "C/main.html")
    assert [r.path for r in one.collect()] == ["main.html"]
    assert E.by_path(t["entries"], "main.html").count() == 1
    assert E.by_path(t["entries"], "Main.html", strict=True).count() == 0 and E.by_path(t["entries"], "Xylo", strict=True).count() == 0
    assert [r.path for r in E.by_index(t["entries"], 2).collect()] == [t["entries"].orderBy("entry_idx").collect()[2].path]
    assert E.with_prefix(t["entries"], "ma").count() == 2
    assert t["entries"].where("namespace = 'M' and path like 'Ill%'").count() == 1
    reader = zim.ZimReader({"path": str(good[0]), "namespace": "C", "path_is": "main.html"}, None)
    assert [(p.start, p.end) for p in reader.partitions()] == [(2, 3)]
    reader = zim.ZimReader({"path": str(good[0]), "namespace": "C", "path_starts": "ma"}, None)
    assert [(p.start, p.end) for p in reader.partitions()] == [(2, 3)]
    assert [(p.start, p.end) for p in zim.ZimReader({"path": str(good[0]), "namespace": "M"}, None).partitions()] == [(4, 7)]
    assert zim.lookup(spark, str(good[0]), "main.html").first().path == "main.html"
    assert zim.lookup(spark, str(good[0]), "nowhere").count() == 0
    assert bytes(zim.read_item(spark, str(good[0]), "M/Title").first().data) == b"Test"


def test_metadata_reads_its_clusters_only(spark, tmp_path):
    items = [("C", f"a{k}", "", "text/html", b"x" * 2000, None) for k in range(300)] + [("M", "Title", "", "text/plain", b"Many", None), ("M", "Language", "", "text/plain", b"eng", None)]
    path = str(tmp_path / "m.zim")
    archive(spark, path, items, cluster_size="4000")
    assert zim.metadata(spark, path).first().metadata == {"Language": "eng", "Title": "Many"}
    plain = str(tmp_path / "p.zim")
    archive(spark, plain, items[:3])
    assert zim.metadata(spark, plain).count() == 0
    reader = zim.ZimReader({"path": path, "table": "blobs", "cluster": "1,2,90,999"}, None)
    assert [(p.start, p.end) for p in reader.partitions()] == [(1, 3), (90, 91)]
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.num_rows for b in batches] == [2, 2, 2] and sorted(set(batches[2]["cluster"].to_pylist())) == [90]  # one cluster in memory at a time


def test_codecs_hold_single_values(spark):
    docs = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(),), (None,)], "data binary")
    for there, back in ((K.zstd_compress, K.zstd_decompress), (K.xz_compress, K.xz_decompress), (K.lzma_compress, K.lzma_decompress), (K.lzma2_compress, K.lzma2_decompress)):
        out = docs.select(back(there(F.col("data"))).alias("data"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
        assert [r.data and bytes(r.data) for r in out.collect()] == [b"abc", b"", None]


def test_rows_ahead_are_found_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]) if k % 10 else "c", k, rng.choice([None, 1, 2, 3])) for k in rng.sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "archive_id string, entry_idx long, v long").repartition(5)
    got = E.preceded(df, ["archive_id"], F.col("entry_idx"), {"before": "v"}, ["entry_idx", "v"])
    want = df.withColumn("before", F.lag("v").over(Window.partitionBy("archive_id").orderBy("entry_idx")))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    plan = I.offset_errors(df.withColumn("dirent_offset", F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "[archive_id, __range]" in re.sub(r"#\d+", "", plan) and E.preceded(df.limit(0), ["archive_id"], F.col("entry_idx"), {"before": "v"}, ["v"]).count() == 0


def test_own_archives_pass_the_checks(spark, good):
    r = I.report(good[1])
    assert r["summary"].drop("archive_id").first().asDict() == {"broken_links": 0, "redirect_loops": 0, "redundant": 0, "errors": 2, "checksum_ok": True}
    assert "out of order" in r["errors"].first().message  # paths begin anew with M and with X


def test_bad_checksum(spark, good, tmp_path):
    data = good[0].read_bytes()
    bad = tmp_path / "bad.zim"
    bad.write_bytes(data[:-16] + bytes(16))
    t = zim.tables(spark, str(bad))
    assert not I.checksums(t["archives"]).first().ok
    assert t["entries"].count() == 9


def test_parts_and_many_archives(spark, good, tmp_path):
    data = good[0].read_bytes()
    cut = len(data) // 3
    for name, part in (("aa", data[:cut]), ("ab", data[cut : 2 * cut]), ("ac", data[2 * cut :]), ("ae", b"not ours")):
        (tmp_path / f"p.zim{name}").write_bytes(part)
    (tmp_path / "q.zim").write_bytes(data)
    t = zim.tables(spark, f"{tmp_path}/*.zim")
    assert {(r.archive_id, r.multipart) for r in t["archives"].collect()} == {(f"{tmp_path}/p.zim", True), (f"{tmp_path}/q.zim", False)}
    assert t["entries"].count() == 18 and t["blobs"].where("archive_id like '%/p.zim'").count() == 7
    assert len(part_files(f"{tmp_path}/p.zim")) == 3
    assert I.checksums(t["archives"]).where("ok").count() == 2


def test_poor_archive(spark, tmp_path):
    rows = [
        ("C", "a.html", "a", "text/html", b'<a href="nowhere.html"><a href=\'../out.html\'><img src=x.png><a href="#top"><a data-src="b.html"><a href="">', None), ("C", "b.html", "b", "text/html", b"same", None), ("C", "c.html", "c", "text/html", b"same", None),
        ("C", "empty.html", "e", "text/html", b"", None), ("C", "loop1", "", None, None, "loop2"), ("C", "loop2", "", None, None, "loop1"), ("C", "self", "", None, None, "self"), ("C", "tail", "", None, None, "loop1"), ("C", "chain", "", None, None, "ok"), ("C", "ok", "", None, None, "b.html"),
    ]
    t = archive(spark, tmp_path / "poor.zim", rows, compression="xz")
    r = I.report(t)
    assert {x.link for x in r["broken_links"].collect()} == {"nowhere.html", "../out.html", "x.png"}
    idx = {x.path: x.entry_idx for x in t["entries"].collect()}
    assert {x.entry_idx: x.loop for x in r["redirect_loops"].collect()} == {idx["loop1"]: [idx["loop1"], idx["loop2"]], idx["loop2"]: [idx["loop1"], idx["loop2"]], idx["tail"]: [idx["loop1"], idx["loop2"]], idx["self"]: [idx["self"]]}
    assert [(x.first, x.later) for x in r["redundant"].select("first", "later").collect()] == [(idx["b.html"], idx["c.html"])]
    assert "empty content" in r["errors"].where("check = 'empty'").first().message
    assert {x.path: x.status for x in E.resolved(t["entries"]).collect()}["chain"] == "redirect"


def test_report_of_two_archives_at_once(spark, tmp_path):
    rows = [
        ("C", "a.html", "a", "text/html", b'<a href="only_b.html"><a href="a.html">', None), ("C", "b.html", "b", "text/html", b"same", None), ("C", "c.html", "c", "text/html", b"same", None),
        ("C", "loop1", "", None, None, "loop2"), ("C", "loop2", "", None, None, "loop1"), ("C", "tail", "", None, None, "loop1"),
    ]
    good = [("C", "a.html", "a", "text/html", b'<a href="only_b.html">', None), ("C", "only_b.html", "o", "text/html", b"same", None), ("C", "r", "", None, None, "a.html")]
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    for folder, some in (("x", rows), ("y", rows), (".", good)):
        archive(spark, tmp_path / folder / "one.zim", some)
    parts = [zim.tables(spark, str(tmp_path / f / "one.zim")) for f in ("x", "y", ".")]
    t = {k: parts[0][k].unionByName(parts[1][k]).unionByName(parts[2][k]) for k in parts[0]}
    r = I.report(t)
    summary = {s.archive_id.replace(str(tmp_path), "").replace("/./", "/"): s for s in r["summary"].collect()}
    for name, want in (("/x/one.zim", (1, 3, 1)), ("/y/one.zim", (1, 3, 1)), ("/one.zim", (0, 0, 0))):
        s = summary[name]
        assert (s.broken_links, s.redirect_loops, s.redundant, s.checksum_ok) == (*want, True), name
    assert all(x.link == "only_b.html" for x in r["broken_links"].collect())
    assert {tuple(x.loop) for x in r["redirect_loops"].collect()} == {tuple(r["redirect_loops"].first().loop)}
    assert E.by_title(t["entries"], "a").count() == 3


def test_frames_of_clusters_and_values():
    import zstandard

    from stacklight.functions.codecs import inflate
    from stacklight.sources.container import XZ, ZSTD, FormatError, decompress

    frame = lambda x: zstandard.ZstdCompressor().compress(x)
    one, two = b"a" * 1000, b"b" * 50000
    assert inflate(frame(one) + frame(two)) == one + two and inflate(frame(b"")) == b""
    for bad in (b"", frame(two)[:-1], frame(one) + frame(two)[:7], frame(one) + b"trailing"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            inflate(bad)
    with pytest.raises(ValueError, match="more than"):
        inflate(frame(bytes(1 << 24)), 1 << 20)
    assert decompress(ZSTD, frame(one) + b"what comes next") == one
    for code, data in ((ZSTD, frame(two)), (XZ, __import__("lzma").compress(two))):
        with pytest.raises(FormatError):
            decompress(code, data, 100)
        with pytest.raises(FormatError):
            decompress(code, data[:-3])


def test_writer_refuses(spark, tmp_path):
    for rows in ([("C", "a", "", None, None, "missing")], [("C", "a", "", "text/plain", b"1", None), ("C", "a", "", "text/plain", b"2", None)]):
        with pytest.raises(Exception, match="no entry|same namespace"):
            archive(spark, tmp_path / "x.zim", rows)
        assert not (tmp_path / "x.zim").exists()


def test_links_of_all_spellings(spark):
    cases = [
        ("""<a href="x">""", ["x"]), ("""<a href='y z'>""", ["y z"]), ("<a href=u v>", ["u"]), ("<a href=>w", [""]), ("""<a href="open><a href="n">""", ["open><a href="]), ("""<a href='never closed <img src="s">""", ["s"]), ("<img data-src=d>", ["d"]), ("href=q", []), ("""<img src="1"><a href="2">""", ["2", "1"]), (None, []),
    ]
    df = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(cases)], "entry_idx int, html string")
    got: dict = {}
    for r in I.links(df).orderBy("entry_idx", "nr").collect():
        got.setdefault(r.entry_idx, []).append(r.link)
    assert [got.get(k, []) for k in range(len(cases))] == [want for _, want in cases]


def test_dictionary_of_deleted_rows(spark):
    rows = spark.createDataFrame([("content", "C", "b", 1), ("deleted", "C", "a", 2)], "entry_type string, namespace string, title string, entry_idx int").withColumn("path", F.col("title"))
    assert [r.entry_idx for r in E.title_order(rows).collect()] == [1]
