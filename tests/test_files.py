import pytest

from stacklight import __main__ as cli
from stacklight.operators import files
from stacklight.streaming import archives
from tests.test_container import GOOD, archive


def test_folder_to_archive_and_back(spark, tmp_path):
    src, out = tmp_path / "site", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    pages = {"index.html": b"<a href='a b+c.txt'>x</a>", "a b+c.txt": "grüße".encode(), "i.png": b"\x89PNG\r\n"}
    for n, b in pages.items():
        (src / n).write_bytes(b)
    (src / "sub" / "deep.html").write_bytes(b"not packed")
    files.pack_folder(spark, str(src), str(tmp_path / "site.zim"))
    got = files.unpack(spark, str(tmp_path / "site.zim"), str(out)).collect()
    assert {r.path for r in got} == set(pages) and all(r.error is None for r in got)
    assert {f.name: f.read_bytes() for f in out.iterdir()} == pages
    head = files.info(spark, str(tmp_path / "site.zim")).first()
    assert (head.entry_count, head.articles, head.main_page, head.major) == (4, 1, 2, 6)


def test_unpack_refuses_paths_that_lead_out(spark, tmp_path):
    archive(spark, tmp_path / "e.zim", [("C", "../evil.txt", "", "text/plain", b"x", None), ("C", "good/x.txt", "", "text/plain", b"y", None), ("C", "/abs.txt", "", "text/plain", b"z", None)])
    got = {r.path: r.error for r in files.unpack(spark, str(tmp_path / "e.zim"), str(tmp_path / "o")).collect()}
    assert got == {"../evil.txt": "leads out of the folder", "good/x.txt": None, "/abs.txt": None}
    assert not (tmp_path / "evil.txt").exists() and (tmp_path / "o" / "good" / "x.txt").read_bytes() == b"y" and (tmp_path / "o" / "abs.txt").exists()


def test_views(spark, tmp_path, capsys):
    path = tmp_path / "good.zim"
    archive(spark, path, GOOD)
    assert {r.path: r.target_path for r in files.dump(spark, str(path), "W").collect()} == {"W/mainPage": None}
    assert files.dump(spark, str(path)).count() == 9
    parts = files.trace(spark, str(path))
    assert {k: df.count() for k, df in parts.items() if k in ("header", "mime_types", "entries", "title_index", "checksum")} == {"header": 1, "mime_types": 4, "entries": 9, "title_index": 3, "checksum": 1}
    for argv in (["info"], ["dump"], ["check"], ["trace"]):
        cli.main([argv[0], str(path), *argv[1:]])
    cli.main(["search", str(path), "href"])
    cli.main(["suggest", str(path), "TEST"])
    text = capsys.readouterr().out
    assert "**href**" in text and "Test archive - Article 1" in text


def test_arriving_archives_are_indexed_once(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for k in range(2):
        archive(spark, inbox / f"a{k}.zim", GOOD[: 2 + k])
        q = archives.index_arrivals(spark, str(inbox), out, str(tmp_path / "cp"))
        q.awaitTermination()
        assert q.exception() is None
        found = spark.read.parquet(f"{out}/entries")
        assert {r.archive_id for r in found.select("archive_id").distinct().collect()} == {f"{tmp_path}/in/a{j}.zim" for j in range(k + 1)}
    assert spark.read.parquet(f"{out}/postings").where("term = 'href'").count() == 4
    assert found.count() == 3 + 4


def test_reading_a_folder_or_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        files.info(spark, str(tmp_path / "nowhere*.zim")).collect()
