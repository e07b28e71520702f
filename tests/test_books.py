import pytest

from quirework.sources import books, epub, kfx, mobi

BOOKS = "book_id string, title string, language string, authors array<string>, chapters array<struct<title string, xhtml string>>"


def test_every_format_is_found_and_read(spark, rows, tmp_path):
    page = "<html><body><p>x</p></body></html>"
    made = {"a.epub": epub.build_epub("T", "en", "i", ["A"], [("t", page)]), "b.azw3": mobi.build_azw3({"title": "T", "authors": ["A"]}, [page]), "c.mobi": mobi.build_mobi({"title": "T"}, "<p>y</p>"), "d.kfx": kfx.build_container("CR!1", []), "e.txt": b"plain", "f.epub": b"PK\x03\x04 broken"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in books.opened(spark, str(tmp_path)).collect()}
    assert {k: r.format for k, r in got.items()} == {"a.epub": "epub", "b.azw3": "azw3", "c.mobi": "mobi", "d.kfx": "kfx", "e.txt": None, "f.epub": "epub"}
    assert got["a.epub"].document == got["b.azw3"].document == page and got["c.mobi"].document == "<p>y</p>"
    assert got["d.kfx"].error is None and "unknown" in got["e.txt"].error and got["f.epub"].error
    meta = {r.path.rsplit("/", 1)[1]: r.title for r in books.opened(spark, str(tmp_path / "*.{azw3,epub}"), "metadata").collect()}
    assert meta == {"a.epub": "T", "b.azw3": "T", "f.epub": None}
    assert books.opened(spark, str(tmp_path / "c.mobi"), kind="mobi").count() == 1
    with pytest.raises(ValueError, match="markdown"):
        books.opened(spark, str(tmp_path), kind="markdown")


def test_every_writer(spark, rows):
    note = '<p>a<span epub:type="footnote">n</span></p>'
    own = spark.createDataFrame([("b", "T", "en", ["A"], [("one", note), ("two", note)]), ("n", None, None, None, None)], BOOKS)
    for kind in ("epub", "azw3"):
        files = books.exported(own, kind).withColumnRenamed("book_id", "path")
        assert [r[3] for r in rows(books.read_books(files).where("path = 'b'"))] == [note, note]
    [text] = [bytes(r[1]).decode() for r in rows(books.exported(own, "markdown"))]
    assert "[^1]: n" in text and "[^2]: n" in text and "\n---\n" in text
    with pytest.raises(ValueError, match="mobi"):
        books.exported(own, "mobi")
