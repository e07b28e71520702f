import hashlib
import io
import zipfile

from quirework.functions.decoding import deobfuscated
from quirework.sources import epub

OPF = """<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">
<dc:identifier id="id">urn:uuid:12345678-1234-1234-1234-123456789abc</dc:identifier><dc:title id="t">The Title</dc:title><dc:language>en</dc:language>
<dc:creator id="c1">Ann One</dc:creator><dc:creator id="c2">Bob Two</dc:creator><dc:contributor id="k" opf:file-as="Old, Ed">Ed Old</dc:contributor>
<meta refines="#t" property="file-as">Title, The</meta><meta refines="#c1" property="file-as">One, Ann</meta><meta refines="#c2" property="file-as">Two, Bob</meta>
<meta refines="#k" property="role">aut</meta><meta refines="#k" property="role">edt</meta><meta property="dcterms:modified">2020-01-01T00:00:00Z</meta>
<meta property="belongs-to-collection" id="s">The Series</meta><meta refines="#s" property="collection-type">series</meta><meta refines="#s" property="group-position">2.5</meta></metadata>
<manifest><item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="a" href="text/a%20b.xhtml" media-type="application/xhtml+xml"/><item id="f" href="f.otf" media-type="font/otf"/></manifest>
<spine page-progression-direction="rtl"><itemref idref="a"/></spine></package>"""
NAV = """<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><ol><li><a epub:type="own cover" href="text/a%20b.xhtml#x"> A  cover </a></li>
<li><a epub:type="unknown" href="q"/></li><li><a epub:type="bodymatter" href="text/a%20b.xhtml">Go</a></li></ol></nav></body></html>"""
CRYPT = """<encryption xmlns:enc="http://www.w3.org/2001/04/xmlenc#"><enc:EncryptedData><enc:EncryptionMethod Algorithm="%s"/><enc:CipherData><enc:CipherReference URI="f.otf"/></enc:CipherData></enc:EncryptedData></encryption>"""
FONT = b"OTTO" + bytes(range(256)) * 8


def _file(algorithm, key, length):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", OPF)
        z.writestr("nav.xhtml", NAV)
        z.writestr("text/a b.xhtml", "<p>x</p>")
        z.writestr("META-INF/encryption.xml", CRYPT % algorithm)
        z.writestr("f.otf", deobfuscated(FONT, key, length))
    return out.getvalue()


IDPF = _file("http://www.idpf.org/2008/embedding", hashlib.sha1(b"urn:uuid:12345678-1234-1234-1234-123456789abc").digest(), 1040)
ADOBE = _file("http://ns.adobe.com/pdf/enc#RC", bytes.fromhex("12345678123412341234123456789abc"), 1024)


def test_refined_metadata():
    [row] = epub.epub_rows("f", IDPF, "metadata")
    assert row[-7:-1] == ("2020-01-01T00:00:00Z", [{"name": "Ed Old", "file_as": "Old, Ed", "role": "edt"}], "Title, The", "One, Ann", {"name": "The Series", "collection_type": "series", "position": 2.5}, "rtl")


def test_landmarks():
    assert [r[1:-1] for r in epub.epub_rows("f", IDPF, "landmarks")] == [(0, "Cover", "A cover", "text/a b.xhtml#x"), (1, "BodyMatter", "Go", "text/a b.xhtml")]


def test_fonts():
    for raw, kind in ((IDPF, "idpf"), (ADOBE, "adobe")):
        assert [r[1:-1] for r in epub.epub_rows("f", raw, "fonts")] == [("f.otf", kind, True, FONT)]
        assert {r[1]: r[3] for r in epub.epub_rows("f", raw, "assets")}["f.otf"] == FONT
    wrong = _file("http://www.idpf.org/2008/embedding", b"another key that nobody knows", 1040)
    assert [r[3] for r in epub.epub_rows("f", wrong, "fonts")] == [False]


def test_repackaged():
    again = epub.repackaged(IDPF)
    assert zipfile.ZipFile(io.BytesIO(again)).namelist()[:3] == ["mimetype", "META-INF/container.xml", "p.opf"]
    assert list(epub.epub_rows("f", again, "chapters")) == list(epub.epub_rows("f", IDPF, "chapters"))
    assert epub.repackaged(again) == again


def test_tables(spark, rows):
    files = spark.createDataFrame([("a", bytearray(IDPF)), ("b", bytearray(b"x"))], "path string, content binary")
    for table in epub.SCHEMAS:
        got = epub.read_epub(files, table)
        assert {r["path"] for r in got.where("error is not null").collect()} == {"b"} and epub.read_epub(files.limit(0), table).count() == 0
    assert epub.read_epub(files, "metadata").where("path = 'a'").select("collection.position", "contributors.role").first()[:] == (2.5, ["edt"])
