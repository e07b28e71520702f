import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.functions.decoding import lz77_compress, lz77_decompress
from quirework.sources import mobi as M

META = {"title": "Das Öl", "authors": ["A. One", "B. Two"], "subjects": ["x; y"], "publisher": "P", "pub_date": "2020", "asin": "B0", "language": "de", "cover_offset": 0}
PNG = b"\x89PNG\r\n\x1a\n" + bytes(40)


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=400) | st.text(alphabet="ab éю\n", max_size=600).map(str.encode))
def test_compression_round_trip(raw):
    assert lz77_decompress(lz77_compress(raw)) == raw


@given(st.integers(0, 1 << 28 - 1))
def test_varints(n):
    assert M.varint(M.to_varint(n) + b"x") == (n, len(M.to_varint(n))) and M.back_varint(b"ab" + M.to_back_varint(n)) == n


def test_trailers():
    text = "abc".encode()
    assert M.without_trailers(text + b"zz" + M.to_back_varint(3), 2) == text
    assert M.without_trailers(text + b"\x81\x01", 1) == text and M.without_trailers(b"", 3) == b"" and M.without_trailers(text, 0) == text


@pytest.mark.parametrize("compress", [True, False])
def test_old_file(compress):
    html = "<html><body><p>eins é</p><a filepos=0000000072>go</a><mbp:pagebreak/><p>zwei</p>" + "<p>drei</p>" * 900 + "</body></html>"
    raw = M.build_mobi(META, html, [PNG], compress)
    [head] = M.mobi_rows("f", raw, "headers")
    assert head[2] == ("PalmDoc" if compress else "None") and head[3] == len(html.encode()) and head[8] == "Utf8" and head[-1] is None
    [meta] = M.mobi_rows("f", raw, "metadata")
    assert meta[1:3] == ("Das Öl", ["A. One", "B. Two"]) and meta[8] == ["x; y"] and meta[12] == 0
    rows = list(M.mobi_rows("f", raw, "chapters"))
    assert [r[1] for r in rows] == [0, 1] and 'href="part0001.html#filepos72"' in rows[0][2] and rows[1][2].startswith('<a id="filepos72"></a>') or "filepos72" in rows[1][2]
    assert [r[1:4] for r in M.mobi_rows("f", raw, "images")] == [(1, "image/png", PNG)]


def test_kf8_file():
    rng = random.Random(3)
    pages = ["<html><head><title>é</title></head><body class='x'>" + "".join(f"<p>{'wörd ' * rng.randint(1, 60)}</p>" for _ in range(n)) + "</body></html>" for n in (0, 1, 200)] + ["no body", ""]
    raw = M.build_azw3(META, pages)
    assert [r[2] for r in M.mobi_rows("f", raw, "chapters")] == pages
    index = list(M.mobi_rows("f", raw, "index"))
    assert {r[1] for r in index} == {"fragments", "skeletons"} and all(r[-1] is None for r in index)
    assert b"".join(M.body_chunks(pages[2].encode(), 100)) == pages[2].encode() and max(map(len, M.body_chunks(pages[2].encode(), 100))) <= 100
    assert M.body_chunks(b"") == [b""]


def test_huffman():
    """Two phrases under codes of one bit each, one of them coded itself."""
    quick = [(1 | 0x80 | (1 << 8)) if i < 128 else (1 | 0x80 | (1 << 8)) for i in range(256)]
    huff = b"HUFF" + struct.pack(">III", 24, 24, 24 + 1024) + bytes(8) + struct.pack(">256I", *quick) + struct.pack(">64I", *([0, 1] * 32))
    phrases = [b"a", b"bc"]
    table, body = b"", b""
    for p in phrases:
        table += struct.pack(">H", 4 + len(body))
        body += struct.pack(">H", 0x8000 | len(p)) + p
    cdic = b"CDIC" + struct.pack(">III", 16, 2, 1) + table + body
    h = M.Huffman(huff, [cdic])
    assert h.undo(bytes([0b11010000])) == b"aabca" + b"bcbcbcbc"[:0] + b"bc" * 4
    with pytest.raises(ValueError, match="HUFF"):
        M.Huffman(b"xxxx", [])


def test_broken_files(spark, rows):
    good = M.build_azw3(META, ["<body>x</body>"])
    protected = bytearray(M.build_mobi(META, "x"))
    at = struct.unpack_from(">I", protected, 78)[0]
    struct.pack_into(">H", protected, at + 12, 2)
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good[:90])), ("c", bytearray(b"")), ("d", None), ("e", protected)], "path string, content binary")
    got = {r[0]: r[1:] for r in rows(M.read_mobi(files, "chapters"))}
    assert got["a"] == (0, "<body>x</body>", None) and all(got[k][-1] for k in "bcde") and "protected" in got["e"][-1]
    for table in M.SCHEMAS:
        assert M.read_mobi(files.limit(0), table).count() == 0
