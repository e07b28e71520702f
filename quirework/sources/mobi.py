"""MOBI and KF8 (AZW3) files as tables: headers, metadata, text, chapters, parts, images, index rows.

Files come as binaryFile gives them, one row a file; one that can't be read gives one row that carries the
error. Files are written as well, for round trips and as a sink of KF8 books.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from quirework.functions.decoding import lz77_compress, lz77_decompress

NULL = 0xFFFFFFFF
RECORD = 4096
# Kinds of compression, encodings and EXTH records.
COMPRESSION = {1: "None", 2: "PalmDoc", 17480: "Huffman"}
ENCODINGS = {1252: "cp1252", 65001: "utf-8"}
EXTH = {100: "authors", 101: "publisher", 103: "description", 104: "isbn", 105: "subjects", 106: "pub_date", 109: "rights", 112: "source", 113: "asin", 503: "title", 524: "language"}
EXTH_NUMBERS = {121: "kf8_boundary", 201: "cover_offset", 202: "thumbnail_offset"}
_MANY = ("authors", "subjects")
SCHEMAS = {
    "headers": "path string, name string, compression string, text_length bigint, text_records int, record_size int, encryption int, mobi_type int, encoding string, mobi_version int, first_image_index bigint, exth_flags bigint, extra_data_flags int, header_length int, error string",
    "metadata": "path string, title string, authors array<string>, publisher string, description string, isbn string, asin string, source string, subjects array<string>, pub_date string, rights string, language string, cover_offset int, thumbnail_offset int, kf8_boundary int, error string",
    "chapters": "path string, chapter_id int, document string, error string",
    "images": "path string, ord int, media_type string, content binary, error string",
    "index": "path string, kind string, ord int, label string, tag int, values array<bigint>, error string",
}


def varint(raw: bytes, at: int = 0) -> tuple[int, int]:
    """(value, bytes): seven bits a byte, the last one marked by its high bit."""
    value = n = 0
    while at + n < len(raw):
        b = raw[at + n]
        n += 1
        value = value << 7 | b & 0x7F
        if b & 0x80:
            break
    return value, n


def to_varint(value: int) -> bytes:
    out = [value & 0x7F | 0x80]
    while value := value >> 7:
        out.append(value & 0x7F)
    return bytes(reversed(out))


def back_varint(raw: bytes) -> int:
    """A number written so that it's read from the end: up to four bytes, the first one marked."""
    value = 0
    for b in raw[-4:]:
        if b & 0x80:
            value = 0
        value = value << 7 | b & 0x7F
    return value


def to_back_varint(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F)
    out[-1] |= 0x80
    return bytes(reversed(out))


def without_trailers(raw: bytes, flags: int) -> bytes:
    """A text record without the entries behind its text: one for each flag above the first, whose size
    includes itself, and the bytes of a split character, counted in the last two bits."""
    for bit in range(flags.bit_length() - 1, 0, -1):
        if flags >> bit & 1 and raw:
            raw = raw[: max(len(raw) - max(back_varint(raw), 1), 0)]
    return raw[: max(len(raw) - (raw[-1] & 3) - 1, 0)] if flags & 1 and raw else raw


class Huffman:
    """HUFF/CDIC decompression: codes of up to 32 bits name phrases, which may be coded themselves."""

    def __init__(self, huff: bytes, dictionaries: list[bytes]):
        if huff[:4] != b"HUFF":
            raise ValueError("no HUFF record")
        first, second = struct.unpack_from(">II", huff, 8)
        self.quick = struct.unpack_from(">256I", huff, first)
        limits = struct.unpack_from(">64I", huff, second)
        self.low, self.high = [0, *limits[::2]], [0, *limits[1::2]]
        self.phrases: list[tuple[bytes, bool] | None] = []
        for d in dictionaries:
            if d[:4] != b"CDIC":
                raise ValueError("no CDIC record")
            total, bits = struct.unpack_from(">II", d, 8)
            for i in range(min(1 << bits, total - len(self.phrases))):
                at = 16 + struct.unpack_from(">H", d, 16 + 2 * i)[0]
                size = struct.unpack_from(">H", d, at)[0]
                self.phrases.append((d[at + 2 : at + 2 + (size & 0x7FFF)], bool(size & 0x8000)))

    def undo(self, raw: bytes, depth: int = 0) -> bytes:
        if depth > 32:
            raise ValueError("phrases in a circle")
        bits, left, out = int.from_bytes(raw + bytes(8), "big"), len(raw) * 8, bytearray()
        at = (len(raw) + 8) * 8
        while left > 0:
            code = bits >> (at - 32) & NULL
            entry = self.quick[code >> 24]
            n, most = entry & 0x1F, (entry >> 8) + 1
            if n == 0:
                raise ValueError("no such code")
            if entry & 0x80:
                top = (most << (32 - n)) - 1
            else:
                while n < 32 and code < self.low[n] << (32 - n) & NULL:
                    n += 1
                top = (self.high[n] + 1 << (32 - n)) - 1
            left -= n
            at -= n
            if left < 0:
                break
            which = top - code >> (32 - n)
            phrase, plain = self.phrases[which]
            if not plain:
                phrase = self.undo(phrase, depth + 1)
                self.phrases[which] = (phrase, True)
            out += phrase
        return bytes(out)


@dataclass
class Index:
    """Rows of an INDX table: (label, tag to values), and the strings they refer to by offset."""

    rows: list[tuple[str, dict[int, list[int]]]] = field(default_factory=list)
    strings: dict[int, str] = field(default_factory=dict)


class Mobi:
    """One file, opened at one of its headers: that of the old part, or of the KF8 part behind it."""

    def __init__(self, raw: bytes, start: int = 0):
        if raw[60:68] not in (b"BOOKMOBI", b"TEXtREAd"):
            raise ValueError("no MOBI file")
        n = struct.unpack_from(">H", raw, 76)[0]
        offsets = [struct.unpack_from(">I", raw, 78 + 8 * i)[0] for i in range(n)] + [len(raw)]
        if n == 0 or any(a > b for a, b in zip(offsets, offsets[1:], strict=False)):
            raise ValueError("records out of order")
        self.name = raw[:32].split(b"\0")[0].decode("latin-1")
        self.records = [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        self.raw, self.start = raw, start
        self.head = head = self.records[start]
        self.compression, self.text_length, self.text_records, self.record_size, self.encryption = struct.unpack_from(">HxxIHHH", head, 0)
        self.is_mobi = head[16:20] == b"MOBI"
        self.header_length = self._int(20) if self.is_mobi else 0
        self.mobi_type, self.codepage, self.version = (self._int(24), self._int(28), self._int(36)) if self.is_mobi else (2, 1252, 1)
        self.first_image, self.exth_flags = (self._int(108), self._int(128)) if self.is_mobi else (NULL, 0)
        self.extra = struct.unpack_from(">H", head, 242)[0] if self.header_length >= 228 and len(head) >= 244 else 0
        self.encoding = ENCODINGS.get(self.codepage, "cp1252")

    def _int(self, at: int) -> int:
        return struct.unpack_from(">I", self.head, at)[0] if len(self.head) >= at + 4 else NULL

    @property
    def encoding_name(self) -> str:
        return {1252: "Cp1252", 65001: "Utf8"}.get(self.codepage, f"Unknown({self.codepage})")

    def full_name(self) -> str | None:
        at, n = self._int(84), self._int(88)
        return self.head[at : at + n].decode(self.encoding, "replace") if self.is_mobi and at != NULL and at + n <= len(self.head) else None

    def exth(self) -> dict:
        out: dict = {k: [] for k in _MANY}
        at = 16 + self.header_length
        if not self.exth_flags & 0x40 or self.head[at : at + 4] != b"EXTH":
            return out
        count, at = struct.unpack_from(">I", self.head, at + 8)[0], at + 12
        for _ in range(count):
            kind, size = struct.unpack_from(">II", self.head, at)
            if size < 8:
                break
            value = self.head[at + 8 : at + size]
            if kind in EXTH:
                text = value.decode(self.encoding, "replace")
                if EXTH[kind] in _MANY:
                    out[EXTH[kind]].append(text)
                else:
                    out.setdefault(EXTH[kind], text)
            elif kind in EXTH_NUMBERS and len(value) <= 4:
                number = int.from_bytes(value, "big")
                out.setdefault(EXTH_NUMBERS[kind], None if number == NULL else number)
            at += size
        return out

    def kf8(self) -> Mobi | None:
        """The KF8 part of this file: the file itself from version 8 on, else what stands behind its boundary."""
        if self.version >= 8:
            return self
        at = self.exth().get("kf8_boundary")
        if at is not None and 0 < at < len(self.records):
            if self.records[at][16:20] == b"MOBI":
                return Mobi(self.raw, at)
        return None

    def text(self) -> bytes:
        """The whole text; protected files are an error."""
        if self.encryption:
            raise ValueError("protected file")
        pieces = [without_trailers(r, self.extra) for r in self.records[self.start + 1 : self.start + 1 + self.text_records]]
        if self.compression == 2:
            pieces = [lz77_decompress(p) for p in pieces]
        elif self.compression == 17480:
            first, n = self._int(112), self._int(116)
            records = self.records[self.start + first : self.start + first + n]
            huffman = Huffman(records[0], records[1:])
            pieces = [huffman.undo(p) for p in pieces]
        elif self.compression != 1:
            raise ValueError(f"compression {self.compression}")
        return b"".join(pieces)

    def index(self, at: int) -> Index:
        """The table whose first record is at a number that the header names; empty if it names none."""
        if at == NULL or self.start + at >= len(self.records):
            return Index()
        main = self.records[self.start + at]
        if main[:4] != b"INDX":
            raise ValueError("no INDX record")
        length, count, strings = struct.unpack_from(">I", main, 4)[0], struct.unpack_from(">I", main, 24)[0], struct.unpack_from(">I", main, 52)[0]
        if main[length : length + 4] != b"TAGX":
            raise ValueError("no TAGX section")
        size, controls = struct.unpack_from(">II", main, length + 4)
        tags = [tuple(main[i : i + 4]) for i in range(length + 12, length + size, 4)]
        out = Index()
        for record in self.records[self.start + at + 1 : self.start + at + 1 + count]:
            offset, n = struct.unpack_from(">II", record, 20)
            places = list(struct.unpack_from(f">{n}H", record, offset + 4)) + [offset]
            out.rows += [_index_row(record[a:b], tags, controls) for a, b in zip(places, places[1:], strict=False)]
        for i, record in enumerate(self.records[self.start + at + 1 + count : self.start + at + 1 + count + (strings if strings != NULL else 0)]):
            pos = 0
            while pos < len(record):
                n, used = varint(record, pos)
                if n == 0:
                    break
                out.strings[i << 16 | pos] = record[pos + used : pos + used + n].decode(self.encoding, "replace")
                pos += used + n
        return out

    def tables(self) -> dict[str, Index]:
        if self.version >= 8:
            return {"fragments": self.index(self._int(248)), "skeletons": self.index(self._int(252)), "ncx": self.index(self._int(244))}
        return {"ncx": self.index(self._int(244)) if self.header_length >= 232 else Index()}

    def flows(self, text: bytes) -> list[bytes]:
        """The text's flows as FDST cuts them: the book's own first, then style sheets and drawings."""
        at = self._int(192)
        if at == NULL or self.start + at >= len(self.records) or self.records[self.start + at][:4] != b"FDST":
            return [text]
        record = self.records[self.start + at]
        n = struct.unpack_from(">I", record, 8)[0]
        return [text[a:b] for a, b in (struct.unpack_from(">II", record, 12 + 8 * i) for i in range(n))]

    def parts(self) -> list[str]:
        """The documents of a KF8 book: each skeleton with its fragments put in where they belong."""
        raw, tables = self.flows(self.text())[0], self.tables()
        fragments = iter(tables["fragments"].rows)
        out = []
        for _, tags in tables["skeletons"].rows:
            start, size = tags[6][:2]
            text, at = bytearray(raw[start : start + size]), start + size
            for _ in range(tags.get(1, [0])[0]):
                label, own = next(fragments)
                n = own[6][1]
                where = int(label) - start
                text[where:where] = raw[at : at + n]
                at += n
            out.append(bytes(text).decode(self.encoding, "replace"))
        return out or ([raw.decode(self.encoding, "replace")] if raw else [])

    def chapters(self) -> list[str]:
        """The documents of the book: parts of a KF8 one, else pieces between page breaks with their anchors."""
        kf8 = self.kf8()
        return kf8.parts() if kf8 else split_pages(with_anchors(self.text()).decode(self.encoding, "replace"))

    def images(self) -> Iterator[tuple[int, str, bytes]]:
        """(number from 1, media type, content) of the image records."""
        if self.first_image == NULL:
            return
        for i, record in enumerate(self.records[self.first_image :], 1):
            kind = image_type(record)
            if kind:
                yield i, kind, record


def _index_row(raw: bytes, tags: list[tuple[int, int, int, int]], controls: int) -> tuple[str, dict[int, list[int]]]:
    n = raw[0]
    label, at = raw[1 : 1 + n].decode("latin-1"), 1 + n
    flags, at = raw[at : at + controls], at + controls
    which, wanted = 0, []
    for tag, per, mask, end in tags:
        if end:
            which += 1
            continue
        value = flags[which] & mask
        if not value:
            continue
        shift = (mask & -mask).bit_length() - 1
        if mask.bit_count() > 1 and value == mask:
            size, used = varint(raw, at)
            at += used
            wanted.append((tag, per, None, size))
        else:
            wanted.append((tag, per, value >> shift, None))
    out: dict[int, list[int]] = {}
    for tag, per, times, size in wanted:
        values, stop = [], at + size if size is not None else None
        while (stop is not None and at < stop) or (stop is None and len(values) < per * times):
            value, used = varint(raw, at)
            if not used:
                break
            at += used
            values.append(value)
        out[tag] = values
    return label, out


def image_type(raw: bytes) -> str | None:
    for sign, kind in ((b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG", "image/png"), (b"GIF8", "image/gif"), (b"BM", "image/bmp")):
        if raw.startswith(sign):
            return kind
    return None


_FILEPOS = re.compile(rb"""(<a\b[^>]*?)\bfilepos\s*=\s*["']?0*(\d+)["']?""", re.I)
_BREAK = re.compile(r"<\s*/?\s*mbp:pagebreak\b[^>]*>", re.I)


def with_anchors(html: bytes) -> bytes:
    """Links by byte become links to anchors, which are put in where they lead: never inside a tag."""
    places = sorted({int(m.group(2)) for m in _FILEPOS.finditer(html)})
    out, at = [], 0
    for p in places:
        if p > len(html):
            continue
        opened, closed = html.rfind(b"<", 0, p), html.rfind(b">", 0, p)
        cut = opened if opened > closed else p
        cut = max(cut, at)
        out += [html[at:cut], b'<a id="filepos%d"></a>' % p]
        at = cut
    return _FILEPOS.sub(rb'\1href="#filepos\2"', b"".join([*out, html[at:]]))


def split_pages(html: str) -> list[str]:
    """The pieces between page breaks; blank ones are dropped."""
    pieces = [p for p in _BREAK.split(html) if re.sub(r"<[^>]*>|\s|&nbsp;", "", p) or "<img" in p]
    return pieces or ([html] if html.strip() else [])


def link_chapters(chapters: list[str]) -> list[str]:
    """Links to anchors of another chapter name its file, part0000.html and so on; a first anchor counts."""
    where: dict[str, int] = {}
    for i, text in enumerate(chapters):
        for name in re.findall(r'<a id="(filepos\d+)"', text):
            where.setdefault(name, i)

    def turn(i: int, m: re.Match) -> str:
        to = where.get(m.group(1), i)
        return m.group() if to == i else f'href="part{to:04d}.html#{m.group(1)}"'

    return [re.sub(r'href="#(filepos\d+)"', lambda m, i=i: turn(i, m), text) for i, text in enumerate(chapters)]


def mobi_rows(path: str, raw: bytes, table: str) -> Iterator[tuple]:
    """The rows of one file for one table; of a broken file one row with the error."""
    width = SCHEMAS[table].count(", ") + 1 - 2
    try:
        book = Mobi(raw)
        none = lambda x: None if x == NULL else x
        if table == "headers":
            rows = [(book.name, COMPRESSION.get(book.compression, f"Unknown({book.compression})"), book.text_length, book.text_records, book.record_size, book.encryption, book.mobi_type, book.encoding_name, book.version, none(book.first_image), book.exth_flags, book.extra, book.header_length)]
        elif table == "metadata":
            x = book.exth()
            one = lambda k: x.get(k)
            rows = [(one("title") or book.full_name() or book.name, x["authors"], *map(one, ("publisher", "description", "isbn", "asin", "source")), x["subjects"], *map(one, ("pub_date", "rights", "language", "cover_offset", "thumbnail_offset", "kf8_boundary")))]
        elif table == "chapters":
            rows = list(enumerate(link_chapters(book.chapters())))
        elif table == "images":
            rows = list(book.images())
        else:
            rows = [(kind, i, label, tag, values) for kind, ix in (book.kf8() or book).tables().items() for i, (label, tags) in enumerate(ix.rows) for tag, values in sorted(tags.items())]
        for row in rows:
            yield (path, *row, None)
    except (ValueError, KeyError, IndexError, StopIteration, struct.error) as e:
        yield (path, *[None] * width, f"{type(e).__name__}: {e}")


def read_mobi(files: DataFrame, table: str) -> DataFrame:
    """One of the tables headers, metadata, chapters, images or index of files(path, content), as binaryFile gives them."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in SCHEMAS[table].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for r in mobi_rows(p, c or b"", table)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])

    return files.select("path", "content").mapInArrow(run, SCHEMAS[table])


# Writing


def index_records(rows: list[tuple[str, dict[int, list[int]]]], tags: list[tuple[int, int, int]], record: int = 0xF000) -> list[bytes]:
    """INDX records of rows whose tags are (tag, values an entry, mask): the main one with TAGX, then the data."""
    tagx = b"".join(bytes((*t, 0)) for t in tags) + bytes((0, 0, 0, 1))
    bodies: list[list[bytes]] = [[]]
    for label, own in rows:
        flags, data = 0, b""
        for tag, per, mask in tags:
            values = own.get(tag, [])
            if values:
                shift = (mask & -mask).bit_length() - 1
                flags |= (len(values) // per) << shift & mask
                data += b"".join(map(to_varint, values))
        entry = bytes((len(label),)) + label.encode("latin-1") + bytes((flags,)) + data
        if sum(map(len, bodies[-1])) + len(entry) > record:
            bodies.append([])
        bodies[-1].append(entry)

    def header(count: int, idxt: int, total: int) -> bytes:
        return b"INDX" + struct.pack(">IIIIII", 192, 0, 0, 0, idxt, count) + struct.pack(">IIII", 65001, NULL, total, 0) + struct.pack(">III", 0, 0, 0) + bytes(192 - 56)

    out = []
    for body in bodies:
        places, at = [], 192
        for e in body:
            places.append(at)
            at += len(e)
        out.append(header(len(body), at, 0) + b"".join(body) + b"IDXT" + b"".join(struct.pack(">H", p) for p in places))
    main = header(len(bodies), 192 + 12 + len(tagx), len(rows)) + b"TAGX" + struct.pack(">II", 12 + len(tagx), 1) + tagx + b"IDXT"
    return [main, *out]


def _exth(meta: dict) -> bytes:
    rows = [(kind, v.encode()) for kind, name in EXTH.items() for v in (meta.get(name) or [] if name in _MANY else [meta[name]] if meta.get(name) is not None else [])]
    rows += [(kind, struct.pack(">I", meta[name])) for kind, name in EXTH_NUMBERS.items() if meta.get(name) is not None]
    body = b"".join(struct.pack(">II", kind, 8 + len(v)) + v for kind, v in rows)
    whole = b"EXTH" + struct.pack(">II", 12 + len(body), len(rows)) + body
    return whole + bytes(-len(whole) % 4)


def _file(name: str, records: list[bytes]) -> bytes:
    short = re.sub(rb"[^A-Za-z0-9_-]", b"_", name.encode("ascii", "replace"))[:31]
    at = 78 + 8 * len(records) + 2
    head = short.ljust(32, b"\0") + bytes(28) + b"BOOKMOBI" + struct.pack(">IIH", 2 * len(records) + 1, 0, len(records))
    places = b""
    for i, r in enumerate(records):
        places += struct.pack(">II", at, 2 * i)
        at += len(r)
    return head + places + b"\0\0" + b"".join(records)


def _text_records(text: bytes, compress: bool) -> list[bytes]:
    pieces = [text[i : i + RECORD] for i in range(0, len(text), RECORD)]
    return [lz77_compress(p) for p in pieces] if compress else pieces


def _head(meta: dict, text: bytes, records: int, version: int, compress: bool, images_at: int, **more: int) -> bytes:
    title = (meta.get("title") or "").encode()
    exth = _exth(meta)
    head = bytearray(struct.pack(">HHIHHHH", 2 if compress else 1, 0, len(text), records, RECORD, 0, 0) + bytes(248 + 16))
    put = lambda at, value: struct.pack_into(">I", head, at, value)
    head[16:20] = b"MOBI"
    for at, value in ((20, 264), (24, 2), (28, 65001), (36, version), (80, records + 1), (84, 280 + len(exth)), (88, len(title)), (104, version), (108, images_at), (128, 0x50), (192, NULL), (244, NULL), (248, NULL), (252, NULL)):
        put(at, value)
    for name, at in (("fdst", 192), ("fragments", 248), ("skeletons", 252)):
        if name in more:
            put(at, more[name])
    return bytes(head) + exth + title + bytes(2)


def build_mobi(meta: dict, html: str, images: list[bytes] = (), compress: bool = True) -> bytes:
    """An old MOBI file of one text."""
    text = html.encode()
    records = _text_records(text, compress)
    first = len(records) + 1 if images else NULL
    return _file(meta.get("title") or "book", [_head(meta, text, len(records), 6, compress, first), *records, *images])


def body_chunks(body: bytes, most: int = 8192) -> list[bytes]:
    """Pieces of at most so many bytes, cut behind tags where there are any, never inside a tag or a character."""
    out, at = [], 0
    while len(body) - at > most:
        cut = body.rfind(b">", at, at + most) + 1
        if cut <= at:
            cut = at + most
            opened = body.rfind(b"<", at, cut)
            cut = opened if opened > at and body.find(b">", opened, cut) < 0 else cut
            while cut > at + 1 and body[cut : cut + 1] and body[cut] & 0xC0 == 0x80:
                cut -= 1
        out.append(body[at:cut])
        at = cut
    return [*out, body[at:]] if body[at:] or not out else out


def build_azw3(meta: dict, documents: list[str], images: list[bytes] = (), compress: bool = True) -> bytes:
    """A KF8 file: each document is a skeleton, up to and from its body's content, and fragments of that content."""
    text, skeletons, fragments = bytearray(), [], []
    for i, document in enumerate(documents):
        raw = document.encode()
        opened = re.search(rb"<body[^>]*>", raw)
        begin = opened.end() if opened else 0
        end = raw.rfind(b"</body>") if opened and b"</body>" in raw else len(raw)
        skeleton, chunks = raw[:begin] + raw[end:], body_chunks(raw[begin:end])
        start, at = len(text), begin
        text += skeleton
        for chunk in chunks:
            fragments.append((f"{start + at:010d}", {2: [0], 3: [i], 4: [len(fragments)], 6: [at, len(chunk)]}))
            text += chunk
            at += len(chunk)
        skeletons.append((f"SKEL{i:010d}", {1: [len(chunks)], 6: [start, len(skeleton)]}))
    records = _text_records(bytes(text), compress)
    frag = index_records(fragments, [(2, 1, 1), (3, 1, 2), (4, 1, 4), (6, 2, 8)])
    skel = index_records(skeletons, [(1, 1, 3), (6, 2, 12)])
    at = len(records) + 1
    fdst = b"FDST" + struct.pack(">II", 12, 1) + struct.pack(">II", 0, len(text))
    first = at + len(frag) + len(skel) + 1 if images else NULL
    head = _head(meta, bytes(text), len(records), 8, compress, first, fragments=at, skeletons=at + len(frag), fdst=at + len(frag) + len(skel))
    return _file(meta.get("title") or "book", [head, *records, *frag, *skel, fdst, *images])


def to_azw3(books: DataFrame) -> DataFrame:
    """(book_id, content) of books(book_id, title, language, authors, chapters ARRAY<STRUCT<title, xhtml>>): one KF8 file per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("title", "language", "authors", "chapters")]
            files = [build_azw3({"title": t, "language": lang, "authors": a}, [c["xhtml"] or "" for c in ch or []]) for t, lang, a, ch in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("book_id"), pa.array(files, pa.binary())], ["book_id", "content"])

    return books.select("book_id", "title", "language", "authors", "chapters").mapInArrow(run, "book_id string, content binary")


def escaped_html(text: str) -> str:
    """Plain text as paragraphs of HTML."""
    return "".join(f"<p>{escape(x, quote=False)}</p>" for x in text.split("\n") if x.strip())
