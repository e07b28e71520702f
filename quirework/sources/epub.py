"""EPUB files as tables, and tables as EPUB files.

Files come through Spark's binaryFile, from any file system, and ``read_epub`` gives one of the tables
``metadata``, ``spine``, ``toc``, ``landmarks``, ``fonts``, ``assets`` or ``chapters``. A file that can't be read gives one row
that carries the error.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from html import escape
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quirework.functions.decoding import decode_bytes, deobfuscated
from quirework.operators.navigation import LANDMARKS

ENTRY_LIMIT = 512 << 20
SCHEMAS = {
    "metadata": "path string, title string, authors array<string>, language string, identifier string, publisher string, description string, subjects array<string>, date string, rights string, cover string, modified_date string, contributors array<struct<name:string,file_as:string,role:string>>, title_sort string, author_sort string, collection struct<name:string,collection_type:string,position:double>, direction string, error string",
    "landmarks": "path string, ord int, kind string, title string, href string, error string",
    "fonts": "path string, href string, algorithm string, restored boolean, content binary, error string",
    "spine": "path string, chapter_id int, href string, size_estimate bigint, error string",
    "toc": "path string, ord int, parent_ord int, depth int, title string, href string, error string",
    "assets": "path string, href string, media_type string, content binary, length bigint, error string",
    "chapters": "path string, chapter_id int, href string, document string, error string",
}


# How fonts begin.
FONT_STARTS = (b"\x00\x01\x00\x00", b"OTTO", b"true", b"ttcf", b"wOFF", b"wOF2")


def _number(text: str | None) -> float | None:
    try:
        return float(text or "")
    except ValueError:
        return None


def _font_keys(kind: str, identifier: str) -> Iterator[tuple[bytes, int]]:
    """(key, bytes it covers) that an identifier gives."""
    if kind == "idpf":
        yield hashlib.sha1("".join(identifier.split()).encode()).digest(), 1040  # noqa: S324
    else:
        digits = re.sub(r"[^0-9a-fA-F]", "", identifier.rsplit(":", 1)[-1])
        if len(digits) == 32:
            yield bytes.fromhex(digits), 1024


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _local(e) == name]


class Epub:
    """One file, opened; entries are inflated up to a limit."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        container = ElementTree.fromstring(self.read("META-INF/container.xml"))  # noqa: S314
        self.opf_path = _all(container, "rootfile")[0].get("full-path")
        self.opf = ElementTree.fromstring(self.read(self.opf_path))  # noqa: S314
        self.base = posixpath.dirname(self.opf_path)
        self.manifest = {e.get("id"): e for e in _all(self.opf, "item")}

    def read(self, name: str) -> bytes:
        info = self.zip.getinfo(name)
        with self.zip.open(info) as f:
            raw = f.read(ENTRY_LIMIT + 1)
        if len(raw) > ENTRY_LIMIT:
            raise ValueError(f"{name} inflates beyond {ENTRY_LIMIT} bytes")
        return raw

    def full(self, href: str, base: str | None = None) -> str:
        return posixpath.normpath(posixpath.join(self.base if base is None else base, unquote(href)))

    def metadata(self) -> tuple:
        texts = lambda name: [t for e in _all(self.opf, name) if (t := "".join(e.itertext()).strip())]
        one = lambda name: next(iter(texts(name)), None)
        cover = next((i.get("href") for i in self.manifest.values() if "cover-image" in (i.get("properties") or "").split()), None)
        if cover is None:
            old = next((e.get("content") for e in _all(self.opf, "meta") if e.get("name") == "cover"), None)
            cover = self.manifest[old].get("href") if old in self.manifest else None
        own = one("title"), texts("creator"), one("language"), one("identifier"), one("publisher"), one("description"), texts("subject"), one("date"), one("rights"), cover and self.full(cover)
        return (*own, *self.refined())

    def refined(self) -> tuple:
        """(modified_date, contributors, title_sort, author_sort, collection, direction): what refinements say of the
        elements they name; of several of one kind the last counts, author_sort is the first author's."""
        metas = _all(self.opf, "meta")
        said: dict[str, dict[str, str]] = {}
        for e in metas:
            if (e.get("refines") or "").startswith("#") and e.get("property"):
                said.setdefault(e.get("refines")[1:], {})[e.get("property")] = "".join(e.itertext()).strip()
        attribute = lambda e, name: next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)
        of = lambda e, name: said.get(e.get("id") or "", {}).get(name) or attribute(e, name)
        titles, creators = _all(self.opf, "title"), _all(self.opf, "creator")
        named = lambda e: "".join(e.itertext()).strip()
        contributors = [{"name": named(e), "file_as": of(e, "file-as"), "role": of(e, "role")} for e in _all(self.opf, "contributor") if named(e)]
        old = {e.get("name"): e.get("content") for e in metas if e.get("name")}
        group = next((e for e in metas if e.get("property") == "belongs-to-collection"), None)
        collection = None
        if group is not None and named(group):
            collection = {"name": named(group), "collection_type": of(group, "collection-type"), "position": _number(of(group, "group-position"))}
        elif old.get("calibre:series"):
            collection = {"name": old["calibre:series"], "collection_type": "series", "position": _number(old.get("calibre:series_index"))}
        modified = next((named(e) for e in metas if e.get("property") == "dcterms:modified" and not e.get("refines")), None)
        spine = next(iter(_all(self.opf, "spine")), None)
        return (
            modified, contributors, next((x for t in titles[:1] if (x := of(t, "file-as"))), None) or old.get("calibre:title_sort"), next((x for c in creators[:1] if (x := of(c, "file-as"))), None),
            collection, None if spine is None else spine.get("page-progression-direction"),
        )

    def landmarks(self) -> list[tuple]:
        """(ord, kind, title, href): the nav document's landmarks whose kind is known, else the guide's."""
        out: list[tuple] = []
        nav = next((i for i in self.manifest.values() if "nav" in (i.get("properties") or "").split()), None)
        found: list[tuple[str, str, str, str]] = []
        if nav is not None:
            path = self.full(nav.get("href"))
            for n in _all(ElementTree.fromstring(self.read(path)), "nav"):  # noqa: S314
                if any(k.endswith("type") and "landmarks" in v.split() for k, v in n.attrib.items()):
                    for a in _all(n, "a"):
                        types = next((v for k, v in a.attrib.items() if k.endswith("type")), "")
                        found.append((types, "".join(a.itertext()), a.get("href") or "", posixpath.dirname(path)))
        found = found or [(e.get("type") or "", e.get("title") or "", e.get("href") or "", self.base) for e in _all(self.opf, "reference")]
        for types, title, href, base in found:
            kind = next((LANDMARKS[t] for t in types.lower().split() if t in LANDMARKS), None)
            if kind and href:
                out.append((len(out), kind, " ".join(title.split()), "#".join([self.full(href.split("#")[0], base), *href.split("#")[1:]])))
        return out

    def obfuscated(self) -> dict[str, str]:
        """The files that the container says are obfuscated, with the algorithm."""
        try:
            root = ElementTree.fromstring(self.read("META-INF/encryption.xml"))  # noqa: S314
        except KeyError:
            return {}
        out = {}
        for data in _all(root, "EncryptedData"):
            how = next((e.get("Algorithm") for e in _all(data, "EncryptionMethod")), "") or ""
            name = next((e.get("URI") for e in _all(data, "CipherReference")), None)
            kind = "idpf" if "idpf.org" in how else "adobe" if "ns.adobe.com" in how else None
            if name and kind:
                out[posixpath.normpath(unquote(name))] = kind
        return out

    def fonts(self) -> list[tuple]:
        """(href, algorithm, restored, content) of the obfuscated fonts: every identifier of the book is tried, and a
        font counts as restored if it begins as fonts do; else it is given as it is."""
        ids = [t for e in _all(self.opf, "identifier") if (t := "".join(e.itertext()))]
        out = []
        for name, kind in sorted(self.obfuscated().items()):
            if name not in self.zip.namelist():
                continue
            raw = self.read(name)
            tried = (deobfuscated(raw, key, length) for i in ids for key, length in _font_keys(kind, i))
            good = next((x for x in tried if x[:4] in FONT_STARTS), None)
            out.append((name, kind, good is not None, raw if good is None else good))
        return out

    def spine(self) -> list[tuple[str, int]]:
        names = set(self.zip.namelist())
        refs = [self.manifest[r.get("idref")] for r in _all(self.opf, "itemref") if r.get("idref") in self.manifest]
        paths = [self.full(i.get("href")) for i in refs if i.get("href")]
        return [(p, self.zip.getinfo(p).file_size) for p in paths if p in names]

    def toc(self) -> list[tuple]:
        """(ord, parent, depth, title, href); the NCX counts if it has entries, else the nav document."""
        ncx = next((i for i in self.manifest.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
        nav = next((i for i in self.manifest.values() if "nav" in (i.get("properties") or "").split()), None)
        out: list[tuple] = []

        def add(parent: int | None, depth: int, title: str, href: str | None, base: str) -> int:
            target = None if href is None else "#".join([self.full(href.split("#")[0], base), *href.split("#")[1:]])
            out.append((len(out), parent, depth, " ".join(title.split()), target))
            return len(out) - 1

        def points(e: ElementTree.Element, parent: int | None, depth: int, base: str) -> None:
            for p in [x for x in e if _local(x) == "navPoint"]:
                label = "".join(next((x.itertext() for x in p if _local(x) == "navLabel"), []))
                src = next((x.get("src") for x in p if _local(x) == "content"), None)
                points(p, add(parent, depth, label, src, base), depth + 1, base)

        def listed(e: ElementTree.Element, parent: int | None, depth: int, base: str) -> None:
            for li in [x for x in e if _local(x) == "li"]:
                a = next((x for x in li if _local(x) in ("a", "span")), None)
                me = parent if a is None else add(parent, depth, "".join(a.itertext()), a.get("href"), base)
                for ol in [x for x in li if _local(x) == "ol"]:
                    listed(ol, me, depth + 1, base)

        for item, kind in ((ncx, "ncx"), (nav, "nav")):
            if item is None or out:
                continue
            path = self.full(item.get("href"))
            root = ElementTree.fromstring(self.read(path))  # noqa: S314
            base = posixpath.dirname(path)
            if kind == "ncx":
                for m in _all(root, "navMap"):
                    points(m, None, 0, base)
            else:
                for n in _all(root, "nav"):
                    if any(k.endswith("type") and "toc" in v.split() for k, v in n.attrib.items()):
                        for ol in [x for x in n if _local(x) == "ol"]:
                            listed(ol, None, 0, base)
        if not out and self.spine():
            out.append((0, None, 0, "Start", self.spine()[0][0]))
        return out


def epub_rows(path: str, raw: bytes, table: str) -> Iterator[tuple]:
    """The rows of one file for one table; of a broken file one row with the error."""
    width = len(_fields(table)) - 2
    try:
        book = Epub(raw)
        if table == "metadata":
            rows = [book.metadata()]
        elif table == "spine":
            rows = [(i, p, n) for i, (p, n) in enumerate(book.spine())]
        elif table == "toc":
            rows = book.toc()
        elif table == "landmarks":
            rows = book.landmarks()
        elif table == "fonts":
            rows = book.fonts()
        elif table == "chapters":
            rows = [(i, p, decode_bytes(book.read(p), None)) for i, (p, _) in enumerate(book.spine())]
        else:
            names = [i for i in book.zip.infolist() if not i.is_dir()]
            types = {book.full(i.get("href")): i.get("media-type") for i in book.manifest.values() if i.get("href")}
            clear = {name: content for name, _, good, content in book.fonts() if good}
            rows = [(i.filename, types.get(i.filename), clear.get(i.filename) or book.read(i.filename), i.file_size) for i in names]
        for row in rows:
            yield (path, *row, None)
    except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, IndexError, ValueError, OSError) as e:
        yield (path, *[None] * width, f"{type(e).__name__}: {e}")


def load_epub(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of the tables of all files under a path or pattern, on any file system that Spark reads."""
    return read_epub(spark.read.format("binaryFile").load(path), table)


_KINDS = {
    "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
    "array<struct<name:string,file_as:string,role:string>>": pa.list_(pa.struct([("name", pa.string()), ("file_as", pa.string()), ("role", pa.string())])),
    "struct<name:string,collection_type:string,position:double>": pa.struct([("name", pa.string()), ("collection_type", pa.string()), ("position", pa.float64())]),
}


def _fields(table: str) -> list[list[str]]:
    return [f.split(" ") for f in SCHEMAS[table].split(", ")]


def read_epub(files: DataFrame, table: str) -> DataFrame:
    """The same tables out of files(path, content), as Spark's binaryFile gives them, so any file system will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for r in epub_rows(p, c, table)]
            names, types = [n for n, _ in _fields(table)], [_KINDS[k] for _, k in _fields(table)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMAS[table])


def build_epub(title: str, language: str, identifier: str, authors: list[str], chapters: list[tuple[str, str]], stylesheet: str = "") -> bytes:
    """An EPUB 3 of chapters (title, xhtml); equal input gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, text: str, how: int = zipfile.ZIP_DEFLATED) -> None:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = how
            z.writestr(info, text)

        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i:05d}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(chapters)))
        refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
        creators = "".join(f"<dc:creator>{escape(a)}</dc:creator>" for a in authors)
        put("OEBPS/content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(identifier)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{escape(language)}</dc:language>{creators}</metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="css" href="style.css" media-type="text/css"/>{items}</manifest><spine>{refs}</spine></package>')
        links = "".join(f'<li><a href="c{i:05d}.xhtml">{escape(t)}</a></li>' for i, (t, _) in enumerate(chapters))
        put("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        put("OEBPS/style.css", stylesheet)
        for i, (_, text) in enumerate(chapters):
            put(f"OEBPS/c{i:05d}.xhtml", text)
    return out.getvalue()


def to_epub(books: DataFrame) -> DataFrame:
    """(book_id, content) of books(book_id, title, language, authors, chapters ARRAY<STRUCT<title, xhtml>>): one file per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("book_id", "title", "language", "authors", "chapters")]
            files = [build_epub(t or "", lang or "und", k or "", a or [], [(c["title"] or "", c["xhtml"] or "") for c in ch or []]) for k, t, lang, a, ch in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("book_id"), pa.array(files, pa.binary())], ["book_id", "content"])

    return books.select("book_id", "title", "language", "authors", "chapters").mapInArrow(run, "book_id string, content binary")


def repackaged(raw: bytes) -> bytes:
    """A file with its documents and other contents as they are, and the package around them written anew: the type
    first and uncompressed, then the container, the package file, and the rest in the order of their names."""
    book = Epub(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kept = sorted(i.filename for i in book.zip.infolist() if not i.is_dir() and i.filename != "mimetype")
        first = [n for n in ("META-INF/container.xml", book.opf_path) if n in kept]
        for name in ["mimetype", *first, *[n for n in kept if n not in first]]:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, b"application/epub+zip" if name == "mimetype" else book.read(name))
    return out.getvalue()


def packaged(opf: str) -> bytes:
    """A file of nothing but its container and a package file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("META-INF/container.xml"), '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr(zipfile.ZipInfo("p.opf"), opf)
    return out.getvalue()
