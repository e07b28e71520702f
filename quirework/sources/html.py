"""HTML and XHTML as node rows with nested-set columns.

``html_nodes`` parses whole documents in Arrow batches; each node gets its pre-order rank, the
last rank of its subtree, depth, sibling ordinal and parent, so that every later tree operator
is a range or equality predicate inside one document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import spread

MAX_DEPTH = 512
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
BLOCKS = frozenset("address article aside blockquote body caption dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Elements that end an open one of the second set, within the nearest of the third.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "li", "dt", "dd", "caption", "thead", "tbody", "tfoot"}

# Roles of elements; what is not listed is a Container.
ROLES = {
    tag: role
    for role, tags in {
        "Break": "br",
        "Rule": "hr",
        "Sidebar": "aside",
        "Figure": "figure",
        "Caption": "figcaption caption",
        "Paragraph": "p",
        "CodeBlock": "pre",
        "Inline": "span em i cite var dfn strong b code kbd samp font tt sup sub u ins s strike del small mark abbr time q label legend output data ruby rt rp bdi bdo wbr",
        "Heading": "h1 h2 h3 h4 h5 h6",
        "Link": "a",
        "Image": "img",
        "UnorderedList": "ul",
        "OrderedList": "ol",
        "ListItem": "li",
        "BlockQuote": "blockquote",
        "DefinitionList": "dl",
        "DefinitionTerm": "dt",
        "DefinitionDescription": "dd",
        "Table": "table",
        "TableHead": "thead",
        "TableBody": "tbody",
        "TableRow": "tr",
        "TableCell": "td th",
        "Math": "math",
    }.items()
    for tag in tags.split()
}
#: Columns of plain attributes, and the names under which they come.
_NAMES = {"href": ("href",), "src": ("src",), "alt": ("alt",), "id": ("id", "xml:id"), "title": ("title",), "lang": ("lang", "xml:lang"), "epub_type": ("epub:type",), "aria_role": ("role",), "datetime": ("datetime",), "class": ("class",), "style": ("style",)}
_NOWHERE = frozenset(("meta", "link", "base", *RAW))
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
SCHEMA = (
    "doc_key bigint, pre int, `end` int, depth int, sib int, parent_pre int, tag string, role string, level int, text string, "
    "href string, src string, alt string, id string, title string, lang string, epub_type string, aria_role string, datetime string, class string, style string, "
    "list_start int, row_span int, col_span int, is_header_cell boolean, language string, dropcap int, error string"
)
FIELDS = [f.strip().strip("`").split(" ")[0].strip("`") for f in SCHEMA.split(",")]
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_ARROW = [_TYPES[f.strip().rsplit(" ", 1)[1]] for f in SCHEMA.split(",")]
_ALWAYS = ("pre", "end", "depth", "sib", "parent_pre", "tag", "text", "role")
_CODE = re.compile(r"(?:^|\s)lang(?:uage)?-(\S+)")


def _number(value: str | None, least: int) -> int | None:
    """A whole number above a default, else none: defaults aren't kept."""
    try:
        n = int((value or "").strip())
    except ValueError:
        return None
    return n if least < n < 1 << 31 else None


_TOKEN = re.compile(
    r"""<!--(?:.*?-->|[^>]*>?)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"""
    r"""|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class _Builder:
    """Builds the rows of one document token by token."""

    def __init__(self):
        self.rows: list[dict] = []
        self.open: list[tuple[str, int]] = []
        self.children = [0]
        self.head = False
        self.deep = 0

    def feed(self, text: str) -> None:
        at, n = 0, len(text)
        while at < n:
            m = _TOKEN.search(text, at)
            if m is None:
                self.data(text[at:])
                return
            if m.start() > at:
                self.data(text[at : m.start()])
            at = m.end()
            if m["end"]:
                self.close_tag(m["end"].lower())
            elif m["start"]:
                tag, attrs = m["start"].lower(), m["attrs"]
                self.open_tag(tag, attrs)
                if tag in RAW:
                    stop = _RAW_END[tag].search(text, at)
                    at = stop.end() if stop else n
                elif attrs.endswith("/") and tag not in VOID:
                    self.close_tag(tag)
            elif m["cdata"]:
                self.data(m["cdata"], plain=True)

    def _row(self, tag: str, text: str | None) -> dict:
        depth = len(self.open)
        row = {"pre": len(self.rows), "end": len(self.rows), "depth": depth, "sib": self.children[depth], "parent_pre": self.open[-1][1] if self.open else None, "tag": tag, "text": text}
        self.children[depth] += 1
        self.rows.append(row)
        return row

    def _attributes(self, row: dict, tag: str, attrs: dict) -> None:
        for name, keys in _NAMES.items():
            for k in keys:
                if value := (attrs.get(k) or "").strip():
                    row[name] = value
                    break
        if tag == "ol":
            row["list_start"] = _number(attrs.get("start"), 1)
        if tag in ("td", "th"):
            row["row_span"], row["col_span"] = _number(attrs.get("rowspan"), 1), _number(attrs.get("colspan"), 1)
        if tag in ("code", "pre") and (code := _CODE.search(attrs.get("class") or "")):
            row["language"] = code.group(1)

    def _close(self, upto: int) -> None:
        while len(self.open) > upto:
            _, at = self.open.pop()
            self.rows[at]["end"] = len(self.rows) - 1
            self.children.pop()

    def _implied(self, tag: str) -> None:
        if tag in _ENDS_P:
            for i in range(len(self.open) - 1, -1, -1):
                name = self.open[i][0]
                if name in ("table", "button", "td", "th"):
                    break
                if name == "p":
                    self._close(i)
                    break
        if tag in _CLOSES:
            ends, fence = _CLOSES[tag]
            upto = len(self.open)
            for i in range(len(self.open) - 1, -1, -1):
                name = self.open[i][0]
                if name in fence:
                    break
                if name in ends:
                    upto = i
            self._close(upto)

    def open_tag(self, tag: str, text: str) -> None:
        if tag in ("html", "head"):
            self.head = self.head or tag == "head"
            return
        if self.head:
            if tag != "body":
                return
            self.head = False
        if tag in _NOWHERE:
            return
        attrs = {}
        if "=" in text or text.strip("/ "):
            for k, x, y, z in _ATTRIBUTE.findall(text):
                value = x or y or z
                attrs.setdefault(k.lower(), unescape(value) if "&" in value else value)
        if (style := attrs.get("style")) and tag != "br" and _HIDDEN.search(style) or self.deep:
            self.deep += tag not in VOID
            return
        self._implied(tag)
        if len(self.open) > MAX_DEPTH:
            self.deep += tag not in VOID
            return
        row = self._row(tag, None)
        if attrs:
            self._attributes(row, tag, attrs)
        if tag not in VOID:
            self.open.append((tag, row["pre"]))
            self.children.append(0)

    def close_tag(self, tag: str) -> None:
        if tag == "head":
            self.head = False
        if self.head or tag in VOID or tag in _NOWHERE or tag in ("html", "head"):
            return
        if self.deep:
            self.deep -= 1
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                self._close(i)
                return
            if name in ("td", "th", "table") and tag not in ("tr", "table", "tbody", "thead", "tfoot"):
                return

    def data(self, text: str, plain: bool = False) -> None:
        if self.head or self.deep or not (self.open or text.strip()):
            return
        self._row("#text", unescape(text) if "&" in text and not plain else text)


def parse_html(html: str | None) -> list[dict]:
    """Node rows of one document; head, scripts, styles, comments and hidden elements give none.

    Unclosed and misnested elements are repaired by implied end tags, not by adoption. A row has
    the columns that it has a value for, besides those of structure."""
    if not html:
        return []
    builder = _Builder()
    builder.feed(html)
    builder._close(0)
    for row in builder.rows:
        tag = row["tag"]
        row["role"] = "Text" if tag == "#text" else ROLES.get(tag, "Container")
        if row["role"] == "Heading":
            row["level"] = int(tag[1])
        if tag == "th":
            row["is_header_cell"] = True
    return builder.rows


def html_nodes(documents: DataFrame, key: str, html: str, finish: Callable[[list[dict]], list[dict]] | None = None) -> DataFrame:
    """Node rows of every document. Null and empty documents have none; a document that can't
    be parsed has one row that carries the error. finish may rewrite the rows of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):  # a row of input gives hundreds of rows of output
                part = b.slice(start, 256)
                keys: list[int | None] = []
                full: dict[str, list] = {name: [] for name in _ALWAYS}
                sparse: dict[str, list[tuple]] = defaultdict(list)
                for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    try:
                        rows = parse_html(text)
                        rows = finish(rows) if finish else rows
                    except Exception as e:  # noqa: BLE001
                        rows = [{"pre": 0, "end": 0, "depth": 0, "sib": 0, "parent_pre": None, "tag": "#error", "text": None, "role": "Error", "error": f"{type(e).__name__}: {e}"}]
                    first = len(keys)
                    keys += [k] * len(rows)
                    for name, column in full.items():
                        column += [r[name] for r in rows]
                    for i, row in enumerate(rows, first):
                        if len(row) > len(full):
                            for name, value in row.items():
                                if name not in full and value is not None:
                                    sparse[name].append((i, value))
                columns = {"doc_key": keys, **full}
                for name, held in sparse.items():
                    columns[name] = column = [None] * len(keys)
                    for i, value in held:
                        column[i] = value
                yield pa.RecordBatch.from_arrays([pa.array(columns[name], t) if name in columns else pa.nulls(len(keys), t) for name, t in zip(FIELDS, _ARROW, strict=True)], FIELDS)

    return spread(documents.select(documents[key].cast("bigint").alias("doc_key"), documents[html].alias("html"))).mapInArrow(run, SCHEMA)


def stylesheets(documents: DataFrame, key: str, html: str) -> DataFrame:
    """(doc_key, ord, kind, value): hrefs of linked style sheets (link) and bodies of style elements (style), in the
    order of the document. Links of another kind and empty ones are left out."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*>|<style\b[^>]*>.*?</style\s*>)"), F.lit(1))
    each = documents.select(F.col(key).cast("bigint").alias("doc_key"), F.posexplode(found).alias("at", "x"))
    linked = F.lower("x").startswith("<link")
    value = F.when(linked, F.regexp_extract("x", r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)""", 1)).otherwise(F.regexp_extract("x", r"(?is)<style\b[^>]*>(.*?)</style", 1))
    sheet = ~linked | F.col("x").rlike(r"""(?i)\srel\s*=\s*["']?[^"'>]*\bstylesheet\b""")
    kept = each.where(sheet).select("doc_key", "at", F.when(linked, "link").otherwise("style").alias("kind"), value.alias("value")).where("value <> ''")
    return kept.select("doc_key", (F.row_number().over(Window.partitionBy("doc_key").orderBy("at")) - 1).alias("ord"), "kind", "value")
