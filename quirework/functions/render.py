"""Node rows of one document as Markdown or XHTML; one document is rendered in one task."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators.grouped import per_document
from quirework.operators.ranks import running_sum

_COLUMNS = ["doc_key", "pre", "parent_pre", "tag", "role", "level", "text", "href", "src", "alt", "id", "title", "epub_type", "class", "list_start", "row_span", "col_span", "is_header_cell", "language"]
_STRONG, _EMPHASIS, _CODE, _STRIKE = ("b", "strong"), ("i", "em", "cite", "var", "dfn"), ("code", "kbd", "samp", "tt"), ("s", "strike", "del")


def _longest(text: str) -> int:
    return max(map(len, re.findall("`+", text)), default=0)


def md_escape(text: str) -> str:
    """Like functions.text.markdown_escape, for text in the middle of a line."""
    text = re.sub(r"([\\*_\[\]`|<>])", r"\\\1", text)
    return re.sub(r"!(?=\\\[)", r"\\!", text)


def _line_start(text: str) -> str:
    text = re.sub(r"(?m)^(#|(?=(?:-+|=+)[ \t]*$)|[-+](?=[ \t]|$))", r"\\\1", text)
    return re.sub(r"(?m)^(\d+)([.)])(?=[ \t]|$)", r"\1\\\2", text)


def destination(href: str) -> str:
    depth, bad = 0, False
    for c in href:
        depth += {"(": 1, ")": -1}.get(c, 0)
        bad = bad or depth < 0
    if bad or depth or re.search(r"[\s\x00-\x1f]", href):
        return "<" + re.sub("([<>])", r"\\\1", href) + ">"
    return href


_EMPTY = dict.fromkeys(_COLUMNS)


class Markdown:
    """A renderer of one document; footnotes are numbered from first and defined at the end."""

    def __init__(self, nodes: list[dict], first: int = 1):
        self.kids: dict[int | None, list[dict]] = {}
        for n in nodes:
            self.kids.setdefault(n["parent_pre"], []).append(_EMPTY | n)
        self.notes: list[str] = []
        self.first = first

    def render(self) -> str:
        body = self.blocks(None)
        notes = [f"[^{self.first + i}]: {x}" for i, x in enumerate(self.notes)]
        return "\n\n".join([body, *notes]).strip() + "\n" if body or notes else ""

    def of(self, n: dict | None) -> list[dict]:
        return self.kids.get(None if n is None else n["pre"], [])

    def plain(self, n: dict) -> str:
        return n["text"] or "" if n["role"] == "Text" else "".join(map(self.plain, self.of(n)))

    def inline(self, nodes: list[dict]) -> str:
        out = []
        for n in nodes:
            role, tag = n["role"], n["tag"]
            if role == "Text":
                out.append(md_escape(re.sub(r"\s+", " ", n["text"].replace("­", "").replace("​", ""))))
            elif role == "Break":
                out.append("\\\n")
            elif role == "Image":
                out.append(f"![{md_escape(n['alt'] or '')}]({destination(n['src'] or '')})")
            elif tag in _CODE:
                text = self.plain(n)
                ticks = "`" * (_longest(text) + 1)
                pad = " " if text.startswith("`") or text.endswith("`") else ""
                out.append(f"{ticks}{pad}{text}{pad}{ticks}" if text else "")
            elif n["epub_type"] == "footnote":
                self.notes.append(self.inline(self.of(n)).strip())
                out.append(f"[^{self.first + len(self.notes) - 1}]")
            else:
                inner = self.inline(self.of(n))
                mark = "**" if tag in _STRONG else "*" if tag in _EMPHASIS else "~~" if tag in _STRIKE else ""
                if role == "Link" and n["href"]:
                    inner = f"[{inner}]({destination(n['href'])})"
                elif mark and inner.strip():
                    lead, rest = inner[: len(inner) - len(inner.lstrip())], inner.strip()
                    inner = lead + mark + rest + mark + inner[len(lead) + len(rest) :]
                out.append(inner)
        return "".join(out)

    def paragraph(self, nodes: list[dict]) -> str:
        return _line_start("\n".join(x.strip() for x in self.inline(nodes).strip().split("\n")))

    def blocks(self, parent: dict | None) -> str:
        out: list[str] = []
        run: list[dict] = []
        last = None

        def flush() -> None:
            if run:
                text = self.paragraph(run)
                if text:
                    out.append(text)
                run.clear()

        for n in self.of(parent):
            if n["role"] in ("Text", "Inline", "Link", "Image", "Break") and n["epub_type"] != "footnote":
                run.append(n)
                continue
            flush()
            text = self.block(n)
            if text:
                if n["role"] == last and n["role"] in ("UnorderedList", "OrderedList"):
                    out.append("<!-- -->")
                out.append(text)
                last = n["role"]
        flush()
        return "\n\n".join(out)

    def block(self, n: dict) -> str:
        role = n["role"]
        if n["epub_type"] == "footnote":
            self.notes.append(self.blocks(n).replace("\n", "\n    "))
            return ""
        if role == "Heading":
            text = self.inline(self.of(n)).strip().replace("\\\n", " ").replace("\n", " ")
            return "#" * int(n["level"]) + " " + text if text else ""
        if role in ("Paragraph", "Caption", "DefinitionTerm"):
            return self.paragraph(self.of(n))
        if role == "Rule":
            return "---"
        if role == "CodeBlock":
            text = self.plain(n).rstrip("\n")
            fence = "`" * (max(_longest(text), 2) + 1)
            code = n["language"] or next((k["language"] for k in self.of(n) if k["language"]), None) or ""
            return f"{fence}{code}\n{text}\n{fence}"
        if role == "BlockQuote":
            inner = self.blocks(n)
            return "\n".join(("> " + x).rstrip() for x in inner.split("\n")) if inner else ""
        if role in ("UnorderedList", "OrderedList"):
            return self.listing(n)
        if role == "DefinitionDescription":
            return ": " + self.blocks(n).replace("\n", "\n  ")
        if role == "Table":
            return self.table(n)
        return self.blocks(n)

    def listing(self, n: dict) -> str:
        items = [k for k in self.of(n) if k["role"] == "ListItem"]
        bodies = [self.blocks(k) for k in items]
        loose = any(sum(x["role"] == "Paragraph" for x in self.of(k)) > 1 or any(x["role"] in ("BlockQuote", "CodeBlock", "Table") for x in self.of(k)) for k in items)
        out, number = [], int(n["list_start"] or 1)
        for body in bodies:
            mark = f"{number}. " if n["role"] == "OrderedList" else "- "
            number += 1
            if not loose:
                body = re.sub(r"\n\n(?=(?:- |\d+\. ))", "\n", body)
            out.append((mark + body.replace("\n", "\n" + " " * len(mark))).rstrip())
        return ("\n\n" if loose else "\n").join(re.sub(r"(?m)^ +$", "", x) for x in out)

    def table(self, n: dict) -> str:
        rows: list[list[dict]] = []
        heads = 0
        caption = ""

        def walk(x: dict, head: bool) -> None:
            nonlocal heads, caption
            for k in self.of(x):
                if k["role"] == "TableRow":
                    cells = [c for c in self.of(k) if c["role"] == "TableCell"]
                    if head or (not rows and cells and all(c["is_header_cell"] for c in cells)):
                        heads = max(heads, len(rows) + 1)
                    rows.append(cells)
                elif k["role"] in ("TableHead", "TableBody"):
                    walk(k, k["role"] == "TableHead")
                elif k["role"] == "Caption":
                    caption = self.paragraph(self.of(k))

        walk(n, False)
        width = max((len(r) for r in rows), default=0)
        if not width:
            return caption
        text = [[re.sub(r"\s*\n+\s*", " ", self.blocks(c)) for c in r] + [""] * (width - len(r)) for r in rows]
        if not heads:
            text.insert(0, [""] * width)
        line = lambda r: "| " + " | ".join(r) + " |"
        out = "\n".join([line(text[0]), line(["---"] * width), *map(line, text[1:])])
        return f"{caption}\n\n{out}" if caption else out


def to_markdown(nodes: DataFrame) -> DataFrame:
    """(doc_key, markdown) of every document."""
    return per_document(nodes, _COLUMNS, lambda k, rows: [(k, Markdown(rows).render())], "doc_key bigint, markdown string")


def numbered_markdown(nodes: DataFrame, chapters: DataFrame) -> DataFrame:
    """(doc_key, book_id, chapter_id, markdown): footnotes are numbered on through the chapters of a book.

    chapters(doc_key, book_id, chapter_id), doc_key unique. The notes of each chapter are counted first,
    and summed by ranges of book and chapter."""
    notes = nodes.where("epub_type = 'footnote'").groupBy("doc_key").agg(F.count("*").alias("notes"))
    counted = chapters.select("doc_key", "book_id", "chapter_id").join(notes, "doc_key", "left").withColumn("notes", F.coalesce("notes", F.lit(0)))
    first = running_sum(counted, "book_id", "chapter_id", "doc_key", value="notes", name="upto").select("doc_key", "book_id", "chapter_id", (F.col("upto") - F.col("notes") + 1).cast("int").alias("first"))
    with_first = nodes.join(first.select("doc_key", "first"), "doc_key", "left")
    done = per_document(with_first, [*_COLUMNS, "first"], lambda k, rows: [(k, Markdown(rows, rows[0]["first"] or 1).render())], "doc_key bigint, markdown string")
    return done.join(first, "doc_key").select("doc_key", "book_id", "chapter_id", "markdown")


# Tags of roles that have one.
TAGS = {"Paragraph": "p", "Link": "a", "Image": "img", "Break": "br", "Rule": "hr", "UnorderedList": "ul", "OrderedList": "ol", "ListItem": "li", "BlockQuote": "blockquote", "CodeBlock": "pre", "Figure": "figure", "Caption": "figcaption", "Sidebar": "aside", "DefinitionList": "dl", "DefinitionTerm": "dt", "DefinitionDescription": "dd", "Table": "table", "TableHead": "thead", "TableBody": "tbody", "TableRow": "tr", "Container": "div", "Inline": "span"}


def xhtml(nodes: list[dict], title: str = "", stylesheet: str | None = None) -> str:
    """A whole XHTML document; a paragraph or heading that holds a block becomes a div."""
    kids: dict[int | None, list[dict]] = {}
    for n in nodes:
        kids.setdefault(n["parent_pre"], []).append(n)
    inline = {"Text", "Inline", "Link", "Image", "Break", "Math"}

    def render(n: dict) -> Iterator[str]:
        if n["role"] == "Text":
            yield escape(n["text"] or "", quote=False)
            return
        own = kids.get(n["pre"], [])
        if n["tag"] in ("body", "html"):
            for k in own:
                yield from render(k)
            return
        if n["role"] == "Heading":
            tag = f"h{int(n['level'])}"
        elif n["role"] == "TableCell":
            tag = "th" if n["is_header_cell"] else "td"
        elif n["role"] == "Inline" and n["tag"] in (*_STRONG, *_EMPHASIS, *_CODE, *_STRIKE, "sub", "sup", "u", "small"):
            tag = n["tag"]
        elif n["role"] == "Caption" and n["tag"] == "caption":
            tag = "caption"
        else:
            tag = TAGS.get(n["role"], "div")
        if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and any(k["role"] not in inline for k in own):
            tag = "div"
        names = {"href": n["href"], "src": n["src"], "alt": n["alt"] if tag != "img" else n["alt"] or "", "id": n["id"], "title": n["title"], "epub:type": n["epub_type"], "class": n["class"], "start": n["list_start"], "rowspan": n["row_span"], "colspan": n["col_span"]}
        attrs = "".join(f' {k}="{escape(str(int(v) if isinstance(v, float) else v))}"' for k, v in names.items() if v is not None)
        if tag in ("br", "hr", "img"):
            yield f"<{tag}{attrs}/>"
            return
        yield f"<{tag}{attrs}>"
        for k in own:
            yield from render(k)
        yield f"</{tag}>"

    body = "".join(x for n in kids.get(None, []) for x in render(n))
    link = f'<link rel="stylesheet" type="text/css" href="{escape(stylesheet)}"/>' if stylesheet else ""
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title>{link}</head><body>{body}</body></html>'


def to_xhtml(nodes: DataFrame) -> DataFrame:
    """(doc_key, xhtml) of every document."""
    return per_document(nodes, _COLUMNS, lambda k, rows: [(k, xhtml(rows))], "doc_key bigint, xhtml string")


def book_markdown(chapters: DataFrame) -> DataFrame:
    """(book_id, markdown): chapters(book_id, chapter_id, markdown) joined in order by rules."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chapter_id", "markdown"))), lambda x: x["markdown"])
    return chapters.groupBy("book_id").agg(F.array_join(parts, "\n---\n\n").alias("markdown"))
