"""All rewriting passes over one document at a time, where its nodes are made: no shuffle, no step written.

The tree of a document is built from its rows, rewritten in place by the passes in their order, and
numbered again. ``passes`` has those of them that can be told as windows and joins over tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from quirework.operators import grouped, passes
from quirework.sources.html import FIELDS, SCHEMA, html_nodes

_STRUCTURAL, _BLOCK, _INLINE = frozenset(passes.STRUCTURAL), frozenset(passes.BLOCK), frozenset(passes.INLINE)
_PRUNABLE, _WRAPPING = frozenset(passes.PRUNABLE), frozenset(passes.WRAPPING)
_LISTS = frozenset(("UnorderedList", "OrderedList"))
_ATTRIBUTES = ("id", "href", "src", "epub_type")
_FLOAT = re.compile(r"float\s*:\s*(?:left|right)", re.I)
_SIZE = re.compile(r"font-size\s*:\s*([\d.]+)\s*(em|rem|%|px|pt)", re.I)
#: A first letter is a drop cap from so many times its paragraph's size on, with so many letters at most.
CAP_RATIO, CAP_CHARS = 1.6, 3


class Tree:
    """One node, as its row, and the nodes below it."""

    __slots__ = ("kids", "row")

    def __init__(self, row: dict, kids: list[Tree] | None = None):
        self.row, self.kids = row, kids or []

    @property
    def role(self) -> str:
        return self.row["role"]

    @property
    def text(self) -> str:
        return self.row.get("text") or ""

    def blank(self) -> bool:
        return self.role == "Text" and not self.text.strip()

    def attributed(self) -> bool:
        return any(self.row.get(a) is not None for a in _ATTRIBUTES)


def grow(rows: list[dict]) -> Tree:
    """The tree of a document's rows in their order, below a root of its own."""
    root, at = Tree({"role": "Root", "tag": "#root"}), {}
    for row in rows:
        at[row["pre"]] = node = Tree(row)
        at.get(row.get("parent_pre"), root).kids.append(node)
    return root


def rows_of(root: Tree) -> list[dict]:
    """Rows with dense numbers, in document order."""
    out: list[dict] = []
    stack: list[tuple[Tree, int, int | None, int]] = [(k, 0, None, i) for i, k in reversed(list(enumerate(root.kids)))]
    while stack:
        node, depth, parent, sib = stack.pop()
        pre = len(out)
        out.append(node.row | {"pre": pre, "end": pre, "depth": depth, "sib": sib, "parent_pre": parent})
        stack += [(k, depth + 1, pre, i) for i, k in reversed(list(enumerate(node.kids)))]
    for row in reversed(out):
        if row["parent_pre"] is not None:
            out[row["parent_pre"]]["end"] = max(out[row["parent_pre"]]["end"], row["end"])
    return out


def _everywhere(root: Tree, work: Callable[[Tree], None], upwards: bool = False) -> None:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if upwards:
            order.append(node)
        else:
            work(node)
        stack += node.kids
    for node in reversed(order):
        work(node)


def vacuum(node: Tree) -> None:
    if node.role not in _STRUCTURAL:
        return
    kept: list[Tree] = []
    before = False
    for i, kid in enumerate(node.kids):
        if kid.blank() and kid.row.get("id") is None:
            after = i + 1 < len(node.kids) and node.kids[i + 1].role in _INLINE and not node.kids[i + 1].blank()
            if before and after:
                kept.append(kid)
        else:
            before = kid.role in _INLINE
            kept.append(kid)
    node.kids = kept


def merge_spans(node: Tree) -> None:
    kept: list[Tree] = []
    for kid in node.kids:
        if kept and kid.role == kept[-1].role == "Text" and kid.row.get("id") is None:
            kept[-1].row = kept[-1].row | {"text": kept[-1].text + kid.text}
        else:
            kept.append(kid)
    node.kids = kept


def fuse_lists(node: Tree) -> None:
    kept: list[Tree] = []
    for kid in node.kids:
        if kept and kid.role in _LISTS and kept[-1].role == kid.role and not kid.attributed() and kid.row.get("list_start") is None and not kept[-1].attributed():
            kept[-1].kids += kid.kids
        else:
            kept.append(kid)
    node.kids = kept


def wrap_mixed(node: Tree) -> None:
    """Puts each run of inline nodes beside blocks into a Container of its own."""
    if node.role not in _WRAPPING or len({k.role in _INLINE for k in node.kids}) < 2:
        return
    kept: list[Tree] = []
    for kid in node.kids:
        if kid.role not in _INLINE:
            kept.append(kid)
        elif kept and kept[-1].row["tag"] == "#run":
            kept[-1].kids.append(kid)
        else:
            kept.append(Tree({"role": "Container", "tag": "#run", "text": None}, [kid]))
    node.kids = kept


def table_parts(node: Tree) -> None:
    """Rows of a bare table go below a head, as long as all their cells are header cells, and a body."""
    if node.role != "Table" or any(k.role in ("TableHead", "TableBody") for k in node.kids):
        return
    head, body, rest = [], [], []
    for kid in node.kids:
        if kid.role != "TableRow":
            rest.append(kid)
        elif not body and (cells := [c for c in kid.kids if c.role == "TableCell"]) and all(c.row.get("is_header_cell") for c in cells):
            head.append(kid)
        else:
            body.append(kid)
    parts = [Tree({"role": role, "tag": tag, "text": None}, own) for role, tag, own in (("TableHead", "thead", head), ("TableBody", "tbody", body)) if own]
    node.kids = rest + parts


def _flow(node: Tree) -> list[Tree]:
    """The leaves of a block that no block below it owns."""
    out, stack = [], list(reversed(node.kids))
    while stack:
        kid = stack.pop()
        if kid.role in ("Text", "Image", "Math", "Break"):
            out.append(kid)
        elif kid.role not in _BLOCK:
            stack += reversed(kid.kids)
    return out


def trim_edges(node: Tree) -> None:
    if node.role not in passes.TRIMMED:
        return
    leaves = _flow(node)
    solid = [i for i, x in enumerate(leaves) if not x.blank()] or [len(leaves)]
    for i, leaf in enumerate(leaves):
        if leaf.role == "Text":
            text = "" if i < solid[0] or i > solid[-1] else leaf.text
            text = text.lstrip() if i == solid[0] else text
            text = text.rstrip() if i == solid[-1] else text
            leaf.row = leaf.row | {"text": text}


def _size(style: str | None) -> float | None:
    m = _SIZE.search(style or "")
    return float(m.group(1)) / {"em": 1, "rem": 1, "%": 100, "px": 16, "pt": 12}[m.group(2).lower()] if m else None


def dropcaps(node: Tree) -> None:
    """Marks a first inline node that floats in a font far larger than its paragraph's with its lines."""
    first = next((k for k in node.kids if k.role != "Text" or k.text), None)
    if node.role != "Paragraph" or first is None or first.role != "Inline":
        return
    style = first.row.get("style")
    size, chars = _size(style), sum(len(x.text.strip()) for x in _flow(first))
    if size is None or not _FLOAT.search(style) or not 1 <= chars <= CAP_CHARS:
        return
    relative = _SIZE.search(style).group(2).lower() in ("em", "%")
    ratio = size if relative else size / (_size(node.row.get("style")) or 1.0)
    if ratio >= CAP_RATIO:
        first.row = first.row | {"dropcap": min(max(round(ratio), 2), 5)}


def prune(node: Tree) -> None:
    def worth(kid: Tree) -> bool:
        if kid.role == "Text":
            return kid.text != "" or kid.attributed()
        return bool(kid.kids) or kid.role not in _PRUNABLE or kid.attributed()

    node.kids = [k for k in node.kids if worth(k)]


STEPS = ((vacuum, False), (merge_spans, False), (fuse_lists, True), (wrap_mixed, False), (table_parts, False), (trim_edges, False), (dropcaps, False), (prune, True))


def rewritten(rows: list[dict]) -> list[dict]:
    """The rows of one document after all passes; a document that couldn't be parsed stays as it is."""
    if any(r["role"] == "Error" for r in rows):
        return rows
    root = grow(rows)
    for step, upwards in STEPS:
        _everywhere(root, step, upwards)
    return rows_of(root)


def optimised_nodes(documents: DataFrame, key: str, html: str) -> DataFrame:
    """Node rows of every document after all passes, in one stage without a shuffle.

    Null and empty documents have none. A task holds one document's tree at a time."""
    return html_nodes(documents, key, html, finish=rewritten)


def pipeline(nodes: DataFrame) -> DataFrame:
    """The same over nodes that are there already: one shuffle by document."""
    columns = [c for c in FIELDS if c in nodes.columns]

    def work(key: int, rows: list[dict]) -> list[tuple]:
        return [tuple((r | {"doc_key": key}).get(c) for c in FIELDS) for r in rewritten(rows)]

    return grouped.per_document(nodes, columns, work, SCHEMA.replace("`", ""))
