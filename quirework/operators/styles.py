"""Stylesheets against node rows: selector matching, the cascade, inheritance, style dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import css
from quirework.operators.grouped import per_document
from quirework.operators.ranks import numbered

RULES = "sheet string, rule int, origin string, selector string, ids int, classes int, elements int, property string, value string, important boolean"


def parse_stylesheets(sheets: DataFrame) -> DataFrame:
    """(sheet, rule, origin, selector, ids, classes, elements, property, value, important) of sheets(sheet, origin, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in RULES.split(",")]
        for b in batches:
            out = []
            for sheet, origin, text in zip(*(b.column(c).to_pylist() for c in ("sheet", "origin", "text")), strict=True):
                for i, (selector, body) in enumerate(css.rules(text)):
                    out += [(sheet, i, origin, selector, *css.specificity(selector), *d) for d in css.declarations(body)]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            s, i32 = pa.string(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (s, i32, s, s, i32, i32, i32, s, s, pa.bool_()), strict=True)], names)

    return sheets.select("sheet", "origin", "text").mapInArrow(run, RULES)


def winning(candidates: DataFrame, *element: str) -> DataFrame:
    """Of each element and property the declaration that wins: importance, origin (turned round
    where important), specificity, order. candidates(element, property, value, important,
    origin_rank, ids, classes, elements, ord)."""
    origin = F.when(F.col("important"), -F.col("origin_rank")).otherwise(F.col("origin_rank"))
    key = F.struct("important", origin.alias("o"), "ids", "classes", "elements", "ord")
    return candidates.groupBy(*element, "property").agg(F.max_by("value", key).alias("value"))


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+|\[[^\]]*\]|:[\w-]+(?:\([^)]*\))?)*)")


def _compile(selector: str) -> list[tuple[str, str | None, list[tuple[str, str]]]] | None:
    """(combinator, tag, tests) from the right; none if there is something unknown in it."""
    tokens = re.findall(r"\s*[>+~]\s*|\s+|[^\s>+~]+", selector.strip())
    out, combinator = [], ""
    for t in tokens:
        if not t.strip():
            combinator = combinator.strip() and combinator or " "
        elif t.strip() in (">", "+", "~"):
            combinator = t.strip()
        else:
            m = _SIMPLE.fullmatch(t)
            if not m:
                return None
            tests = [(x[0], x[1:]) for x in re.findall(r"[#.][\w-]+|\[[^\]]*\]|:[\w-]+(?:\([^)]*\))?", m.group(2))]
            out.append((combinator, m.group(1) if m.group(1) not in (None, "*") else None, tests))
            combinator = ""
    return out[::-1]


def _tests(node: dict, tests: list[tuple[str, str]], siblings: list[dict]) -> bool:
    for kind, what in tests:
        if kind == "#" and node["id"] != what:
            return False
        if kind == "." and what not in (node["class"] or "").split():
            return False
        if kind == "[":
            m = re.fullmatch(r"([\w:-]+)(?:([~|^$*]?=)['\"]?([^'\"\]]*)['\"]?)?\]", what)
            have = node.get(m.group(1).replace(":", "_")) if m else None
            if have is None:
                return False
            op, want = m.group(2), m.group(3) or ""
            if op and not {"=": have == want, "~=": want in have.split(), "^=": have.startswith(want), "$=": have.endswith(want), "*=": want in have, "|=": have == want or have.startswith(want + "-")}[op]:
                return False
        if kind == ":":
            at = [x["pre"] for x in siblings].index(node["pre"]) if siblings else 0
            nth = re.fullmatch(r"nth-child\((\d+)\)", what)
            if what == "first-child":
                ok = at == 0
            elif what == "last-child":
                ok = at == len(siblings) - 1
            elif nth:
                ok = at == int(nth.group(1)) - 1
            else:
                return False
            if not ok:
                return False
    return True


def _bucket(selector: list) -> tuple[str, str]:
    """Under which feature of an element a compiled selector is kept: an id, a class, a tag, or all."""
    _, tag, tests = selector[0]
    for kind in "#.":
        for k, what in tests:
            if k == kind:
                return kind, what
    return ("t", tag) if tag else ("*", "")


def _above(selector: list) -> frozenset[tuple[str, str]]:
    """Features that the ancestors of an element must have among them for a compiled selector to fit."""
    out, up = set(), True
    for i, (_, tag, tests) in enumerate(selector):
        if i and up:
            out |= {(k, what) for k, what in tests if k in "#."} | ({("t", tag)} if tag else set())
        up = selector[i][0] in (">", " ", "") if i + 1 < len(selector) else up
        if not up:
            break
    return frozenset(out)


def features(node: dict) -> set[tuple[str, str]]:
    """The id, the classes and the tag of an element."""
    own = {("t", node["tag"])} | {(".", c) for c in (node["class"] or "").split()}
    return own | {("#", node["id"])} if node["id"] else own


def matches(selector: list, node: dict, by: dict[int, dict], kids: dict[int | None, list[dict]]) -> bool:
    """Whether a compiled selector fits a node of one document."""

    def fits(i: int, n: dict) -> bool:
        _, tag, tests = selector[i]
        if tag is not None and n["tag"] != tag or not _tests(n, tests, kids.get(n["parent_pre"], [])):
            return False
        if i == len(selector) - 1:
            return True
        how = selector[i][0] or " "
        if how in ("+", "~"):
            line = kids.get(n["parent_pre"], [])
            at = [x["pre"] for x in line].index(n["pre"])
            return any(fits(i + 1, x) for x in (line[at - 1 : at] if how == "+" else line[:at]))
        up = by.get(n["parent_pre"])
        while up is not None:
            if fits(i + 1, up):
                return True
            if how == ">":
                return False
            up = by.get(up["parent_pre"])
        return False

    return fits(0, node)


def cascade(nodes: DataFrame, author: str, user_agent: str = css.DEFAULTS) -> DataFrame:
    """(doc_key, pre, property, value): the computed style of every element.

    One document is matched and cascaded in one task, documents are spread over tasks. The style
    sheets are parameters of the query; their rules are kept by the rightmost id, class or tag, so an element
    meets only those of its own features, and of them only those whose ancestors it has. Order of weight: browser, author, inline, important;
    inherited properties come from the nearest element above, font-size as rem."""
    sheets = [(0, *r) for r in css.rules(user_agent)] + [(1, *r) for r in css.rules(author)]
    compiled = [(o, c, css.specificity(sel), css.declarations(body), i, _above(c)) for i, (o, sel, body) in enumerate(sheets) if (c := _compile(sel))]
    buckets: dict[tuple[str, str], list] = {}
    for x in compiled:
        buckets.setdefault(_bucket(x[1]), []).append(x)

    def work(key: int, rows: list[dict]) -> list[tuple]:
        nodes = [r for r in rows if r["tag"] != "#text"]
        by = {n["pre"]: n for n in nodes}
        kids: dict[int | None, list[dict]] = {}
        for n in nodes:
            kids.setdefault(n["parent_pre"], []).append(n)
        styles: dict[int, dict[str, str]] = {}
        higher: dict[int | None, frozenset] = {None: frozenset()}
        out = []
        for n in nodes:
            best: dict[str, tuple] = {}
            own, above = features(n), higher[n["parent_pre"]]
            higher[n["pre"]] = above | own if kids.get(n["pre"]) else above
            near = [x for f in (*own, ("*", "")) for x in buckets.get(f, ()) if x[5] <= above]
            found = [((imp, -o if imp else o, *spec, i), p, v) for o, c, spec, ds, i, _ in near if matches(c, n, by, kids) for p, v, imp in ds]
            found += [((imp, 2, 9, 9, 9, 1 << 30), p, v) for p, v, imp in css.declarations(n["style"])]
            for order, p, v in found:
                if p not in best or order >= best[p][0]:
                    best[p] = (order, v)
            above = styles.get(n["parent_pre"], {"font-size": "1rem"})
            own = {p: v for p, v in above.items() if p in css.INHERITED} | {p: v for p, (_, v) in best.items() if v != "inherit"}
            own["font-size"] = f"{font_size(best['font-size'][1] if 'font-size' in best else None, above['font-size']):g}rem"
            styles[n["pre"]] = own
            out += [(key, n["pre"], p, v) for p, v in sorted(own.items())]
        return out

    cols = ["doc_key", "pre", "parent_pre", "tag", "id", "class", "style", "href", "src", "lang", "epub_type", "title"]
    return per_document(nodes, cols, work, "doc_key bigint, pre int, property string, value string")


def font_size(value: str | None, parent: str) -> float:
    """An absolute size in rem: em and % of the parent's, px by 16, the parent's where nothing is said."""
    above = float(parent[:-3])
    got = css.length(value) if value else None
    if got is None or got[1] is None:
        return above
    unit, n = got
    return {"em": n * above, "%": n * above / 100, "px": n / 16, "rem": n}[unit]


def intern(styles: DataFrame, *fields: str, order: str) -> DataFrame:
    """(fields, style_id): a number for each distinct style by first appearance, from 1."""
    first = styles.groupBy(*fields).agg(F.min(order).alias("__first"))
    return numbered(first, "__first", *fields, name="style_id").withColumn("style_id", F.col("style_id") + 1).drop("__first")


def dominant(texts: DataFrame, value: str, weight: str) -> DataFrame:
    """(value, scale): the value that most text has, and by what to scale if it is off by more than 2 %."""
    best = texts.groupBy(value).agg(F.sum(weight).alias("w")).orderBy(F.desc("w"), value).limit(1)
    inverse = F.least(F.greatest(1 / F.col(value), F.lit(0.5)), F.lit(2.0))
    return best.select(value, F.when(F.abs(F.col(value) - 1) > 0.02, inverse).otherwise(1.0).alias("scale"))


def collapsed_margin(margins: DataFrame, group: str, value: str) -> DataFrame:
    """(group, margin): the largest positive plus the smallest negative margin of an adjoining set."""
    return margins.groupBy(group).agg((F.max(F.greatest(value, F.lit(0.0))) + F.min(F.least(value, F.lit(0.0)))).alias("margin"))


def candidate_rules(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """(element, rule): each element's rules by its features. elements(element, id, class, tag), rules(rule, kind, name):
    kind is #, ., t or * for all. An equality join on features; the rest of a selector is tested after it."""
    classes = F.transform(F.filter(F.split(F.coalesce("class", F.lit("")), r"\s+"), lambda c: c != ""), lambda c: F.struct(F.lit(".").alias("kind"), c.alias("name")))
    one = lambda kind, c: F.when(c.isNotNull(), F.array(F.struct(F.lit(kind).alias("kind"), c.alias("name")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))
    own = F.concat(one("#", F.col("id")), classes, one("t", F.col("tag")), one("*", F.lit("")))
    return elements.select("element", F.explode(own).alias("f")).select("element", "f.kind", "f.name").join(rules, ["kind", "name"]).select("element", "rule").distinct()


def predicates(style: DataFrame) -> DataFrame:
    """Adds is_bold, is_italic, is_underline, is_strike, is_sub, is_sup, is_monospace, is_small_caps of the columns
    font_weight, font_style, text_decoration, vertical_align, font_family, font_variant."""
    c = lambda name: F.coalesce(F.lower(name), F.lit(""))
    weight = F.when(c("font_weight").isin("bold", "bolder"), 700).otherwise(F.coalesce(F.expr("try_cast(font_weight as int)"), F.lit(400)))
    return style.withColumns(
        {
            "is_bold": weight >= 700,
            "is_italic": c("font_style").isin("italic", "oblique"),
            "is_underline": c("text_decoration").contains("underline"),
            "is_strike": c("text_decoration").contains("line-through"),
            "is_sub": c("vertical_align") == "sub",
            "is_sup": c("vertical_align") == "super",
            "is_monospace": c("font_family").contains("mono") | c("font_family").contains("courier"),
            "is_small_caps": c("font_variant") == "small-caps",
        }
    )


def dominant_line_height(texts: DataFrame, value: str, weight: str, base: float = 1.2, within: float = 0.02) -> DataFrame:
    """(value, scale): the line height that most text has, and by what to divide to get the base if it is off by more than within."""
    best = texts.groupBy(value).agg(F.sum(weight).alias("w")).orderBy(F.desc("w"), value).limit(1)
    return best.select(value, F.when(F.abs(F.col(value) / base - 1) > within, F.lit(base) / F.col(value)).otherwise(1.0).alias("scale"))


def difference(computed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_key, pre, property, value): what a node's style says that it wouldn't inherit anyhow.

    computed(doc_key, pre, property, value), nodes(doc_key, pre, parent_pre)."""
    up = computed.select("doc_key", F.col("pre").alias("parent_pre"), "property", F.col("value").alias("above"))
    own = computed.join(nodes.select("doc_key", "pre", "parent_pre"), ["doc_key", "pre"])
    same = F.col("value").eqNullSafe(F.col("above")) & F.col("property").isin(*sorted(css.INHERITED))
    return own.join(up, ["doc_key", "parent_pre", "property"], "left").where(~same).select("doc_key", "pre", "property", "value")


def remapped(uses: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds global_id: what (chapter, local_id) stands for in the whole book, 0 where nothing is known."""
    return uses.join(mapping.select("chapter", "local_id", "global_id"), ["chapter", "local_id"], "left").withColumn("global_id", F.coalesce("global_id", F.lit(0)))


def hints(nodes: DataFrame) -> DataFrame:
    """(doc_key, pre, property, value): declarations that attributes of old HTML stand for.

    nodes(doc_key, pre, tag, align, valign, size, color, face, bgcolor, width, height): align and valign of any
    element, size, color and face of font, bgcolor of any, width and height of tables, cells and images."""
    sizes = F.create_map(*[F.lit(x) for k, v in {"1": "x-small", "2": "small", "3": "medium", "4": "large", "5": "x-large", "6": "xx-large", "7": "xx-large"}.items() for x in (k, v)])
    relative = F.when(F.col("size").startswith("+"), "larger").when(F.col("size").startswith("-"), "smaller")
    font = F.lower("tag") == "font"
    boxed = F.lower("tag").isin("table", "td", "th", "img", "col", "colgroup", "hr")
    long = lambda c: F.when(F.col(c).rlike(r"^\s*\d+\s*$"), F.concat(F.trim(c), F.lit("px"))).when(F.col(c).rlike(r"^\s*\d+%\s*$"), F.trim(c))
    rules = {
        "text-align": F.when(F.lower("align").isin("left", "right", "center", "justify"), F.lower("align")),
        "vertical-align": F.when(F.lower("valign").isin("top", "middle", "bottom", "baseline"), F.lower("valign")),
        "font-size": F.when(font, F.coalesce(relative, sizes[F.trim("size")])),
        "color": F.when(font, F.col("color")),
        "font-family": F.when(font, F.col("face")),
        "background-color": F.col("bgcolor"),
        "width": F.when(boxed, long("width")),
        "height": F.when(boxed, long("height")),
    }
    listed = F.array(*[F.struct(F.lit(k).alias("property"), v.alias("value")) for k, v in rules.items()])
    return nodes.select("doc_key", "pre", F.explode(F.filter(listed, lambda d: d["value"].isNotNull())).alias("d")).select("doc_key", "pre", "d.property", "d.value")


def margin_sets(nodes: DataFrame) -> DataFrame:
    """(doc_key, set, margin): vertical margins of blocks that touch, collapsed into one.

    nodes(doc_key, pre, end, depth, parent_pre, sib, top, bottom, closed): closed tells of a border or padding that
    keeps a block's own margins from its children's. A block's bottom meets the top of the next sibling; the top of
    a first and the bottom of a last child meet those of an open parent. A set is named by its first edge's place."""
    def work(key: int, rows: list[dict]) -> list[tuple]:
        by = {r["pre"]: r for r in rows}
        root: dict[tuple[int, str], tuple[int, str]] = {}

        def find(x: tuple[int, str]) -> tuple[int, str]:
            while root.get(x, x) != x:
                x = root[x]
            return x

        def meet(a: tuple[int, str], b: tuple[int, str]) -> None:
            a, b = sorted((find(a), find(b)))
            root[b] = a

        last: dict[int | None, int] = {}
        for r in rows:
            at = (r["pre"], "a")
            parent = by.get(r["parent_pre"])
            if r["parent_pre"] in last:
                meet((last[r["parent_pre"]], "z"), at)
            elif parent is not None and not parent["closed"]:
                meet((parent["pre"], "a"), at)
            last[r["parent_pre"]] = r["pre"]
        for parent, kid in last.items():
            if parent is not None and parent in by and not by[parent]["closed"]:
                meet((parent, "z"), (kid, "z"))
        sets: dict[tuple[int, str], list[float]] = {}
        for r in rows:
            for side, c in (("a", "top"), ("z", "bottom")):
                sets.setdefault(find((r["pre"], side)), []).append(r[c] or 0.0)
        return [(key, f"{at}{side}", max(0.0, *v) + min(0.0, *v)) for (at, side), v in sorted(sets.items())]

    return per_document(nodes, ["doc_key", "pre", "parent_pre", "top", "bottom", "closed"], work, "doc_key bigint, set string, margin double")


def weighted_mode(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """(group, value): the value that most weight of a group has; null counts as the empty text, ties go to the one that sorts last."""
    said = F.coalesce(value, F.lit("")).alias(value)
    n = rows.groupBy(group, said).agg(F.sum(weight).alias("__n"))
    return n.groupBy(group).agg(F.max_by(value, F.struct("__n", value)).alias(value))
