"""Rewriting passes over node rows: each takes nodes and returns nodes. ``rewrite`` runs all in one.

Structure is told by (doc_key, pre, end, depth, parent_pre, sib); windows are partitioned by
document and parent, so no pass sorts more than a document at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRUCTURAL = ("Container", "Root", "Figure", "Sidebar", "UnorderedList", "OrderedList", "DefinitionList", "Table", "TableHead", "TableBody", "TableRow", "BlockQuote", "ListItem", "TableCell", "DefinitionDescription")
BLOCK = (*STRUCTURAL, "Paragraph", "Heading", "CodeBlock", "Rule", "Caption", "DefinitionTerm")
INLINE = ("Text", "Inline", "Link", "Image", "Break", "Math")
PRUNABLE = ("Container", "Inline", "Paragraph", "ListItem", "UnorderedList", "OrderedList", "Figure", "Caption", "BlockQuote", "Sidebar")
WRAPPING = ("Container", "BlockQuote", "ListItem", "TableCell", "Figure", "Sidebar", "DefinitionDescription")
TRIMMED = ("Paragraph", "Heading", "Caption", "ListItem", "DefinitionTerm", "DefinitionDescription", "BlockQuote", "TableCell", "Container", "Sidebar")
_PARENT = ["doc_key", "parent_pre"]
_BLANK = r"(?U)^\s*$"
#: Nodes, about, of a task where a pass is told how many there are.
NODES_A_TASK = 50_000


def blank(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(_BLANK)


def has_attributes() -> Column:
    """Whether a node carries what must not get lost with it."""
    return F.col("id").isNotNull() | F.col("href").isNotNull() | F.col("src").isNotNull() | F.col("epub_type").isNotNull()


def predicates(nodes: DataFrame) -> DataFrame:
    """Adds is_structural, is_block, is_inline, is_prunable, has_attrs."""
    return nodes.withColumns({"is_structural": F.col("role").isin(*STRUCTURAL), "is_block": F.col("role").isin(*BLOCK), "is_inline": F.col("role").isin(*INLINE), "is_prunable": F.col("role").isin(*PRUNABLE), "has_attrs": has_attributes()})


def _shuffled(nodes: DataFrame) -> DataFrame:
    """For joins with the nodes themselves. Spark goes by the size of a stored step's files, and
    nodes compress so well that it would send all of them through the driver to be broadcast."""
    return nodes.hint("merge")


def parts_of(nodes: DataFrame) -> int:
    """Tasks for passes over stored nodes, by how many there are. Spark goes by the size of a shuffle, and
    nodes compress so well that a task's sorts would need many times what it expects."""
    return max(1, -(-nodes.count() // NODES_A_TASK))


def _with_parent_role(nodes: DataFrame, parts: int = 0) -> DataFrame:
    parents = nodes.select("doc_key", F.col("pre").alias("parent_pre"), F.col("role").alias("parent_role"))
    if parts:
        nodes, parents = (x.repartition(parts, *_PARENT) for x in (nodes, parents))
    return nodes.join(_shuffled(parents), _PARENT, "left")


def vacuum(nodes: DataFrame, parts: int = 0) -> DataFrame:
    """Drops blank text under structural parents unless inline content flanks it.

    The flank before is the last sibling that isn't blank text, the one after the next sibling
    as it stands, so of two blanks between inlines exactly one survives."""
    n = _with_parent_role(nodes, parts)
    w = Window.partitionBy(*_PARENT).orderBy("sib")
    empty = (F.col("role") == "Text") & blank("text") & F.col("id").isNull()
    inline = F.col("role").isin(*INLINE)
    before = F.last(F.when(~empty, inline), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(F.when(empty, F.lit(False)).otherwise(inline)).over(w)
    drop = empty & F.coalesce(F.col("parent_role"), F.lit("Root")).isin(*STRUCTURAL) & ~(F.coalesce(before, F.lit(False)) & F.coalesce(after, F.lit(False)))
    return n.withColumn("__drop", drop).where(~F.col("__drop")).drop("__drop", "parent_role")


def merge_spans(nodes: DataFrame) -> DataFrame:
    """Joins adjacent text siblings into the first of them."""
    w = Window.partitionBy(*_PARENT).orderBy("sib")
    joins = (F.col("role") == "Text") & F.col("id").isNull() & (F.lag("role").over(w) == "Text")
    island = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w)
    n = nodes.withColumn("__island", island)
    texts = n.where("role = 'Text'").groupBy(*_PARENT, "__island").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sib", "text"))), lambda x: x["text"]), "").alias("__text"), F.min("pre").alias("pre"))
    kept = n.where("role <> 'Text'").withColumn("__text", F.lit(None).cast("string"))
    first = n.where("role = 'Text'").join(texts.select("doc_key", "pre", "__text"), ["doc_key", "pre"])
    out = kept.unionByName(first)
    return out.withColumn("text", F.coalesce("__text", "text")).select(*nodes.columns)


def fuse_lists(nodes: DataFrame) -> DataFrame:
    """Joins adjacent lists of one kind without attributes: items move to the first list."""
    lists = ("UnorderedList", "OrderedList")
    w = Window.partitionBy(*_PARENT).orderBy("sib")
    same = F.col("role").isin(*lists) & (F.lag("role").over(w) == F.col("role")) & ~has_attributes() & F.col("list_start").isNull() & ~F.coalesce(F.lag(has_attributes()).over(w), F.lit(False))
    n = nodes.withColumn("__joins", F.coalesce(same, F.lit(False)))
    n = n.withColumn("__island", F.sum(F.when(F.col("__joins"), 0).otherwise(1)).over(w))
    island = Window.partitionBy(*_PARENT, "__island")
    n = n.withColumns({"__head": F.min("pre").over(island), "__end": F.max("end").over(island)})
    moved = n.where("__joins").select("doc_key", F.col("pre").alias("parent_pre"), F.col("__head").alias("__to"))
    out = n.where("not __joins").join(_shuffled(moved), _PARENT, "left").withColumn("end", F.when(F.col("role").isin(*lists), F.greatest("end", "__end")).otherwise(F.col("end")))
    order = Window.partitionBy("doc_key", F.coalesce("__to", "parent_pre")).orderBy("pre")
    out = out.withColumn("sib", F.when(F.col("parent_pre").isNull(), F.col("sib")).otherwise(F.row_number().over(order) - 1))
    return out.withColumn("parent_pre", F.coalesce("__to", "parent_pre")).select(*nodes.columns)


def wrap_runs(nodes: DataFrame, parts: int = 0) -> DataFrame:
    """(doc_key, parent_pre, run, first_pre, last_end, nodes): the inline runs of parents that also have block children.

    Each run is what an anonymous Container wraps."""
    n = _with_parent_role(nodes, parts).where(F.col("parent_role").isin(*WRAPPING))
    inline = F.col("role").isin(*INLINE)
    whole = Window.partitionBy(*_PARENT)
    w = whole.orderBy("sib")
    n = n.withColumns({"__inline": inline, "__mixed": F.max(inline.cast("int")).over(whole) + F.max((~inline).cast("int")).over(whole)})
    n = n.where("__mixed = 2").withColumn("run", F.sum(F.when(F.col("__inline") & F.coalesce(F.lag("__inline").over(w), F.lit(False)), 0).otherwise(1)).over(w))
    return n.where("__inline").groupBy(*_PARENT, "run").agg(F.min("pre").alias("first_pre"), F.max("end").alias("last_end"), F.count("*").cast("int").alias("nodes"))


def table_parts(nodes: DataFrame) -> DataFrame:
    """(doc_key, table_pre, row_pre, part): each row of a table without its own thead or tbody is
    head where all of its cells are header cells, else body."""
    tables = nodes.where("role = 'Table'").select("doc_key", F.col("pre").alias("table_pre"), F.col("end").alias("table_end"))
    sectioned = nodes.where("role in ('TableHead', 'TableBody')").select("doc_key", F.col("parent_pre").alias("table_pre")).distinct()
    bare = tables.join(sectioned, ["doc_key", "table_pre"], "left_anti")
    rows = nodes.where("role = 'TableRow'").select("doc_key", F.col("pre").alias("row_pre"), F.col("parent_pre").alias("table_pre"))
    cells = nodes.where("role = 'TableCell'").select("doc_key", F.col("parent_pre").alias("row_pre"), F.coalesce("is_header_cell", F.lit(False)).alias("th"))
    heads = cells.groupBy("doc_key", "row_pre").agg(F.bool_and("th").alias("all_th"))
    return rows.join(bare.select("doc_key", "table_pre"), ["doc_key", "table_pre"]).join(heads, ["doc_key", "row_pre"], "left").select("doc_key", "table_pre", "row_pre", F.when(F.coalesce("all_th", F.lit(False)), "head").otherwise("body").alias("part"))


def trim_edges(nodes: DataFrame) -> DataFrame:
    """Strips white space at both ends of each block's inline flow, up to the first content or atom."""
    leaf = F.col("role").isin("Text", "Image", "Math", "Break")
    blocks = nodes.where(F.col("role").isin(*BLOCK)).select("doc_key", F.col("pre").alias("b_pre"), F.col("end").alias("b_end"), F.col("depth").alias("b_depth"), F.col("role").alias("b_role"))
    owner = nodes.where(leaf).select("doc_key", "pre").join(blocks, "doc_key").where("pre between b_pre and b_end").groupBy("doc_key", "pre").agg(F.max_by(F.struct("b_pre", "b_role"), "b_depth").alias("o"))
    n = nodes.where(leaf).join(owner, ["doc_key", "pre"]).withColumns({"owner": F.col("o.b_pre"), "owner_role": F.col("o.b_role")})
    solid = (F.col("role") != "Text") | ~blank("text")
    whole = Window.partitionBy("doc_key", "owner")
    at = F.when(solid, F.col("pre"))
    n = n.withColumns({"first": F.min(at).over(whole), "last": F.max(at).over(whole)})
    text = F.col("text")
    text = F.when(F.col("first").isNull() | (F.col("pre") < F.col("first")), "").when(F.col("pre") == F.col("first"), F.regexp_replace(text, r"(?U)^\s+", "")).otherwise(text)
    text = F.when(F.col("pre") > F.col("last"), "").when(F.col("pre") == F.col("last"), F.regexp_replace(text, r"(?U)\s+$", "")).otherwise(text)
    trimmed = n.where((F.col("role") == "Text") & F.col("owner_role").isin(*TRIMMED)).select("doc_key", "pre", text.alias("__text"))
    return nodes.join(trimmed, ["doc_key", "pre"], "left").withColumn("text", F.coalesce("__text", "text")).select(*nodes.columns)


def dropcaps(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_key, pre, chars, lines): first inline children that float in a font 1.6 times the paragraph's or more.

    sizes(doc_key, pre, size, floats): the absolute font size of styled nodes."""
    first = nodes.where("role = 'Inline' and sib = 0").select("doc_key", "pre", "parent_pre", "end")
    paragraphs = nodes.where("role = 'Paragraph'").select("doc_key", F.col("pre").alias("parent_pre"))
    texts = nodes.where("role = 'Text'").select("doc_key", F.col("pre").alias("t_pre"), F.col("text").alias("t"))
    own = first.join(paragraphs, _PARENT).join(texts, "doc_key").where("t_pre between pre and end").groupBy("doc_key", "pre", "parent_pre").agg(F.sum(F.length(F.trim("t"))).cast("int").alias("chars"))
    of = lambda a, b: sizes.select("doc_key", F.col("pre").alias(a), F.col("size").alias(b), F.col("floats").alias(f"{b}_floats"))
    joined = own.join(of("pre", "size"), ["doc_key", "pre"]).join(of("parent_pre", "base"), _PARENT, "left").withColumn("ratio", F.col("size") / F.coalesce("base", F.lit(1.0)))
    return joined.where("size_floats and ratio >= 1.6 and chars between 1 and 3").select("doc_key", "pre", "chars", F.least(F.greatest(F.round("ratio").cast("int"), F.lit(2)), F.lit(5)).alias("lines"))


def prune(nodes: DataFrame) -> DataFrame:
    """Drops prunable nodes below which nothing is worth keeping; the cascade is one semi join on ranges."""
    worth = ~F.col("role").isin(*PRUNABLE, "Text") | has_attributes() | ((F.col("role") == "Text") & (F.coalesce("text", F.lit("")) != ""))
    keep = nodes.where(worth).select(F.col("doc_key").alias("k_key"), F.col("pre").alias("k_pre"))
    n = nodes.alias("n")
    return n.join(keep, (F.col("n.doc_key") == F.col("k_key")) & F.col("k_pre").between(F.col("n.pre"), F.col("n.end")), "left_semi")


def renumber(nodes: DataFrame) -> DataFrame:
    """Dense pre, end and sib again after rows were dropped.

    A node's new end is how many survivors stand up to its old one, which a running count over
    starts and ends in one order tells."""
    w = Window.partitionBy("doc_key").orderBy("pre")
    n = nodes.withColumn("__new", F.row_number().over(w) - 1)
    starts = n.select("doc_key", F.col("pre").alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast("int").alias("pre"))
    stops = n.select("doc_key", F.col("end").alias("__at"), F.lit(1).alias("__side"), "pre")
    seen = F.sum(1 - F.col("__side")).over(Window.partitionBy("doc_key").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = starts.unionByName(stops).withColumn("__end", (seen - 1).cast("int")).where("__side = 1").select("doc_key", "pre", "__end")
    by_parent = n.select("doc_key", F.col("pre").alias("parent_pre"), F.col("__new").alias("__parent"))
    out = n.join(by_parent, _PARENT, "left").join(ends, ["doc_key", "pre"])
    sib = F.row_number().over(Window.partitionBy("doc_key", "parent_pre").orderBy("pre")) - 1
    out = out.withColumn("sib", sib).withColumns({"pre": F.col("__new"), "end": F.col("__end"), "parent_pre": F.col("__parent")})
    return out.select(*nodes.columns)


def inline_spaces(nodes: DataFrame) -> DataFrame:
    """Blank texts become one space; those with a line break in a block are dropped unless inline nodes stand on both sides."""
    n = _with_parent_role(nodes)
    w = Window.partitionBy(*_PARENT).orderBy("sib")
    inline = F.col("role").isin(*INLINE) & ~((F.col("role") == "Text") & blank("text"))
    empty = (F.col("role") == "Text") & blank("text")
    flanked = F.coalesce(F.lag(inline).over(w), F.lit(False)) & F.coalesce(F.lead(inline).over(w), F.lit(False))
    drop = empty & F.coalesce("text", F.lit("")).rlike(r"[\n\r]") & F.coalesce(F.col("parent_role"), F.lit("Root")).isin(*BLOCK) & ~flanked
    return n.withColumns({"__drop": drop, "text": F.when(empty & (F.coalesce("text", F.lit("")) != ""), " ").otherwise(F.col("text"))}).where(~F.col("__drop")).drop("__drop", "parent_role")
