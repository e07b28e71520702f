"""Sections and content blocks of documents: text by subtree, headings, lists, tables, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators.tree import previous_smaller

LEAVES = ("Paragraph", "CodeBlock", "BlockQuote", "Table", "UnorderedList", "OrderedList", "DefinitionList", "Image", "Rule", "Caption")


def subtree_text(nodes: DataFrame, roots: DataFrame, verbatim: bool = False, footnotes: bool = False) -> DataFrame:
    """(doc_key, pre, text): what each root's subtree says, in order.

    Line breaks become spaces, runs of white space one, invisible characters none; with
    verbatim the text stays as it is. Footnotes are left out unless asked for."""
    leaves = nodes.where("role in ('Text', 'Break')")
    if not footnotes:
        leaves = leaves.where("coalesce(epub_type, '') <> 'footnote'")
    t = leaves.select("doc_key", F.col("pre").alias("t_pre"), F.when(F.col("role") == "Break", "\n" if verbatim else " ").otherwise(F.col("text")).alias("t"))
    r = roots.select("doc_key", "pre", "end")
    joined = r.join(t, "doc_key").where("t_pre between pre and end").groupBy("doc_key", "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t_pre", "t"))), lambda x: x["t"]), "").alias("text"))
    if not verbatim:
        joined = joined.withColumn("text", F.trim(T.normalize_spaces(T.strip_invisible(F.col("text")))))
    return r.select("doc_key", "pre").join(joined, ["doc_key", "pre"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def headings(nodes: DataFrame) -> DataFrame:
    """(doc_key, pre, level, title): headings that say something."""
    h = nodes.where("role = 'Heading'")
    return h.select("doc_key", "pre", "level").join(subtree_text(nodes, h).withColumnRenamed("text", "title"), ["doc_key", "pre"]).where("title <> ''")


def outermost_blocks(nodes: DataFrame) -> DataFrame:
    """Leaf blocks that no other leaf block holds: (doc_key, pre, end, role)."""
    b = nodes.where(F.col("role").isin(*LEAVES)).select("doc_key", "pre", "end", "role")
    w = Window.partitionBy("doc_key").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("__reach", F.max("end").over(w)).where("__reach is null or pre > __reach").drop("__reach")


def sections(nodes: DataFrame) -> DataFrame:
    """(doc_key, ord, level, title, parent_ord): headings in order, nested by level."""
    w = Window.partitionBy("doc_key").orderBy("pre")
    rows = headings(nodes).withColumn("ord", F.row_number().over(w))
    return previous_smaller(rows, "doc_key", "ord", "level").select("doc_key", "ord", "level", "title", "parent_ord")


def section_blocks(nodes: DataFrame) -> DataFrame:
    """(doc_key, section_ord, block_ord, role, text): each block under the last heading before it; 0 is the preamble."""
    h = headings(nodes).select("doc_key", "pre", F.lit("Heading").alias("role"), F.lit("").alias("text"))
    b = outermost_blocks(nodes)
    texts = subtree_text(nodes, b)
    rows = b.select("doc_key", "pre", "role").join(texts, ["doc_key", "pre"]).unionByName(h)
    w = Window.partitionBy("doc_key").orderBy("pre")
    n = rows.withColumn("section_ord", F.sum((F.col("role") == "Heading").cast("int")).over(w)).where("role <> 'Heading'")
    order = Window.partitionBy("doc_key", "section_ord").orderBy("pre")
    return n.withColumn("block_ord", F.row_number().over(order)).select("doc_key", F.col("section_ord").cast("int").alias("section_ord"), "block_ord", "role", "text")


def list_items(nodes: DataFrame) -> DataFrame:
    """(doc_key, list_pre, items): one text per item in order, blank ones dropped."""
    items = nodes.where("role = 'ListItem'")
    t = items.select("doc_key", "pre", F.col("parent_pre").alias("list_pre")).join(subtree_text(nodes, items), ["doc_key", "pre"]).where("text <> ''")
    return t.groupBy("doc_key", "list_pre").agg(F.transform(F.sort_array(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]).alias("items"))


def list_numbers(nodes: DataFrame) -> DataFrame:
    """(doc_key, pre, number): items of ordered lists, counted from each list's start."""
    lists = nodes.where("role = 'OrderedList'").select("doc_key", F.col("pre").alias("parent_pre"), F.coalesce("list_start", F.lit(1)).alias("start"))
    w = Window.partitionBy("doc_key", "parent_pre").orderBy("sib")
    return nodes.where("role = 'ListItem'").join(lists, ["doc_key", "parent_pre"]).select("doc_key", "pre", (F.row_number().over(w) + F.col("start") - 1).alias("number"))


def tight_lists(nodes: DataFrame) -> DataFrame:
    """(doc_key, list_pre, tight): no item holds a nested block or two paragraphs."""
    items = nodes.where("role = 'ListItem'").select("doc_key", F.col("pre").alias("item"), F.col("parent_pre").alias("list_pre"))
    inner = nodes.select("doc_key", F.col("parent_pre").alias("item"), "role")
    nested = F.col("role").isin("UnorderedList", "OrderedList", "BlockQuote", "CodeBlock", "Table", "DefinitionList")
    per = items.join(inner, ["doc_key", "item"], "left").groupBy("doc_key", "list_pre", "item").agg(F.count_if(F.col("role") == "Paragraph").alias("paragraphs"), F.coalesce(F.bool_or(nested), F.lit(False)).alias("nested"))
    return per.groupBy("doc_key", "list_pre").agg(F.bool_and(~F.col("nested") & (F.col("paragraphs") <= 1)).alias("tight"))


def definition_pairs(nodes: DataFrame) -> DataFrame:
    """(doc_key, pre, entry): each description with the term just before it, if that has none yet."""
    parts = nodes.where("role in ('DefinitionTerm', 'DefinitionDescription')")
    t = parts.select("doc_key", "pre", "parent_pre", "role", "sib").join(subtree_text(nodes, parts), ["doc_key", "pre"])
    w = Window.partitionBy("doc_key", "parent_pre").orderBy("sib")
    term = F.when(F.lag("role").over(w) == "DefinitionTerm", F.lag("text").over(w))
    return t.withColumn("term", term).where("role = 'DefinitionDescription'").select("doc_key", "pre", F.when(F.col("term").isNotNull(), F.concat("term", F.lit(": "), "text")).otherwise(F.col("text")).alias("entry"))


def table_grid(nodes: DataFrame) -> DataFrame:
    """(doc_key, table_pre, headers, rows): headers is the first head row, or else the first row with any header cell."""
    tables = nodes.where("role = 'Table'").select("doc_key", F.col("pre").alias("table_pre"), F.col("end").alias("table_end"))
    cells = nodes.where("role = 'TableCell'")
    texts = cells.select("doc_key", "pre", F.col("parent_pre").alias("row_pre"), "sib", F.coalesce("is_header_cell", F.lit(False)).alias("th")).join(subtree_text(nodes, cells), ["doc_key", "pre"])
    rows = texts.groupBy("doc_key", "row_pre").agg(F.transform(F.sort_array(F.collect_list(F.struct("sib", "text"))), lambda x: x["text"]).alias("cells"), F.bool_or("th").alias("any_th"))
    placed = rows.join(tables, "doc_key").where("row_pre between table_pre and table_end")
    inner = placed.groupBy("doc_key", "row_pre").agg(F.max("table_pre").alias("table_pre"))
    placed = placed.join(inner, ["doc_key", "row_pre", "table_pre"])
    heads = nodes.where("role = 'TableHead'").select("doc_key", F.col("pre").alias("h_pre"), F.col("end").alias("h_end"))
    placed = placed.join(heads, (placed.doc_key == heads.doc_key) & F.col("row_pre").between(F.col("h_pre"), F.col("h_end")), "left").drop(heads.doc_key)
    w = Window.partitionBy("doc_key", "table_pre")
    head = F.coalesce(F.min(F.when(F.col("h_pre").isNotNull(), F.col("row_pre"))).over(w), F.min(F.when(F.col("any_th"), F.col("row_pre"))).over(w))
    n = placed.withColumn("head", head)
    body = F.transform(F.sort_array(F.collect_list(F.when(F.col("head").isNull() | (F.col("row_pre") != F.col("head")), F.struct("row_pre", "cells")))), lambda x: x["cells"])
    return n.groupBy("doc_key", "table_pre").agg(F.max(F.when(F.col("row_pre") == F.col("head"), F.col("cells"))).alias("headers"), body.alias("rows"))


def outline(sections_: DataFrame, limit: int = 150) -> DataFrame:
    """(doc_key, outline): titles indented by level, in order."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), T.truncated(F.col("title"), limit))
    return sections_.withColumn("line", line).groupBy("doc_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("outline"))


def chapter_title(nodes: DataFrame, fallback: DataFrame) -> DataFrame:
    """(doc_key, title): the first heading's text, else fallback(doc_key, path)."""
    first = headings(nodes).groupBy("doc_key").agg(F.min_by("title", "pre").alias("title"))
    return fallback.join(first, "doc_key", "left").select("doc_key", F.coalesce("title", "path").alias("title"))


def stats(nodes: DataFrame) -> DataFrame:
    """Counts by document: nodes, texts, images, links, headings and characters."""
    is_ = lambda role: F.count_if(F.col("role") == role)
    return nodes.groupBy("doc_key").agg(
        F.count("*").alias("nodes"), is_("Text").alias("texts"), is_("Image").alias("images"), is_("Link").alias("links"), is_("Heading").alias("headings"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.max("depth").alias("depth"),
    )


def image_only(nodes: DataFrame) -> DataFrame:
    """(doc_key, image_only): exactly one image and no text but blanks."""
    said = F.count_if((F.col("role") == "Text") & ~F.coalesce("text", F.lit("")).rlike(r"(?U)^\s*$"))
    return nodes.groupBy("doc_key").agg(((F.count_if(F.col("role") == "Image") == 1) & (said == 0)).alias("image_only"))


def display_math(nodes: DataFrame) -> DataFrame:
    """(doc_key, pre, display): a formula stands on its own line if nothing else in its parent isn't blank."""
    kids = nodes.where("parent_pre is not null").select("doc_key", "pre", "parent_pre", "role", ((F.col("role") != "Text") | (F.trim(F.coalesce("text", F.lit(""))) != "")).alias("solid"))
    alone = kids.groupBy("doc_key", "parent_pre").agg(F.count_if("solid").alias("solids"))
    return kids.where("role = 'Math'").join(alone, ["doc_key", "parent_pre"]).select("doc_key", "pre", (F.col("solids") == 1).alias("display"))


def list_separators(rows: DataFrame, group: str, key: str, kind: str, *order: str) -> DataFrame:
    """(key, separated): whether a list needs a separator before it, as one of its kind stands right before."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.select(key, F.col(kind).eqNullSafe(F.lag(kind).over(w)).alias("separated"))
