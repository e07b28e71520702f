"""Tables of contents, landmarks and anchors: counts, targets, repair, positions, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators.links import as_of, resolve_links
from quirework.operators.ranks import numbered, running_sum

# What the names of landmarks and guide entries stand for.
LANDMARKS = {
    "cover": "Cover", "titlepage": "TitlePage", "title-page": "TitlePage", "toc": "Toc", "bodymatter": "BodyMatter", "text": "BodyMatter", "frontmatter": "FrontMatter",
    "backmatter": "BackMatter", "start": "StartReading", "acknowledgements": "Acknowledgements", "bibliography": "Bibliography", "glossary": "Glossary", "index": "Index",
    "preface": "Preface", "endnotes": "Endnotes", "loi": "Loi", "lot": "Lot",
}


def toc_stats(toc: DataFrame, book: str = "book") -> DataFrame:
    """(book, entries, levels): entries of each table of contents and how deep it goes; toc(book, depth from 0)."""
    return toc.groupBy(book).agg(F.count("*").alias("entries"), (F.max("depth") + 1).alias("levels"))


def flattened(toc: DataFrame, book: str = "book") -> DataFrame:
    """Adds first_child, last_child and children of each entry; toc(book, ord, parent_ord)."""
    kids = toc.where("parent_ord is not null").groupBy(book, F.col("parent_ord").alias("ord")).agg(F.min("ord").alias("first_child"), F.max("ord").alias("last_child"), F.count("*").alias("children"))
    return toc.join(kids, [book, "ord"], "left").withColumn("children", F.coalesce("children", F.lit(0)))


def toc_targets(toc: DataFrame, spine: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds target_kind, target_doc and target_node to toc(book, href): entries are resolved from the book's
    root, whatever chapter they stand in."""
    return resolve_links(toc.withColumn("path", F.lit("")), spine, anchors).drop("path", "target_url")


def repaired_fragments(toc: DataFrame, places: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds repaired: the href with the id that stands last up to the entry's place, where it names a file only.

    toc(book, play_order, href); places(book, play_order, pos); ids(book, pos, id). Entries with a
    fragment, and those without a place or an id, keep their href."""
    bare = toc.where(~F.col("href").contains("#")).join(places, ["book", "play_order"]).select("book", "play_order", "href", "pos")
    found = as_of(bare, ids.select("book", "pos", "id"), "book", "pos", "id").select("book", "play_order", "id")
    return toc.join(found, ["book", "play_order"], "left").withColumn("repaired", F.when(F.col("id").isNotNull(), F.concat("href", F.lit("#"), "id")).otherwise(F.col("href"))).drop("id")


def toc_positions(targets: DataFrame, placed: DataFrame) -> DataFrame:
    """Adds position: where the target begins in reading order; of a target without a node, where its document
    begins. targets(book, target_doc, target_node), placed(book, doc, node, start)."""
    nodes = placed.select("book", F.col("doc").alias("target_doc"), F.col("node").alias("target_node"), F.col("start").alias("__n"))
    docs = placed.groupBy("book", F.col("doc").alias("target_doc")).agg(F.min("start").alias("__d"))
    return targets.join(nodes, ["book", "target_doc", "target_node"], "left").join(docs, ["book", "target_doc"], "left").withColumn("position", F.coalesce("__n", "__d")).drop("__n", "__d")


def landmark_kind(types: F.Column | str) -> F.Column:
    """The kind of the first name in a landmark's type that is known; null if none is."""
    names = F.split(F.lower(F.col(types) if isinstance(types, str) else types), r"\s+")
    known = F.create_map(*[F.lit(x) for pair in sorted(LANDMARKS.items()) for x in pair])
    return F.get(F.filter(F.transform(names, lambda n: known[n]), lambda x: x.isNotNull()), F.lit(0))


def landmark_targets(landmarks: DataFrame, spine: DataFrame, anchors: DataFrame, covers: DataFrame) -> DataFrame:
    """(book, kind, doc, node) of landmarks(book, types, href): what is resolved, and where a book has none of the
    kind, its cover document as Cover and the first document that isn't its cover as StartReading.

    spine(book, path, doc), anchors as in resolve_links, covers(book, path)."""
    named = landmarks.withColumns({"kind": landmark_kind("types"), "path": F.lit("")}).where("kind is not null")
    own = resolve_links(named, spine, anchors).where("target_doc is not null").groupBy("book", "kind").agg(F.min(F.struct(F.col("target_doc").alias("doc"), F.col("target_node").alias("node"))).alias("x")).select("book", "kind", "x.doc", "x.node")
    cover = spine.join(covers.select("book", "path"), ["book", "path"]).groupBy("book").agg(F.min("doc").alias("doc"))
    start = spine.join(covers.select("book", "path"), ["book", "path"], "left_anti").groupBy("book").agg(F.min("doc").alias("doc"))
    guess = cover.select("book", F.lit("Cover").alias("kind"), "doc").unionByName(start.select("book", F.lit("StartReading").alias("kind"), "doc"))
    return own.unionByName(guess.join(own, ["book", "kind"], "left_anti").withColumn("node", F.lit(None).cast(own.schema["node"].dataType)))


def heading_slugs(headings: DataFrame, resolved: DataFrame) -> DataFrame:
    """(doc, node, slug): slugs of headings that some internal link goes to; empty ones are left out.

    headings(doc, node, title); resolved(target_doc, target_node)."""
    wanted = resolved.where("target_node is not null").select(F.col("target_doc").alias("doc"), F.col("target_node").alias("node")).distinct()
    return headings.join(wanted, ["doc", "node"], "left_semi").select("doc", "node", T.slugify(F.col("title")).alias("slug")).where("slug <> ''")


def anchor_names(uses: DataFrame, order: str) -> DataFrame:
    """(target, name): a0, a1, ... in upper-case hexadecimal for each target, by first use."""
    first = uses.where("target is not null").groupBy("target").agg(F.min(order).alias("__first"))
    return numbered(first, "__first", "target", name="__n").select("target", F.concat(F.lit("a"), F.hex("__n")).alias("name"))


def fragment_ids(nodes: DataFrame, *order: str, first: int = 1) -> DataFrame:
    """Adds fragment: numbers without a gap in reading order, which has to tell all nodes apart."""
    return numbered(nodes, *order, name="fragment").withColumn("fragment", F.col("fragment") + first)


def clamped(offset: F.Column, length: F.Column) -> F.Column:
    """An anchor's offset in a text that may have been dropped: 0 where the text is shorter."""
    return F.when(offset < F.coalesce(length, F.lit(0)), offset).otherwise(F.lit(0))


def outline(sections: DataFrame, summaries: DataFrame, limit: int = 200) -> DataFrame:
    """(doc_key, ord, line): titles indented by level, with the beginning of the summary behind a colon.

    sections(doc_key, ord, level, title), summaries(doc_key, ord, summary)."""
    said = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.concat(F.lit(": "), F.substring(F.trim("summary"), 1, limit))).otherwise("")
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), F.lit("- "), "title", said)
    return sections.join(summaries, ["doc_key", "ord"], "left").select("doc_key", "ord", line.alias("line"))


def section_content(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_key, ord, content): each section's own texts and those of all sections below it, in order.

    blocks(doc_key, section_ord, block_ord, text); sections(doc_key, ord, last): last is the last section of
    its subtree."""
    met = sections.select("doc_key", "ord", "last").join(blocks, "doc_key").where("section_ord between ord and last")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("section_ord", "block_ord", "text"))), lambda x: x["text"])
    return met.groupBy("doc_key", "ord").agg(F.array_join(parts, "\n\n").alias("content"))


def section_spans(sections: DataFrame) -> DataFrame:
    """(doc_key, ord, last): the last section below each, which is the one before the next of no higher level number."""
    ends = sections.groupBy("doc_key").agg(F.max("ord").alias("stop"))
    from quirework.operators.positions import toc_spans

    spans = toc_spans(sections.withColumn("at", F.col("ord").cast("bigint")), "doc_key", "at", "level", ends.withColumn("stop", (F.col("stop") + 1).cast("bigint")))
    return spans.select("doc_key", "ord", (F.col("ord") + F.col("span") - 1).cast("int").alias("last"))


def strands(entries: DataFrame, book: str = "book") -> DataFrame:
    """Adds strand: one number for a parent and its chain of first children, one for neighbours without children.

    entries(book, record, ord, parent_ord, children). Within a record an entry goes on with the strand of the
    entry before it if that is its parent, or if both have no children and one parent."""
    w = Window.partitionBy(book, "record").orderBy("ord")
    before = F.lag(F.struct("ord", "parent_ord", "children")).over(w)
    follows = before.isNotNull() & ((before["ord"] == F.col("parent_ord")) | ((before["children"] == 0) & (F.col("children") == 0) & before["parent_ord"].eqNullSafe(F.col("parent_ord"))))
    marked = entries.withColumn("__new", F.when(follows, 0).otherwise(1))
    return running_sum(marked, book, "record", "ord", value="__new", name="strand").drop("__new")
