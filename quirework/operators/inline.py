"""Inline content: nested nodes as segments with merged state, and spans over a text as nested nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.grouped import per_document

INLINE = ("Text", "Inline", "Link", "Image", "Break", "Math")


def segments(nodes: DataFrame, *inherited: str) -> DataFrame:
    """(doc_key, pre, block_pre, offset, length, text, inherited...): the text leaves of every block, disjoint and in
    order, each with the innermost value of the inherited columns among the inline nodes above it.

    offset counts the characters of the block's text before the leaf."""
    spans = nodes.where(F.col("role").isin("Inline", "Link")).select("doc_key", F.col("pre").alias("a_pre"), F.col("end").alias("a_end"), F.col("depth").alias("a_depth"), *[F.col(c).alias(f"a_{c}") for c in inherited])
    blocks = nodes.where(~F.col("role").isin(*INLINE)).select("doc_key", F.col("pre").alias("b_pre"), F.col("end").alias("b_end"), F.col("depth").alias("b_depth"))
    leaves = nodes.where("role = 'Text' and text <> ''").select("doc_key", "pre", "text")
    owner = leaves.select("doc_key", "pre").join(blocks, "doc_key").where("pre between b_pre and b_end").groupBy("doc_key", "pre").agg(F.max(F.struct("b_depth", "b_pre")).alias("b"))
    state = leaves.select("doc_key", "pre").join(spans, "doc_key").where("pre between a_pre and a_end").groupBy("doc_key", "pre").agg(*[F.max_by(f"a_{c}", F.when(F.col(f"a_{c}").isNotNull(), F.col("a_depth"))).alias(c) for c in inherited])
    out = leaves.join(owner, ["doc_key", "pre"], "left").join(state, ["doc_key", "pre"], "left").withColumn("block_pre", F.col("b.b_pre"))
    w = Window.partitionBy("doc_key", "block_pre").orderBy("pre")
    n = F.length("text")
    return out.select("doc_key", "pre", "block_pre", (F.sum(n).over(w) - n).alias("offset"), n.alias("length"), "text", *inherited)


def nest(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int | None, str | None, str | None]]:
    """(node, parent, name, text) of spans (offset, length, name) over a text: earlier and longer spans hold the
    others, one that crosses its holder's end is cut there, gaps become text. Nodes are numbered in order."""
    ordered = sorted((max(o, 0), -max(n, 0), i) for i, (o, n, _) in enumerate(spans))
    out: list[tuple[int, int | None, str | None, str | None]] = []
    stack: list[tuple[int | None, int]] = [(None, len(text))]
    at = 0

    def say(upto: int) -> None:
        nonlocal at
        if upto > at:
            out.append((len(out), stack[-1][0], None, text[at:upto]))
            at = upto

    def close(upto: int) -> None:
        while len(stack) > 1 and stack[-1][1] <= upto:
            say(stack[-1][1])
            stack.pop()

    for offset, length, i in ordered:
        offset, stop = min(offset, len(text)), min(offset - length, len(text))
        close(offset)
        say(offset)
        stop = min(stop, stack[-1][1])
        out.append((len(out), stack[-1][0], spans[i][2], None))
        stack.append((len(out) - 1, stop))
    close(len(text))
    say(len(text))
    return out


def nested_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_key, node, parent, name, text): texts(doc_key, text), spans(doc_key, offset, length, name) as a tree.

    Texts without spans are one text node; spans without a text, or of a null one, are left out."""
    rows = texts.where("text is not null").select("doc_key", F.lit(0).alias("pre"), "text", F.lit(None).cast("int").alias("offset"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("name"))
    more = spans.select("doc_key", F.lit(1).alias("pre"), F.lit(None).cast("string").alias("text"), F.col("offset").cast("int"), F.col("length").cast("int"), "name")

    def work(key: int, own: list[dict]) -> list[tuple]:
        if own[0]["pre"]:
            return []
        given = sorted((r["offset"], r["length"], r["name"] or "") for r in own[1:] if r["offset"] is not None and r["length"] is not None)
        return [(key, *x) for x in nest(own[0]["text"], given)]

    return per_document(rows.unionByName(more), ["doc_key", "pre", "text", "offset", "length", "name"], work, "doc_key bigint, node int, parent int, name string, text string")
