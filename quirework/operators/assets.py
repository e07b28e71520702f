"""A book's files: which go along, which are re-encoded, what an edited book serves, reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes from which an image is worth encoding again, and the share that has to be saved.
LEAST_BYTES, LEAST_SAVING = 10 * 1024, 0.10


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def is_packaging(path: Column) -> Column:
    """Whether a file only holds the old package together and is written anew."""
    low = F.lower(path)
    return (low == "mimetype") | low.startswith("meta-inf/") | low.endswith(".opf") | low.endswith(".ncx")


def needs_cover(covers: DataFrame, images: DataFrame) -> DataFrame:
    """Adds standalone: whether the cover's file name is another than that of the first chapter's image.

    covers(book, cover), images(book, src) with the first chapter's image, if it has one."""
    return covers.join(images.select("book", "src"), "book", "left").withColumn("standalone", F.col("cover").isNotNull() & ~basename(F.col("cover")).eqNullSafe(basename(F.col("src")))).drop("src")


def accepted_edits(assets: DataFrame, encoded: DataFrame, styled: DataFrame) -> DataFrame:
    """(book, path, new_path, old_size, new_size): the re-encoded images that replace their originals.

    assets(book, path, media_type, size); encoded(book, path, new_path, new_size); styled(book, path) are
    files that style sheets name. An original has to be a PNG or JPEG of LEAST_BYTES or more and the
    new one smaller by LEAST_SAVING; a new name is refused where a style sheet names the old one or
    another file, or another edit, has it."""
    big = assets.where(F.col("media_type").isin("image/png", "image/jpeg") & (F.col("size") >= LEAST_BYTES)).select("book", "path", F.col("size").alias("old_size"))
    fits = big.join(encoded, ["book", "path"]).where(F.col("new_size") <= F.col("old_size") * (1 - LEAST_SAVING))
    kept, moved = fits.where("new_path = path"), fits.where("new_path <> path")
    moved = moved.join(styled.select("book", "path").distinct(), ["book", "path"], "left_anti")
    moved = moved.join(assets.select("book", F.col("path").alias("new_path")), ["book", "new_path"], "left_anti")
    first = moved.groupBy("book", "new_path").agg(F.min(F.struct("path", "old_size", "new_size")).alias("x")).select("book", "x.path", "new_path", "x.old_size", "x.new_size")
    return kept.select(first.columns).unionByName(first)


def overlaid(assets: DataFrame, edits: DataFrame) -> DataFrame:
    """(book, path, served_as, data): an edit's data instead of the asset's; the old path still serves it.

    assets(book, path, data), edits(book, path, new_path, data)."""
    e = edits.select("book", "path", "new_path", F.col("data").alias("__d"))
    both = assets.select("book", "path", "data").join(e, ["book", "path"], "left")
    now = both.select("book", "path", F.coalesce("new_path", "path").alias("served_as"), F.coalesce("__d", "data").alias("data"))
    return now


def renamed(references: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds now: what a reference(book, href) to an edited file becomes."""
    return references.join(edits.select("book", F.col("path").alias("href"), "new_path"), ["book", "href"], "left").withColumn("now", F.coalesce("new_path", "href")).drop("new_path")


def edit_report(edits: DataFrame, *group: str) -> DataFrame:
    """(group, changed, renamed, saved): files changed and bytes saved."""
    return edits.groupBy(*group).agg(F.count("*").alias("changed"), F.count_if(F.col("new_path") != F.col("path")).alias("renamed"), F.sum(F.col("old_size") - F.col("new_size")).alias("saved"))


def type_stats(entities: DataFrame, kind: str, size: str) -> DataFrame:
    """(kind, n, bytes, largest): how many of each kind there are and how large."""
    return entities.groupBy(kind).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))


def fingerprint(parts: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, sha1): a digest of the digests of a group's texts in order, so that no text is moved."""
    each = parts.select(group, order, F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("__h"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, "__h"))), lambda x: x["__h"])
    return each.groupBy(group).agg(F.sha1(F.array_join(listed, "").cast("binary")).alias("sha1"))
