"""Books of any format: which reader a file needs, and which writer a format has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import render
from quirework.sources.epub import read_epub, to_epub
from quirework.sources.html import html_nodes
from quirework.sources.kfx import read_kfx
from quirework.sources.mobi import read_mobi, to_azw3

FORMATS = ("epub", "azw3", "mobi", "kfx")


def format_of_content(content: Column, path: Column | None = None) -> Column:
    """epub, azw3, mobi or kfx by the first bytes; a MOBI file counts as azw3 by its name. Null for anything else."""
    start = F.hex(F.substring(content, 1, 4))
    mobi = F.hex(F.substring(content, 61, 8)) == "424F4F4B4D4F4249"
    named = F.lower(path).rlike(r"\.(?:azw3|kf8)$") if path is not None else F.lit(False)
    return F.when(start == "504B0304", "epub").when(start == "434F4E54", "kfx").when(mobi & named, "azw3").when(mobi, "mobi")


def opened(spark: SparkSession, path: str, table: str = "chapters", kind: str | None = None) -> DataFrame:
    """One table of all books under a path or pattern, on any file system that Spark reads."""
    return read_books(spark.read.format("binaryFile").load(path).select("path", "content"), table, kind)


def read_books(files: DataFrame, table: str = "chapters", kind: str | None = None) -> DataFrame:
    """(path, format, chapter_id, document, error), or (path, format, title, authors, error) of table metadata.

    files(path, content). kind names the format; without it each file's is found by its bytes. Files of no known
    format, and those that their reader refuses, have one row that carries the error. KFX has no chapters in
    this form: its entities are read by read_kfx, and here it has a row for its container."""
    if kind is not None and kind not in FORMATS:
        raise ValueError(f"{kind} is no format that can be read")
    known = files.withColumn("format", F.lit(kind) if kind else format_of_content(F.col("content"), F.col("path")))
    of = lambda *names: known.where(F.coalesce("format", F.lit("")).isin(*names)).select("path", "content")
    columns = ["chapter_id", "document"] if table == "chapters" else ["title", "authors"]
    parts = [read_epub(of("epub"), table), read_mobi(of("azw3", "mobi"), table)]
    null = {"chapter_id": "int", "document": "string", "title": "string", "authors": "array<string>"}
    rest = [read_kfx(of("kfx"), "containers"), known.where("format is null").select("path", F.lit("ValueError: unknown format").alias("error"))]
    out = [p.select("path", *columns, "error") for p in parts] + [p.select("path", *[F.lit(None).cast(null[c]).alias(c) for c in columns], "error") for p in rest]
    union = out[0]
    for p in out[1:]:
        union = union.unionByName(p)
    return union.join(known.select("path", "format"), "path", "left").select("path", "format", *columns, "error")


def exported(books: DataFrame, kind: str) -> DataFrame:
    """(book_id, content) of books(book_id, title, language, authors, chapters) in a format: epub, azw3 or markdown."""
    if kind == "epub":
        return to_epub(books)
    if kind == "azw3":
        return to_azw3(books)
    if kind == "markdown":
        each = books.select("book_id", F.posexplode("chapters").alias("chapter_id", "c")).select("book_id", "chapter_id", F.col("c.xhtml").alias("xhtml")).withColumn("doc_key", F.xxhash64("book_id", "chapter_id"))
        done = render.numbered_markdown(html_nodes(each, "doc_key", "xhtml"), each)
        return render.book_markdown(done).select("book_id", F.encode("markdown", "UTF-8").alias("content"))
    raise ValueError(f"{kind} is no format that can be written")
