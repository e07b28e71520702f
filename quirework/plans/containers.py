"""Queries of e-reader containers: files are written of the test tables and read back, with the SQL of what has to come out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import ion
from quirework.plans.navigation import ORACLE, QUERIES, query
from quirework.session import spread
from quirework.sources import kfx, mobi

__all__ = ["ORACLE", "QUERIES"]


def _single(t) -> DataFrame:
    """Every chapter as a book of its own."""
    c = t("chapters").where("document is not null and document <> ''")
    return spread(c.select(F.col("chapter_key").cast("string").alias("book_id"), F.col("source_path").alias("title"), F.lit("en").alias("language"), F.array(F.lit("A")).alias("authors"), F.array(F.struct(F.lit("t").alias("title"), F.col("document").alias("xhtml"))).alias("chapters")))


@query("SELECT chapter_key, document FROM chapters WHERE document IS NOT NULL AND document <> ''")
def q_azw3_round_trip(t):
    """Every chapter's document out of the KF8 file written of it: skeletons, fragments and indexes."""
    files = mobi.to_azw3(_single(t)).select(F.col("book_id").alias("path"), "content")
    return mobi.read_mobi(files, "chapters").where("error is null").select(F.col("path").cast("bigint").alias("chapter_key"), "document")


@query("SELECT chapter_key, CASE WHEN source_path <> '' THEN source_path ELSE 'book' END AS title, ['A'] AS authors, 'PalmDoc' AS compression, octet_length(encode(document)) AS text_length, 'Utf8' AS encoding, 8 AS version FROM chapters WHERE document IS NOT NULL AND document <> ''")
def q_mobi_headers(t):
    files = mobi.to_azw3(_single(t)).select(F.col("book_id").alias("path"), "content")
    meta = mobi.read_mobi(files, "metadata").select("path", "title", "authors")
    head = mobi.read_mobi(files, "headers").select("path", "compression", "text_length", "encoding", F.col("mobi_version").alias("version"))
    return meta.join(head, "path").select(F.col("path").cast("bigint").alias("chapter_key"), F.when(F.col("title") != "", F.col("title")).otherwise("book").alias("title"), "authors", "compression", "text_length", "encoding", "version")


@query("SELECT CASE n WHEN 0 THEN 'skeletons' ELSE 'fragments' END AS kind, count(*) AS rows FROM (SELECT unnest([0, 1]) AS n FROM chapters WHERE document IS NOT NULL AND document <> '' AND octet_length(encode(document)) < 8192) GROUP BY 1")
def q_mobi_index(t):
    small = _single(t).where("octet_length(chapters[0].xhtml) < 8192")
    files = mobi.to_azw3(small).select(F.col("book_id").alias("path"), "content")
    return mobi.read_mobi(files, "index").where("tag = 6").groupBy("kind").agg(F.count("*").alias("rows"))


def _kfx(t) -> DataFrame:
    """Every document as a container: a section, its storyline, and the text as content."""
    d = t("documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                section = ion.Struct([(ion.Symbol(176), ion.Symbol(901))])
                out.append(kfx.build_container(f"CR!{key}", [(900, 260, section), (901, 259, [ion.Symbol(902)]), (902, 145, ion.Struct([(ion.Symbol(146), [text])]))]))
            yield pa.RecordBatch.from_arrays([pa.array(list(map(str, b.column("doc_id").to_pylist())), pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    return spread(d).mapInArrow(run, "path string, content binary")


@query("SELECT doc_id, 'CR!' || doc_id AS container, text FROM documents")
def q_kfx_round_trip(t):
    files = _kfx(t)
    content = kfx.read_kfx(files, "entities").where("kind = 'content'").select("path", F.from_json("value", "`$146` array<string>")["$146"][0].alias("text"))
    return kfx.read_kfx(files, "containers").join(content, "path").select(F.col("path").cast("bigint").alias("doc_id"), "container", "text")


@query("SELECT kind, target_kind, count(*) AS n FROM (SELECT unnest(['section', 'storyline']) AS kind, unnest(['storyline', 'content']) AS target_kind FROM documents) GROUP BY 1, 2")
def q_kfx_dependencies(t):
    files = _kfx(t)
    return kfx.dependencies(kfx.read_kfx(files, "references"), kfx.read_kfx(files, "entities")).groupBy("kind", "target_kind").agg(F.sum("n").alias("n"))


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(['section', 'storyline', 'content']) AS kind FROM documents) GROUP BY 1")
def q_kfx_report(t):
    return kfx.container_report(kfx.read_kfx(_kfx(t), "entities")).groupBy("kind").agg(F.sum("n").alias("n"))
