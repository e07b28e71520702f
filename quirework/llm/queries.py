"""Queries of the training-text problems and, where SQL can express one, the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import bpe, langid, leakage, lookalike, mojibake, names, neardup
from quirework.session import prepare, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, key_a, key_b): near-duplicate chapter documents and book titles, as pairs of rows."""
    prepare(spark)
    documents = neardup.near_duplicate_pairs(neardup.keyed(table(spark, sf_dir, "chapters"), "chapter_key", "document"), neardup.DOCUMENTS)
    titles = neardup.near_duplicate_pairs(neardup.keyed(table(spark, sf_dir, "books"), "record_id", "title"), neardup.TITLES)
    return documents.select(F.lit("chapters.document").alias("field"), "key_a", "key_b").unionByName(titles.select(F.lit("books.title").alias("field"), "key_a", "key_b"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_key, pos, clean_md5): the cells that aren't in the clean form."""
    prepare(spark)
    return lookalike.unclean_cells(lookalike.text_cells(table(spark, sf_dir, "books"), table(spark, sf_dir, "chapters")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, field, restored): the garbled title and description cells."""
    prepare(spark)
    return mojibake.restore_garbled(mojibake.header_cells(table(spark, sf_dir, "exth_headers"), table(spark, sf_dir, "mobi_headers")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name_a, name_b): different strings that name the same person or organisation."""
    prepare(spark)
    return names.name_pairs(names.typed_names(table(spark, sf_dir, "books"), table(spark, sf_dir, "exth_headers")))


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, entity, variants): each distinct name with its entity and how many names mean the same."""
    prepare(spark)
    return names.name_entities(names.typed_names(table(spark, sf_dir, "books"), table(spark, sf_dir, "exth_headers")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of every document."""
    prepare(spark)
    return bpe.encode(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every document encoded and decoded again."""
    prepare(spark)
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): the documents and the evaluation items they leak."""
    prepare(spark)
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, share): documents that say an item's passage in other words."""
    prepare(spark)
    return leakage.find_paraphrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seg_no, lang, confidence): the segments of every document that has sentences."""
    prepare(spark)
    return langid.segment_languages(table(spark, sf_dir, "documents")).select("doc_id", "seg_no", "lang", "confidence")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, key, class_id, links): each chapter's and title's class of exact copies and how many other classes are similar to it."""
    prepare(spark)

    def classes(field: str, texts: DataFrame, s: neardup.Settings) -> DataFrame:
        pairs, members = neardup.near_duplicate_classes(texts, s)
        links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        return members.join(links, "rep", "left").select(F.lit(field).alias("field"), "key", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))

    documents = neardup.keyed(table(spark, sf_dir, "chapters"), "chapter_key", "document")
    titles = neardup.keyed(table(spark, sf_dir, "books"), "record_id", "title")
    return classes("chapters.document", documents, neardup.DOCUMENTS).unionByName(classes("books.title", titles, neardup.TITLES))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seg_no, lang): the segments of documents whose label doesn't tell their language."""
    prepare(spark)
    return langid.mislabelled(table(spark, sf_dir, "documents")).select("doc_id", "seg_no", "lang")


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_entities": p6_entities, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_found": p8_found, "p9_found": p9_found, "p2_classes": p2_classes, "p8_paraphrases": p8_paraphrases, "p9_segments": p9_segments}
ORACLE: dict[str, str] = {"p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
