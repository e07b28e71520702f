"""Look-ups over an index of sections, leaves, entities and relations, and the index on disk.

Nodes are (node_id, book, kind, title, text), links (key, node), relations (source, target, label);
keys are trimmed lower-case names. What a caller asks for is few rows against the index.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators.retrieval import mention_index, query_scores, top

#: Characters of a text that are embedded, and least cosine of an entity that a query means.
EMBEDDED, MEANT = 2000, 0.3
_WORD = re.compile(r"[^\W_]+")


def key_of(name: Column | str) -> Column:
    return F.lower(F.trim(name))


def embedded(text: str | None, width: int = 384) -> list[float]:
    """A text's words, hashed with a sign to so many places, by the root of their counts, at length 1.

    It stands in for a trained model behind the same interface; texts without words are zero."""
    out = [0.0] * width
    for w in _WORD.findall((text or "")[:EMBEDDED].lower()):
        h = crc32(w.encode("utf-8", "surrogatepass"))
        out[h % width] += 1.0 if h >> 31 else -1.0
    out = [math.copysign(math.sqrt(abs(x)), x) for x in out]
    length = math.sqrt(sum(x * x for x in out))
    return [x / length for x in out] if length else out


def embed(texts: DataFrame, key: str, text: str, width: int = 384) -> DataFrame:
    """(key, embedding) of every text."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [embedded(x, width) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], [key, "embedding"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def reranked(candidates: DataFrame, query: str, key: str, text: str, n: int = 10) -> DataFrame:
    """(key, score): the candidates by the share of words that they and the query have in common; ties go to the
    lower key. It stands in for a trained model."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    a, b = words(F.coalesce(F.col(text), F.lit(""))), words(F.lit(query))
    every = F.size(F.array_union(a, b))
    scored = candidates.select(key, F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(0.0).alias("score"))
    return top(scored, n, key)


def entities(mentions: DataFrame) -> DataFrame:
    """(key, name, type, description, nodes): mentions(node, name, type, description, ord) by key; the first spelling,
    the commonest type (ties to the one that sorts first) and the first description that says something."""
    base = mention_index(mentions)
    m = mentions.where(F.trim("name") != "").withColumn("key", key_of("name"))
    types = m.where("type is not null").groupBy("key", "type").agg(F.count("*").alias("n")).groupBy("key").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"))
    said = m.where(F.trim(F.coalesce("description", F.lit(""))) != "").groupBy("key").agg(F.min_by("description", F.struct("ord", "description")).alias("description"))
    return base.join(types, "key", "left").join(said, "key", "left").select("key", "name", "type", "description", "nodes")


def linked(mentions: DataFrame) -> DataFrame:
    """(key, node): which nodes name an entity, each once."""
    return mentions.where(F.trim("name") != "").select(key_of("name").alias("key"), "node").distinct()


def relations_of(relations: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, source, target, label): the relations that touch each key, as their source or target; one that does so
    at both ends comes once. Two equality joins, no join on either."""
    k = keys.select("key").distinct()
    r = relations.select(key_of("source").alias("source"), key_of("target").alias("target"), "label")
    one = r.join(k, r.source == k.key).select("key", "source", "target", "label")
    other = r.where("source <> target").join(k, r.target == k.key).select("key", "source", "target", "label")
    return one.unionByName(other)


def relations_between(relations: DataFrame, keys: DataFrame) -> DataFrame:
    """(source, target, label): relations both of whose ends are known and differ, each once."""
    k = keys.select("key").distinct()
    r = relations.select(key_of("source").alias("source"), key_of("target").alias("target"), "label").where("source <> target")
    return r.join(k.select(F.col("key").alias("source")), "source", "left_semi").join(k.select(F.col("key").alias("target")), "target", "left_semi").select("source", "target", "label").distinct()


def query_entities(vectors: DataFrame, query: list[float], n: int = 5, least: float = MEANT) -> DataFrame:
    """(key, score): the n entities whose vectors are most like a query's; vectors(key, embedding)."""
    return top(query_scores(vectors, query, "key").where(F.col("score") >= least), n, "key")


def matched_entities(keys: DataFrame, topic: str, vectors: DataFrame | None = None, query: list[float] | None = None, n: int = 5) -> DataFrame:
    """(key, how): the entity of that name; where there is none, those whose names hold it or are held by it; where
    there is none either, the n most like it."""
    asked = topic.lower().strip()
    same = keys.where(F.col("key") == asked).select("key", F.lit("exact").alias("how"))
    part = keys.where((F.col("key") != asked) & (F.col("key").contains(asked) | F.lit(asked).contains(F.col("key"))) & F.lit(bool(asked))).select("key", F.lit("part").alias("how"))
    out = same.unionByName(part)
    if vectors is not None and query is not None:
        out = out.unionByName(query_entities(vectors, query, n).select("key", F.lit("alike").alias("how")))
    order = F.create_map(F.lit("exact"), F.lit(0), F.lit("part"), F.lit(1), F.lit("alike"), F.lit(2))
    ranked = out.withColumn("r", order[F.col("how")])
    best = ranked.agg(F.min("r").alias("best"))
    return ranked.join(best, ranked.r == best.best).select("key", "how").distinct()


def related(matched: DataFrame, links: DataFrame, nodes: DataFrame, n: int = 10) -> DataFrame:
    """(node_id, top, mentions): the nodes that name the matched entities, most of them first; top is the node's
    highest section. nodes(node_id, top)."""
    met = links.join(matched.select("key").distinct(), "key", "left_semi").groupBy("node").agg(F.count("*").alias("mentions"))
    return met.join(nodes.select(F.col("node_id").alias("node"), "top"), "node").select(F.col("node").alias("node_id"), "top", "mentions").orderBy(F.desc("mentions"), "node_id").limit(n)


def selected_by_entity(name: str, keys: DataFrame, links: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, node), (key, source, target, label)) of the entity that a name means: the nodes that name it and the
    relations that touch it, of the key that was found, not of the one that was asked for."""
    found = matched_entities(keys, name).orderBy(F.length("key"), "key").limit(1).select("key")
    return links.join(found, "key", "left_semi").select("key", "node"), relations_of(relations, found)


def save_index(nodes: DataFrame, path: str) -> None:
    """Writes an index, a folder for each book; a book that is there is replaced, others stay."""
    spark = nodes.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        nodes.repartition("book").write.mode("overwrite").partitionBy("book").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def load_index(spark: SparkSession, path: str, book: str | None = None) -> DataFrame:
    """An index; of one book only that book's folder is read. Files that can't be read are left out."""
    found = spark.read.option("ignoreCorruptFiles", "true").option("basePath", path).parquet(path)
    return found if book is None else found.where(F.col("book") == book)
