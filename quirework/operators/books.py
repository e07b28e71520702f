"""Operators on whole books: indexes of sections and leaves, look-ups by name, reports and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators.ranks import numbered, running_sum

LEAF_LEAST, SECTION_CAP, LEAF_CAP = 10, 8000, 3000
FIRST_SYMBOL = 852


def index_nodes(headings: DataFrame, leaves: DataFrame, book: str = "book_id") -> DataFrame:
    """(node_id, book, kind, title, text): sections and the leaves that say at least ten characters.

    headings(book, doc_key, ord, title), leaves(book, doc_key, ord, text). Ids are hashes of what
    they stand for, so a second run gives the same."""
    make = lambda kind: F.sha2(F.concat_ws("|", F.col(book), F.col("doc_key").cast("string"), F.lit(kind), F.col("ord").cast("string")), 256)
    s = headings.select(make("section").alias("node_id"), book, F.lit("section").alias("kind"), "title", F.lit("").alias("text"))
    said = F.trim("text")
    x = leaves.where(F.length(said) >= LEAF_LEAST).select(make("leaf").alias("node_id"), book, F.lit("leaf").alias("kind"), F.lit("").alias("title"), said.alias("text"))
    return s.unionByName(x)


def best_title(rows: DataFrame, title: str, wanted: str, key: str, least: float = 0.1) -> DataFrame:
    """The row whose title is most like the wanted one, if it is like it at all; ties go to the lower key."""
    scored = rows.withColumn("score", F.round(T.fuzzy_title(F.col(title), F.lit(wanted)), 6)).where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), key).limit(1)


def resolve_name(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, name, matches): the same name, else the only one that holds it; name is null where there are several or none.

    wanted(wanted) is what callers ask for, few against the names."""
    asked = wanted.select(F.lower(F.trim("wanted")).alias("wanted")).distinct()
    every = names.select("name", F.lower(F.trim("name")).alias("low")).distinct()
    same = asked.join(every, asked.wanted == every.low).groupBy("wanted").agg(F.min("name").alias("same"))
    held = asked.join(every, F.col("low").contains(F.col("wanted"))).groupBy("wanted").agg(F.count("*").alias("matches"), F.min("name").alias("one"))
    out = asked.join(same, "wanted", "left").join(held, "wanted", "left")
    return out.select("wanted", F.coalesce("same", F.when(F.col("matches") == 1, F.col("one"))).alias("name"), F.coalesce("matches", F.lit(0)).alias("matches"))


def capped(text: Column, kind: Column) -> Column:
    """Text as far as it is shown: more of a section than of a leaf."""
    return F.when(kind == "section", F.substring(text, 1, SECTION_CAP)).otherwise(F.substring(text, 1, LEAF_CAP))


def symbols(names: DataFrame, name: str, order: str) -> DataFrame:
    """(name, symbol): $N stands for N, any other name gets the next number from 852 in order of first use."""
    first = names.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("__first"))
    literal = F.when(F.col(name).rlike(r"^\$\d+$"), F.expr(f"cast(substring({name}, 2) as bigint)"))
    fresh = numbered(first.where(~F.col(name).rlike(r"^\$\d+$")), "__first", name, name="__n").withColumn("__n", F.col("__n") + FIRST_SYMBOL)
    return first.where(F.col(name).rlike(r"^\$\d+$")).select(name, literal.alias("symbol")).unionByName(fresh.select(name, F.col("__n").cast("bigint").alias("symbol")))


def resource_names(uses: DataFrame, href: str, order: str) -> DataFrame:
    """(href, resource): e0, e1, ... in upper-case hexadecimal by first use."""
    first = uses.where(F.col(href).isNotNull()).groupBy(href).agg(F.min(order).alias("__first"))
    return numbered(first, "__first", href, name="__n").select(href, F.concat(F.lit("e"), F.hex("__n")).alias("resource"))


def mentions(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n): how often each one-word term stands in a text."""
    words = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+)"), F.lit(1))).alias("term"))
    return words.join(terms.select("term").distinct(), "term").groupBy(key, "term").agg(F.count("*").alias("n"))


def split_chapters(texts: DataFrame, key: str, text: str, at: str) -> DataFrame:
    """(key, part, chunk): a text cut at a pattern; blank chunks are dropped and the others counted from 0."""
    cut = texts.where(F.col(text).isNotNull()).select(key, F.filter(F.split(text, at), lambda x: F.trim(x) != "").alias("c"))
    return cut.select(key, F.posexplode("c").alias("part", "chunk"))


def report(*rules: tuple[str, str, DataFrame]) -> DataFrame:
    """(severity, category, n): how many rows break each rule; rules that none breaks are left out."""
    out = None
    for severity, category, broken in rules:
        one = broken.select(F.lit(severity).alias("severity"), F.lit(category).alias("category"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("severity", "category").agg(F.count("*").alias("n"))


def reachable(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """(key, reachable): whether anything uses a row; used(key) may repeat."""
    there = used.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__u", F.lit(True))
    return rows.select(key).join(there, key, "left").select(key, F.coalesce("__u", F.lit(False)).alias("reachable"))


def first_of(rows: DataFrame, group: str, value: str, *order: str) -> DataFrame:
    """(group, value): of several rows the first by the order counts."""
    return rows.groupBy(group).agg(F.min_by(value, F.struct(*order)).alias(value))


def merged(name: str, *columns: tuple[DataFrame, str]) -> DataFrame:
    """(name): the different values of several columns, each once."""
    out = None
    for df, c in columns:
        one = df.select(F.col(c).alias(name))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def note_numbers(rows: DataFrame, group: str, key: str, *order: str) -> DataFrame:
    """(key, number): notes are numbered from 1 in each group, by ranges, so that no group is one task."""
    return running_sum(rows.withColumn("__one", F.lit(1).cast("bigint")), group, *order, value="__one", name="number").select(key, "number")


def asset_set(documents: DataFrame, text: str, attribute: str = "href") -> DataFrame:
    """(attribute): the different values of an attribute in all documents."""
    return documents.select(F.explode(F.regexp_extract_all(text, F.lit(f' {attribute}="([^"]*)"'), F.lit(1))).alias(attribute)).distinct()


def section_members(rows: DataFrame, section: str, member: str, head: int = 0) -> DataFrame:
    """(section, members): the members of each section in order, its head first."""
    ids = F.concat(F.array(F.lit(head).cast(rows.schema[member].dataType)), F.sort_array(F.collect_list(member)))
    return rows.groupBy(F.col(section).alias("section")).agg(ids.alias("members"))


def index_stats(rows: DataFrame, kind: str, text: str, chars: str, source: str) -> DataFrame:
    """(kind, n, empty, chars, sources) of an index by kind."""
    empty = F.count_if(F.col(text).isNull() | (F.col(text) == ""))
    return rows.groupBy(kind).agg(F.count("*").alias("n"), empty.alias("empty"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars"), F.count_distinct(source).alias("sources"))
