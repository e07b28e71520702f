"""Queries of the look-ups over entities and relations and of the books' package files, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators import passes, positions, tools
from quirework.plans.navigation import ORACLE, QUERIES, query
from quirework.session import spread, stored
from quirework.sources import books as any_books
from quirework.sources import epub, html, mobi

__all__ = ["ORACLE", "QUERIES"]

_M = "SELECT record_id AS node, unnest(authors) AS name, format AS type, description, record_id AS ord FROM books"


def _mentions(t) -> DataFrame:
    return t("books").select(F.col("record_id").alias("node"), F.explode("authors").alias("name"), F.col("format").alias("type"), "description", F.col("record_id").alias("ord"))


@query(
    f"""WITH m AS (SELECT *, lower(trim(name)) AS key FROM ({_M}) WHERE trim(name) <> ''), k AS (SELECT key, arg_min(name, (ord, name)) AS name, count(DISTINCT node) AS nodes FROM m GROUP BY 1),
      t AS (SELECT key, type, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, type) AS n FROM m WHERE type IS NOT NULL GROUP BY 1, 2), d AS (SELECT key, arg_min(description, (ord, description)) AS description FROM m WHERE trim(coalesce(description, '')) <> '' GROUP BY 1)
      SELECT k.key, k.name, t.type, d.description, k.nodes FROM k LEFT JOIN t ON t.key = k.key AND t.n = 1 LEFT JOIN d ON d.key = k.key"""
)
def q_entities_built(t):
    return tools.entities(_mentions(t))


@query(f"WITH k AS (SELECT DISTINCT lower(trim(name)) AS key FROM ({_M}) WHERE trim(name) <> ''), r AS (SELECT lower(trim(authors[1])) AS source, lower(trim(publisher)) AS target, language AS label FROM exth_headers) SELECT key, source, target, label FROM r JOIN k ON source = key UNION ALL SELECT key, source, target, label FROM r JOIN k ON target = key WHERE source <> target")
def q_relations_of(t):
    r = t("exth_headers").select(F.get("authors", F.lit(0)).alias("source"), F.col("publisher").alias("target"), F.col("language").alias("label"))
    return tools.relations_of(r, tools.linked(_mentions(t)))


@query(f"WITH m AS (SELECT DISTINCT lower(trim(name)) AS key, node FROM ({_M}) WHERE trim(name) <> ''), k AS (SELECT DISTINCT key FROM m WHERE contains(key, 'press') OR contains('press', key)) SELECT node AS node_id, book_id AS top, count(*) AS mentions FROM m JOIN k USING (key) JOIN books ON record_id = node GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10")
def q_find_related(t):
    links = tools.linked(_mentions(t))
    matched = tools.matched_entities(links.select("key").distinct(), "Press")
    return tools.related(matched, links, t("books").select(F.col("record_id").alias("node_id"), F.col("book_id").alias("top")))


@query(f"WITH m AS (SELECT DISTINCT lower(trim(name)) AS key, node FROM ({_M}) WHERE trim(name) <> ''), k AS (SELECT DISTINCT key FROM m WHERE contains(key, 'press') OR contains('press', key) ORDER BY length(key), key LIMIT 1) SELECT key, node FROM m JOIN k USING (key)")
def q_select_by_entity(t):
    links = tools.linked(_mentions(t))
    none = t("books").where("false").selectExpr("title AS source", "title AS target", "title AS label")
    return tools.selected_by_entity("press", links.select("key").distinct(), links, none)[0]


@query()
def q_query_entities(t):
    keys = tools.entities(_mentions(t)).select("key", "name")
    return tools.query_entities(tools.embed(keys, "key", "name"), tools.embedded("institute for book history")).withColumn("score", F.round("score", 6))


@query(
    r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS a FROM documents),
      s AS (SELECT doc_id, len(list_filter(['old', 'lighthouse'], lambda x: list_contains(a, x))) AS shared, len(a) AS n FROM w) SELECT doc_id, round(shared / (n + 2 - shared), 6) AS score FROM s ORDER BY shared / (n + 2 - shared) DESC, doc_id LIMIT 10"""
)
def q_reranked(t):
    return tools.reranked(t("documents"), "old lighthouse", "doc_id", "text").withColumn("score", F.round("score", 6))


def _packages(t) -> DataFrame:
    """Every delivery's metadata as an EPUB file without documents."""
    b = t("books").select("record_id", "title", "title_sort", "contributors", "collection", "page_progression_direction")

    def text(x: object) -> str:
        return escape("".join(c for c in str(x) if c >= " " and not "\ud800" <= c <= "\udfff" and c not in "￾￿"))

    def package(title: str | None, sort: str | None, people: list | None, group: dict | None, direction: str | None) -> bytes:
        meta = f'<dc:title id="t">{text(title)}</dc:title>' if title else ""
        meta += f'<meta refines="#t" property="file-as">{text(sort)}</meta>' if sort and title else ""
        for i, p in enumerate(people or []):
            if p and p["name"]:
                meta += f'<dc:contributor id="k{i}">{text(p["name"])}</dc:contributor>'
                meta += "".join(f'<meta refines="#k{i}" property="{k}">{text(p[c])}</meta>' for k, c in (("file-as", "file_as"), ("role", "role")) if p[c])
        if group and group["name"]:
            meta += f'<meta property="belongs-to-collection" id="g">{text(group["name"])}</meta>'
            meta += f'<meta refines="#g" property="group-position">{group["position"]}</meta>' if group["position"] is not None else ""
        turned = f' page-progression-direction="{text(direction)}"' if direction else ""
        return epub.packaged(f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest/><spine{turned}/></package>')

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("title", "title_sort", "contributors", "collection", "page_progression_direction")), strict=True)
            keys = [str(x) for x in batch.column("record_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([package(*r) for r in rows], pa.binary())], ["path", "content"])

    return spread(b).mapInArrow(run, "path string, content binary")


@query(
    r"""SELECT record_id, len(list_filter(contributors, lambda x: x.name <> '' AND regexp_matches(x.name, '\S')))::BIGINT AS contributors, collection.position AS position, CASE WHEN page_progression_direction <> '' THEN page_progression_direction END AS direction FROM books"""
)
def q_epub_refinements(t):
    """Contributors, collection and direction of every delivery, as they are read back out of its package file."""
    meta = epub.read_epub(_packages(t), "metadata").where("error is null")
    return meta.select(F.col("path").cast("bigint").alias("record_id"), F.nullif(F.size("contributors"), F.lit(-1)).cast("bigint").alias("contributors"), F.col("collection.position").alias("position"), "direction")


@query(r"""SELECT chapter_key AS doc_key, 0 AS ord, 'link' AS kind, unnest(regexp_extract_all(document, '<link[^>]* href="([^"]*)"', 1)) AS value FROM chapters""")
def q_stylesheets(t):
    return html.stylesheets(t("chapters"), "chapter_key", "document")


@query(r"SELECT chapter_key AS doc_key, count(*) AS texts FROM (SELECT chapter_key, unnest(regexp_extract_all(document, '(?s)<(?:p|h2)(?: [^>]*)?>([^<]+)', 1)) FROM chapters) GROUP BY 1")
def q_inline_spaces(t):
    """No line break between blocks is left as text."""
    n = stored(html.html_nodes(t("chapters"), "chapter_key", "document"), "nodes")
    return passes.inline_spaces(n).where("role = 'Text'").groupBy("doc_key").agg(F.count("*").alias("texts"))


@query("SELECT chapter_key, document, octet_length(encode(document)) // 1000 >= 0 AS small FROM chapters WHERE document IS NOT NULL")
def q_body_chunks(t):
    """Every document out of its chunks of at most 1,000 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, i, c.decode(), len(c) <= 1000) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(mobi.body_chunks(x.encode(), 1000))]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.bool_()), strict=True)], ["chapter_key", "n", "chunk", "small"])

    c = spread(t("chapters").where("document is not null").select("chapter_key", "document")).mapInArrow(run, "chapter_key bigint, n int, chunk string, small boolean")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("n", "chunk"))), lambda x: x["chunk"])
    return c.groupBy("chapter_key").agg(F.array_join(parts, "").alias("document"), F.bool_and("small").alias("small"))


_PLACED = "SELECT doc_id, source, text, greatest(coalesce(n_chars, 0), 1) AS size, sum(greatest(coalesce(n_chars, 0), 1)) OVER (PARTITION BY source ORDER BY doc_id) - greatest(coalesce(n_chars, 0), 1) AS start FROM documents"


def _placed(t) -> DataFrame:
    return positions.positions(t("documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars")


@query(f"SELECT source, count(*) AS elements, min(start)::BIGINT AS first, max(start)::BIGINT AS last, sum(size)::BIGINT AS length FROM ({_PLACED}) GROUP BY 1")
def q_position_report(t):
    return positions.position_report(_placed(t), "source")


@query(f"SELECT doc_id, o AS offset, substr(text, (o + 1)::INTEGER, 40) AS snippet FROM (SELECT doc_id, text, unnest(range(0, size, 150)) AS o FROM ({_PLACED}))")
def q_location_report(t):
    return positions.location_report(positions.locations(_placed(t)), t("documents"), "doc_id", "text").select("doc_id", "offset", "snippet")


@query()
def q_markdown_books(t):
    """Every chapter as a Markdown book of its own, by the writer that its format asks for."""
    c = t("chapters").where("document is not null")
    own = c.select(F.col("chapter_key").cast("string").alias("book_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("language"), F.array().cast("array<string>").alias("authors"), F.array(F.struct(F.lit("t").alias("title"), F.col("document").alias("xhtml"))).alias("chapters"))
    return any_books.exported(own, "markdown").select(F.col("book_id").cast("bigint").alias("chapter_key"), F.decode("content", "UTF-8").alias("markdown"))
