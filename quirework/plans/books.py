"""Queries of the book-level operators, codecs and math, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirework.functions import codecs, mathml
from quirework.operators import blocks, books, positions, retrieval
from quirework.plans.documents import _said, nodes_of
from quirework.session import prepare, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(lambda name: table(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return run

    return add


@query("SELECT b.book_id, count(*) AS deliveries, arg_min(b.title, b.record_id) AS title, any_value(c.n) AS chapters FROM books b LEFT JOIN (SELECT book_id, count(*) AS n FROM chapters GROUP BY 1) c ON b.book_id = c.book_id GROUP BY 1")
def q_info(t):
    c = t("chapters").groupBy("book_id").agg(F.count("*").alias("chapters"))
    b = t("books").groupBy("book_id").agg(F.count("*").alias("deliveries"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("record_id"))).alias("title"))
    return b.join(c, "book_id", "left")


@query()
def q_info_json(t):
    c = t("chapters").groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("chapter_id", "chapter_key", "source_path"))).alias("spine"))
    b = t("books").join(c, "book_id", "left")
    return b.select("record_id", F.to_json(F.struct("title", "authors", "language", "publisher", "subjects", "collection", "spine")).alias("info"))


@query(rf"""SELECT chapter_key AS doc_key, '[{{"ord":1,"level":2,"title":' || to_json({_said("regexp_extract(document, '(?s)<h2>(.*?)</h2>', 1)")}) || '}}]' AS sections FROM chapters WHERE contains(document, '<h2>')""")
def q_sections_json(t):
    s = blocks.sections(nodes_of(t, again=True))
    return s.groupBy("doc_key").agg(F.to_json(F.sort_array(F.collect_list(F.struct("ord", "level", "title", "parent_ord")))).alias("sections"))


@query()
def q_ir_dump(t):
    n = nodes_of(t)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("role"), F.coalesce(F.concat(F.lit(" "), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 60)), F.lit("")))
    return n.select("doc_key", "pre", line.alias("line"))


@query(
    rf"""WITH h AS (SELECT book_id, chapter_key, {_said("regexp_extract(document, '(?s)<h2>(.*?)</h2>', 1)")} AS title FROM chapters WHERE contains(document, '<h2>')),
      p AS (SELECT book_id, chapter_key, regexp_extract_all(document, '(?s)<p(?: [^>]*)?>(.*?)</p>', 1) AS ps FROM chapters WHERE contains(document, '<p')),
      e AS (SELECT book_id, chapter_key, {_said('x')} AS x, n FROM (SELECT book_id, chapter_key, unnest(ps) AS x, unnest(range(1, len(ps) + 1)) AS n FROM p))
      SELECT sha256(concat_ws('|', book_id, chapter_key::VARCHAR, 'section', '1')) AS node_id, book_id, 'section' AS kind, title, '' AS text FROM h WHERE title <> ''
      UNION ALL SELECT sha256(concat_ws('|', book_id, chapter_key::VARCHAR, 'leaf', n::VARCHAR)), book_id, 'leaf', '', x FROM e WHERE length(x) >= 10"""
)
def q_index_nodes(t):
    n = nodes_of(t, again=True)
    c = t("chapters").select(F.col("chapter_key").alias("doc_key"), "book_id")
    h = blocks.sections(n).join(c, "doc_key")
    x = blocks.section_blocks(n).join(c, "doc_key").withColumn("ord", F.col("block_ord"))
    return books.index_nodes(h, x)


@query(
    r"""WITH q AS (SELECT ['small', 'ring'] AS w, 'small ring' AS n), a AS (SELECT p_partkey, p_name, lower(trim(p_name)) AS n, list_distinct(list_filter(regexp_split_to_array(lower(trim(p_name)), '\s+'), lambda x: x <> '')) AS w FROM part),
      s AS (SELECT p_partkey, p_name, round(greatest(len(list_intersect(a.w, q.w)) / len(list_distinct(list_concat(a.w, q.w))), CASE WHEN contains(a.n, q.n) OR contains(q.n, a.n) THEN 0.5 + 0.5 * least(length(a.n), length(q.n)) / greatest(length(a.n), length(q.n)) ELSE 0 END), 6)::DOUBLE AS score FROM a, q)
      SELECT p_partkey, p_name, score FROM s WHERE score >= 0.1 ORDER BY score DESC, p_partkey LIMIT 1"""
)
def q_get_section(t):
    return books.best_title(t("part").select("p_partkey", "p_name"), "p_name", "small ring", "p_partkey")


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name, lower(trim(p_name)) AS low FROM part), w AS (SELECT unnest(['small ring', 'red', 'no such thing', 'small rin']) AS wanted),
      s AS (SELECT wanted, min(name) AS same FROM w JOIN n ON low = wanted GROUP BY 1), h AS (SELECT wanted, count(*) AS matches, min(name) AS one FROM w JOIN n ON contains(low, wanted) GROUP BY 1)
      SELECT w.wanted, coalesce(same, CASE WHEN matches = 1 THEN one END) AS name, coalesce(matches, 0) AS matches FROM w LEFT JOIN s USING (wanted) LEFT JOIN h USING (wanted)"""
)
def q_resolve_book(t):
    p = t("part")
    wanted = p.sparkSession.createDataFrame([("small ring",), ("red",), ("no such thing",), ("small rin",)], "wanted string")
    return books.resolve_name(p.select(F.col("p_name").alias("name")), wanted)


@query("SELECT chapter_key, left(document, 3000) AS shown FROM chapters")
def q_content_caps(t):
    return t("chapters").select("chapter_key", books.capped(F.col("document"), F.lit("leaf")).alias("shown"))


@query("SELECT source AS name, row_number() OVER (ORDER BY f, source) - 1 + 852 AS symbol FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY 1)")
def q_symbols(t):
    return books.symbols(t("documents").select(F.col("source").alias("name"), "doc_id"), "name", "doc_id")


@query("SELECT href, 'e' || printf('%X', row_number() OVER (ORDER BY f, href) - 1) AS resource FROM (SELECT source_path AS href, min(chapter_key) AS f FROM chapters GROUP BY 1)")
def q_resource_names(t):
    return books.resource_names(t("chapters").select(F.col("source_path").alias("href"), "chapter_key"), "href", "chapter_key")


@query("SELECT DISTINCT href FROM (SELECT unnest(regexp_extract_all(document, ' href=\"([^\"]*)\"', 1)) AS href FROM chapters)")
def q_asset_set(t):
    return books.asset_set(t("chapters"), "document")


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents), s AS (SELECT DISTINCT lower(term) AS term FROM subject_terms) SELECT doc_id, term, count(*) AS n FROM w JOIN s USING (term) GROUP BY 1, 2")
def q_mentions(t):
    return books.mentions(t("documents"), t("subject_terms").select(F.lower("term").alias("term")), "doc_id", "text")


@query("WITH c AS (SELECT chapter_key, list_filter(string_split(document, '</p>'), lambda x: trim(x) <> '') AS c FROM chapters WHERE document IS NOT NULL) SELECT chapter_key, unnest(range(len(c)))::INTEGER AS part, unnest(c) AS chunk FROM c")
def q_page_breaks(t):
    return books.split_chapters(t("chapters"), "chapter_key", "document", "</p>")


@query(
    """SELECT severity, category, count(*) AS n FROM (
      SELECT 'error' AS severity, 'chapter without book' AS category FROM chapters WHERE book_id NOT IN (SELECT book_id FROM books WHERE book_id IS NOT NULL)
      UNION ALL SELECT 'warning', 'empty chapter' FROM chapters WHERE document IS NULL
      UNION ALL SELECT 'warning', 'chapter loaded twice' FROM (SELECT book_id, chapter_id FROM chapters GROUP BY 1, 2 HAVING count(*) > 1)
      UNION ALL SELECT 'error', 'header without book' FROM exth_headers WHERE record_id NOT IN (SELECT record_id FROM books)
      UNION ALL SELECT 'info', 'no language' FROM books WHERE coalesce(language, '') = '') GROUP BY 1, 2"""
)
def q_validate(t):
    b, c, e = t("books"), t("chapters"), t("exth_headers")
    return books.report(
        ("error", "chapter without book", c.where("book_id is not null").join(b.select("book_id").distinct(), "book_id", "left_anti")),
        ("warning", "empty chapter", c.where("document is null")),
        ("warning", "chapter loaded twice", c.groupBy("book_id", "chapter_id").count().where("count > 1")),
        ("error", "header without book", e.join(b.select("record_id"), "record_id", "left_anti")),
        ("info", "no language", b.where("coalesce(language, '') = ''")),
    )


@query("SELECT event_id, event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS separated FROM events")
def q_list_separators(t):
    return blocks.list_separators(t("events"), "user_id", "event_id", "event_type", "ts", "event_id")


@query("SELECT o_custkey AS section, [0] || list(o_orderkey ORDER BY o_orderkey) AS members FROM orders GROUP BY 1")
def q_section_members(t):
    return books.section_members(t("orders"), "o_custkey", "o_orderkey")


@query(
    """WITH st AS (SELECT c_custkey AS id, c_acctbal AS s FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, id LIMIT 30), sg AS (SELECT o_custkey AS id, sum(o_totalprice) AS s FROM orders GROUP BY 1),
      u AS (SELECT coalesce(st.id, sg.id) AS id, coalesce(st.s, 0) AS a, coalesce(sg.s, 0) AS b FROM st FULL JOIN sg ON st.id = sg.id), n AS (SELECT id, a / (SELECT max(a) FROM u) AS a, b / (SELECT max(b) FROM u) AS b FROM u)
      SELECT id, round(a, 6) AS s_t, round(b, 6) AS s_g FROM n x WHERE NOT EXISTS (SELECT 1 FROM n y WHERE y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b)) ORDER BY a + b DESC, id LIMIT 10"""
)
def q_search(t):
    s_t = retrieval.top(t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), 30, "id")
    s_g = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("score"))
    return retrieval.search(s_t, s_g, "id").select("id", F.round("s_t", 6).alias("s_t"), F.round("s_g", 6).alias("s_g"))


@query(r"SELECT p_partkey, '\frac{' || p_size || '}{\sqrt{' || p_partkey || '}}' AS latex, '(' || p_size || ')/(√(' || p_partkey || '))' AS said FROM part")
def q_math(t):
    source = F.concat(F.lit("<math><mfrac><mn>"), "p_size", F.lit("</mn><msqrt><mn>"), "p_partkey", F.lit("</mn></msqrt></mfrac></math>"))

    @F.pandas_udf(StringType())
    def latex(s: pd.Series) -> pd.Series:
        return s.map(lambda x: mathml.to_latex(mathml.parse(x)))

    @F.pandas_udf(StringType())
    def said(s: pd.Series) -> pd.Series:
        return s.map(lambda x: mathml.to_text(mathml.parse(x)))

    return t("part").withColumn("m", source).select("p_partkey", latex("m").alias("latex"), said("m").alias("said"))


@query("SELECT doc_id, text FROM documents")
def q_decode_text(t):
    western = F.col("text").rlike(r"^[\x00-\x7f\xa1-\xff]*\z")
    raw = F.when(western, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return t("documents").select("doc_id", codecs.decode_text(raw, F.when(western, "latin-1").otherwise("utf-8")).alias("text"))


@query("SELECT doc_id, text FROM documents")
def q_palmdoc(t):
    """Every text compressed and decompressed again."""
    raw = codecs.palmdoc_decompress(codecs.palmdoc_compress(F.encode("text", "UTF-8")))
    return t("documents").select("doc_id", F.decode(raw, "UTF-8").alias("text"))


@query("SELECT doc_id, text FROM documents")
def q_percent_round_trip(t):
    escaped = F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))
    return t("documents").select("doc_id", codecs.percent_decode(escaped).alias("text"))


@query("SELECT doc_id, text FROM documents")
def q_entities(t):
    coded = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&#x3C;")), F.lit("é"), F.lit("&eacute;"))
    return t("documents").select("doc_id", codecs.resolve_entities(coded).alias("text"))


@query("WITH w AS (SELECT user_id, unnest(range(time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes', time_bucket(INTERVAL '30 minutes', ts) + INTERVAL '1 minute', INTERVAL '30 minutes')) AS start FROM events) SELECT user_id, start, count(*) AS n FROM w GROUP BY 1, 2")
def x_sliding(t):
    w = F.window("ts", "1 hour", "30 minutes")
    return t("events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem) SELECT l_orderkey, o, sum(greatest(l_quantity::BIGINT, 1)) OVER (PARTITION BY l_orderkey ORDER BY o)::BIGINT - greatest(l_quantity::BIGINT, 1) AS start FROM i")
def q_text_offsets(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    i = t("lineitem").select("l_orderkey", F.row_number().over(w).cast("bigint").alias("o"), F.col("l_quantity").cast("bigint").alias("q"))
    return positions.positions(i, "l_orderkey", "o", "q").select("l_orderkey", "o", "start")
