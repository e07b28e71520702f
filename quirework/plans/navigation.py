"""Queries of navigation, files, inline content and styles over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import assets as A
from quirework.operators import blocks, inline, styles
from quirework.operators import navigation as N
from quirework.plans.documents import nodes_of
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


@query("SELECT book_id AS book, count(*) AS entries, max(chapter_id % 4) + 1 AS levels FROM chapters GROUP BY 1")
def q_toc_stats(t):
    return N.toc_stats(t("chapters").select(F.col("book_id").alias("book"), (F.col("chapter_id") % 4).alias("depth")))


def _entries(t) -> DataFrame:
    """Every customer's orders as a table of contents: an order whose key divides by 3 is on top, the others stand below the last of those."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    top = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey"))
    up = F.when(F.col("o_orderkey") % 3 != 0, F.last(top, ignorenulls=True).over(w))
    return t("orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("ord"), up.alias("parent_ord"))


_ENTRIES = "SELECT o_custkey AS book, o_orderkey AS ord, CASE WHEN o_orderkey % 3 <> 0 THEN max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS parent_ord FROM orders"


@query(f"WITH e AS ({_ENTRIES}) SELECT e.book, e.ord, e.parent_ord, min(k.ord) AS first_child, max(k.ord) AS last_child, count(k.ord) AS children FROM e LEFT JOIN e k ON k.book = e.book AND k.parent_ord = e.ord GROUP BY ALL")
def q_toc_flatten(t):
    return N.flattened(_entries(t))


@query(
    f"""WITH e AS ({_ENTRIES}), f AS (SELECT e.book, e.ord, e.parent_ord, e.ord // 64 AS record, count(k.ord) AS children FROM e LEFT JOIN e k ON k.book = e.book AND k.parent_ord = e.ord GROUP BY ALL),
      m AS (SELECT *, CASE WHEN lag(ord) OVER w = parent_ord OR (lag(children) OVER w = 0 AND children = 0 AND lag(ord) OVER w IS NOT NULL AND lag(parent_ord) OVER w IS NOT DISTINCT FROM parent_ord) THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY book, record ORDER BY ord))
      SELECT book, ord, sum(new) OVER (PARTITION BY book ORDER BY record, ord) AS strand FROM m"""
)
def q_strands(t):
    return N.strands(N.flattened(_entries(t)).withColumn("record", F.expr("ord div 64"))).select("book", "ord", "strand")


def _spine(t) -> DataFrame:
    return t("chapters").where("book_id is not null").groupBy(F.col("book_id").alias("book"), F.col("source_path").alias("path")).agg(F.min("chapter_key").alias("doc"))


_SPINE = "SELECT book_id AS book, source_path AS path, min(chapter_key) AS doc FROM chapters WHERE book_id IS NOT NULL GROUP BY 1, 2"


@query(
    f"""WITH s AS ({_SPINE}), l AS (SELECT chapter_key, book_id AS book, chapter_id, source_path || CASE chapter_id % 3 WHEN 1 THEN '#a' WHEN 2 THEN '#gone' ELSE '' END AS href FROM chapters WHERE book_id IS NOT NULL)
      SELECT chapter_key, CASE chapter_id % 3 WHEN 1 THEN 'internal' WHEN 0 THEN 'chapter' END AS target_kind, CASE WHEN chapter_id % 3 <> 2 THEN s.doc END AS target_doc, CASE WHEN chapter_id % 3 = 1 THEN 7 END AS target_node FROM l JOIN s ON s.book = l.book AND s.path = regexp_replace(l.href, '#.*', '')"""
)
def q_toc_targets(t):
    spine = _spine(t)
    tail = F.when(F.col("chapter_id") % 3 == 1, "#a").when(F.col("chapter_id") % 3 == 2, "#gone").otherwise("")
    toc = t("chapters").where("book_id is not null").select("chapter_key", F.col("book_id").alias("book"), F.concat("source_path", tail).alias("href"))
    anchors = spine.select("book", F.concat("path", F.lit("#a")).alias("key"), "doc", F.lit(7).alias("node"))
    return N.toc_targets(toc, spine, anchors).select("chapter_key", "target_kind", "target_doc", "target_node")


@query(
    """WITH p AS (SELECT o_custkey AS book, o_orderkey AS play_order, o_orderkey AS pos, 'c' || (o_orderkey % 5) || CASE WHEN o_orderkey % 4 = 0 THEN '#x' ELSE '' END AS href FROM orders),
      i AS (SELECT o_custkey AS book, l_orderkey * 1 + 1 AS pos, min(l_linenumber::VARCHAR) AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
      f AS (SELECT book, arg_min(id, pos) AS first FROM i GROUP BY 1)
      SELECT p.book, p.play_order, CASE WHEN contains(href, '#') THEN href WHEN coalesce(i.id, f.first) IS NOT NULL THEN href || '#' || coalesce(i.id, f.first) ELSE href END AS repaired
      FROM p ASOF LEFT JOIN i ON p.book = i.book AND p.pos >= i.pos LEFT JOIN f ON f.book = p.book"""
)
def q_repair_fragments(t):
    o, li = t("orders"), t("lineitem")
    toc = o.select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("play_order"), F.concat(F.lit("c"), (F.col("o_orderkey") % 5).cast("string"), F.when(F.col("o_orderkey") % 4 == 0, "#x").otherwise("")).alias("href"))
    places = o.select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("play_order"), F.col("o_orderkey").alias("pos"))
    ids = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("book"), (F.col("l_orderkey") + 1).alias("pos")).agg(F.min(F.col("l_linenumber").cast("string")).alias("id"))
    return N.repaired_fragments(toc, places, ids).select("book", "play_order", "repaired")


@query(
    f"""WITH s AS ({_SPINE}), l AS (SELECT book_id AS book, chapter_key, source_path AS href, CASE chapter_id % 3 WHEN 0 THEN 'bodymatter' WHEN 1 THEN 'x-own toc' ELSE 'unknown' END AS types FROM chapters WHERE book_id IS NOT NULL),
      o AS (SELECT l.book, CASE types WHEN 'bodymatter' THEN 'BodyMatter' ELSE 'Toc' END AS kind, min(s.doc) AS doc FROM l JOIN s ON s.book = l.book AND s.path = l.href WHERE types <> 'unknown' GROUP BY 1, 2),
      c AS (SELECT book, min(path) AS path FROM s GROUP BY 1)
      SELECT * FROM o UNION ALL SELECT s.book, 'Cover', min(doc) FROM s JOIN c USING (book, path) GROUP BY 1 UNION ALL SELECT s.book, 'StartReading', min(s.doc) FROM s LEFT JOIN c ON c.book = s.book AND c.path = s.path WHERE c.book IS NULL GROUP BY 1"""
)
def q_landmark_targets(t):
    spine = _spine(t)
    kinds = F.when(F.col("chapter_id") % 3 == 0, "bodymatter").when(F.col("chapter_id") % 3 == 1, "x-own toc").otherwise("unknown")
    marks = t("chapters").where("book_id is not null").select(F.col("book_id").alias("book"), F.col("source_path").alias("href"), kinds.alias("types"))
    none = spine.where("false").select("book", F.col("path").alias("key"), "doc", F.lit(0).alias("node"))
    return N.landmark_targets(marks, spine, none, spine.groupBy("book").agg(F.min("path").alias("path"))).select("book", "kind", "doc")


@query(
    """WITH p AS (SELECT l_orderkey AS book, l_linenumber AS node, l_partkey % 3 AS doc, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_quantity::BIGINT AS start FROM lineitem),
      g AS (SELECT o_orderkey AS book, o_custkey % 3 AS target_doc, CASE WHEN o_orderkey % 2 = 0 THEN 2 END AS target_node FROM orders),
      d AS (SELECT book, doc, min(start) AS start FROM p GROUP BY 1, 2)
      SELECT g.book, coalesce(p.start, d.start) AS position FROM g LEFT JOIN p ON p.book = g.book AND p.doc = target_doc AND p.node = target_node LEFT JOIN d ON d.book = g.book AND d.doc = target_doc"""
)
def q_toc_positions(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    n = F.col("l_quantity").cast("bigint")
    placed = t("lineitem").select(F.col("l_orderkey").alias("book"), (F.col("l_partkey") % 3).alias("doc"), F.col("l_linenumber").alias("node"), (F.sum(n).over(w) - n).alias("start"))
    targets = t("orders").select(F.col("o_orderkey").alias("book"), (F.col("o_custkey") % 3).alias("target_doc"), F.when(F.col("o_orderkey") % 2 == 0, 2).alias("target_node"))
    return N.toc_positions(targets, placed).select("book", "position")


@query(
    r"""WITH h AS (SELECT record_id AS doc, title, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0B_-]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM books)
      SELECT doc, slug FROM h WHERE slug <> '' AND doc IN (SELECT record_id FROM exth_headers)"""
)
def q_heading_slugs(t):
    heads = t("books").select(F.col("record_id").alias("doc"), F.lit(1).alias("node"), "title")
    return N.heading_slugs(heads, t("exth_headers").select(F.col("record_id").alias("target_doc"), F.lit(1).alias("target_node"))).select("doc", "slug")


@query("SELECT target, 'a' || upper(format('{:x}', row_number() OVER (ORDER BY f, target) - 1)) AS name FROM (SELECT source_path AS target, min(chapter_key) AS f FROM chapters WHERE source_path IS NOT NULL GROUP BY 1)")
def q_anchor_names(t):
    return N.anchor_names(t("chapters").select(F.col("source_path").alias("target"), "chapter_key"), "chapter_key")


@query("SELECT chapter_key, row_number() OVER (ORDER BY book_id, chapter_id, chapter_key) AS fragment FROM chapters WHERE book_id IS NOT NULL AND chapter_id IS NOT NULL")
def q_fragment_ids(t):
    return N.fragment_ids(t("chapters").where("book_id is not null and chapter_id is not null").select("book_id", "chapter_id", "chapter_key"), "book_id", "chapter_id", "chapter_key").select("chapter_key", F.col("fragment").cast("bigint").alias("fragment"))


@query("SELECT doc_id, CASE WHEN length(coalesce(source, '')) * 20 < coalesce(n_chars, 0) THEN length(coalesce(source, '')) * 20 ELSE 0 END AS clamped FROM documents")
def q_clamped(t):
    return t("documents").select("doc_id", N.clamped(F.length(F.coalesce("source", F.lit(""))) * 20, F.col("n_chars")).cast("bigint").alias("clamped"))


@query("SELECT o_orderkey AS ord, repeat('  ', (o_orderkey % 4)::INTEGER) || '- ' || o_clerk || CASE WHEN trim(o_comment) <> '' THEN ': ' || substr(trim(o_comment), 1, 12) ELSE '' END AS line FROM (SELECT *, o_orderpriority AS o_clerk, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || ' of ' || o_orderpriority ELSE ' ' END AS o_comment FROM orders)")
def q_outline_summaries(t):
    o = t("orders")
    sections = o.select(F.col("o_custkey").alias("doc_key"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("level"), F.col("o_orderpriority").alias("title"))
    said = o.select(F.col("o_custkey").alias("doc_key"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderstatus", F.lit(" of "), "o_orderpriority")).otherwise(" ").alias("summary"))
    return N.outline(sections, said, 12).select("ord", "line")


@query(
    """WITH s AS (SELECT o_custkey AS doc, row_number() OVER w AS ord, o_orderkey % 3 + 1 AS level, o_orderpriority AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
      e AS (SELECT a.doc, a.ord, coalesce(min(b.ord) - 1, max(m.stop)) AS last FROM s a JOIN (SELECT doc, max(ord) AS stop FROM s GROUP BY 1) m ON m.doc = a.doc LEFT JOIN s b ON b.doc = a.doc AND b.ord > a.ord AND b.level <= a.level GROUP BY 1, 2)
      SELECT e.doc AS doc_key, e.ord::INTEGER AS ord, md5(string_agg(s.t, chr(10) || chr(10) ORDER BY s.ord)) AS content FROM e JOIN s ON s.doc = e.doc AND s.ord BETWEEN e.ord AND e.last GROUP BY 1, 2"""
)
def q_section_content(t):
    s = t("orders").select(F.col("o_custkey").alias("doc_key"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ord"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("level"), F.col("o_orderpriority").alias("text"))
    own = s.select("doc_key", F.col("ord").alias("section_ord"), F.lit(1).alias("block_ord"), "text")
    return N.section_content(own, N.section_spans(s.select("doc_key", "ord", "level"))).select("doc_key", "ord", F.md5("content").alias("content"))


@query("SELECT chapter_key FROM chapters WHERE NOT (lower(source_path) = 'mimetype' OR lower(source_path) LIKE 'meta-inf/%' OR lower(source_path) LIKE '%.opf' OR lower(source_path) LIKE '%.ncx')")
def q_packaging(t):
    return t("chapters").where(~A.is_packaging(F.col("source_path"))).select("chapter_key")


@query("SELECT record_id AS book, cover_image IS NOT NULL AND regexp_extract(cover_image, '[^/]+$') IS DISTINCT FROM CASE WHEN record_id % 2 = 0 THEN regexp_extract(cover_image, '[^/]+$') ELSE 'other.png' END AS standalone FROM books")
def q_standalone_cover(t):
    b = t("books")
    first = b.select(F.col("record_id").alias("book"), F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("text/"), F.regexp_extract("cover_image", r"([^/]+)$", 1))).otherwise("img/other.png").alias("src"))
    return A.needs_cover(b.select(F.col("record_id").alias("book"), F.col("cover_image").alias("cover")), first).select("book", "standalone")


def _edits(t) -> DataFrame:
    keep = [F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.max("l_extendedprice").alias("l_extendedprice"), F.max("l_quantity").alias("l_quantity")]
    li = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*keep)
    path, size = F.concat(F.lit("p"), F.col("l_linenumber").cast("string")), (F.col("l_extendedprice")).cast("bigint")
    all_ = li.select(F.col("l_orderkey").alias("book"), path.alias("path"), F.when(F.col("l_suppkey") % 3 == 0, "image/gif").otherwise("image/png").alias("media_type"), size.alias("size"))
    new = li.select(F.col("l_orderkey").alias("book"), path.alias("path"), F.when(F.col("l_partkey") % 2 == 0, path).otherwise(F.concat(F.lit("q"), (F.col("l_linenumber") % 2).cast("string"))).alias("new_path"), (size - F.col("l_quantity").cast("bigint") * 60).alias("new_size"))
    styled = li.where("l_partkey % 5 = 0").select(F.col("l_orderkey").alias("book"), path.alias("path"))
    return A.accepted_edits(all_, new, styled)


_EDITS = """WITH li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, max(l_extendedprice) AS l_extendedprice, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2), a AS (SELECT l_orderkey AS book, 'p' || l_linenumber AS path, l_suppkey % 3 = 0 AS gif, trunc(l_extendedprice)::BIGINT AS size, CASE WHEN l_partkey % 2 = 0 THEN 'p' || l_linenumber ELSE 'q' || (l_linenumber % 2) END AS new_path, trunc(l_extendedprice)::BIGINT - trunc(l_quantity)::BIGINT * 60 AS new_size, l_partkey % 5 = 0 AS styled FROM li),
      f AS (SELECT * FROM a WHERE NOT gif AND size >= 10240 AND new_size <= size * 0.9),
      e AS (SELECT book, path, new_path, size AS old_size, new_size FROM f WHERE path = new_path UNION ALL
        SELECT book, path, new_path, size, new_size FROM (SELECT *, row_number() OVER (PARTITION BY book, new_path ORDER BY path) AS n FROM f WHERE path <> new_path AND NOT styled) WHERE n = 1)"""


@query(_EDITS + " SELECT * FROM e")
def q_asset_edits(t):
    return _edits(t)


@query(_EDITS + " SELECT book, count(*) AS changed, count(*) FILTER (new_path <> path) AS renamed, sum(old_size - new_size)::BIGINT AS saved FROM e GROUP BY 1")
def q_edit_report(t):
    return A.edit_report(_edits(t), "book")


@query("SELECT o_orderkey AS book, 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'g' ELSE 'f' END || o_orderkey AS served_as, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 3 = 1 THEN 'same' ELSE o_orderstatus END AS data FROM orders")
def q_overlay(t):
    o = t("orders")
    path = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))
    files = o.select(F.col("o_orderkey").alias("book"), path.alias("path"), F.col("o_orderstatus").alias("data"))
    edits = o.where("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("book"), path.alias("path"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("g"), F.col("o_orderkey").cast("string"))).otherwise(path).alias("new_path"), F.when(F.col("o_orderkey") % 3 == 0, "new").otherwise("same").alias("data"))
    return A.overlaid(files, edits)


@query("SELECT kind, count(*) AS n, sum(length(text)) AS bytes, max(length(text)) AS largest FROM documents GROUP BY 1")
def q_type_stats(t):
    return A.type_stats(t("documents").withColumn("size", F.length("text")), "kind", "size").select("kind", "n", "bytes", F.col("largest").cast("bigint").alias("largest"))


@query("SELECT book_id, sha1(string_agg(sha1(coalesce(document, '')), '' ORDER BY chapter_key, sha1(coalesce(document, '')))) AS sha1 FROM chapters GROUP BY 1")
def q_fingerprint(t):
    return A.fingerprint(t("chapters"), "book_id", "chapter_key", "document")


@query(r"WITH e AS (SELECT chapter_key, unnest(regexp_extract_all(document, '(?s)<(?:p|h2)(?: [^>]*)?>([^<]+)', 1)) AS x FROM chapters) SELECT chapter_key AS doc_key, count(*) AS segments, sum(length(x))::BIGINT AS chars, 0::BIGINT AS offsets FROM e GROUP BY 1")
def q_segments(t):
    n = nodes_of(t, again=True)
    own = inline.segments(n.where(F.coalesce("text", F.lit("x")).rlike(r"\S")).where(F.col("tag").isin("p", "h2", "#text")), "href", "id")
    return own.groupBy("doc_key").agg(F.count("*").alias("segments"), F.sum("length").cast("bigint").alias("chars"), F.sum("offset").cast("bigint").alias("offsets"))


@query(
    """SELECT doc_id AS doc_key, 3::BIGINT + CASE WHEN length(text) > 10 THEN 2 WHEN length(text) > 5 THEN 1 WHEN length(text) > 0 THEN 0 ELSE -1 END AS nodes, length(text)::BIGINT AS chars FROM documents WHERE text IS NOT NULL"""
)
def q_nested_spans(t):
    """A span over the first ten characters of each text, one over five of those: the texts come out whole."""
    d = t("documents").select(F.col("doc_id").alias("doc_key"), "text")
    spans = d.select("doc_key", F.explode(F.expr("array(named_struct('offset', 0, 'length', 10, 'name', 'outer'), named_struct('offset', 0, 'length', 5, 'name', 'inner'))")).alias("s")).select("doc_key", "s.offset", "s.length", "s.name")
    return inline.nested_spans(d, spans).groupBy("doc_key").agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars"))


@query("SELECT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(title), '[^a-z]+')) AS w FROM books) WHERE w <> '' EXCEPT SELECT w FROM (SELECT unnest(regexp_split_to_array(lower(title), '[^a-z]+')) AS w FROM exth_headers)")
def q_word_except(t):
    words = lambda df: df.select(F.explode(F.split(F.lower("title"), "[^a-z]+")).alias("word")).where("word <> ''")
    return words(t("books")).distinct().subtract(words(t("exth_headers")))


@query("SELECT record_id, 'CR!' || upper(substr(translate(sha1(coalesce(book_id, '')), 'abcdef', 'GHJKLM'), 1, 28)) AS container FROM books")
def q_container_id(t):
    return t("books").select("record_id", T.container_id(F.col("book_id")).alias("container"))


@query(
    """SELECT o_orderkey, o_orderkey % 3 IN (0, 1) AS is_bold, o_orderkey % 2 = 0 AS is_italic, o_orderkey % 5 = 0 AS is_underline, o_orderkey % 5 = 1 AS is_strike, o_orderkey % 7 = 1 AS is_sub, o_orderkey % 7 = 2 AS is_sup, o_orderkey % 4 = 0 AS is_monospace, o_orderkey % 4 = 1 AS is_small_caps FROM orders"""
)
def q_style_predicates(t):
    k = F.col("o_orderkey")
    s = t("orders").select(
        "o_orderkey",
        F.when(k % 3 == 0, "bold").when(k % 3 == 1, "800").otherwise("normal").alias("font_weight"),
        F.when(k % 2 == 0, "Italic").alias("font_style"),
        F.when(k % 5 == 0, "underline dotted").when(k % 5 == 1, "line-through").alias("text_decoration"),
        F.when(k % 7 == 1, "sub").when(k % 7 == 2, "super").alias("vertical_align"),
        F.when(k % 4 == 0, "Courier New, serif").otherwise("serif").alias("font_family"),
        F.when(k % 4 == 1, "small-caps").alias("font_variant"),
    )
    return styles.predicates(s).select("o_orderkey", *[f"is_{x}" for x in ("bold", "italic", "underline", "strike", "sub", "sup", "monospace", "small_caps")])


@query("WITH w AS (SELECT l_discount + 1.0 AS h, sum(l_quantity) AS w FROM lineitem GROUP BY 1) SELECT h, CASE WHEN abs(h / 1.2 - 1) > 0.02 THEN round(1.2 / h, 6) ELSE 1.0 END AS scale FROM w ORDER BY w DESC, h LIMIT 1")
def q_line_height(t):
    d = styles.dominant_line_height(t("lineitem").withColumn("h", (F.col("l_discount") + 1.0).cast("double")), "h", "l_quantity")
    return d.select("h", F.round("scale", 6).alias("scale"))


@query(r"""SELECT count(*) AS n, 'font-size' AS property FROM chapters WHERE document IS NOT NULL AND false GROUP BY 2 UNION ALL
      SELECT count(*), 'color' FROM (SELECT unnest(regexp_extract_all(document, '<p[ >]', 0)) FROM chapters) GROUP BY 2""")
def q_style_diff(t):
    """Of a sheet that colours bodies and paragraphs alike in one colour and font, only what a child wouldn't inherit is kept."""
    n = nodes_of(t, again=True)
    full = styles.cascade(n, "body { font-style: italic } section { font-style: italic } p { color: red; font-style: italic }", "")
    d = styles.difference(full, n).join(n.where("tag = 'p'").select("doc_key", "pre"), ["doc_key", "pre"], "left_semi")
    return d.groupBy("property").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS chapter, l_linenumber AS local_id, CASE WHEN l_linenumber <= 2 THEN l_linenumber * 100 + l_orderkey % 7 ELSE 0 END AS global_id FROM lineitem")
def q_style_remap(t):
    uses = t("lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("local_id"))
    known = uses.where("local_id <= 2").distinct().withColumn("global_id", (F.col("local_id") * 100 + F.col("chapter") % 7).cast("bigint"))
    return styles.remapped(uses, known).select("chapter", "local_id", F.col("global_id").cast("bigint").alias("global_id"))


@query(
    """SELECT o_orderkey, rule FROM (SELECT o_orderkey, 'all' AS rule FROM orders UNION ALL SELECT o_orderkey, 'tag' FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'class' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'id' FROM orders WHERE o_orderkey = 7)"""
)
def q_candidate_rules(t):
    k = F.col("o_orderkey")
    elements = t("orders").select(k.alias("element"), F.when(k == 7, "seven").alias("id"), F.when(k % 3 == 0, "third  other").alias("class"), F.lower("o_orderstatus").alias("tag"))
    rules = t("orders").sparkSession.createDataFrame([("all", "*", ""), ("tag", "t", "o"), ("class", ".", "third"), ("id", "#", "seven"), ("none", ".", "absent")], "rule string, kind string, name string")
    return styles.candidate_rules(elements, rules).select(F.col("element").alias("o_orderkey"), "rule")


@query(
    """SELECT 'text-align' AS property, CASE o_orderkey % 2 WHEN 0 THEN 'center' ELSE 'right' END AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL
      SELECT 'font-size', CASE o_orderkey % 3 WHEN 0 THEN 'x-large' ELSE 'larger' END, count(*) FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 5 = 0 GROUP BY 2 UNION ALL
      SELECT 'width', '40px', count(*) FROM orders WHERE o_orderkey % 5 = 1"""
)
def q_hints(t):
    k = F.col("o_orderkey")
    n = t("orders").select(
        k.alias("doc_key"), F.lit(0).alias("pre"), F.when(k % 5 == 0, "font").when(k % 5 == 1, "TD").otherwise("p").alias("tag"), F.when(k % 2 == 0, "CENTER").otherwise("right").alias("align"), F.lit("sideways").alias("valign"),
        F.when(k % 3 == 0, "5").when(k % 3 == 1, "+1").otherwise("huge").alias("size"), *[F.lit(None).cast("string").alias(c) for c in ("color", "face", "bgcolor")], F.lit(" 40").alias("width"), F.lit("tall").alias("height"),
    )
    return styles.hints(n).groupBy("property", "value").agg(F.count("*").alias("n"))


@query(
    """WITH m AS (SELECT o_orderkey AS doc_key, (o_orderkey % 9) * 1.0 AS a, (o_orderkey % 4) * 1.0 - 2 AS b FROM orders)
      SELECT doc_key, unnest(['0a', '1z', '2z']) AS set, unnest([greatest(0, 3.0, a) + least(0, 3.0, a), greatest(0, a, b) + least(0, a, b), greatest(0, b, 3.0) + least(0, b, 3.0)])::DOUBLE AS margin FROM m"""
)
def q_margin_sets(t):
    """A block with two children: its top meets the first one's, the children's meet each other, its bottom the last one's."""
    k = F.col("o_orderkey")
    a, b = (k % 9).cast("double"), (k % 4).cast("double") - 2
    row = lambda pre, parent, top, bottom: F.struct(F.lit(pre).alias("pre"), F.lit(parent).cast("int").alias("parent_pre"), top.alias("top"), bottom.alias("bottom"))
    three = F.array(row(0, None, F.lit(3.0), F.lit(3.0)), row(1, 0, a, a), row(2, 0, b, b))
    nodes = t("orders").select(k.alias("doc_key"), F.explode(three).alias("r")).select("doc_key", "r.*", F.lit(False).alias("closed"))
    sets = styles.margin_sets(nodes)
    return sets.select("doc_key", F.regexp_replace(F.col("set"), "^0z$", "2z").alias("set"), "margin")


def _made(t) -> DataFrame:
    return t("books").select("record_id", F.concat(F.lit('<a xmlns:q="u" href="part1.html" aid="'), F.col("record_id").cast("string"), F.lit('" data-AmznRemoved="1">'), F.coalesce("title", F.lit("")), F.lit('</a><img src="x"/><p xml:lang="en" q:a="b">')).alias("html"))


@query("""SELECT record_id, '<a xmlns:q="u" aid="' || record_id || '" data-AmznRemoved="1">' || coalesce(title, '') || '</a><img src="x"/><p xml:lang="en" q:a="b">' AS html FROM books""")
def q_neutral_links(t):
    return _made(t).select("record_id", T.without_file_links(F.col("html")).alias("html"))


@query("""SELECT record_id, '<a xmlns:q="u" href="part1.html">' || coalesce(title, '') || '</a><img alt="" src="x"/><p xml:lang="en" q:a="b">' AS html FROM books""")
def q_reader_attributes(t):
    return _made(t).select("record_id", T.with_alternatives(T.without_reader_attributes(F.col("html"))).alias("html"))


@query("""SELECT record_id, '<a href="part1.html" aid="' || record_id || '" data-AmznRemoved="1">' || coalesce(title, '') || '</a><img src="x"/><p xml:lang="en">' AS html FROM books""")
def q_namespaces(t):
    return _made(t).select("record_id", T.without_namespaces(F.col("html")).alias("html"))


@query("SELECT record_id, 'p { color: red }  @media print { p { margin: 0 } } .c' || record_id || ' { margin: 0 }' AS css FROM books")
def q_at_rules(t):
    sheet = F.concat(F.lit("p { color: red } @supports (display: grid) { p { display: grid } } @media print { p { margin: 0 } }@namespace q url(x); .c"), F.col("record_id").cast("string"), F.lit(" { margin: 0 }"))
    return t("books").select("record_id", T.without_at_rules(sheet).alias("css"))


@query("""SELECT chapter_key, CASE WHEN chapter_key % 2 = 0 THEN document ELSE '<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>' || coalesce(replace(replace(replace(replace(replace(source_path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'), '') || '</title></head><body><p>' || chapter_id || '</p></body></html>' END AS html FROM chapters WHERE document IS NOT NULL AND document <> '' AND chapter_id IS NOT NULL""")
def q_wrapped_html(t):
    c = t("chapters").where("document is not null and document <> '' and chapter_id is not null")
    body = F.when(F.col("chapter_key") % 2 == 0, F.col("document")).otherwise(F.concat(F.lit("<p>"), F.col("chapter_id").cast("string"), F.lit("</p>")))
    return c.select("chapter_key", T.wrapped_html(body, F.col("source_path")).alias("html"))


@query("SELECT chapter_key AS doc_key, true AS display FROM chapters WHERE document IS NOT NULL AND document <> '' UNION ALL SELECT chapter_key, false FROM chapters WHERE document IS NOT NULL AND document <> ''")
def q_display_math(t):
    """One formula alone in its paragraph, one in a sentence, in a page for every chapter."""
    page = F.lit("<p> <math><mi>x</mi></math> </p><p>as <math><mi>y</mi></math> says</p>")
    from quirework.sources.html import html_nodes

    n = html_nodes(t("chapters").where("document is not null and document <> ''").select("chapter_key", page.alias("page")), "chapter_key", "page")
    return blocks.display_math(n).select("doc_key", "display")
