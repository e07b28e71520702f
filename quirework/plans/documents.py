"""Queries of the document operators over the chapters' XHTML, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import render
from quirework.functions import text as T
from quirework.operators import blocks, links, passes, rewrite, styles, tree
from quirework.session import prepare, stored, table
from quirework.sources.epub import read_epub, to_epub
from quirework.sources.html import html_nodes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0B]+"


def _said(sql: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({sql}, '[\x{{00AD}}\x{{200B}}]', '', 'g'), '{_SPACE}', ' ', 'g'))"


_TRIMMED = rf"regexp_replace(regexp_replace(said, '^{_SPACE}', ''), '{_SPACE}$', '')"


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


def nodes_of(t, again: bool = False) -> DataFrame:
    """The chapters' nodes; written once where a query joins them with themselves."""
    nodes = html_nodes(t("chapters"), "chapter_key", "document")
    return stored(nodes, "nodes") if again else nodes


@query("WITH e AS (SELECT unnest(regexp_extract_all(document, '<([a-z0-9]+)', 1)) AS tag FROM chapters) SELECT tag, count(*) AS n FROM e WHERE tag NOT IN ('html', 'head', 'title', 'link') GROUP BY 1")
def q_html_nodes(t):
    return nodes_of(t).where("tag <> '#text'").groupBy("tag").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT unnest(regexp_extract_all(document, '<([a-z0-9]+)', 1)) AS tag FROM chapters) SELECT CASE tag WHEN 'p' THEN 'Paragraph' WHEN 'h2' THEN 'Heading' ELSE 'Container' END AS role, count(*) AS n FROM e WHERE tag NOT IN ('html', 'head', 'title', 'link') GROUP BY 1")
def q_roles(t):
    return nodes_of(t).where("role <> 'Text'").groupBy("role").agg(F.count("*").alias("n"))


@query(rf"SELECT chapter_key AS doc_key, 2 AS level, title FROM (SELECT chapter_key, {_said("regexp_extract(document, '(?s)<h2>(.*?)</h2>', 1)")} AS title FROM chapters WHERE contains(document, '<h2>')) WHERE title <> ''")
def q_headings(t):
    return blocks.headings(nodes_of(t, again=True)).select("doc_key", "level", "title")


@query(rf"SELECT chapter_key AS doc_key, coalesce(nullif({_said("regexp_extract(document, '(?s)<h2>(.*?)</h2>', 1)")}, ''), source_path) AS title FROM chapters")
def q_h1_title(t):
    c = t("chapters")
    return blocks.chapter_title(nodes_of(t, again=True), c.select(F.col("chapter_key").alias("doc_key"), F.col("source_path").alias("path")))


@query(rf"WITH p AS (SELECT chapter_key, regexp_extract_all(document, '(?s)<p(?: [^>]*)?>(.*?)</p>', 1) AS ps FROM chapters WHERE contains(document, '<p')), e AS (SELECT chapter_key, unnest(ps) AS x, unnest(range(1, len(ps) + 1)) AS n FROM p) SELECT chapter_key AS doc_key, 1 AS section_ord, n::INTEGER AS block_ord, 'Paragraph' AS role, {_said('x')} AS text FROM e")
def q_blocks(t):
    return blocks.section_blocks(nodes_of(t, again=True))


@query("SELECT chapter_key AS doc_key, 1 AS ord, 2 AS level, NULL::INTEGER AS parent_ord FROM chapters WHERE contains(document, '<h2>')")
def q_outline_sections(t):
    return blocks.sections(nodes_of(t, again=True)).select("doc_key", "ord", "level", "parent_ord")


@query(rf"SELECT chapter_key AS doc_key, '  - ' || CASE WHEN length(title) > 150 THEN left(title, 150) || '...' ELSE title END AS outline FROM (SELECT chapter_key, {_said("regexp_extract(document, '(?s)<h2>(.*?)</h2>', 1)")} AS title FROM chapters WHERE contains(document, '<h2>')) WHERE title <> ''")
def q_outline(t):
    return blocks.outline(blocks.sections(nodes_of(t, again=True)))


@query()
def q_node_stats(t):
    return blocks.stats(nodes_of(t))


@query("SELECT chapter_key AS doc_key, chapter_key % 2 = 0 AS image_only FROM chapters")
def q_image_only(t):
    """A page for every chapter, half of them with nothing but an image."""
    page = F.when(F.col("chapter_key") % 2 == 0, '<body> <div><img src="a.png"/></div> </body>').otherwise('<body><p>one</p><img src="a.png"/></body>')
    return blocks.image_only(html_nodes(t("chapters").select("chapter_key", page.alias("page")), "chapter_key", "page"))


@query("SELECT chapter_key AS doc_key, len(regexp_extract_all(document, '<(p|h2|section)[ >]')) AS below FROM chapters WHERE contains(document, '<body')")
def q_descendants(t):
    n = nodes_of(t, again=True).where("tag <> '#text'")
    body = n.where("tag = 'body'")
    return tree.descendants(n, body).groupBy("doc_key").agg((F.count("*") - 1).alias("below"))


@query("SELECT chapter_key AS doc_key, count(*) AS n FROM (SELECT chapter_key, unnest(regexp_extract_all(document, '<(h2|section)[ >]')) FROM chapters) GROUP BY 1")
def q_children(t):
    n = nodes_of(t).where("tag in ('body', 'h2', 'section')")
    return tree.children(n).groupBy("doc_key").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT unnest(regexp_extract_all(document, '<(p|h2|section|body)[ >]', 1)) AS tag FROM chapters UNION ALL SELECT '#text' FROM (SELECT unnest(regexp_extract_all(document, '(?s)<(?:p|h2)(?: [^>]*)?>([^<]+)', 1)) FROM chapters)) SELECT CASE tag WHEN 'p' THEN 'Paragraph' WHEN 'h2' THEN 'Heading' WHEN '#text' THEN 'Text' ELSE 'Container' END AS role, count(*) AS n FROM e GROUP BY 1")
def q_vacuum(t):
    return passes.vacuum(nodes_of(t, again=True)).groupBy("role").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT unnest(regexp_extract_all(document, '<(p|h2|section|body)[ >]', 1)) AS tag FROM chapters UNION ALL SELECT '#text' FROM (SELECT unnest(regexp_extract_all(document, '(?s)<(?:p|h2)(?: [^>]*)?>([^<]+)', 1)) FROM chapters)) SELECT tag, count(*) AS n FROM e GROUP BY 1")
def q_prune(t):
    return passes.prune(passes.vacuum(nodes_of(t, again=True))).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT chapter_key AS doc_key, chapter_id::VARCHAR || chapter_key AS text FROM chapters WHERE chapter_id IS NOT NULL UNION ALL SELECT chapter_key, 'x' FROM chapters WHERE chapter_id IS NOT NULL")
def q_span_merge(t):
    """A page for every chapter with text that a comment cuts in two."""
    page = F.concat(F.lit("<p>"), F.col("chapter_id").cast("string"), F.lit("<!-- -->"), F.col("chapter_key").cast("string"), F.lit("<i>x</i></p>"))
    n = html_nodes(t("chapters").where("chapter_id is not null").select("chapter_key", page.alias("page")), "chapter_key", "page")
    return passes.merge_spans(stored(n, "nodes")).where("role = 'Text'").select("doc_key", "text")


@query("SELECT chapter_key AS doc_key, 2::BIGINT AS lists, 3::BIGINT AS items FROM chapters")
def q_list_fuse(t):
    """A page for every chapter with two lists in a row, and one of another kind."""
    page = F.lit("<body><ul><li>a</li></ul>\n<ul><li>b</li></ul><ol><li>c</li></ol></body>")
    n = html_nodes(t("chapters").select("chapter_key", page.alias("page")), "chapter_key", "page")
    f = passes.fuse_lists(stored(passes.vacuum(stored(n, "nodes")), "nodes"))
    return f.groupBy("doc_key").agg(F.count_if(F.col("role").isin("UnorderedList", "OrderedList")).alias("lists"), F.count_if(F.col("role") == "ListItem").alias("items"))


@query("SELECT chapter_key AS doc_key, unnest(['head', 'body']) AS part, unnest([1, 2])::BIGINT AS rows FROM chapters")
def q_table_parts(t):
    page = F.lit("<table><tr><th>a</th></tr><tr><td>b</td></tr><tr><td>c</td></tr></table>")
    n = html_nodes(t("chapters").select("chapter_key", page.alias("page")), "chapter_key", "page")
    return passes.table_parts(stored(n, "nodes")).groupBy("doc_key", "part").agg(F.count("*").alias("rows"))


@query("SELECT chapter_key AS doc_key, unnest([1, 4])::INTEGER AS first_pre, unnest([CASE WHEN chapter_key % 2 = 0 THEN 2 ELSE 1 END, 1])::INTEGER AS nodes FROM chapters WHERE chapter_key % 2 = 1 UNION ALL SELECT chapter_key, unnest([1, 6]), unnest([2, 1]) FROM chapters WHERE chapter_key % 2 = 0")
def q_wrap_runs(t):
    """A page for every chapter with words before and behind a block."""
    page = F.when(F.col("chapter_key") % 2 == 0, "<div>loose <i>run</i><p>block</p>end</div>").otherwise("<div>loose<p>block</p>end</div>")
    n = html_nodes(t("chapters").select("chapter_key", page.alias("page")), "chapter_key", "page")
    n = stored(n, "nodes")
    parts = passes.parts_of(n)
    return passes.wrap_runs(passes.vacuum(n, parts), parts).select("doc_key", "first_pre", "nodes")


@query(
    rf"""WITH e AS (SELECT chapter_key AS doc_key, unnest(regexp_extract_all(document, '(?s)<(?:p|h2|section|body)[ >][^<]*', 0)) AS x FROM chapters),
      k AS (SELECT doc_key, regexp_extract(x, '^<([a-z0-9]+)', 1) AS tag, regexp_replace(x, '^<[^>]*>', '') AS said FROM e),
      u AS (SELECT doc_key, tag, {_TRIMMED} AS said FROM k)
      SELECT doc_key, CASE tag WHEN 'p' THEN 'Paragraph' WHEN 'h2' THEN 'Heading' ELSE 'Container' END AS role, count(*) AS n, NULL::BIGINT AS chars FROM u WHERE tag <> 'p' OR said <> '' GROUP BY ALL
      UNION ALL SELECT doc_key, 'Text', count(*), sum(length(said)) FROM u WHERE said <> '' GROUP BY 1"""
)
def q_pipeline(t):
    """All eight passes: how often each role is left, with how many characters of text, in each document."""
    n = rewrite.optimised_nodes(t("chapters"), "chapter_key", "document")
    return n.groupBy("doc_key", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query()
def q_markdown(t):
    return render.to_markdown(nodes_of(t))


@query()
def q_book_markdown(t):
    c = t("chapters").select(F.col("chapter_key").alias("doc_key"), "book_id", F.struct("chapter_id", "chapter_key").alias("chapter_id"))
    return render.book_markdown(render.numbered_markdown(nodes_of(t, again=True), c))


@query()
def q_xhtml(t):
    return render.to_xhtml(nodes_of(t))


@query(r"SELECT chapter_key AS doc_key, 1.0::DOUBLE AS retention FROM chapters WHERE contains(document, '<body')")
def q_markdown_retention(t):
    """How many of a chapter's words are still there once it is Markdown: all of them."""
    md = render.to_markdown(nodes_of(t))
    body = F.regexp_replace(F.regexp_replace("document", r"(?s)^.*?<body[^>]*>", ""), "<[^>]*>", " ")
    src = t("chapters").select(F.col("chapter_key").alias("doc_key"), T.strip_invisible(body).alias("said"))
    plain = F.regexp_replace("markdown", r"\\", "")
    return md.join(src, "doc_key").select("doc_key", F.round(T.word_retention(F.col("said"), plain), 6).alias("retention"))


@query(r"SELECT chapter_key, unnest(regexp_extract_all(document, '<link[^>]* href=\"([^\"]*)\"', 1)) AS href FROM chapters")
def q_links_extract(t):
    found = F.regexp_extract_all("document", F.lit('<link[^>]* href="([^"]*)"'), F.lit(1))
    return t("chapters").select("chapter_key", F.explode(found).alias("href"))


@query(
    r"""WITH l AS (SELECT book_id, chapter_key, source_path, regexp_extract(document, ' href="([^"]*)"', 1) AS href FROM chapters WHERE document IS NOT NULL),
      r AS (SELECT *, CASE WHEN href LIKE '../%' THEN regexp_replace(regexp_replace(source_path, '[^/]*$', ''), '[^/]*/$', '') || substr(href, 4) ELSE href END AS target FROM l),
      k AS (SELECT target FROM r GROUP BY 1 HAVING count(*) % 2 = 0) SELECT r.chapter_key, CASE WHEN k.target IS NOT NULL THEN 'chapter' END AS target_kind FROM r LEFT JOIN k USING (target)"""
)
def q_link_resolve(t):
    c = t("chapters").where("document is not null")
    raw = c.select("chapter_key", "source_path", F.regexp_extract("document", ' href="([^"]*)"', 1).alias("href"))
    full = raw.select("chapter_key", F.lit("all").alias("book"), F.lit("").alias("path"), T.resolve_path(F.col("source_path"), F.col("href")).alias("href"))
    spine = full.groupBy("book", F.col("href").alias("path")).agg(F.count("*").alias("n")).where("n % 2 = 0").select("book", "path", F.lit(0).alias("doc"))
    none = spine.where("false").select("book", F.col("path").alias("key"), "doc", F.lit(0).alias("node"))
    return links.resolve_links(full, spine, none).select("chapter_key", "target_kind")


@query("SELECT d.chapter_key FROM chapters d WHERE d.book_id NOT IN (SELECT book_id FROM exth_headers WHERE book_id IS NOT NULL) AND d.book_id IS NOT NULL")
def q_broken_links(t):
    return links.broken(t("chapters").where("book_id is not null").select("chapter_key", F.col("book_id").alias("href")), t("exth_headers").select("book_id")).select("chapter_key")


@query("SELECT book_id, count(*) AS links, count(DISTINCT source_path) AS sources FROM chapters WHERE book_id IS NOT NULL GROUP BY 1")
def q_backlinks(t):
    return links.backlinks(t("chapters"), "book_id", "source_path")


_CSS = ".c1 { text-indent: 1em; font-size: 0.9em } .c2 { color: #333; font-weight: bold !important } body.b2 p { color: navy } section > p { margin: 0 1em }"


@query()
def q_cascade(t):
    n = styles.cascade(nodes_of(t), _CSS)
    return n.groupBy("property", "value").agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT unnest(regexp_extract_all(document, '<p( class="c1")?', 1)) AS c FROM chapters) SELECT CASE WHEN coalesce(c, '') = '' THEN '1rem' ELSE '0.9rem' END AS value, count(*) AS n FROM p GROUP BY 1""")
def q_font_sizes(t):
    n = nodes_of(t, again=True)
    own = styles.cascade(n, _CSS).where("property = 'font-size'").join(n.where("tag = 'p'").select("doc_key", "pre"), ["doc_key", "pre"], "left_semi")
    return own.groupBy("value").agg(F.count("*").alias("n"))


@query(r"""SELECT class, dense_rank() OVER (ORDER BY f, class) AS style_id FROM (SELECT class, min(chapter_key) AS f FROM (SELECT chapter_key, unnest(regexp_extract_all(document, '<(?:p|body) class="([^"]*)"', 1)) AS class FROM chapters) GROUP BY 1)""")
def q_style_pool(t):
    return styles.intern(nodes_of(t).where("class is not null"), "class", order="doc_key").select("class", F.col("style_id").cast("bigint").alias("style_id"))


@query("SELECT l_orderkey, max(greatest(l_discount - l_tax, 0)) + min(least(l_discount - l_tax, 0)) AS margin FROM lineitem GROUP BY 1")
def q_margin_collapse(t):
    m = t("lineitem").withColumn("m", F.col("l_discount") - F.col("l_tax"))
    return styles.collapsed_margin(m, "l_orderkey", "m")


def _as_books(t) -> DataFrame:
    """Every book with its chapters, as the EPUB writer takes it."""
    c = t("chapters").where("document is not null")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chapter_id", "chapter_key", F.col("source_path").alias("title"), F.col("document").alias("xhtml")))), lambda x: F.struct(x["title"].alias("title"), x["xhtml"].alias("xhtml")))
    chapters = c.groupBy("book_id").agg(parts.alias("chapters"))
    first = t("books").groupBy("book_id").agg(F.min_by(F.struct("title", "language", "authors"), "record_id").alias("b"))
    return chapters.join(first, "book_id", "left").select("book_id", "b.title", "b.language", "b.authors", "chapters")


@query("SELECT book_id, count(*) AS chapters FROM chapters WHERE document IS NOT NULL GROUP BY 1")
def q_epub_round_trip(t):
    """Chapters of every book that come back out of the EPUB files written of them."""
    files = to_epub(_as_books(t)).select(F.col("book_id").alias("path"), "content")
    return read_epub(files, "spine").where("error is null").groupBy(F.col("path").alias("book_id")).agg(F.count("*").alias("chapters"))


@query("SELECT source_path, document FROM chapters WHERE document IS NOT NULL")
def q_epub_chapters(t):
    """Every chapter's document as it is read back, under its own path."""
    files = to_epub(_as_books(t)).select(F.col("book_id").alias("path"), "content")
    back = read_epub(files, "chapters").select(F.col("path").alias("book_id"), "chapter_id", "document")
    names = _as_books(t).select("book_id", F.posexplode("chapters.title").alias("chapter_id", "source_path"))
    return back.join(names, ["book_id", "chapter_id"]).select("source_path", "document")


@query(rf"SELECT c.chapter_key AS doc_key, count(*) AS links, {_said("any_value(regexp_extract(document, '(?s)<h2>(.*?)</h2>', 1))")} AS title FROM (SELECT chapter_key, document, unnest(regexp_extract_all(document, ' href=')) FROM chapters) c GROUP BY 1")
def q_flagship(t):
    """Every chapter with its title and how many links it has."""
    titles = blocks.headings(nodes_of(t, again=True)).groupBy("doc_key").agg(F.min_by("title", "pre").alias("title"))
    n = t("chapters").select(F.col("chapter_key").alias("doc_key"), F.size(F.regexp_extract_all("document", F.lit("( href=)"), F.lit(1))).cast("bigint").alias("links")).where("links > 0")
    return n.join(titles, "doc_key", "left").select("doc_key", "links", "title")
