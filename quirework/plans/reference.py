"""Queries of the document and retrieval operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import links as L
from quirework.operators import positions as P
from quirework.operators import retrieval as R
from quirework.operators import books as B
from quirework.operators import styles, tree
from quirework.operators.ranks import numbered
from quirework.session import prepare, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(lambda name: table(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return run

    return add


# Text ----------------------------------------------------------------------------------------


@query(r"SELECT record_id, regexp_replace(title, '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0B]+', ' ', 'g') AS title FROM books")
def q_ws_norm(t):
    return t("books").select("record_id", T.normalize_spaces(F.col("title")).alias("title"))


@query(r"SELECT record_id, regexp_replace(title, '[\x{00AD}\x{200B}]', '', 'g') AS title FROM books")
def q_strip_invisible(t):
    return t("books").select("record_id", T.strip_invisible(F.col("title")).alias("title"))


@query(
    r"""SELECT record_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0B_-]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM books"""
)
def q_slug(t):
    return t("books").select("record_id", T.slugify(F.col("title")).alias("slug"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      text, '([\\*_\[\]`|<>])', '\\\1', 'g'), '(?m)^#', '\\#', 'g'), '(?m)^(-+[ \t]*|=+[ \t]*)$', '\\\1', 'g'),
      '(?m)^([-+])([ \t]|$)', '\\\1\2', 'g'), '(?m)^(\d+)([.)])([ \t]|$)', '\1\\\2\3', 'g') AS escaped FROM documents"""
)
def q_md_escape(t):
    return t("documents").select("doc_id", T.markdown_escape(F.col("text")).alias("escaped"))


@query("SELECT doc_id, greatest(3, coalesce(n, 0) + 1)::INTEGER AS fence, (coalesce(n, 0) + 1)::INTEGER AS ticks FROM (SELECT doc_id, list_max(list_transform(regexp_extract_all(repeat('`', (doc_id % 6)::INTEGER) || 'x' || text, '`+'), lambda x: length(x))) AS n FROM documents WHERE text IS NOT NULL)")
def q_fence_len(t):
    ticked = F.concat(F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")), F.lit("x"), "text")
    return t("documents").where("text is not null").select("doc_id", T.fence_length(ticked).alias("fence"), T.inline_ticks(ticked).alias("ticks"))


@query("SELECT chapter_key, replace(replace(replace(replace(replace(document, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM chapters")
def q_xml_escape(t):
    return t("chapters").select("chapter_key", T.xml_escape(F.col("document")).alias("escaped"))


@query("SELECT chapter_key, document FROM chapters")
def q_xml_round_trip(t):
    return t("chapters").select("chapter_key", T.xml_unescape(T.xml_escape(F.col("document"))).alias("document"))


@query("SELECT doc_id, CASE WHEN length(f) > 300 THEN left(f, 300) || '...' ELSE f END AS summary FROM (SELECT doc_id, replace(trim(text), chr(10), ' ') AS f FROM documents)")
def q_summary(t):
    return t("documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("SELECT record_id, CASE lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) WHEN 'epub' THEN 'epub' WHEN 'azw3' THEN 'azw3' WHEN 'mobi' THEN 'mobi' WHEN 'azw' THEN 'mobi' WHEN 'kfx' THEN 'kfx' WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'markdown' END AS detected FROM books")
def q_format_detect(t):
    return t("books").select("record_id", T.format_of(F.col("path")).alias("detected"))


@query("SELECT chapter_key, CASE lower(regexp_extract(source_path, '\\.([^./\\\\]+)$', 1)) WHEN 'xhtml' THEN 'application/xhtml+xml' WHEN 'html' THEN 'application/xhtml+xml' WHEN 'htm' THEN 'application/xhtml+xml' WHEN 'css' THEN 'text/css' ELSE 'application/octet-stream' END AS media_type FROM chapters")
def q_media_type(t):
    return t("chapters").select("chapter_key", T.media_type(F.col("source_path")).alias("media_type"))


@query("SELECT record_id, split_part(date, 'T', 1) AS day FROM books WHERE date IS NOT NULL")
def q_date_prefix(t):
    return t("books").where("date is not null").select("record_id", T.date_prefix(F.col("date")).alias("day"))


@query("SELECT record_id, upper(substr(sha1(book_id), 1, 32)) AS content_id, ('0x' || substr(sha1(book_id || chr(10) || coalesce(title, '')), 1, 8))::BIGINT AS uid FROM books")
def q_book_ids(t):
    return t("books").select("record_id", T.content_id(F.col("book_id")).alias("content_id"), T.uid(F.col("book_id"), F.coalesce("title", F.lit(""))).alias("uid"))


@query("SELECT record_id, replace(regexp_replace(title, '[^A-Za-z0-9 _-]', '', 'g'), ' ', '_') AS file_title FROM books")
def q_file_title(t):
    return t("books").select("record_id", T.file_title(F.col("title")).alias("file_title"))


@query("SELECT p_partkey, p_partkey AS back, length('0000000000') AS digits FROM part")
def q_base32(t):
    code = T.base32(F.col("p_partkey"), 10)
    return t("part").select("p_partkey", T.from_base32(code).alias("back"), F.length(code).cast("bigint").alias("digits"))


@query("SELECT record_id, CASE WHEN p = floor(p) THEN floor(p)::BIGINT::VARCHAR ELSE p::VARCHAR END AS position FROM (SELECT record_id, collection.position AS p FROM books WHERE collection.position IS NOT NULL)")
def q_series_position(t):
    return t("books").where("collection.position is not null").select("record_id", T.series_position(F.col("collection.position")).alias("position"))


@query("SELECT chapter_key, regexp_replace(source_path, '[^/]*$', '') || '../style.css' AS raw, regexp_replace(regexp_replace(source_path, '[^/]*$', ''), '[^/]*/$', '') || 'style.css' AS resolved FROM chapters")
def q_path_resolve(t):
    c = t("chapters")
    raw = F.concat(F.regexp_replace("source_path", "[^/]*$", ""), F.lit("../style.css"))
    return c.select("chapter_key", raw.alias("raw"), T.resolve_path(F.col("source_path"), F.lit("../style.css")).alias("resolved"))


@query(
    r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]{4,}')) AS a,
      list_distinct(regexp_extract_all(lower(coalesce(left(text, 400), '')), '[\p{L}\p{N}]{4,}')) AS b FROM documents)
      SELECT doc_id, CASE WHEN len(a) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(a), 6) END::DOUBLE AS retention FROM w"""
)
def q_word_retention(t):
    d = t("documents")
    return d.select("doc_id", F.round(T.word_retention(F.col("text"), F.substring("text", 1, 400)), 6).alias("retention"))


@query(
    r"""WITH a AS (SELECT p_partkey AS k, list_distinct(list_filter(regexp_split_to_array(lower(trim(p_name)), '\s+'), lambda x: x <> '')) AS w, lower(trim(p_name)) AS n FROM part),
      q AS (SELECT w, n FROM a WHERE k = 7)
      SELECT k AS p_partkey, round(greatest(len(list_intersect(a.w, q.w)) / len(list_distinct(list_concat(a.w, q.w))),
        CASE WHEN contains(a.n, q.n) OR contains(q.n, a.n) THEN 0.5 + 0.5 * least(length(a.n), length(q.n)) / greatest(length(a.n), length(q.n)) ELSE 0 END), 6)::DOUBLE AS score FROM a, q"""
)
def q_fuzzy_title(t):
    p = t("part")
    wanted = p.where("p_partkey = 7").select("p_name").first()[0]
    return p.select("p_partkey", F.round(T.fuzzy_title(F.col("p_name"), F.lit(wanted)), 6).alias("score"))


# Retrieval -----------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5)"


def _first_vector(v: DataFrame) -> list[float]:
    return v.where("vec_id = 0").select("embedding").first()[0]


@query(f"SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 30")
def q_cosine_topk(t):
    v = t("embeddings")
    return R.top(R.query_scores(v, _first_vector(v)).withColumn("score", F.round("score", 5)), 30, "vec_id")


@query(f"SELECT * FROM (SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE score >= 0.05")
def q_cosine_threshold(t):
    v = t("embeddings")
    return R.query_scores(v, _first_vector(v)).withColumn("score", F.round("score", 5)).where("score >= 0.05")


@query(f"SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (SELECT label FROM embeddings WHERE vec_id < 3)")
def q_scoped_search(t):
    v = t("embeddings")
    scope = v.where("vec_id < 3").select("label").distinct()
    return R.query_scores(v.join(scope, "label", "left_semi"), _first_vector(v)).withColumn("score", F.round("score", 5))


@query("WITH s AS (SELECT c_nationkey AS node, count(*) AS n, avg(c_acctbal) AS a FROM customer GROUP BY 1) SELECT node, round(a / (1 + 0.15 * ln(1 + n)), 4) AS score FROM s")
def q_tree_penalty(t):
    s = t("customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.avg("c_acctbal").alias("score"), F.count("*").alias("descendants"))
    return R.penalised(s.select("node", "score"), s.select("node", "descendants"), "node").withColumn("score", F.round("score", 4))


@query("WITH p AS (SELECT user_id, count(*) AS n, max(value) AS v FROM events GROUP BY 1) SELECT user_id, n, v FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.n >= a.n AND b.v >= a.v AND (b.n > a.n OR b.v > a.v))")
def q_skyline(t):
    p = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("v"))
    return R.skyline(p, "n", "v").select("user_id", "n", "v")


@query(
    """WITH a AS (SELECT c_nationkey AS k, sum(c_acctbal) AS s FROM customer WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY 1), b AS (SELECT s_nationkey AS k, sum(s_acctbal) AS s FROM supplier GROUP BY 1),
      u AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.s, 0) AS s_t, coalesce(b.s, 0) AS s_g FROM a FULL JOIN b ON a.k = b.k)
      SELECT k, round(s_t / (SELECT max(s_t) FROM u), 6) AS s_t, round(s_g / (SELECT max(s_g) FROM u), 6) AS s_g FROM u"""
)
def q_score_union(t):
    a = t("customer").where("c_mktsegment = 'HOUSEHOLD'").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("score"))
    b = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("score"))
    u = R.normalised(R.union_scores(a, b, "k"), "s_t", "s_g")
    return u.select("k", F.round("s_t", 6).alias("s_t"), F.round("s_g", 6).alias("s_g"))


@query(
    """SELECT a, b, round(score, 5) AS score FROM (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS score,
      row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 12) DESC, y.vec_id) AS n
      FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id AND x.vec_id % 100 = 0) WHERE n <= 10 AND score >= 0.3"""
)
def q_er_candidates(t):
    """The query set is every vector whose id divides by 100, held against all."""
    return R.pair_candidates(t("embeddings"), 10, 0.3, queries=t("embeddings").where("vec_id % 100 = 0")).withColumn("score", F.round("score", 5))


@query(
    """WITH c AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS score FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id AND x.vec_id % 100 = 0),
      k AS (SELECT *, row_number() OVER w AS n, lag(score) OVER w AS p FROM c WINDOW w AS (PARTITION BY a ORDER BY score DESC, b)),
      g AS (SELECT *, bool_and(score >= 0.2 AND (p IS NULL OR score > p / 1.1)) OVER (PARTITION BY a ORDER BY n) AS ok FROM k WHERE n <= 10 AND score >= 0.1) SELECT a, b, score FROM g WHERE ok"""
)
def q_er_gradient(t):
    c = R.pair_candidates(t("embeddings"), 10, 0.1, queries=t("embeddings").where("vec_id % 100 = 0")).withColumn("score", F.round("score", 5))
    return R.gradient_cut(c, 0.2, 1.1)


_FLOW = "SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"


def _flow(t) -> DataFrame:
    li, o, c, s = t("lineitem"), t("orders"), t("customer"), t("supplier")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return joined.select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()


_PPR = f"""WITH RECURSIVE e AS ({_FLOW}), u AS (SELECT a AS s, b AS d FROM e WHERE a <> b UNION ALL SELECT b, a FROM e WHERE a <> b), w AS (SELECT s, d, count(*) / sum(count(*)) OVER (PARTITION BY s) AS w FROM u GROUP BY 1, 2),
      p AS (SELECT 0 AS i, n_nationkey AS node, 1 / 3.0::DOUBLE AS rank FROM nation WHERE n_nationkey < 3 UNION ALL SELECT p.i + 1, w.d, sum(0.85 * p.rank * w.w) + CASE WHEN w.d < 3 THEN 0.05 ELSE 0 END FROM p JOIN w ON w.s = p.node WHERE p.i < 40 GROUP BY 1, 2)"""


@query(_PPR + " SELECT node, round(rank, 8) AS rank FROM p WHERE i = 40")
def q_ppr(t):
    edges = _flow(t)
    starts = t("nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("node"))
    return R.pagerank(edges, starts, rounds=40).withColumn("rank", F.round("rank", 8))


@query(_PPR + " SELECT c_custkey AS node, round(rank, 8) AS score FROM p JOIN customer ON c_nationkey = p.node WHERE i = 40 AND rank >= 1e-6 ORDER BY 2 DESC, 1 LIMIT 15")
def q_graph_reason(t):
    starts = t("nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("node"))
    ranks = R.pagerank(_flow(t), starts, rounds=40)
    links = t("customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("node"))
    return R.top(R.node_scores(ranks, links).withColumn("score", F.round("score", 8)), 15, "node")


@query(
    """WITH RECURSIVE g AS (SELECT lower(title) AS k, min(book_id) AS first FROM books WHERE book_id IS NOT NULL AND title IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT first AS a, book_id AS b FROM books JOIN g ON lower(title) = k WHERE book_id IS NOT NULL),
      u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS low FROM u UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.node) SELECT node, min(low) AS root FROM r GROUP BY node"""
)
def q_components(t):
    """Books that are tied by a title that some delivery of both has."""
    b = t("books").where("book_id is not null and title is not null").select("book_id", F.lower("title").alias("k"))
    first = b.groupBy("k").agg(F.min("book_id").alias("first"))
    return R.components(b.join(first, "k").select(F.col("first").alias("a"), F.col("book_id").alias("b")))


@query(
    r"""WITH m AS (SELECT record_id AS node, unnest(authors) AS name, record_id AS ord FROM books) SELECT lower(trim(name)) AS key, arg_min(name, (ord, name)) AS name, count(DISTINCT node) AS nodes FROM m WHERE trim(name) <> '' GROUP BY 1"""
)
def q_entity_index(t):
    m = t("books").select(F.col("record_id").alias("node"), F.explode("authors").alias("name"), F.col("record_id").alias("ord"))
    return R.mention_index(m)


@query("WITH k AS (SELECT DISTINCT lower(p_name) AS key FROM part), w AS (SELECT unnest(['red widget', 'ring', 'blue']) AS wanted) SELECT wanted, arg_min(key, (CASE WHEN key = wanted THEN 0 ELSE 1 END, key)) AS key FROM k JOIN w ON key = wanted OR contains(key, wanted) OR contains(wanted, key) GROUP BY wanted")
def q_start_entities(t):
    return R.start_entities(t("part").select(F.lower("p_name").alias("key")).distinct(), ["red widget", "ring", "blue"])


# Trees ---------------------------------------------------------------------------------------


def _places(t) -> DataFrame:
    """Region, nation and customer as one tree of parent ids."""
    r = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return r.unionByName(n).unionByName(c)


_PLACES = """places AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"""


@query(f"WITH RECURSIVE {_PLACES}, up AS (SELECT id AS node, id AS ancestor, 0 AS distance FROM places UNION ALL SELECT up.node, p.parent, up.distance + 1 FROM up JOIN places p ON p.id = up.ancestor WHERE p.parent IS NOT NULL) SELECT ancestor, count(*) AS below FROM up GROUP BY 1")
def q_entity_propagate(t):
    return tree.nest_parents(_places(t), "id", "parent").groupBy("ancestor").agg(F.count("*").alias("below"))


@query("SELECT c_custkey, r_name || ' > ' || n_name || ' > ' || c_name AS breadcrumb FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def q_breadcrumb(t):
    p = _places(t)
    up = tree.nest_parents(p, "id", "parent").join(p.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.negative("distance").alias("d"), "name"))), lambda x: x["name"]), " > ")
    out = up.groupBy("node").agg(line.alias("breadcrumb")).where("node like 'c%'")
    return out.select(F.expr("cast(substring(node, 2) as bigint)").alias("c_custkey"), "breadcrumb")


@query(f"WITH {_PLACES}, done AS (SELECT id FROM places WHERE id LIKE 'c%' OR id IN ('n1', 'n2')) SELECT DISTINCT id AS node FROM places p WHERE id NOT IN (SELECT id FROM done) AND NOT EXISTS (SELECT 1 FROM places c WHERE c.parent = p.id AND c.id NOT IN (SELECT id FROM done))")
def q_ready_frontier(t):
    p = _places(t)
    return tree.ready(p, "id", "parent", p.where("id like 'c%' or id in ('n1', 'n2')").select(F.col("id").alias("node")))


@query("SELECT r_regionkey, n_nationkey, round(sum(sum(c_acctbal)) OVER (PARTITION BY r_regionkey), 2) AS region_total, round(sum(c_acctbal), 2) AS nation_total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def q_rollup_bottom_up(t):
    """Every region as a tree with its nations below it."""
    n = t("customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("s")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    leaves = n.select(F.col("n_regionkey").alias("doc_key"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("pre"), "n_nationkey", "s")
    roots = leaves.groupBy("doc_key").agg(F.count("*").cast("int").alias("end")).select("doc_key", F.lit(0).alias("pre"), "end", F.lit(None).cast("double").alias("s"))
    sums = tree.rolled_up(roots.unionByName(leaves.select("doc_key", "pre", F.col("pre").alias("end"), F.col("s").cast("double").alias("s"))), "s")
    top = sums.where("pre = 0").select("doc_key", F.round("total", 2).alias("region_total"))
    own = leaves.select("doc_key", "pre", "n_nationkey").join(sums, ["doc_key", "pre"])
    return own.join(top, "doc_key").select(F.col("doc_key").alias("r_regionkey"), "n_nationkey", "region_total", F.round("total", 2).alias("nation_total"))


# Positions and windows -----------------------------------------------------------------------


@query("SELECT doc_id, source, (sum(greatest(n_chars, 1)) OVER (PARTITION BY source ORDER BY doc_id) - greatest(n_chars, 1))::BIGINT AS start FROM documents")
def q_positions(t):
    return P.positions(t("documents"), "source", "doc_id", "n_chars").select("doc_id", "source", "start")


@query("SELECT doc_id, unnest(range(0, greatest(n_chars, 1), 150)) AS \"offset\" FROM documents")
def q_locations(t):
    return P.locations(P.positions(t("documents"), "source", "doc_id", "n_chars")).select("doc_id", "offset")


@query(
    """WITH p AS (SELECT doc_id, greatest(n_chars, 1) AS n, sum(greatest(n_chars, 1)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT - greatest(n_chars, 1) AS start FROM documents),
      r AS (SELECT doc_id, start, unnest(range(((start + 1849) // 1850)::BIGINT, ((start + n - 1) // 1850 + 1)::BIGINT)) AS p FROM p) SELECT doc_id, p + 1 AS page, p * 1850 - start AS "offset" FROM r"""
)
def q_pages(t):
    return P.pages(P.positions(t("documents"), "source", "doc_id", "n_chars")).select("doc_id", "page", "offset")


@query("SELECT source, sum(n_chars)::BIGINT AS total FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def q_max_section(t):
    return P.largest_section(t("documents"), "source", "n_chars")


_ENTRIES = "e AS (SELECT o_orderkey, o_custkey, 1 + o_orderkey % 3 AS depth, sum(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS pos FROM orders)"


def _entries(t) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t("orders").select("o_orderkey", "o_custkey", (1 + F.col("o_orderkey") % 3).alias("depth"), F.sum(F.floor("o_totalprice").cast("bigint")).over(w).alias("at"))


@query(f"WITH {_ENTRIES}, z AS (SELECT o_custkey, max(pos) + 100 AS stop FROM e GROUP BY 1) SELECT e.o_orderkey, coalesce((SELECT min(n.pos) FROM e n WHERE n.o_custkey = e.o_custkey AND n.pos > e.pos AND n.depth <= e.depth), z.stop) - e.pos AS span FROM e JOIN z USING (o_custkey)")
def q_toc_span(t):
    e = _entries(t)
    ends = e.groupBy("o_custkey").agg((F.max("at") + 100).alias("stop"))
    return P.toc_spans(e, "o_custkey", "at", "depth", ends).select("o_orderkey", "span")


@query(
    """WITH d AS (SELECT doc_id, sum(greatest(n_chars, 1)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS stop, greatest(n_chars, 1) AS n FROM documents), s AS (SELECT doc_id, stop - n AS start, stop FROM d),
      r AS (SELECT *, unnest(range(start // 4096, (stop - 1) // 4096 + 1)) AS record FROM s)
      SELECT doc_id, record, CASE WHEN start // 4096 = record AND (stop - 1) // 4096 = record THEN 'completes' WHEN start // 4096 = record THEN 'starts' WHEN (stop - 1) // 4096 = record THEN 'ends' ELSE 'spans' END AS kind FROM r"""
)
def q_overlap_class(t):
    s = P.positions(t("documents"), "source", "doc_id", "n_chars").withColumn("stop", F.col("start") + F.col("size"))
    return P.overlap_class(s, "start", "stop").select("doc_id", "record", "kind")


@query("SELECT chapter_key, r AS record, substr(document, r * 4096 + 1, 4096) AS piece FROM (SELECT chapter_key, document, unnest(range(0, (length(document) + 4095) // 4096)) AS r FROM chapters WHERE document IS NOT NULL)")
def q_fixed_records(t):
    return P.fixed_records(t("chapters"), "document").select("chapter_key", F.col("record").cast("bigint").alias("record"), "piece")


@query("SELECT p.event_id, coalesce(last_id, first_id) AS signup FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p JOIN (SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id FROM events WHERE event_type = 'signup' GROUP BY 1) f USING (user_id) ASOF LEFT JOIN (SELECT user_id, ts, event_id AS last_id FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts")
def q_asof_anchor(t):
    e = t("events")
    s = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup"))
    return L.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), s, "user_id", "ts", "signup").where("signup is not null").select("event_id", "signup")


@query(
    """WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s, event_type FROM events), m AS (SELECT p.event_id, v.event_id AS near, v.s - p.s AS far FROM e p JOIN e v ON p.user_id = v.user_id AND abs(v.s - p.s) <= 2000 WHERE p.event_type = 'purchase' AND v.event_type = 'view'),
      b AS (SELECT event_id, arg_min(near, (CASE WHEN far < 0 THEN 1 ELSE 0 END, abs(far), near)) AS near FROM m GROUP BY 1) SELECT p.event_id, b.near FROM e p LEFT JOIN b USING (event_id) WHERE p.event_type = 'purchase'"""
)
def q_nearest_window(t):
    e = t("events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"), "event_type")
    views = e.where("event_type = 'view'").select("user_id", "s", F.col("event_id").alias("near"))
    return L.nearest_in_window(e.where("event_type = 'purchase'").select("event_id", "user_id", "s"), views, "user_id", "s", 2000, "near").select("event_id", "near")


@query(
    """WITH s AS (SELECT doc_id, source, sum(greatest(n_chars, 1)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT - greatest(n_chars, 1) AS start, greatest(n_chars, 1) AS n FROM documents),
      q AS (SELECT DISTINCT source, p FROM documents, (SELECT unnest([0, 1000, 25000, 900000000]) AS p)), f AS (SELECT source, arg_min(doc_id, start) AS first FROM s GROUP BY 1)
      SELECT q.source, q.p, coalesce(s.doc_id, f.first) AS doc_id FROM q JOIN f USING (source) LEFT JOIN s ON s.source = q.source AND q.p >= s.start AND q.p < s.start + s.n"""
)
def q_range_file(t):
    s = P.positions(t("documents"), "source", "doc_id", "n_chars")
    q = t("documents").select("source").distinct().withColumn("p", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, 1000, 25000, 900000000)])))
    return L.containing(q, s, "source", "p", "start", "size", "doc_id").select("source", F.col("p").cast("int").alias("p"), "doc_id")


@query("SELECT user_id, event_id, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM events")
def q_sections(t):
    e = t("events").withColumn("o", F.struct("ts", "event_id"))
    return P.sessions(e, "user_id", "o", F.col("event_type") == "signup").select("user_id", "event_id", "session")


@query(
    """WITH h AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id % 6 + 1 AS level FROM events)
      SELECT a.user_id, a.ord, (SELECT max(b.ord) FROM h b WHERE b.user_id = a.user_id AND b.ord < a.ord AND b.level < a.level) AS parent_ord FROM h a"""
)
def q_section_parent(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    h = t("events").select("user_id", F.row_number().over(w).cast("bigint").alias("ord"), (F.col("event_id") % 6 + 1).alias("level"))
    return tree.previous_smaller(h, "user_id", "ord", "level").select("user_id", "ord", "parent_ord")


@query("WITH w AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), i AS (SELECT *, sum(CASE WHEN event_type IS NOT DISTINCT FROM p AND p IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM w) SELECT user_id, island::BIGINT AS island, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY 1, 2")
def q_islands(t):
    e = P.islands(t("events").withColumn("o", F.struct("ts", "event_id")), "user_id", "o", "event_type")
    return e.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events WHERE event_type = 'error'")
def q_footnote_numbers(t):
    return B.note_numbers(t("events").where("event_type = 'error'"), "user_id", "event_id", "ts", "event_id")


@query("SELECT source, dense_rank() OVER (ORDER BY f) - 1 AS id FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY 1)")
def q_dictionary(t):
    first = t("documents").groupBy("source").agg(F.min("doc_id").alias("f"))
    return numbered(first, "f", "source", name="id").select("source", "id")


@query("SELECT event_type AS s FROM events UNION SELECT o_orderstatus FROM orders")
def q_union_styles(t):
    return B.merged("s", (t("events"), "event_type"), (t("orders"), "o_orderstatus"))


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS reachable FROM part")
def q_reachable(t):
    return B.reachable(t("part"), t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def q_dedupe_first(t):
    return B.first_of(t("events"), "user_id", "event_id", "ts", "event_id")


@query("SELECT l_orderkey, arg_max(l_returnflag, (l_quantity, l_discount, l_linenumber, l_partkey)) AS winner FROM lineitem GROUP BY 1")
def q_cascade_argmax(t):
    c = t("lineitem").select("l_orderkey", F.lit("flag").alias("property"), F.col("l_returnflag").alias("value"), F.lit(False).alias("important"), F.lit(0).alias("origin_rank"), F.col("l_quantity").alias("ids"), F.col("l_discount").alias("classes"), F.col("l_linenumber").alias("elements"), F.col("l_partkey").alias("ord"))
    return styles.winning(c, "l_orderkey").select("l_orderkey", F.col("value").alias("winner"))


@query("SELECT kind, arg_max(coalesce(lang, ''), (n, coalesce(lang, ''))) AS lang FROM (SELECT kind, lang, sum(n_chars) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def q_weighted_mode(t):
    return styles.weighted_mode(t("documents"), "kind", "lang", "n_chars")


@query("SELECT kind, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty, coalesce(sum(n_chars), 0)::BIGINT AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def q_stats(t):
    return B.index_stats(t("documents"), "kind", "text", "n_chars", "source")


@query(
    """WITH RECURSIVE t AS (SELECT coalesce(source, '') AS source, doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS k, sum(coalesce(n_chars, 0)) OVER (PARTITION BY coalesce(source, '')) AS total FROM documents),
      f AS (SELECT source, k, doc_id, 0::BIGINT AS batch, list_transform(range(greatest(1, round_even(total / 10000.0, 0)::BIGINT)), lambda x: CASE WHEN x = 0 THEN n ELSE 0 END) AS loads FROM t WHERE k = 1 UNION ALL
        SELECT t.source, t.k, t.doc_id, (list_position(f.loads, list_min(f.loads)) - 1)::BIGINT, list_transform(f.loads, lambda x, i: CASE WHEN i = list_position(f.loads, list_min(f.loads)) THEN x + t.n ELSE x END) FROM f JOIN t ON t.source = f.source AND t.k = f.k + 1)
      SELECT source, doc_id, batch::INTEGER AS batch FROM f"""
)
def q_lpt_pack(t):
    d = t("documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    return P.lpt_pack(d, "source", "doc_id", "n_chars")


@query(
    """WITH RECURSIVE r AS (SELECT book_id, chapter_key, coalesce(octet_length(encode(document)), 0) AS size, row_number() OVER (PARTITION BY book_id ORDER BY chapter_key) AS n FROM chapters),
      f AS (SELECT book_id, chapter_key, n, 0 AS chunk, size AS filled FROM r WHERE n = 1 UNION ALL
        SELECT r.book_id, r.chapter_key, r.n, CASE WHEN f.filled >= 8192 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.filled >= 8192 THEN r.size ELSE f.filled + r.size END FROM f JOIN r ON r.book_id IS NOT DISTINCT FROM f.book_id AND r.n = f.n + 1)
      SELECT book_id, chapter_key, chunk FROM f"""
)
def q_next_fit(t):
    d = t("chapters").select("book_id", "chapter_key", F.coalesce(F.octet_length("document"), F.lit(0)).alias("size"))
    return P.next_fit(d, "book_id", "chapter_key", "size")


@query("SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def x_tumbling(t):
    return t("events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def x_session(t):
    s = t("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
