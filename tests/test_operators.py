import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import blocks, links, passes, positions, retrieval, rewrite, styles, tree
from quirework.plans import documents
from quirework.session import stored
from quirework.sources import epub
from quirework.sources.html import html_nodes

PAGE = """<html><head><title>t</title></head><body><p>before</p><h1>One</h1><p>a <i>b</i> <b>c</b></p>
<div><span></span></div><h2>Two</h2><ul><li>x</li><li>y<p>z</p></li></ul><ul><li>w</li></ul>
<h3>Three</h3><table><tr><th>h</th></tr><tr><td>d</td></tr></table><h2>Four</h2><dl><dt>t</dt><dd>d1</dd><dd>d2</dd></dl>
<ol start="5"><li>q</li><li>r</li></ol><div>loose <p>block</p> end</div></body></html>"""


@pytest.fixture(scope="module")
def nodes(spark):
    docs = spark.createDataFrame([(1, PAGE, "clash"), (2, None, "x"), (3, "", "x"), (4, "<p>only</p>", "x")], "k bigint, h string, pre string")
    return html_nodes(docs, "k", "h").cache()


def test_sections_and_blocks(nodes, rows):
    assert rows(blocks.sections(nodes).select("ord", "level", "title", "parent_ord")) == [(1, 1, "One", None), (2, 2, "Two", 1), (3, 3, "Three", 2), (4, 2, "Four", 1)]
    got = rows(blocks.section_blocks(nodes).where("doc_key = 1").select("section_ord", "block_ord", "role", "text"))
    assert got[0] == (0, 1, "Paragraph", "before") and (1, 1, "Paragraph", "a b c") in got
    assert rows(blocks.chapter_title(nodes, nodes.sparkSession.createDataFrame([(1, "p1"), (4, "p4")], "doc_key bigint, path string"))) == [(1, "One"), (4, "p4")]


def test_lists_tables_definitions(nodes, rows):
    assert [r[0] for r in rows(blocks.list_items(nodes).select("items"))] == [["q", "r"], ["w"], ["x", "yz"]]
    assert [r[0] for r in rows(blocks.list_numbers(nodes).select("number"))] == [5, 6]
    assert rows(blocks.table_grid(nodes).select("headers", "rows")) == [(["h"], [["d"]])]
    assert [r[0] for r in rows(blocks.definition_pairs(nodes).select("entry"))] == ["d2", "t: d1"]
    assert {r[0] for r in rows(blocks.tight_lists(nodes).select("tight"))} == {True}


def test_passes(nodes, rows):
    texts = lambda n: [r[1] for r in sorted(n.where("role = 'Text' and doc_key = 1").select("pre", "text").collect())]
    clean = passes.vacuum(nodes)
    assert " " in texts(clean) and all(t.strip() or t == " " for t in texts(clean))
    assert rows(passes.prune(clean).where("tag = 'span'")) == []
    fused = passes.fuse_lists(clean)
    assert fused.where("role = 'UnorderedList' and doc_key = 1").count() == 1
    assert rows(passes.table_parts(nodes).select("part")) == [("body",), ("head",)]
    assert rows(passes.wrap_runs(clean).where("doc_key = 1").select("nodes")) == [(1,), (1,), (1,)]
    done = rewrite.pipeline(nodes).collect()
    by = {(r.doc_key, r.pre): r for r in done}
    assert sorted(p for k, p in by if k == 1) == list(range(sum(k == 1 for k, _ in by)))
    assert all(r.parent_pre is None or (by[(r.doc_key, r.parent_pre)].pre < r.pre <= r.end <= by[(r.doc_key, r.parent_pre)].end) for r in done)
    assert " ".join("".join(r.text for r in sorted(done, key=lambda r: r.pre) if r.doc_key == 1 and r.text).split()).startswith("beforeOnea b c")


def test_merge_spans(spark, rows):
    n = html_nodes(spark.createDataFrame([(1, "<p>a<!-- x -->b<i>c</i>d</p>")], "k bigint, h string"), "k", "h")
    assert [r[0] for r in sorted(passes.merge_spans(n).where("role = 'Text'").select("text").collect())] == ["ab", "c", "d"]


def test_tree(nodes, rows):
    sizes = {r[0]: r[1] for r in rows(tree.descendant_counts(nodes.where("doc_key = 4")).select("pre", "descendants"))}
    assert sizes == {0: 1, 1: 0}
    lang = html_nodes(nodes.sparkSession.createDataFrame([(1, "<div lang='fr'><p>a<i lang='de'>b</i></p></div>")], "k bigint, h string"), "k", "h")
    assert [r[1] for r in rows(tree.inherited(lang, "lang").select("pre", "value"))] == ["fr", "fr", "fr", "de", "de"]
    up = tree.rolled_up(lang.withColumn("v", F.lit(1)), "v")
    assert [r[0] for r in rows(up.orderBy("pre").select("total"))] == [1, 1, 2, 4, 5]


def test_previous_smaller_against_a_stack(spark, rows):
    rng = random.Random(3)
    levels = [rng.randint(1, 6) for _ in range(300)]
    got = dict((r[0], r[1]) for r in rows(tree.previous_smaller(spark.createDataFrame([(1, i, x) for i, x in enumerate(levels)], "g int, o int, level int"), "g", "o", "level").select("o", "parent_ord")))
    stack = []
    for i, x in enumerate(levels):
        while stack and stack[-1][1] >= x:
            stack.pop()
        assert got[i] == (stack[-1][0] if stack else None)
        stack.append((i, x))


def test_links(spark, rows):
    anchors = links.anchor_index(spark.createDataFrame([("b", "c1", "x", 1, 5), ("b", "c2#old", "y", 2, 7), ("b", "c2", "y", 2, 9)], "book string, path string, id string, doc int, node int"))
    spine = spark.createDataFrame([("b", "c1", 1), ("b", "c2", 2)], "book string, path string, doc int")
    l = spark.createDataFrame([("b", "c1", h) for h in ("#x", "c2", "c2#y", "c2#no", "zz", "http://q", None)], "book string, path string, href string")  # noqa: E741
    got = {r[0]: r[1:] for r in rows(links.resolve_links(l, spine, anchors).select("href", "target_kind", "target_doc", "target_node"))}
    assert got == {"#x": ("internal", 1, 5), "c2": ("chapter", 2, None), "c2#y": ("internal", 2, 9), "c2#no": (None, None, None), "zz": (None, None, None), "http://q": ("external", None, None), None: (None, None, None)}


def test_skyline_against_brute_force(spark, rows):
    rng = random.Random(5)
    pts = [(i, rng.randint(0, 40), rng.randint(0, 40)) for i in range(400)] + [(900, 40, 0), (901, 40, 0)]
    want = [p for p in pts if not any(q[1] >= p[1] and q[2] >= p[2] and (q[1] > p[1] or q[2] > p[2]) for q in pts)]
    assert sorted(r[0] for r in retrieval.skyline(spark.createDataFrame(pts, "id int, x int, y int"), "x", "y").select("id").collect()) == sorted(p[0] for p in want)


def test_pagerank_by_joins_equals_matrix(spark, rows):
    rng = random.Random(7)
    e = spark.createDataFrame([(f"n{rng.randint(0, 20)}", f"n{rng.randint(0, 20)}") for _ in range(60)], "a string, b string")
    s = spark.createDataFrame([("n1",), ("n2",)], "node string")
    a = {r[0]: r[1] for r in retrieval.pagerank(e, s, rounds=6).collect()}
    b = {r[0]: r[1] for r in retrieval.pagerank(e, s, rounds=6, dense=0).collect()}
    assert all(abs(a[k] - b.get(k, 0)) < 1e-9 for k in a)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (3, 9), (5, 5), (None, 1)], "a int, b int")
    assert dict(retrieval.components(e).collect()) == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7, 5: 5}


def test_packings(spark, rows):
    d = spark.createDataFrame([("g", i, n) for i, n in enumerate([9000, 6000, 5000, 5000])], "g string, k int, n int")
    loads = {}
    for _, k, b in rows(positions.lpt_pack(d, "g", "k", "n")):
        loads[b] = loads.get(b, 0) + [9000, 6000, 5000, 5000][k]
    assert sorted(loads.values()) == [11000, 14000]
    assert [r[2] for r in rows(positions.next_fit(d, "g", "k", "n"))] == [0, 1, 1, 2]
    assert rows(positions.next_fit(d.limit(0), "g", "k", "n")) == []


def test_cascade(nodes, rows):
    s = styles.cascade(nodes.where("doc_key = 4"), "p { color: red; font-size: 2em } p { color: blue } #z { color: green }")
    got = {r[0]: r[1] for r in rows(s.select("property", "value"))}
    assert got["color"] == "blue" and got["font-size"] == "2rem" and got["margin-top"] == "1em"


def test_epub_round_trip(spark, rows, tmp_path):
    books = spark.createDataFrame([("b1", "T & t", "fr", ["A"], [("one", "<html><body><p>x</p></body></html>"), ("two", "<p>y</p>")]), ("b2", None, None, None, None)], "book_id string, title string, language string, authors array<string>, chapters array<struct<title string, xhtml string>>")
    files = epub.to_epub(books).collect()
    assert epub.to_epub(books).collect() == files
    for f in files:
        (tmp_path / f"{f.book_id}.epub").write_bytes(f.content)
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    read = lambda t: epub.load_epub(spark, str(tmp_path / "*.epub"), t)
    meta = {r.path.rsplit("/", 1)[1]: r for r in read("metadata").collect()}
    assert meta["b1.epub"].title == "T & t" and meta["b1.epub"].authors == ["A"] and "BadZipFile" in meta["bad.epub"].error
    assert [r[0] for r in rows(read("toc").where("error is null").select("title"))] == ["one", "two"]
    assert [r[0] for r in rows(read("chapters").where("error is null").select("document"))] == ["<html><body><p>x</p></body></html>", "<p>y</p>"]
    assert read("assets").where("href like '%.css'").count() == 2


def test_streams(spark, rows, tmp_path):
    from quirework.streaming import jobs

    spark.sql("select timestamp'2024-01-01 00:00:01' ts, 'a' event_type, 1 user_id, 7 node_id union all select timestamp'2024-01-01 00:59:00', 'a', 1, 7").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, user_id int, node_id int").parquet(str(tmp_path / "in"))
    q = jobs.windowed_counts(stream, "1 hour", "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r[0] for r in rows(spark.table("w").select("n"))] == [2]
    jobs.upsert_latest(stream, str(tmp_path / "t"), str(tmp_path / "c"), "node_id", "ts").awaitTermination()
    latest = spark.read.parquet(str(tmp_path / "t" / "v=0"))
    assert latest.count() == 1
    assert rows(jobs.progress(latest, spark.createDataFrame([(7,), (8,)], "node_id int"), "node_id")) == [(1, 1)]


def test_core_stands_without_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parent.parent / "quirework"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s+quirework\.llm", p.read_text(), re.M), p


def test_numbers_over_ranges(spark, rows):
    from quirework.operators.ranks import numbered

    df = spark.createDataFrame([(i * 7919 % 1000, f"k{i}") for i in range(1000)], "o int, k string").repartition(5)
    assert rows(numbered(df, "o", "k").where("o <> number")) == []
    assert rows(numbered(df.limit(0), "o", "k")) == []


def test_steps_are_cleared(spark, tmp_path):
    import os

    from quirework import session

    df = session.stored(spark.range(5), "probe")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    session.clear(spark)
    assert not os.path.exists(path)


REWRITTEN = """<body><p> <span style="float:left;font-size:3em">O</span>nce <b> upon </b> </p><div>loose <i>run</i><p>block</p> end</div>
<table><tr><th>h</th></tr><tr><td>d</td></tr></table><ul><li>a</li></ul>
<ul><li>b</li></ul><div><p> </p></div><p id="x"></p><pre> kept </pre></body>"""


def test_all_passes_in_one(spark, rows):
    docs = spark.createDataFrame([(1, REWRITTEN), (2, None), (3, ""), (4, "<p>only</p>")], "k bigint, h string")
    done = rewrite.optimised_nodes(docs, "k", "h")
    one = {r["pre"]: r for r in done.where("doc_key = 1").collect()}
    tags = [one[i]["tag"] for i in sorted(one)]
    assert tags == ["body", "p", "span", "#text", "#text", "b", "#text", "div", "#run", "#text", "i", "#text", "p", "#text", "#run", "#text", "table", "thead", "tr", "th", "#text", "tbody", "tr", "td", "#text", "ul", "li", "#text", "li", "#text", "p", "pre", "#text"]
    assert [r["dropcap"] for r in one.values() if r["dropcap"]] == [3]
    assert [one[i]["text"] for i in sorted(one) if one[i]["text"] is not None][:3] == ["O", "nce ", " upon"] and " kept " in {r["text"] for r in one.values()}
    assert all(one[i]["end"] == max(j for j in one if j == i or _below(one, j, i)) for i in one)
    again = rewrite.pipeline(html_nodes(docs, "k", "h"))
    assert sorted(map(str, again.collect())) == sorted(map(str, done.collect())) and rows(rewrite.pipeline(done.limit(0))) == []


def _below(nodes, j, i):
    while j is not None and j != i:
        j = nodes[j]["parent_pre"]
    return j == i


def test_windowed_passes_and_the_single_one_agree(nodes):
    one = nodes.where("doc_key = 4")
    by_window = passes.renumber(passes.prune(passes.trim_edges(passes.fuse_lists(passes.merge_spans(passes.vacuum(one))))))
    assert {tuple(r) for r in by_window.select(*nodes.columns).collect()} == {tuple(r) for r in rewrite.pipeline(one).select(*nodes.columns).collect()}


def test_list_fusion_sends_no_nodes_through_the_driver(spark, nodes, rows):
    small = stored(nodes)
    fused = passes.fuse_lists(stored(passes.vacuum(small)))
    for step in (passes.vacuum(small), fused):
        assert "Broadcast" not in step._jdf.queryExecution().executedPlan().toString()
    assert rows(fused.select("doc_key", "pre", "end", "parent_pre", "sib")) == rows(passes.fuse_lists(passes.vacuum(nodes)).select("doc_key", "pre", "end", "parent_pre", "sib"))
    assert fused.where("role = 'UnorderedList' and doc_key = 1").count() == 1


def test_wrapped_runs_send_no_nodes_through_the_driver(spark, nodes, rows):
    runs = passes.wrap_runs(passes.vacuum(stored(nodes)))
    assert "Broadcast" not in runs._jdf.queryExecution().executedPlan().toString()
    assert rows(runs.where("doc_key = 1").select("nodes")) == [(1,), (1,), (1,)]


def test_the_query_of_wrapped_runs_sends_no_nodes_through_the_driver_once_it_has_run(spark, rows, tmp_path):
    spark.range(1, 7).selectExpr("id AS chapter_key").write.parquet(f"{tmp_path}/chapters.parquet")
    runs = documents.QUERIES["q_wrap_runs"](spark, str(tmp_path))
    assert rows(runs) == sorted(r for k in range(1, 7) for r in ([(k, 1, 2), (k, 6, 1)] if k % 2 == 0 else [(k, 1, 1), (k, 4, 1)]))
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and plan.count("SortMergeJoin") >= 3 and "Broadcast" not in plan


def test_tasks_of_the_query_of_wrapped_runs_follow_the_number_of_nodes(spark, rows, tmp_path, monkeypatch):
    spark.range(1, 41).selectExpr("id AS chapter_key").write.parquet(f"{tmp_path}/chapters.parquet")
    monkeypatch.setattr(passes, "NODES_A_TASK", 20)
    runs = documents.QUERIES["q_wrap_runs"](spark, str(tmp_path))
    plan = runs._jdf.queryExecution().executedPlan().toString()
    nodes = 20 * 7 + 20 * 5
    assert plan.count(f", {nodes // 20}), REPARTITION_BY_NUM") >= 4 and "ENSURE_REQUIREMENTS" not in plan
    assert rows(runs) == sorted((r for k in range(1, 41) for r in ([(k, 1, 2), (k, 6, 1)] if k % 2 == 0 else [(k, 1, 1), (k, 4, 1)])), key=lambda r: tuple((x is not None, str(x)) for x in r))
