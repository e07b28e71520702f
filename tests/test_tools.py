import pytest

from quirework.operators import navigation, ranks, retrieval, tools, tree

M = "node bigint, name string, type string, description string, ord int"


def test_entities_and_look_ups(spark, rows):
    m = spark.createDataFrame([(1, "Ann One", "Person", "", 1), (2, " ann one", "Place", "says", 2), (2, "ANN ONE", "Person", "more", 3), (3, "Ann", None, None, 1), (4, " ", "x", "y", 1), (5, None, "x", "y", 1)], M)
    e = tools.entities(m)
    assert rows(e) == [("ann", "Ann", None, None, 1), ("ann one", "Ann One", "Person", "says", 2)]
    links = tools.linked(m)
    assert rows(links) == [("ann", 3), ("ann one", 1), ("ann one", 2)]
    keys = e.select("key")
    assert rows(tools.matched_entities(keys, "Ann ONE ")) == [("ann one", "exact")]
    assert rows(tools.matched_entities(keys, "nn o")) == [("ann one", "part")] and rows(tools.matched_entities(keys, "zzz")) == []
    vectors = tools.embed(e, "key", "name", 64)
    assert rows(tools.query_entities(vectors, tools.embedded("one ann", 64)).select("key"))[-1] == ("ann one",)
    assert {r[1] for r in rows(tools.matched_entities(keys, "one x", vectors, tools.embedded("one x", 64)))} == {"alike"}
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "node_id bigint, top string")
    assert rows(tools.related(keys, links, nodes)) == [(1, "a", 1), (2, "b", 1), (3, "a", 1)]
    r = spark.createDataFrame([("Ann", "ann one", "knows"), ("ann one", "Bob", "sees"), ("ann", "Ann", "is"), ("Bob", "Cy", "x")], "source string, target string, label string")
    assert rows(tools.relations_between(r, keys)) == [("ann", "ann one", "knows")]
    own, touched = tools.selected_by_entity("ann one", keys, links, r)
    assert rows(own) == [("ann one", 1), ("ann one", 2)] and sorted(x[3] for x in rows(touched)) == ["knows", "sees"]
    assert tools.embedded(None) == tools.embedded("") == [0.0] * 384 and abs(sum(x * x for x in tools.embedded("a b b")) - 1) < 1e-9


def test_reranking(spark, rows):
    c = spark.createDataFrame([(1, "the old ship"), (2, "A ship, old"), (3, None), (4, "")], "id bigint, text string")
    assert [r[0] for r in tools.reranked(c, "old ship", "id", "text", 2).collect()] == [1, 2]
    assert {r[0]: round(r[1], 2) for r in rows(tools.reranked(c, "old ship", "id", "text"))} == {1: 0.67, 2: 0.67, 3: 0.0, 4: 0.0}


def test_index_on_disk(spark, rows, tmp_path):
    n = spark.createDataFrame([(1, "a"), (2, "b")], "node_id bigint, book string")
    path = str(tmp_path / "ix")
    tools.save_index(n, path)
    tools.save_index(spark.createDataFrame([(3, "b")], "node_id bigint, book string"), path)
    assert sorted(rows(tools.load_index(spark, path))) == [(1, "a"), (3, "b")] and rows(tools.load_index(spark, path, "b")) == [(3, "b")]


def test_running_sums_and_last_values_of_a_hot_group(spark, rows):
    own = [(1 if i % 3 else None, i, i if i % 4 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(own, "g int, o int, v int").repartition(7)
    sums, lasts, want = {}, {}, []
    for g, o, v in own:
        sums[g] = sums.get(g, 0) + o
        lasts[g] = v if v is not None else lasts.get(g)
        want.append((g, o, sums[g], lasts[g]))
    a = {(r["g"], r["o"]): r["s"] for r in ranks.running_sum(df, "g", "o", value="o", name="s").collect()}
    b = {(r["g"], r["o"]): r["l"] for r in ranks.last_value(df, "g", "o", value="v", name="l").collect()}
    assert all(a[g, o] == s and b[g, o] == x for g, o, s, x in want) and len(a) == len(b) == 200
    assert ranks.running_sum(df.limit(0), "g", "o", value="o", name="s").count() == 0


def test_closures_end_or_fail(spark, rows):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)], "c int, p int")
    assert tree.nest_parents(chain, "c", "p").count() == 45
    with pytest.raises(ValueError, match="circle"):
        tree.nest_parents(spark.createDataFrame([(1, 2), (2, 1)], "c int, p int"), "c", "p")
    deep = spark.createDataFrame([(1, i, i) for i in range(1, 10)], "g int, o int, level int")
    assert [r[3] for r in rows(tree.previous_smaller(deep, "g", "o", "level"))] == [None, *range(1, 9)]


def test_both_ways_of_pagerank_give_the_same_rows(spark, rows):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9), (4, 4)], "a int, b int")
    starts = spark.createDataFrame([(1,), (7,)], "node int")
    a, b = (dict(map(tuple, retrieval.pagerank(edges, starts, rounds=8, dense=d).collect())) for d in (0, 100))
    assert set(a) == set(b) == {1, 2, 3, 4, 7} and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_landmark_kinds(spark, rows):
    df = spark.createDataFrame([("own Cover",), ("x",), (None,)], "types string")
    assert [r[0] for r in df.select(navigation.landmark_kind("types")).collect()] == ["Cover", None, None]
