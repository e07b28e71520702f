"""Retrieval over embedded texts and entity graphs: similarity, ranking, resolution, search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector counts as one of length 1."""
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def query_scores(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score) against one query vector, a literal of the plan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = max(sum(float(x) ** 2 for x in query) ** 0.5, 1e-10)
    n = norm(F.col(vector))
    return vectors.select(key, (dot(F.col(vector), q) / (F.when(n == 0, 1.0).otherwise(n) * length)).alias("score"))


def top(scores: DataFrame, n: int, key: str, score: str = "score") -> DataFrame:
    """The n highest; ties go to the lower key."""
    return scores.orderBy(F.desc(score), key).limit(n)


def penalised(scores: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Scores of inner nodes cut by 1 / (1 + 0.15 ln(1 + descendants)). counts(key, descendants)."""
    n = F.coalesce(F.col("descendants"), F.lit(0))
    return scores.join(counts, key, "left").select(key, F.when(n > 0, F.col("score") / (1 + 0.15 * F.log(1 + n))).otherwise(F.col("score")).alias("score"))


def pair_candidates(vectors: DataFrame, n: int, least: float, key: str = "vec_id", vector: str = "embedding", block: int = 512, queries: DataFrame | None = None) -> DataFrame:
    """(a, b, score): for each query vector the n nearest others of cosine least or more.

    queries are rows of the same columns, as new entities held against the known ones; without them
    they are all vectors. They are held against all in blocks that are multiplied as matrices; each
    task keeps n per vector and block, and a window keeps n of those. No pair below the cut is a
    row; the work is queries times vectors, and exact. Nulls are left out."""
    spark = vectors.sparkSession
    parts = max(1, spark.sparkContext.defaultParallelism)

    def cut(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v")).where("v is not null")
        return stored(rows.repartition(parts).mapInArrow(_blocks(block), "part bigint, keys array<bigint>, rows binary, width int"), "vectors")

    blocks = cut(vectors)
    asked = blocks if queries is None else cut(queries)
    heads = blocks.select(F.col("keys").alias("keys2"), F.col("rows").alias("rows2"), F.col("width").alias("width2"))
    met = asked.join(heads, F.col("width") == F.col("width2")).select("keys", "rows", "keys2", "rows2", "width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, raw, keys2, raw2, width in zip(*(b.column(c).to_pylist() for c in ("keys", "rows", "keys2", "rows2", "width")), strict=True):
                x, y = (np.frombuffer(r, np.float64).reshape(-1, width) for r in (raw, raw2))
                keys, keys2 = np.array(keys), np.array(keys2)
                s = x @ y.T
                s[keys[:, None] == keys2[None, :]] = -2
                order = np.lexsort((np.broadcast_to(keys2, s.shape), -np.round(s, 12)), axis=1)[:, :n]
                i = np.repeat(np.arange(len(keys)), order.shape[1])
                j = order.ravel()
                good = s[i, j] >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[i[good]]), pa.array(keys2[j[good]]), pa.array(s[i, j][good])], ["a", "b", "score"])

    best = met.mapInArrow(run, "a bigint, b bigint, score double")
    w = Window.partitionBy("a").orderBy(F.desc(F.round("score", 12)), "b")
    return best.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, size):
                part = b.slice(start, size)
                keys = part.column("k").to_pylist()
                rows = np.array(part.column("v").to_pylist(), np.float64)
                length = np.linalg.norm(rows, axis=1, keepdims=True)
                rows = rows / np.where(length == 0, 1, length)
                yield pa.RecordBatch.from_arrays([pa.array([hash(tuple(keys))], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([rows.tobytes()], pa.binary()), pa.array([rows.shape[1]], pa.int32())], ["part", "keys", "rows", "width"])

    return run


def gradient_cut(candidates: DataFrame, floor: float = 0.5, drop: float = 1.5) -> DataFrame:
    """Of each a's candidates by falling score, those before the first below floor or a sharp drop."""
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    ok = (F.col("score") >= floor) & (F.lag("score").over(w).isNull() | (F.col("score") > F.lag("score").over(w) / drop))
    return candidates.withColumn("__ok", ok).withColumn("__all", F.bool_and("__ok").over(w)).where("__all").drop("__ok", "__all")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the lowest node of each connected component.

    Large-star and small-star by turns: stars grow by doubling, so rounds are few, and go on until
    nothing changes. Each is written to the shared folder, which cuts the lineage."""
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    both = lambda x: x.unionByName(x.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        n = both(e)
        low = n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = n.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = stored(small, "edges")
        if small.exceptAll(e).isEmpty() and e.exceptAll(small).isEmpty():
            break
        e = small
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    return nodes.join(e.select(F.col("u").alias("node"), "v"), "node", "left").groupBy("node").agg(F.coalesce(F.min("v"), F.col("node")).alias("root"))


def merge_entities(links: DataFrame, names: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity map, merged links): the longest key of a component is canonical, ties to the one that sorts first.

    links(key, node), names(key), same(a, b) of keys."""
    comp = components(same)
    canon = comp.groupBy("root").agg(F.min_by("node", F.struct(F.negative(F.length("node")), "node")).alias("canonical"))
    mapped = names.select("key").distinct().join(comp.withColumnRenamed("node", "key"), "key", "left").join(canon, "root", "left").select("key", F.coalesce("canonical", "key").alias("canonical"))
    return mapped, links.join(mapped, "key").select(F.col("canonical").alias("key"), "node").distinct()


def pagerank(edges: DataFrame, starts: DataFrame, alpha: float = 0.15, rounds: int = 20, dense: int = 1000) -> DataFrame:
    """(node, rank) of personalised PageRank over an undirected multigraph: the nodes that starts reach.

    edges(a, b), starts(node). Self-loops are dropped, rows normalised, mass at dangling nodes is
    lost and the ranks renormalised each round. Graphs of up to dense nodes, which have at most the
    square of that many different edges, are walked by a matrix in one task, larger ones by joins; both
    give the same rows. Each round of joins is written once, before its sum is taken."""
    e = edges.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))
    e = stored(e, "graph")
    nodes = e.select(F.col("src").alias("node")).unionByName(starts.select("node")).distinct()
    if nodes.count() <= dense:
        return _dense_rank(e, starts, alpha, rounds).where("rank > 0")
    out = e.groupBy("src").agg(F.sum("n").alias("total"))
    w = stored(e.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w")), "graph")
    restart = starts.select("node").where("node is not null").distinct()
    k = max(restart.count(), 1)
    rank, total = restart.select("node", F.lit(1.0 / k).alias("rank")), 1.0
    for _ in range(rounds):
        moved = rank.join(w, rank.node == w.src).select(F.col("dst").alias("node"), (F.col("rank") * F.col("w") * ((1 - alpha) / total)).alias("m"))
        back = restart.select("node", F.lit(alpha / k).alias("m"))
        rank = stored(moved.unionByName(back).groupBy("node").agg(F.sum("m").alias("rank")), "rank")
        total = rank.agg(F.sum("rank")).first()[0] or 1.0
    return rank.select("node", (F.col("rank") / total).alias("rank"))


def _dense_rank(edges: DataFrame, starts: DataFrame, alpha: float, rounds: int) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()
    both = edges.select("src", "dst", "n").unionByName(starts.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(0).cast("bigint").alias("n")).distinct())

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        names = pd.Index(sorted(set(rows["src"]) | set(rows["dst"].dropna())))
        real = rows[rows["dst"].notna()]
        m = np.zeros((len(names), len(names)))
        np.add.at(m, (names.get_indexer(real["src"]), names.get_indexer(real["dst"])), real["n"].to_numpy(float))
        m /= np.maximum(m.sum(axis=1, keepdims=True), 1)
        r = np.zeros(len(names))
        begin = names.get_indexer(rows[rows["dst"].isna()]["src"])
        r[begin] = 1 / max(len(begin), 1)
        p = r.copy()
        for _ in range(rounds):
            p = (1 - alpha) * (p @ m) + alpha * r
            p /= p.sum() or 1
        return pd.DataFrame({"node": names, "rank": p})

    return both.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda rows: walk(rows), f"node {kind}, rank double")


def node_scores(ranks: DataFrame, links: DataFrame, least: float = 1e-6) -> DataFrame:
    """(node, score): the sum of the ranks of the entities linked to a node. links(key, node)."""
    return ranks.where(F.col("rank") >= least).select(F.col("node").alias("key"), "rank").join(links, "key").groupBy("node").agg(F.sum("rank").alias("score"))


def normalised(scores: DataFrame, *columns: str) -> DataFrame:
    """Each column divided by its maximum, 0 counting as 1."""
    most = scores.agg(*[F.max(c).alias(c) for c in columns]).first()
    return scores.withColumns({c: F.col(c) / float(most[c] or 1) for c in columns})


def skyline(points: DataFrame, x: str, y: str) -> DataFrame:
    """The points no other point beats in one and equals or beats in both.

    The best y of each x is taken first, with partial aggregation; the running maximum from the
    high end of x then runs over distinct values of x by ranges of them, so no task sees all."""
    best = points.groupBy(x).agg(F.max(y).alias("__y"))
    ranged = best.repartitionByRange(F.desc(x)).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged, "skyline")
    tops = ranged.groupBy("__part").agg(F.max("__y").alias("__t"), F.max(x).alias("__x"))
    before = tops.select("__part", F.max("__t").over(Window.orderBy(F.desc("__x")).rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    run = ranged.join(before, "__part").withColumn("__run", F.max("__y").over(Window.partitionBy("__part").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)))
    front = run.where(F.col("__y") > F.coalesce(F.greatest("__before", "__run"), F.lit(float("-inf")))).select(x, F.col("__y").alias(y))
    return points.join(front, [x, y], "left_semi")


def union_scores(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, s_t, s_g): a missing score is 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return a.select(key, F.col("score").alias("s_t")).join(b.select(key, F.col("score").alias("s_g")), key, "full").select(key, zero("s_t"), zero("s_g"))


def search(text_scores: DataFrame, graph_scores: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first n of the skyline of both scores, each divided by its maximum, by their sum."""
    both = normalised(union_scores(text_scores, graph_scores, key), "s_t", "s_g")
    return skyline(both, "s_t", "s_g").orderBy(F.desc(F.col("s_t") + F.col("s_g")), key).limit(n)


def mention_index(mentions: DataFrame) -> DataFrame:
    """(key, name, nodes): mentions(node, name, ord) by trimmed lower-case name; the first spelling shows."""
    key = F.lower(F.trim("name"))
    return mentions.where(F.trim("name") != "").groupBy(key.alias("key")).agg(F.min_by("name", F.struct("ord", "name")).alias("name"), F.count_distinct("node").alias("nodes"))


def start_entities(keys: DataFrame, wanted: list[str]) -> DataFrame:
    """(wanted, key): the same key, else the first by name that holds or is held by it."""
    spark = keys.sparkSession
    w = F.broadcast(spark.createDataFrame([(x.lower().strip(),) for x in wanted], "wanted string"))  # the caller's list
    near = keys.join(w, (F.col("key") == F.col("wanted")) | F.col("key").contains(F.col("wanted")) | F.col("wanted").contains(F.col("key")))
    return near.groupBy("wanted").agg(F.min_by("key", F.struct((F.col("key") != F.col("wanted")).cast("int"), "key")).alias("key"))
