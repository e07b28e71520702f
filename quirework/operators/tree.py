"""Trees as nested sets: children, descendants, ancestors, inheritance and roll-ups.

Every function takes nodes with (doc, pre, end, depth, parent_pre) and keeps the document key in
each predicate, so a range join is a filter inside one hash partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import stored


def children(nodes: DataFrame, key: str = "doc_key") -> DataFrame:
    """(key, parent, child, sib)."""
    return nodes.where("parent_pre is not null").select(key, F.col("parent_pre").alias("parent"), F.col("pre").alias("child"), "sib")


def _spans(nodes: DataFrame, key: str, name: str, *keep: str) -> DataFrame:
    return nodes.select(F.col(key), F.col("pre").alias(f"{name}_pre"), F.col("end").alias(f"{name}_end"), F.col("depth").alias(f"{name}_depth"), *[F.col(c).alias(f"{name}_{c}") for c in keep])


def descendants(nodes: DataFrame, roots: DataFrame, key: str = "doc_key", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each root with each node of its subtree, itself included."""
    a, d = _spans(roots, key, "root"), _spans(nodes, key, "node", *keep)
    return a.join(d, key).where("node_pre between root_pre and root_end")


def descendant_counts(nodes: DataFrame, key: str = "doc_key") -> DataFrame:
    """(key, pre, descendants): a subtraction, as the set is nested."""
    return nodes.select(key, "pre", (F.col("end") - F.col("pre")).alias("descendants"))


def inherited(nodes: DataFrame, column: str, key: str = "doc_key") -> DataFrame:
    """(key, pre, value): the value of the nearest node on the way up that has one.

    Only nodes with a value are joined as ancestors, which are few."""
    holders = _spans(nodes.where(F.col(column).isNotNull()), key, "a", column)
    every = nodes.select(key, "pre")
    found = every.join(holders, key).where("pre between a_pre and a_end").groupBy(key, "pre").agg(F.max_by(f"a_{column}", "a_depth").alias("value"))
    return every.join(found, [key, "pre"], "left")


#: More levels than any document nests; beyond it a table of parents is taken for a circle.
MOST_LEVELS = 4096


def levels_of(rows: DataFrame, level: str, given: int | None = None) -> int:
    """The highest level of some rows; more than 64 of them are an error, as each costs a window."""
    top = given or int(rows.agg(F.max(level)).first()[0] or 1)
    if top > 64:
        raise ValueError(f"{level} goes up to {top}: more than 64 levels")
    return top


def nest_parents(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, distance): the closure of a parent-id table, itself included.

    A loop of joins that ends as soon as a round adds nothing, each written once. A circle of
    parents is an error: it would never end."""
    level = edges.select(F.col(child).alias("node"), F.col(child).alias("ancestor"), F.lit(0).alias("distance"))
    up = edges.where(F.col(parent).isNotNull()).select(F.col(child).alias("ancestor"), F.col(parent).alias("above"))
    out = level
    for n in range(1, MOST_LEVELS + 1):
        level = stored(level.join(up, "ancestor").select("node", F.col("above").alias("ancestor"), F.lit(n).alias("distance")), "level")
        if level.isEmpty():
            return out
        if not level.where("node = ancestor").isEmpty():
            raise ValueError(f"{parent} goes round in a circle")
        out = out.unionByName(level)
    raise ValueError(f"{parent} goes up more than {MOST_LEVELS} levels")


def breadcrumbs(nodes: DataFrame, title: str, key: str = "doc_key", glue: str = " > ") -> DataFrame:
    """(key, pre, breadcrumb): titles from the root down, blank ones skipped."""
    titled = _spans(nodes.where(F.trim(F.coalesce(title, F.lit(""))) != ""), key, "a", title)
    found = (
        nodes.select(key, "pre").join(titled, key).where("pre between a_pre and a_end")
        .groupBy(key, "pre").agg(F.sort_array(F.collect_list(F.struct("a_depth", F.col(f"a_{title}").alias("t")))).alias("w"))
    )
    text = F.array_join(F.transform("w", lambda x: x["t"]), glue)
    return nodes.select(key, "pre").join(found.select(key, "pre", text.alias("breadcrumb")), [key, "pre"], "left").withColumn("breadcrumb", F.coalesce("breadcrumb", F.lit("")))


def previous_smaller(rows: DataFrame, group: str, order: str, level: str, levels: int | None = None) -> DataFrame:
    """Adds parent_ord: the latest earlier row of strictly smaller level.

    It is one running maximum per level instead of a stack; how many levels there are is looked up
    where it isn't given."""
    levels = levels_of(rows, level, levels)
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    for k in range(2, levels + 1):
        out = out.withColumn(f"__p{k}", F.max(F.when(F.col(level) < k, F.col(order))).over(w))
    pick = F.lit(None).cast(rows.schema[order].dataType)
    for k in range(2, levels + 1):
        pick = F.when(F.col(level) == k, F.col(f"__p{k}")).otherwise(pick)
    return out.withColumn("parent_ord", pick).drop(*[f"__p{k}" for k in range(2, levels + 1)])


def ready(edges: DataFrame, child: str, parent: str, done: DataFrame) -> DataFrame:
    """Nodes not yet done all of whose children are: (node)."""
    open_children = edges.where(F.col(parent).isNotNull()).join(done.select(F.col("node").alias(child)), child, "left_anti").select(F.col(parent).alias("node"))
    pending = edges.select(F.col(child).alias("node")).join(done.select("node"), "node", "left_anti")
    return pending.join(open_children, "node", "left_anti").distinct()


def rolled_up(nodes: DataFrame, value: str, key: str = "doc_key") -> DataFrame:
    """(key, pre, total): the sum over each node's subtree, by one running sum and two look-ups.

    The sum of a subtree is the running sum at its last node less that before its first."""
    w = Window.partitionBy(key).orderBy("pre")
    run = nodes.withColumn("__run", F.sum(F.coalesce(value, F.lit(0))).over(w))
    last = run.select(key, F.col("pre").alias("__end"), F.col("__run").alias("__last"))
    joined = run.withColumn("__end", F.col("end")).join(last, [key, "__end"])
    return joined.select(key, "pre", (F.col("__last") - F.col("__run") + F.coalesce(value, F.lit(0))).alias("total"))
