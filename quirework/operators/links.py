"""Hyperlinks: targets by joins, broken ones, reverse look-ups and rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators.ranks import last_value

EXTERNAL = r"^(?i)[a-z][a-z0-9+.-]*:"


def anchor_index(anchors: DataFrame) -> DataFrame:
    """(book, key, doc, node): key is path#id; of repeated ids the last one counts. anchors(book, path, id, doc, node)."""
    key = F.concat(F.substring_index("path", "#", 1), F.lit("#"), F.col("id"))
    return anchors.groupBy("book", key.alias("key")).agg(F.max_by(F.struct("doc", "node"), F.struct("doc", "node")).alias("x")).select("book", "key", "x.doc", "x.node")


def resolve_links(links: DataFrame, spine: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds target_kind (external, internal, chapter or null), target_doc, target_node, target_url.

    links(book, path, href) with href resolved against path; spine(book, path, doc). A fragment
    needs its anchor, a bare path only the chapter; what has neither is broken."""
    outside = F.col("href").rlike(EXTERNAL)
    full = F.when(F.startswith(F.col("href"), F.lit("#")), F.concat(F.substring_index("path", "#", 1), "href")).otherwise(F.col("href"))
    has = F.instr("full", "#") > 0
    n = links.withColumns({"external": outside, "full": full})
    n = n.join(anchors.select("book", F.col("key").alias("full"), F.col("doc").alias("a_doc"), F.col("node").alias("a_node")), ["book", "full"], "left")
    n = n.withColumn("bare", F.substring_index("full", "#", 1))
    n = n.join(spine.select("book", F.col("path").alias("bare"), F.col("doc").alias("s_doc")), ["book", "bare"], "left")
    kind = F.when(F.col("external"), "external").when(has & F.col("a_doc").isNotNull() & F.col("s_doc").isNotNull(), "internal").when(~has & F.col("s_doc").isNotNull(), "chapter")
    n = n.withColumn("target_kind", kind)
    out = {"target_doc": F.when(kind == "internal", F.col("a_doc")).when(kind == "chapter", F.col("s_doc")), "target_node": F.when(kind == "internal", F.col("a_node")), "target_url": F.when(kind == "external", F.col("href"))}
    return n.withColumns(out).drop("external", "full", "bare", "a_doc", "a_node", "s_doc")


def broken(links: DataFrame, targets: DataFrame, href: str = "href") -> DataFrame:
    """Links whose href is in no target."""
    return links.join(targets.select(F.col(targets.columns[0]).alias(href)).distinct(), href, "left_anti")


def backlinks(resolved: DataFrame, target: str, source: str) -> DataFrame:
    """(target, links, sources): who links to each target, how often."""
    return resolved.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("links"), F.count_distinct(source).alias("sources"))


def rewrite(links: DataFrame, overrides: DataFrame, sources: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds emitted: an override, else the emitted file of the source, else of the anchor, else the href itself.

    Each of the three is (href, emitted), href unique."""
    out = links
    for name, df in (("o", overrides), ("s", sources), ("a", anchors)):
        out = out.join(df.select("href", F.col("emitted").alias(f"__{name}")), "href", "left")
    return out.withColumn("emitted", F.coalesce("__o", "__s", "__a", "href")).drop("__o", "__s", "__a")


def as_of(left: DataFrame, right: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """Adds the value of the latest right row not after each left row, else of the first right row.

    Both sides are one stream sorted by group and time and cut into ranges, so it is no range join and
    no group is one task."""
    a = left.select(group, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(group, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    both = last_value(a.unionByName(b), group, "__at", "__side", value="__v", name="__last").where("__side = 1")
    first = right.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.min_by(value, at).alias("__first"))
    return both.join(first, F.col(group).eqNullSafe(F.col("__g")), "left").select("__row.*", F.coalesce("__last", "__first").alias(value))


def nearest_in_window(left: DataFrame, right: DataFrame, group: str, at: str, reach: int, value: str) -> DataFrame:
    """Adds the value of the nearest right row within reach, forward first, then backward; ties to the lower value.

    A band join: both sides are cut into stretches of reach, and each left row looks into its own and the two beside it."""
    l = left.withColumn("__id", F.xxhash64(*left.columns)).withColumn("__band", F.explode(F.array(*[F.floor(F.col(at) / reach) + d for d in (-1, 0, 1)])))  # noqa: E741
    r = right.select(F.col(group), F.floor(F.col(at) / reach).alias("__band"), F.col(at).alias("__to"), F.col(value))
    far = F.col("__to") - F.col(at)
    met = l.join(r, [group, "__band"]).where(F.abs(far) <= reach)
    best = met.groupBy(*left.columns).agg(F.min_by(value, F.struct((far < 0).cast("int").alias("back"), F.abs(far).alias("far"), F.col(value))).alias(value))
    return left.join(best, left.columns, "left")


def containing(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, length: str, value: str) -> DataFrame:
    """Adds the value of the span that holds each point, else of the group's first span.

    Spans don't overlap, so the one that begins last before the point is the only candidate."""
    s = spans.select(group, F.col(start).alias(at), F.struct(F.col(start).alias("s"), F.col(length).alias("n"), F.col(value).alias("v")).alias("__span"))
    first = spans.groupBy(group).agg(F.min_by(value, start).alias("__first"))
    found = as_of(points, s, group, at, "__span").join(first, group, "left")
    inside = (F.col(at) >= F.col("__span.s")) & (F.col(at) < F.col("__span.s") + F.col("__span.n"))
    return found.withColumn(value, F.when(inside, F.col("__span.v")).otherwise(F.col("__first"))).drop("__span", "__first")


