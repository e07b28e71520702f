"""Positions in reading order: running offsets, locations, pages, spans and packings."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.grouped import folded
from quirework.operators.ranks import running_sum
from quirework.operators.tree import levels_of

LOCATION, PAGE, RECORD, CHUNK = 150, 1850, 4096, 8192


def positions(elements: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """Adds start: the sum of the lengths before, an element being one long at least.

    order tells the elements of a group apart; sums run by ranges, so no group is one task."""
    n = F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(1)).cast("bigint")
    return running_sum(elements.withColumn("size", n), group, order, value="size", name="start").withColumn("start", F.col("start") - F.col("size"))


def locations(placed: DataFrame, every: int = LOCATION) -> DataFrame:
    """One row per element start and each so many positions inside it: adds offset."""
    return placed.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(every).cast("bigint"))))


def pages(placed: DataFrame, every: int = PAGE) -> DataFrame:
    """One row per page that begins in an element: adds page (from 1) and offset in the element."""
    low = F.ceil(F.col("start") / every).cast("bigint")
    high = F.expr(f"(start + size - 1) div {every}")
    listed = F.when(low <= high, F.sequence(low, high))
    return placed.withColumn("__p", F.explode(listed)).withColumns({"page": F.col("__p") + 1, "offset": F.col("__p") * every - F.col("start")}).drop("__p")


def largest_section(elements: DataFrame, section: str, length: str) -> DataFrame:
    """(section, total): the longest section; ties go to the one that sorts first."""
    return elements.groupBy(section).agg(F.sum(F.coalesce(length, F.lit(0))).cast("bigint").alias("total")).orderBy(F.desc("total"), section).limit(1)


def toc_spans(entries: DataFrame, group: str, at: str, depth: str, ends: DataFrame, deepest: int | None = None) -> DataFrame:
    """Adds span: how far each entry reaches, to the next entry no deeper than it, else to the end.

    ends(group, stop). It is one running minimum from the right per depth; how deep the entries go is
    looked up where it isn't given. Deeper than MOST_LEVELS is an error."""
    deepest = levels_of(entries, depth, deepest)
    later = Window.partitionBy(group).orderBy(at).rangeBetween(1, Window.unboundedFollowing)
    nxt = F.lit(None).cast("bigint")
    out = entries
    for k in range(1, deepest + 1):
        out = out.withColumn(f"__n{k}", F.min(F.when(F.col(depth) <= k, F.col(at))).over(later))
        nxt = F.when(F.col(depth) == k, F.col(f"__n{k}")).otherwise(nxt)
    out = out.withColumn("__next", nxt).drop(*[f"__n{k}" for k in range(1, deepest + 1)])
    return out.join(ends, group).withColumn("span", F.coalesce("__next", "stop") - F.col(at)).drop("__next", "stop")


def overlap_class(spans: DataFrame, start: str, stop: str, record: int = RECORD) -> DataFrame:
    """One row per span and record it touches, with how: spans, starts, ends or completes in it."""
    first, last = F.expr(f"{start} div {record}"), F.expr(f"({stop} - 1) div {record}")
    rows = spans.where(F.col(stop) > F.col(start)).withColumn("record", F.explode(F.sequence(first, last)))
    starts, ends = F.expr(f"{start} div {record}") == F.col("record"), F.expr(f"({stop} - 1) div {record}") == F.col("record")
    return rows.withColumn("kind", F.when(starts & ends, "completes").when(starts, "starts").when(ends, "ends").otherwise("spans"))


def fixed_records(texts: DataFrame, text: str, size: int = RECORD) -> DataFrame:
    """One row per piece of so many characters: adds record and piece."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    rows = texts.where(F.length(text) > 0).withColumn("record", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("piece", F.substring(text, F.col("record") * size + 1, F.lit(size)))


def next_fit(pieces: DataFrame, group: str, order: str, size: str, limit: int = CHUNK) -> DataFrame:
    """(group, order, chunk): a new chunk begins once the current one holds limit or more; pieces stay whole.

    The fold is sequential in a group; it streams through the group's rows in order."""

    def step(state: tuple[int, int], row: dict) -> tuple:
        chunk, filled = state
        if filled >= limit:
            chunk, filled = chunk + 1, 0
        return (chunk, filled + (row[size] or 0)), (row[group], row[order], chunk)

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    return folded(pieces, group, [order], [group, order, size], lambda _: (0, 0), step, f"{group} {kinds[group]}, {order} {kinds[order]}, chunk int")


def lpt_pack(items: DataFrame, group: str, key: str, size: str, per_batch: int = 10_000) -> DataFrame:
    """(group, key, batch): the largest first into the lightest of max(1, total / per_batch) batches.

    Halves round to even; ties go to the lower key and the lower batch. A task holds the loads of one
    group's batches, not its rows."""
    total = items.groupBy(F.col(group).alias("__g")).agg(F.sum(size).alias("__total"))
    with_total = items.join(total, F.col(group).eqNullSafe(F.col("__g"))).withColumn("__total", F.coalesce("__total", F.lit(0)).cast("bigint"))

    def step(heap: list, row: dict) -> tuple:
        load, batch = heapq.heappop(heap)
        heapq.heappush(heap, (load + int(row[size] or 0), batch))
        return heap, (row[group], row[key], batch)

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    return folded(with_total, group, [F.desc(size), key], [group, key, size, "__total"], lambda row: [(0, b) for b in range(max(1, round(row["__total"] / per_batch)))], step, f"{group} {kinds[group]}, {key} {kinds[key]}, batch int")


def islands(rows: DataFrame, group: str, order: str, same: str) -> DataFrame:
    """Adds island: a number per run of rows with equal values."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("island", F.sum(F.when(F.col(same).eqNullSafe(F.lag(same).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)).over(w))


def sessions(rows: DataFrame, group: str, order: str, begins) -> DataFrame:
    """Adds session: how many rows that begin one there are up to each row; 0 before the first."""
    return rows.withColumn("session", F.count_if(begins).over(Window.partitionBy(group).orderBy(order)))




def location_report(located: DataFrame, texts: DataFrame, key: str, text: str, snippet: int = 40) -> DataFrame:
    """Adds snippet: what stands at each location of located(key, offset), cut after so many characters; of a key
    that has no text it is null. texts(key, text)."""
    said = texts.select(key, F.col(text).alias("__t"))
    return located.join(said, key, "left").withColumn("snippet", F.substring("__t", (F.col("offset") + 1).cast("int"), F.lit(snippet))).drop("__t")


def position_report(placed: DataFrame, group: str) -> DataFrame:
    """(group, elements, first, last, length): how many elements a group has and how far they reach."""
    return placed.groupBy(group).agg(F.count("*").alias("elements"), F.min("start").alias("first"), F.max("start").alias("last"), F.sum("size").alias("length"))
