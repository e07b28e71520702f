"""One document after the other inside a task, for what has to see a document whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def per_document(nodes: DataFrame, columns: list[str], work: Callable[[int, list[dict]], list[tuple]], schema: str, key: str = "doc_key") -> DataFrame:
    """The rows that work(key, nodes in order) gives for each document.

    Documents are hashed over the tasks and sorted there; batches hold many of them, so a small
    document costs no more than its rows. A task holds one document at a time."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    types = [_KINDS[f.strip().split(" ")[1]] for f in schema.split(",")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield from b.to_pylist()

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for k, own in groupby(rows(batches), key=lambda r: r[key]):
            out += work(k, list(own))
            if len(out) >= 2048:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return nodes.select(*columns).repartition(key).sortWithinPartitions(key, "pre").mapInArrow(run, schema)


def folded(rows: DataFrame, group: str, order: list, columns: list[str], start: Callable[[dict], object], step: Callable[[object, dict], tuple], schema: str) -> DataFrame:
    """A fold over the rows of each group in order: step(state, row) gives (state, row out).

    Groups are hashed over the tasks and sorted there, and a task holds one row and one state at a
    time, so a group of most rows needs time, not memory."""
    names = [f.strip().split(" ")[0].strip("`") for f in schema.split(",")]
    types = [_KINDS[f.strip().split(" ")[1]] for f in schema.split(",")]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = object(), None, []
        for b in batches:
            for row in b.to_pylist():
                if row[group] != at:
                    at, state = row[group], start(row)
                state, given = step(state, row)
                out.append(given)
            yield batch(out)
            out = []

    return rows.select(*columns).repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)
