"""KFX containers as tables: their facts, entities and what these refer to; and entities as containers.

An entity is a named piece of a type, both by number: an Ion value, or bytes for media. Tables of a file come
from its bytes as binaryFile gives them; a file that can't be read gives one row that carries the error.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import ion

# Fields of a container's facts, and the types of entities that hold bytes.
ID, COMPRESSION, PROTECTION, CHUNK, INDEX_AT, INDEX_SIZE, SYMBOLS_AT, SYMBOLS_SIZE = 409, 410, 411, 412, 413, 414, 415, 416
RAW = (417, 418)
# What the types of entities are called.
TYPES = {145: "content", 157: "style", 164: "external_resource", 258: "metadata", 259: "storyline", 260: "section", 262: "font", 264: "position_map", 265: "position_id_map", 266: "anchor", 389: "book_navigation", 417: "raw_media", 418: "raw_font", 419: "container_entity_map", 490: "book_metadata", 538: "document_data", 550: "location_map", 585: "content_features", 593: "format_capabilities", 597: "auxiliary_data"}
SCHEMAS = {
    "containers": "path string, container string, entities int, bytes bigint, error string",
    "entities": "path string, ord int, id bigint, type bigint, kind string, size bigint, value string, error string",
    "references": "path string, id bigint, target bigint, error string",
}
_HEAD = struct.Struct("<4sHIII")
_ENTITY = struct.Struct("<4sHI")
_ROW = struct.Struct("<IIQQ")


class Container:
    """One container, opened: facts and (id, type, bytes of the entity) in their order."""

    def __init__(self, raw: bytes):
        if len(raw) < _HEAD.size or raw[:4] != b"CONT":
            raise ValueError("no KFX container")
        _, self.version, length, at, size = _HEAD.unpack_from(raw)
        found = ion.loads(raw[at : at + size])
        if not found or not isinstance(found[0], ion.Struct):
            raise ValueError("container without facts")
        self.facts = found[0]
        if self.facts.get(PROTECTION):
            raise ValueError("protected container")
        at, size = self.facts.get(INDEX_AT, 0), self.facts.get(INDEX_SIZE, 0)
        self.entities = []
        for i in range(at, at + size - size % _ROW.size, _ROW.size):
            number, kind, offset, n = _ROW.unpack_from(raw, i)
            whole = raw[length + offset : length + offset + n]
            if whole[:4] != b"ENTY" or len(whole) != n:
                raise ValueError(f"entity {number} is cut off")
            head = _ENTITY.unpack_from(whole)[2]
            self.entities.append((number, kind, whole[head:]))

    def values(self) -> Iterator[tuple[int, int, object]]:
        """(id, type, value): the Ion value of each entity, or its bytes."""
        for number, kind, body in self.entities:
            if kind in RAW:
                yield number, kind, body
            else:
                found = ion.loads(body)
                yield number, kind, found[0] if found else None


def build_container(container_id: str, entities: list[tuple[int, int, object]]) -> bytes:
    """A container of (id, type, value); bytes are media, anything else is written as Ion."""
    head = ion.dumps(ion.Struct([(ion.Symbol(COMPRESSION), 0), (ion.Symbol(PROTECTION), 0)]))
    index, bodies, at = b"", b"", 0
    for number, kind, value in entities:
        body = _ENTITY.pack(b"ENTY", 1, _ENTITY.size + len(head)) + head + (value if isinstance(value, bytes) else ion.dumps(value))
        index += _ROW.pack(number, kind, at, len(body))
        bodies += body
        at += len(body)
    fields = [(ID, container_id), (COMPRESSION, 0), (PROTECTION, 0), (CHUNK, 4096), (INDEX_AT, _HEAD.size), (INDEX_SIZE, len(index))]
    facts = ion.dumps(ion.Struct([(ion.Symbol(k), v) for k, v in fields]))
    return _HEAD.pack(b"CONT", 2, _HEAD.size + len(index) + len(facts), _HEAD.size + len(index), len(facts)) + index + facts + bodies


def _symbols(value: object) -> Iterator[int]:
    if isinstance(value, ion.Symbol):
        yield value.number
    elif isinstance(value, ion.Annotated):
        yield from _symbols(value.value)
    elif isinstance(value, ion.Struct):
        for _, v in value:
            yield from _symbols(v)
    elif isinstance(value, list):
        for v in value:
            yield from _symbols(v)


def kfx_rows(path: str, raw: bytes, table: str) -> Iterator[tuple]:
    """The rows of one file for one table; of a broken file one row with the error."""
    width = SCHEMAS[table].count(", ") + 1 - 2
    try:
        c = Container(raw)
        if table == "containers":
            rows = [(c.facts.get(ID), len(c.entities), len(raw))]
        elif table == "entities":
            sizes = [len(body) for _, _, body in c.entities]
            rows = [(i, number, kind, TYPES.get(kind, f"${kind}"), sizes[i], None if isinstance(v, bytes) else json.dumps(ion.plain(v), ensure_ascii=False, sort_keys=True)) for i, (number, kind, v) in enumerate(c.values())]
        else:
            there = {number for number, _, _ in c.entities}
            rows = sorted({(number, s) for number, _, v in c.values() for s in _symbols(v) if s in there and s != number})
        for row in rows:
            yield (path, *row, None)
    except (ValueError, IndexError, struct.error, UnicodeDecodeError) as e:
        yield (path, *[None] * width, f"{type(e).__name__}: {e}")


def read_kfx(files: DataFrame, table: str) -> DataFrame:
    """One of the tables containers, entities or references of files(path, content)."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    fields = [f.split(" ") for f in SCHEMAS[table].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for r in kfx_rows(p, c or b"", table)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])

    return files.select("path", "content").mapInArrow(run, SCHEMAS[table])


def container_report(entities: DataFrame) -> DataFrame:
    """(path, kind, n, bytes): what a container holds by type."""
    return entities.where("error is null").groupBy("path", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def dependencies(references: DataFrame, entities: DataFrame) -> DataFrame:
    """(path, kind, target_kind, n): how many entities of a type refer to how many of another."""
    e = entities.where("error is null").select("path", "id", "kind")
    met = references.where("error is null").join(e, ["path", "id"]).join(e.select("path", F.col("id").alias("target"), F.col("kind").alias("target_kind")), ["path", "target"])
    return met.groupBy("path", "kind", "target_kind").agg(F.count("*").alias("n"))


def unreferenced(references: DataFrame, entities: DataFrame, roots: tuple[int, ...] = (258, 259, 260, 389, 490, 538, 419, 550, 264, 265, 585, 593)) -> DataFrame:
    """(path, id, kind): entities that nothing refers to and that aren't of a type that stands by itself."""
    e = entities.where("error is null")
    return e.where(~F.col("type").isin(*roots)).join(references.where("error is null").select("path", F.col("target").alias("id")).distinct(), ["path", "id"], "left_anti").select("path", "id", "kind")
