"""Several values packed in one field, split into one value per row with its position.

A multi-pattern automaton finds the known whole values in an element; dynamic programming
picks the cheapest cover of the element by known values, quoted values, free text and
delimiters, so that a delimiter inside a known, quoted or escaped value splits nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELIMITERS = ";,|/·•、；\t\n"
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}
KNOWN_COST, QUOTED_COST, FREE_COST = 1, 1, 2
#: Most known values of which an automaton is built and sent to the tasks; beyond it the
#: known values of an element are found by a join.
DICTIONARY_LIMIT = 200_000


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, len(term))
    if terms:
        found.make_automaton()
    return found


def known_spans(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int]]:
    return [(end + 1 - n, end + 1) for end, n in words.iter(text)] if len(words) else []


def _quoted(text: str, at: int) -> tuple[int, str] | None:
    """End and content of the quoted value that starts at a position: quotes inside are doubled or escaped."""
    close, out, i = QUOTES[text[at]], [], at + 1
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text) and text[i + 1] in '"\\' + close:
            out.append(text[i + 1])
            i += 2
        elif text[i] == close:
            if text[i + 1 : i + 2] == close:
                out.append(close)
                i += 2
                continue
            return i + 1, "".join(out)
        else:
            out.append(text[i])
            i += 1
    return None


def _free(text: str, at: int) -> tuple[int, str]:
    """End and content of free text: up to the next delimiter that isn't escaped."""
    out, i = [], at
    while i < len(text) and text[i] not in DELIMITERS:
        if text[i] == "\\" and i + 1 < len(text) and (text[i + 1] in DELIMITERS or text[i + 1] in '"\\'):
            i += 1
        out.append(text[i])
        i += 1
    return i, "".join(out)


def segment(element: str | None, spans: list[tuple[int, int]]) -> list[str]:
    """The values of one element. spans: where known values stand in it.

    Null, empty and delimiter-only elements hold no value. Of equally cheap covers the one
    with the longest first value counts.
    """
    if element is None or not element.strip():
        return []
    text = element.strip()
    if text[0] == "[" and text[-1] == "]":
        try:
            listed = json.loads(text)
        except ValueError:
            listed = None
        if isinstance(listed, list) and all(isinstance(x, str) for x in listed):
            return [x.strip() for x in listed if x.strip()]
    text, n = element, len(element)
    at_start: dict[int, list[int]] = {}
    for start, end in spans:
        at_start.setdefault(start, []).append(end)

    def edge(i: int) -> int | None:
        """Where the next value may start if one ends at i."""
        while i < n and text[i].isspace() and text[i] not in DELIMITERS:
            i += 1
        return i if i == n or text[i] in DELIMITERS else None

    best: list[tuple[float, int, str | None, int] | None] = [None] * (n + 1)  # cost, -length, value, next
    best[n] = (0, 0, None, n)
    for i in range(n - 1, -1, -1):
        if not (i == 0 or text[i - 1] in DELIMITERS):
            continue
        j = i
        while j < n and (text[j].isspace() or text[j] in DELIMITERS):
            if text[j] in DELIMITERS and best[j + 1] is not None:
                break
            j += 1
        options = []
        if j == n:
            options.append((0, 0, None, n))
        elif text[j] in DELIMITERS:
            options.append((best[j + 1][0], 0, None, j + 1))
        else:
            pieces = [(end, text[j:end], KNOWN_COST) for end in at_start.get(j, ())]
            if text[j] in QUOTES and (got := _quoted(text, j)):
                pieces.append((*got, QUOTED_COST))
            pieces.append((*_free(text, j), FREE_COST))
            for end, value, cost in pieces:
                stop = edge(end)
                if stop is not None:
                    after = best[stop + 1] if stop < n else best[n]
                    options.append((cost + after[0], j - end, value.strip() or None, stop + (stop < n)))
        best[i] = min(options, key=lambda x: x[:2])
    values, i = [], 0
    while i < n:
        _, _, value, i = best[i]
        if value:
            values.append(value)
    return values


def unpack(records: DataFrame, dictionary: DataFrame, limit: int = DICTIONARY_LIMIT) -> DataFrame:
    """(src, record_id, pos, subject): the values of each record that packs several into one element.

    records(src, record_id, subjects ARRAY<STRING>), dictionary(term). pos counts from 1 across
    all elements of a record in order. Records of which no element holds two values give no
    rows, as do null and empty lists; null terms and elements are passed over; other columns
    are ignored. Rows count on their own, repeated ones too. A dictionary of up to limit terms
    goes to the tasks as an automaton; a larger one is joined with what stands between
    delimiters, which finds the same spans.
    """
    terms = dictionary.select("term").where("term is not null and trim(term) <> ''").distinct()
    few = [r[0] for r in terms.limit(limit + 1).collect()]
    need = records.where(F.size("subjects") > 0).select("src", "record_id", "subjects")
    if len(few) <= limit:
        return _segmented(need.withColumn("known", F.lit(None).cast("array<array<struct<a:int,b:int>>>")), few)
    one = need.withColumn("row", F.monotonically_increasing_id())
    spans = _candidates(one).join(terms, "term").groupBy("row", "element").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    packed = spans.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("element", "spans"))).alias("by_element"))
    known = F.transform(F.sequence(F.lit(0), F.size("subjects") - 1), lambda i: F.coalesce(F.col("by_element")[i], F.array().cast("array<struct<a:int,b:int>>")))
    return _segmented(one.join(packed, "row", "left").select("src", "record_id", "subjects", known.alias("known")), None)


def _candidates(one: DataFrame) -> DataFrame:
    """(row, element, term, a, b): every stretch of an element from one delimiter to a later one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, elements in zip(batch.column("row").to_pylist(), batch.column("subjects").to_pylist(), strict=True):
                for k, text in enumerate(elements):
                    text = text or ""
                    cuts = [-1, *(i for i, c in enumerate(text) if c in DELIMITERS), len(text)]
                    for x, left in enumerate(cuts):
                        for right in cuts[x + 1 :]:
                            piece = text[left + 1 : right]
                            if term := piece.strip():
                                a = left + 1 + len(piece) - len(piece.lstrip())
                                out.append((row, k, term, a, a + len(term)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["row", "element", "term", "a", "b"])

    return one.select("row", "subjects").mapInArrow(run, "row bigint, element int, term string, a int, b int")


def _segmented(records: DataFrame, terms: list[str] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton(terms or [])
        for batch in batches:
            out: list[tuple] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("src", "record_id", "subjects", "known")), strict=True)
            for src, record, elements, known in rows:
                each = [segment(x, known_spans(x or "", words) if known is None else [(s["a"], s["b"]) for s in known[i]]) for i, x in enumerate(elements)]
                if any(len(x) > 1 for x in each):
                    out += [(src, record, pos, value) for pos, value in enumerate((v for x in each for v in x), 1)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["src", "record_id", "pos", "subject"])

    return records.select("src", "record_id", "subjects", "known").mapInArrow(run, "src string, record_id bigint, pos int, subject string")


def subject_records(books: DataFrame, headers: DataFrame) -> DataFrame:
    one = lambda df, src: df.select(F.lit(src).alias("src"), "record_id", "subjects")
    return one(books, "books").unionByName(one(headers, "exth_headers"))
