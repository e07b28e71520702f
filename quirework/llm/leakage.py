"""Evaluation texts leaking into training text, by latent semantic retrieval.

TF-IDF passages of the whole corpus give, by a distributed randomised SVD, a latent space.
Blocks of words of the documents and all stretches of as many words of the items are placed
there; blocks in the same direction as an item's stretch make that item a candidate, and the
candidate is verified on the whole texts by the longest common run of words.

A run of r common words holds a whole block of (r + 1) // 2 words, wherever it begins, and the
same words have the same place: no leak of r words or more is lost by the search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import spread, stored

TAG = re.compile(r"<[^>]*>")
WORD = re.compile(r"[^\W_]+")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e01ef]")


@dataclass(frozen=True)
class Settings:
    """min_run: common words of a leak. features: slots to which words are hashed. rank: axes of
    the latent space. passage: words of a TF-IDF passage. cosine: least cosine of a candidate.
    length: least ratio of the lengths of a block and its candidate. items: most items, with all
    their stretches, that are sent to the tasks at once. added: most partial sums added in one task."""

    min_run: int = 13
    features: int = 1 << 14
    rank: int = 32
    passage: int = 26
    cosine: float = 0.98
    length: float = 0.995
    items: int = 20_000
    added: int = 256

    @property
    def block(self) -> int:
        return (self.min_run + 1) // 2


def words_of(text: str | None) -> list[str]:
    """A text's words, regardless of case, punctuation, spacing, tags and invisible characters."""
    return WORD.findall(TAG.sub(" ", INVISIBLE.sub("", text or "")).lower())


class Hashes(dict):
    """32-bit hashes of words, kept up to a bound; runs of words are compared by many of them."""

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h
        return h


def hashed(text: str | None, hashes: Hashes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(hashes.__getitem__, words), np.uint32, len(words))


def tokenised(texts: DataFrame) -> DataFrame:
    """(doc_id, words) of texts(doc_id, text): the hashes of the words, once for all passes that need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([hashed(x, hashes).tobytes() for x in b.column("text").to_pylist()], pa.binary())], ["doc_id", "words"])

    return stored(spread(texts.select("doc_id", "text").where("text <> ''")).mapInArrow(run, "doc_id bigint, words binary"), "words")


def _words(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in b.column("words").to_pylist()]


def _slots(h: np.ndarray, s: Settings) -> np.ndarray:
    return (h % np.uint32(s.features)).astype(np.int64)


def inverse_frequency(words: DataFrame, s: Settings) -> np.ndarray:
    """Weight of each slot by the number of texts that hold it; counted in the tasks, one row a slot at the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(s.features, np.int64), 0
        for b in batches:
            for h in _words(b):
                seen[np.unique(_slots(h, s))] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], ["slot", "n"])

    counts = np.zeros(s.features + 1)
    for row in words.select("words").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[row["slot"]] = row["n"]
    return np.log1p(max(counts[-1], 1.0) / np.maximum(counts[:-1], 1.0))


def _blocks(h: np.ndarray, width: int, stride: int) -> np.ndarray:
    """Rows of width words, one every stride words."""
    if len(h) < width:
        return np.empty((0, width), h.dtype)
    return np.lib.stride_tricks.sliding_window_view(h, width)[::stride]


def _passage_sums(docs: list[np.ndarray], drawn: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(slots, sums) of some documents: the words' slots, and for each word the projections, added up, of
    the passages that hold it. Passages begin at every half of their length; what is left over at the
    end of a text is in the last one that fits, a shorter text is one passage."""
    half = s.passage // 2
    at = np.concatenate([_slots(h, s) for h in docs])
    sizes = np.array([len(h) for h in docs])
    ends = np.cumsum(sizes)
    first = ends - sizes
    sums = np.zeros((len(at) + 1, drawn.shape[1]))
    np.cumsum(drawn[at], axis=0, out=sums[1:])
    n = np.maximum((sizes - s.passage) // half + 1, 1)
    doc = np.repeat(np.arange(len(docs)), n)
    begin = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * half
    stop = np.minimum(begin + s.passage, ends[doc])
    projected = sums[stop] - sums[begin]
    change = np.zeros((len(at) + 1, drawn.shape[1]))
    np.add.at(change, begin, projected)
    np.add.at(change, stop, -projected)
    return at, np.cumsum(change[:-1], axis=0)


def latent_axes(words: DataFrame, weight: np.ndarray, s: Settings, parts: int = 16) -> np.ndarray:
    """(features, rank): the first right singular vectors of the corpus's TF-IDF passages.

    Each task multiplies its passages A with a random matrix and adds up A'(A R); the sums, of
    features x rank numbers whatever the corpus, are added in blocks of rows and, level by level, at
    most s.added of them in a task; the driver takes the singular vectors out of them (Nystroem).
    """
    random = np.random.default_rng(7).standard_normal((s.features, s.rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((s.features, s.rank))
        drawn = random * weight[:, None]

        def add(docs: list[np.ndarray]) -> None:
            slots, sums = _passage_sums(docs, drawn, s)
            order = np.argsort(slots, kind="stable")
            slots = slots[order]
            first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
            total[slots[first]] += np.add.reduceat(sums[order], first, axis=0)

        for b in batches:
            docs, n = [], 0
            for h in _words(b):
                if len(h):
                    docs.append(h)
                    n += len(h)
                if n > 1 << 16:
                    add(docs)
                    docs, n = [], 0
            if docs:
                add(docs)
        total *= weight[:, None]
        task = TaskContext.get().partitionId()
        pieces = np.array_split(total, parts)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([task] * parts, pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in pieces], pa.binary())], ["part", "task", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(rows["sums"].iloc[0]) // 4)
        for x in rows["sums"]:
            out += np.frombuffer(x, np.float32)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "task": [rows["task"].iloc[0]], "sums": [out.astype(np.float32).tobytes()]})

    partial, left = words.select("words").mapInArrow(run, "part int, task int, sums binary"), words.rdd.getNumPartitions()
    while left > 1:
        partial = partial.withColumn("task", (F.col("task") / s.added).cast("int")).groupBy("part", "task").applyInPandas(add, "part int, task int, sums binary")
        left = -(-left // s.added)
    summed = {r["part"]: np.frombuffer(r["sums"], np.float32) for r in partial.collect()}
    if not summed:
        return np.zeros((s.features, s.rank))
    z = np.concatenate([summed[i] for i in range(parts)]).reshape(s.features, s.rank).astype(np.float64)
    core = random.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 1e-12) * 1e-9
    u, _, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u


def _placed(rows: np.ndarray, loads: np.ndarray, s: Settings) -> np.ndarray:
    """Places of blocks: sums of their words' loads, always added in the same order."""
    out = np.zeros((len(rows), loads.shape[1]), loads.dtype)
    at = _slots(rows, s)
    for j in range(rows.shape[1]):
        out += loads[at[:, j]]
    return out


class Items:
    """All stretches of the items in the latent space, sorted by length, and their runs."""

    def __init__(self, ids: list[int], texts: list[str | None], loads: np.ndarray, s: Settings):
        hashes, rows, owner, self.runs, self.ids = Hashes(), [], [], [], ids
        for i, text in enumerate(texts):
            h = hashed(text, hashes)
            stretches = _blocks(h, s.block, 1)
            rows.append(stretches)
            owner.append(np.full(len(stretches), i))
            self.runs.append(np.unique(run_hashes(h, s.min_run)))
        rows = np.concatenate(rows) if rows else np.empty((0, s.block), np.uint32)
        places = _placed(rows, loads, s)
        norms = np.linalg.norm(places, axis=1)
        order = np.argsort(norms, kind="stable")
        self.norms, self.owner = norms[order], np.concatenate(owner)[order] if owner else np.empty(0, np.int64)
        self.units = places[order] / np.maximum(self.norms, 1e-12)[:, None]

    def candidates(self, places: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) whose cosine is high enough and whose lengths are close enough."""
        norms = np.linalg.norm(places, axis=1)
        low, high = np.searchsorted(self.norms, norms * s.length), np.searchsorted(self.norms, norms / s.length, "right")
        units = places / np.maximum(norms, 1e-12)[:, None]
        found_row, found_item = [], []
        order = np.argsort(low, kind="stable")
        for i in range(0, len(order), 512):
            rows = order[i : i + 512]
            a, b = low[rows].min(), high[rows].max()
            if b > a:
                r, c = np.nonzero(units[rows] @ self.units[a:b].T >= s.cosine)
                found_row.append(rows[r])
                found_item.append(self.owner[a + c])
        none = np.empty(0, np.int64)
        return (np.concatenate(found_row), np.concatenate(found_item)) if found_row else (none, none)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        h = (h.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        for j in range(n):
            out = out * np.uint64(0x165667B19E3779F9) + h[j : len(h) - n + 1 + j]
    return out


def latent_space(documents: DataFrame, s: Settings) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(words, weights, loads): the tokenised documents, each slot's weight and its place in the latent space."""
    words = tokenised(documents)
    weight = inverse_frequency(words, s)
    return words, weight, (latent_axes(words, weight, s) * weight[:, None]).astype(np.float32)


def find_leaks(documents: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id): the documents and items with at least min_run consecutive words in common.

    documents(doc_id, text), items(item_id, text). Null and short texts leak nothing; repeated
    rows count each. Items are read by the driver and sent to the tasks in groups of at most
    s.items; each group is one pass over the documents, without a shuffle. The latent space
    and the weights are of fixed size, the documents' counts in them are of all documents.
    """
    spark = documents.sparkSession
    words, weight, loads = latent_space(documents, s)
    listed = items.select("item_id", "text").where("text <> ''").orderBy("item_id", "text")
    found = None
    for group in _groups(listed, s.items):
        sent = spark.sparkContext.broadcast((loads, [r["item_id"] for r in group], [r["text"] for r in group]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            loads, ids, texts = sent.value
            stretches = Items(ids, texts, loads, s)
            for b in batches:
                whole = _words(b)
                blocks = [_blocks(h, s.block, s.block) for h in whole]
                doc = np.repeat(np.arange(len(whole)), [len(x) for x in blocks])
                rows = np.concatenate(blocks) if blocks else np.empty((0, s.block), np.uint32)
                row, item = stretches.candidates(_placed(rows, loads, s), s)
                pairs = np.unique(np.stack([doc[row], item], axis=1), axis=0) if len(row) else np.empty((0, 2), np.int64)
                keep, runs, at = [], None, -1
                for d, i in pairs:
                    if d != at:
                        runs, at = np.unique(run_hashes(whole[d], s.min_run)), d
                    if len(np.intersect1d(runs, stretches.runs[i], assume_unique=True)):
                        keep.append((d, i))
                docs = b.column("doc_id").take(pa.array([d for d, _ in keep], pa.int64()))
                yield pa.RecordBatch.from_arrays([docs, pa.array([ids[i] for _, i in keep], pa.int64())], ["doc_id", "item_id"])

        part = words.mapInArrow(run, "doc_id bigint, item_id bigint")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "doc_id bigint, item_id bigint")


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one row of the table at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        new = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def _windows(h: np.ndarray, width: int, stride: int) -> np.ndarray:
    """Rows of width words, one every stride words and one at the end; a shorter text is one row, filled up with zeros."""
    if len(h) < width:
        return np.concatenate([h, np.zeros(width - len(h), h.dtype)])[None, :] if len(h) else np.empty((0, width), h.dtype)
    rows = np.lib.stride_tricks.sliding_window_view(h, width)
    return rows[np.unique(np.append(np.arange(0, len(rows), stride), len(rows) - 1))]


def find_paraphrases(documents: DataFrame, items: DataFrame, s: Settings = Settings(), cosine: float = 0.85, share: float = 0.6, answers: int = 3) -> DataFrame:
    """(doc_id, item_id, share): documents in which an item's passage stands, word for word or in other words.

    Passages of the documents, cut at every half of their length, and all stretches of as many words
    of the items are compared in the latent space; of a candidate, most of the answers (the rarest
    words of the item's stretch) have to be in the document's passage, and the longest common
    subsequence has to be that share of the longer passage. The share is the best of a document and
    item; that of exact leaks, which find_leaks finds, is 1. Texts shorter than a passage are one
    passage; null and empty ones give no row. A passage of an item that is reworded over 38 words or
    more holds a whole passage of the document, wherever it begins."""
    spark = documents.sparkSession
    words, weight, loads = latent_space(documents, s)
    listed = items.select("item_id", "text").where("text <> ''").orderBy("item_id", "text")
    schema = "doc_id bigint, item_id bigint, share double"
    found = None
    for group in _groups(listed, s.items):
        sent = spark.sparkContext.broadcast((loads, weight, [r["item_id"] for r in group], [r["text"] for r in group]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            loads, weight, ids, texts = sent.value
            hashes, exact = Hashes(), Items(sent.value[2], sent.value[3], loads, s)
            own = [_windows(hashed(x, hashes), s.passage, 1) for x in texts]
            owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
            asked = np.concatenate(own) if own else np.empty((0, s.passage), np.uint32)

            def place(rows: np.ndarray) -> np.ndarray:
                at = np.where(rows == 0, s.features, _slots(rows, s))
                p = np.zeros((len(rows), loads.shape[1]), np.float32)
                padded = np.concatenate([loads, np.zeros((1, loads.shape[1]), np.float32)])
                for j in range(rows.shape[1]):
                    p += padded[at[:, j]]
                return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)

            units = place(asked)
            rare = np.where(asked == 0, -1.0, weight[_slots(asked, s)])
            told = np.take_along_axis(asked, np.argsort(-rare, axis=1, kind="stable")[:, :answers], axis=1)
            for b in batches:
                out = []
                for doc, h in zip(b.column("doc_id").to_pylist(), _words(b), strict=True):
                    best: dict[int, float] = {}
                    runs = np.unique(run_hashes(h, s.min_run))
                    rows = _windows(h, s.passage, s.passage // 2)
                    if len(rows) and len(asked):
                        r, c = np.nonzero(place(rows) @ units.T >= cosine)
                        there = (told[c][:, :, None] == rows[r][:, None, :]).any(axis=2).sum(axis=1) * 2 > answers
                        for i, k in zip(r[there], c[there], strict=True):
                            if best.get(owner[k], 0.0) < 1.0:
                                x, y = rows[i][rows[i] != 0], asked[k][asked[k] != 0]
                                best[owner[k]] = max(best.get(owner[k], 0.0), common_subsequence(x, y) / max(len(x), len(y)))
                    if len(runs):
                        whole = _blocks(h, s.block, s.block)
                        _, near = exact.candidates(_placed(whole, loads, s), s)
                        best |= {i: 1.0 for i in set(near.tolist()) if len(np.intersect1d(runs, exact.runs[i], assume_unique=True))}
                    out += [(doc, ids[i], n) for i, n in best.items() if n >= share]
                cols = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "share"])

        part = words.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def _groups(rows: DataFrame, size: int) -> Iterator[list]:
    group: list = []
    for row in rows.toLocalIterator():
        group.append(row)
        if len(group) == size:
            yield group
            group = []
    if group:
        yield group
