"""Encoding of a corpus with a byte-level BPE vocabulary, in Spark's own expressions.

Each distinct word is cut into its bytes, and a higher-order fold merges the adjacent pair of
lowest rank, over and over. Ranks come from a literal map, spread over a literal array so that
a look-up scans a few entries; a byte is written as the character of the same number. Words
are encoded once however often they occur: the commonest go into a literal map as well, the
others are joined.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.session import spread, stored

# Fixed value: how the vocabulary's texts are cut into words; (?U) gives \s its Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Slots of a literal map, words in that of the commonest words, bytes up to which a word is
#: folded (a fold takes the square of a word's length; longer words are merged through a heap).
SLOTS, COMMON, FOLDED = 8192, 8192, 96


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Byte sequence to rank, which is the token's id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def _literal(value: object, kind: str) -> Column:
    """A literal of a nested type: constant folding turns the parsed text into one."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _slotted(entries: dict[str, object], kind: str) -> Column:
    """A literal array of maps; an entry is in the map at its key's CRC-32."""
    maps: list[dict] = [{} for _ in range(SLOTS)]
    for key, value in entries.items():
        maps[crc32(key.encode("utf-8", "surrogatepass")) % SLOTS][key] = value
    return _literal(maps, f"array<map<string,{kind}>>")


def _look_up(table: Column, key: Column) -> Column:
    return F.try_element_at(F.get(table, (F.crc32(F.encode(key, "UTF-8")) % SLOTS).cast("int")), key)


def _with(value: Column, body) -> Column:
    """The body with a value bound to a name, so that it is in the plan once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_bytes(text: Column) -> Column:
    """A text's UTF-8 as a string of one character a byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def fold_ids(word: Column, table: Column) -> Column:
    """The ids of a word: the fold over its bytes, or at once where the word is a token."""

    rank = lambda x: _look_up(table, x)
    none = F.array().cast("array<int>")

    def merged(state: Column, at: Column) -> Column:
        """The state after the pair at a place is joined: only the ranks beside it are looked up again."""
        parts, ranks = state["parts"], state["ranks"]
        joined = F.concat(F.get(parts, at), F.get(parts, at + 1))

        def put(one: Column) -> Column:
            before = F.when(at > 0, F.array(rank(F.concat(F.get(parts, at - 1), one)))).otherwise(none)
            after = F.when(at + 2 < F.size(parts), F.array(rank(F.concat(one, F.get(parts, at + 2))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(parts, F.lit(1), at), F.array(one), F.slice(parts, at + 3, F.size(parts))).alias("parts"),
                F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 1, F.lit(0))), before, after, F.slice(ranks, at + 3, F.size(parts))).alias("ranks"),
            )

        return _with(joined, put)

    def step(state: Column) -> Column:
        least = F.array_min(state["ranks"])
        return F.when(least.isNull(), state).otherwise(merged(state, (F.array_position(state["ranks"], least) - 1).cast("int")))

    def start(parts: Column) -> Column:
        pairs = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: rank(F.concat(F.get(parts, i), F.get(parts, i + 1))))).otherwise(none)
        return F.struct(parts.alias("parts"), pairs.alias("ranks"))

    raw = as_bytes(word)
    whole = lambda b: _look_up(table, b)
    folded = lambda b: F.transform(F.aggregate(F.sequence(F.lit(1), F.length(b)), start(F.split(b, "")), lambda p, _: step(p), lambda p: p["parts"]), rank)
    return _with(raw, lambda b: F.when(whole(b).isNotNull(), F.array(whole(b))).otherwise(folded(b)))


def heap_ids(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same ids for a word of any length: pairs wait in a heap, pieces in a linked list."""
    if word in rank:
        return [rank[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(rank[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in rank]
    heapq.heapify(waiting)
    alive = [True] * n

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (r := rank.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(waiting, (r, i, end[end[i]]))

    while waiting:
        _, i, stop = heapq.heappop(waiting)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(rank[word[i : end[i]]])
        i = end[i]
    return out


def _long_ids(words: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for b in batches:
            ids = [heap_ids(w.encode(), table) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, ids array<int>")


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def word_table(texts: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) of every distinct word of texts(text)."""
    counted = texts.select(F.explode(split_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = stored(counted, "words")
    table = _slotted({k.decode("latin-1"): v for k, v in ranks(path).items()}, "int")
    short = words.where(F.octet_length("word") <= FOLDED).repartition(_parts(words)).select("word", "n", _with(table, lambda t: fold_ids(F.col("word"), t)).alias("ids"))
    return short.unionByName(_long_ids(words.where(F.octet_length("word") > FOLDED), path))


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def encode(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of each document of documents(doc_id, text), without special tokens.

    A null and an empty text both give the empty list. Rows count on their own, null and
    repeated ids too, as words are joined by the text's hash. path is on the driver's disk,
    and must be on the workers' for words of more than FOLDED bytes.
    """
    documents = spread(documents.select("doc_id", "text"))
    words = stored(word_table(documents, path), "encoded")
    first = words.orderBy(F.desc("n"), "word").limit(COMMON).collect()
    common = _slotted({r["word"]: r["ids"] for r in first}, "array<int>")
    placed = F.transform(split_words(F.col("text")), lambda w, i: F.struct(i.alias("at"), w.alias("word"), _look_up(common, w).alias("ids")))
    cut = documents.where(F.col("text") != "").select(F.md5("text").alias("h"), F.explode(F.filter(placed, lambda x: x["ids"].isNull())).alias("x"))
    rare = cut.select("h", F.col("x.at").alias("at"), F.col("x.word").alias("word")).join(words.select("word", "ids"), "word").groupBy("h").agg(F.collect_set(F.struct("at", "ids")).alias("rare"))
    joined = documents.withColumn("h", F.md5("text")).join(rare, "h", "left")
    known = F.transform(F.filter(placed, lambda x: x["ids"].isNotNull()), lambda x: F.struct(x["at"].alias("at"), x["ids"].alias("ids")))
    none = F.array().cast("array<struct<at:int,ids:array<int>>>")
    all_ids = F.flatten(F.transform(F.array_sort(F.concat(known, F.coalesce("rare", none))), lambda x: x["ids"]))
    return joined.select("doc_id", F.coalesce(all_ids, F.array().cast("array<int>")).alias("ids"))


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids): the pieces' bytes joined; an unknown id gives none."""
    table = ranks(path)
    pieces = [""] * (max(table.values()) + 1)
    for piece, i in table.items():
        pieces[i] = piece.decode("latin-1")
    text = _with(_literal(pieces, "array<string>"), lambda p: F.concat_ws("", F.transform("ids", lambda i: F.get(p, i))))
    return encoded.select("doc_id", F.decode(F.encode(text, "ISO-8859-1"), "UTF-8").alias("text"))
