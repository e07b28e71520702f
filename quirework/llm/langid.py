"""The language of every document and of each of its mixed-language segments.

Cross-parsing entropy: a suffix automaton of labelled text per language yields the longest
matches of a sentence, and with them into how few phrases the language can cut it. Phrases are
charged by the bits that name one in the language's text; the cheapest path through the
languages of a document's sentences, with a charge for each change, gives the segments.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import spread

LANGUAGES = ("en", "fr", "de", "es", "it", "pt", "nl", "pl", "ru")
# The codes and English names of the languages.
LABELS = {
    name: line.split()[0]
    for line in """
en eng english
fr fra fre french
de deu ger german
es spa spanish castilian
it ita italian
pt por portuguese
nl nld dut dutch flemish
pl pol polish
ru rus russian
""".split("\n")
    for name in line.split()
}


@dataclass(frozen=True)
class Settings:
    """texts, chars: labelled texts of a language, lowest by hash, and characters of them, from
    which its automaton is built: the bound of the sample. change: bits that a change of
    language costs. piece: characters that are scored at a time."""

    texts: int = 160
    chars: int = 24_000
    change: float = 50.0
    piece: int = 240


_BLOCK = re.compile(r"</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|section|blockquote|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_STOP = re.compile(r"(?<=[.!?…])[\"'”’»“)\]]*\s+|\n+|(?<=[.!?…])[”»\"]+(?=\S)")
_NO_WORD = re.compile(r"[/\\@\d]|\w\.\w")
_NOT_LETTER = re.compile(r"[^\w']+|[\d_]+")


def label_language(label: Column) -> Column:
    """The language that a label names, in any case and with any region; null if it names none of them."""
    names = F.create_map(*[F.lit(x) for pair in sorted(LABELS.items()) for x in pair])
    return names[F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)", 1)]


def sentences(text: str) -> list[str]:
    """The sentences of a text: cut at stops, line ends and block tags. Paths, addresses and
    numbers are no words of a language; what has no letters besides is no sentence."""
    if "<" in text:
        text = _TAG.sub(" ", _BLOCK.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    return [y for x in _STOP.split(text) if x and any(map(str.isalpha, y := _words_only(x)))]


def _words_only(text: str) -> str:
    return " ".join([w for w in text.split() if not _NO_WORD.search(w)]) if _NO_WORD.search(text) else text


def letters(text: str, neutral: frozenset[str] = frozenset()) -> str:
    """What is compared of a sentence: its words in lower case between single spaces, without those that tell no language."""
    return " " + "".join([x + " " for x in _NOT_LETTER.sub(" ", text.lower()).split() if x not in neutral])


def neutral_words(texts: dict[str, list[list[str]]], languages: int = 4, length: int = 4, share: float = 0.4) -> frozenset[str]:
    """Words of some length that the texts of several languages share evenly: names, most of them."""
    by: dict[str, list[int]] = {}
    for own in texts.values():
        held = Counter(w for t in own for w in {w for y in t for w in y.split() if len(w) >= length})
        for w, n in held.items():
            by.setdefault(w, []).append(n)
    return frozenset(w for w, ns in by.items() if len(ns) >= languages and max(ns) <= share * sum(ns))


class Automaton:
    """The suffix automaton of a text as one dense table; state 0 is the start, and 0 elsewhere means no way on."""

    def __init__(self, text: str):
        self.symbols = {c: i + 1 for i, c in enumerate(sorted(set(text)))}
        self.width = len(self.symbols) + 1
        link, length, ways = [-1], [0], [{}]
        last = 0
        for c in text:
            here = len(ways)
            ways.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in ways[p]:
                ways[p][c] = here
                p = link[p]
            if p != -1:
                q = ways[p][c]
                if length[p] + 1 == length[q]:
                    link[here] = q
                else:
                    clone = len(ways)
                    ways.append(dict(ways[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and ways[p].get(c) == q:
                        ways[p][c] = clone
                        p = link[p]
                    link[q] = link[here] = clone
            last = here
        self.table = np.zeros(len(ways) * self.width, np.int32)
        for state, out in enumerate(ways):
            for c, to in out.items():
                self.table[state * self.width + self.symbols[c]] = to
        self.bits = math.log2(max(len(text), 2))

    def phrases(self, codes: np.ndarray, lengths: np.ndarray, translate: np.ndarray) -> np.ndarray:
        """Phrases of each row of codes (rows by descending length): as many as the longest matches that cover it."""
        symbols = translate[codes.T]
        state = np.zeros(len(codes), np.int64)
        count = np.ones(len(codes), np.int64)
        active = np.searchsorted(-lengths, -np.arange(1, codes.shape[1] + 1), "right")
        for t, n in enumerate(active):
            if n == 0:
                break
            s = symbols[t, :n]
            to = self.table[state[:n] * self.width + s]
            missed = to == 0
            count[:n] += missed & (state[:n] > 0) | missed & (s == 0)
            state[:n] = np.where(missed, self.table[s], to)
        return count


class Model:
    neutral: frozenset[str] = frozenset()

    def __init__(self, languages: list[str], texts: tuple[str, ...]):
        self.languages, self.texts, self.automata = languages, texts, [Automaton(x) for x in texts]
        chars = sorted(set().union(*[a.symbols for a in self.automata]))
        self.translate = [np.array([0] + [a.symbols.get(c, 0) for c in chars], np.int32) for a in self.automata]
        self.code = np.zeros(0x10000, np.int32)
        for i, c in enumerate(chars):
            if ord(c) < 0x10000:
                self.code[ord(c)] = i + 1

    def bits(self, texts: list[str], piece: int) -> np.ndarray:
        """(texts, languages): what each text costs in each language."""
        parts, owner = [], []
        for i, x in enumerate(texts):
            for k in range(0, max(len(x), 1), piece):
                parts.append(x[k : k + piece])
                owner.append(i)
        out = np.zeros((len(texts), len(self.languages)))
        if not parts:
            return out
        sizes = np.array([len(p) for p in parts])
        order = np.argsort(-sizes, kind="stable")
        own = np.array(owner)
        for start in range(0, len(parts), 8192):
            rows = order[start : start + 8192]
            lengths = sizes[rows]
            codes = np.zeros((len(rows), max(int(lengths[0]), 1)), np.int32)
            raw = np.frombuffer("".join(parts[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
            filled = np.arange(codes.shape[1])[None, :] < lengths[:, None]
            codes[filled] = self.code[np.minimum(raw, 0xFFFF)]
            for k, (a, tr) in enumerate(zip(self.automata, self.translate, strict=True)):
                np.add.at(out[:, k], own[rows], a.phrases(codes, lengths, tr) * a.bits)
        return out


def cheapest_path(bits: np.ndarray, change: float) -> np.ndarray:
    """The language of each sentence on the cheapest way through a document."""
    n, k = bits.shape
    cost, back = bits[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        best = int(cost.argmin())
        moved = cost[best] + change < cost
        back[i] = np.where(moved, best, np.arange(k))
        cost = np.where(moved, cost[best] + change, cost) + bits[i]
    path = np.zeros(n, np.int64)
    path[-1] = cost.argmin()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def labelled_sample(documents: DataFrame, s: Settings) -> dict[str, list[str]]:
    """Labelled texts by language, s.texts of each at most: those lowest by the hash of text and id.

    The group limit is taken in each task before the shuffle, so a language of most rows is no burden.
    """
    known = documents.select(label_language(F.col("lang")).alias("language"), "text", F.xxhash64("text", "doc_id").alias("h")).where("language is not null and text <> ''")
    ranked = known.withColumn("at", F.row_number().over(Window.partitionBy("language").orderBy("h", "text"))).where(F.col("at") <= s.texts)
    found: dict[str, list[str]] = {}
    for row in ranked.orderBy("language", "at").collect():
        found.setdefault(row["language"], []).append(row["text"])
    return found


def train(sample: dict[str, list[str]], s: Settings) -> Model:
    """A model of a sample some of whose labels are wrong and some of whose texts mix languages.

    Each half of the sample is judged, sentence by sentence, by a model of the other half; only
    sentences placed in their label's language make the model that is returned.
    """
    languages = [x for x in LANGUAGES if sample.get(x)]
    split = {x: [sentences(t) for t in sample[x]] for x in languages}
    neutral = neutral_words({x: [[letters(y) for y in t] for t in own] for x, own in split.items()})
    plain = {x: [[letters(y, neutral) for y in t] for t in own] for x, own in split.items()}
    halves = [{x: [y for t in plain[x][h::2] for y in t] or [y for t in plain[x] for y in t] for x in languages} for h in (0, 1)]
    models = [Model(languages, tuple("".join(half[x])[: s.chars // 2] for x in languages)) for half in halves]
    kept: dict[str, list[str]] = {x: [] for x in languages}
    for half, judge in zip(halves, reversed(models), strict=True):
        for k, x in enumerate(languages):
            placed = judge.bits(half[x], s.piece).argmin(axis=1) if half[x] else []
            kept[x] += [y for y, at in zip(half[x], placed, strict=True) if at == k]
    model = Model(languages, tuple("".join(kept[x] or plain[x][0])[: s.chars] for x in languages))
    model.neutral = neutral
    return model


def segment_languages(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, sentences, languages, label) of documents(doc_id, text, lang).

    One row per longest run of sentences in one language, counted from 1; languages is how many
    the document has. confidence is the share of the costlier best rival that the segment's
    language saves. Null, empty and letterless texts give no row; repeated rows count each.
    With no labelled text at all there is no row. label is the language that the document's own
    label names; labels tell nothing but what the model is trained on. One pass, no shuffle.
    """
    sample = labelled_sample(documents, s)
    schema = "doc_id bigint, seg_no int, lang string, confidence double, sentences int, languages int, label string"
    if not sample:
        return documents.sparkSession.createDataFrame([], schema)
    model = train(sample, s)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            each = [[letters(y, model.neutral) for y in sentences(x or "")] for x in b.column("text").to_pylist()]
            bits = model.bits([y for x in each for y in x], s.piece)
            out, at = [], 0
            for doc, label, parts in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), each, strict=True):
                own = bits[at : at + len(parts)]
                at += len(parts)
                if len(parts):
                    out += [(doc, *x, label) for x in _segments(own, model.languages, s.change)]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["doc_id", "seg_no", "lang", "confidence", "sentences", "languages", "label"])

    return spread(documents.select("doc_id", "text", label_language(F.col("lang")).alias("label")).where("text <> ''")).mapInArrow(run, schema)


def _segments(bits: np.ndarray, languages: list[str], change: float) -> list[tuple]:
    best = bits.argmin(axis=1)
    if (best == best[0]).all():  # then no other way is cheaper anywhere
        total = bits.sum(axis=0)
        rival = np.partition(total, 1)[1] if len(total) > 1 else total[0]
        return [(1, languages[best[0]], float(max(0.0, 1 - total[best[0]] / rival)) if rival else 0.0, len(bits), 1)]
    path = cheapest_path(bits, change)
    starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    out = []
    for no, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(path)), strict=True), 1):
        total = bits[a:b].sum(axis=0)
        own = total[path[a]]
        rival = np.delete(total, path[a]).min() if len(total) > 1 else own
        out.append((no, languages[path[a]], float(max(0.0, 1 - own / rival)) if rival else 0.0, int(b - a), len(set(path.tolist()))))
    return out


def mislabelled(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The segments of documents whose label is missing, meaningless or another language's, or that mix languages."""
    wrong = (F.col("languages") > 1) | ~F.col("label").eqNullSafe(F.col("lang"))
    return segment_languages(documents, s).where(wrong).select("doc_id", "seg_no", "lang", "confidence")
