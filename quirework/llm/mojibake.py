"""Text that was decoded with the wrong encoding, found and restored.

Words and short stretches that agree on all that is left without their non-ASCII characters are
near-twins. Aligned character by character, twins give mappings (what stands in the rarer form,
what in the commonest), and mappings the transformations that explain most of them: read with
one encoding, meant in another, of all pairs of the single-byte encodings there are, or UTF-8.
The learned transformations, and no others, are then applied to every cell; a restored cell must
be likelier than the cell as it stands, by how often its characters occur in such surroundings
over all cells. A header's declared encoding weighs in for the transformations that name it.
"""

from __future__ import annotations

import encodings.aliases
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import spread, stored

#: By how many nats a changed character, and in all, a single-byte reading must be likelier.
MARGIN, LEAST = 1.0, 2.0
#: How many UTF-8 sequences make a reading of a whole text in unknown characters.
SEQUENCES = 3
#: By how many nats the characters of a partial UTF-8 reading may be less likely, on average, than what stands there.
FALL = 4.0
#: Nats that a declared encoding is worth.
DECLARED = 1.0
#: ASCII letters that a twin's skeleton has at least; units of a stretch without such letters, of
#: which so many must be repeats.
LETTERS, UNITS, REPEATS = 3, 12, 3

RUN = re.compile(r"[^\x00-\x7f]+")
LOST = "�"
SPACE = r"[\x09-\x0d <>]+"
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_LETTERS = re.compile(r"[^\W\d_]+")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_SPLIT = re.compile(SPACE)
_ASCII_LETTER = re.compile(r"[A-Za-z]")
#: Code pages that a header names by number and Python by another name.
PAGES = {"utf8": "utf_8", "10000": "mac_roman", "28591": "latin_1", "28592": "iso8859_2", "28605": "iso8859_15", "20866": "koi8_r"}


@cache
def codecs() -> tuple[str, ...]:
    """Python's encodings that keep ASCII and have a byte for each of at least 64 other characters."""
    out = []
    for name in sorted(set(encodings.aliases.aliases.values())):
        try:
            if bytes(range(128)).decode(name) == bytes(range(128)).decode("ascii") and len(_upper(name)) >= 64:
                out.append(name)
        except (LookupError, UnicodeDecodeError, TypeError, AttributeError):
            continue
    return tuple(out)


@cache
def _upper(codec: str) -> dict[int, str]:
    """The characters of a single-byte encoding's upper half."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            continue
        if len(c) == 1:
            out[b] = c
    return out


@cache
def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte; of bytes without a character, the control of the same number, as lenient readers give."""
    table = {c: b for b, c in _upper(codec).items()}
    for b in range(0x80, 0xA0 if codec.startswith("cp125") else 0x80):
        table.setdefault(chr(b), b)
    for b in range(0x80, 0x100):
        if b not in _upper(codec):
            table.setdefault(chr(b), b)
    return table


@cache
def hypotheses() -> tuple[tuple[str, str], ...]:
    return tuple((r, "utf_8") for r in codecs()) + tuple((r, m) for r in codecs() for m in codecs() if m != r)


@cache
def _index() -> dict[tuple[str, str], int]:
    return {h: i for i, h in enumerate(hypotheses())}


def page(declared: str | None) -> str | None:
    """The encoding that a header's value (Cp1252, Utf8, Unknown(437)) names."""
    digits = re.sub(r"\D", "", declared or "")
    name = "utf_8" if (declared or "").lower() == "utf8" else PAGES.get(digits, f"cp{digits}")
    return name if name == "utf_8" or name in codecs() else None


def _as_utf8(text: str, codec: str) -> str | None:
    """Text whose runs are UTF-8 read with a codec, restored; None if no run is.

    What is left of a run must be punctuation: a letter left over speaks against the reading."""
    table, changed = _bytes_of(codec), False

    def run(m: re.Match) -> str:
        nonlocal changed
        chars = m.group()
        if any(c not in table for c in chars):
            parts = re.split("([" + re.escape("".join({c for c in chars if c not in table})) + "]+)", chars)
            return "".join(run(x) if (x := RUN.fullmatch(p)) and p[0] in table else p for p in parts)
        raw, out, at = bytes(table[c] for c in chars), [], 0
        for s in _UTF8.finditer(raw):
            try:
                good = s.group().decode()
            except UnicodeDecodeError:
                return chars
            out += [chars[at : s.start()], good]
            at = s.end()
        out.append(chars[at:])
        if any(c.isalpha() for c in "".join(out[::2])):
            return chars
        changed = changed or at > 0
        return "".join(out)

    restored = RUN.sub(run, text)
    return restored if changed else None


def _whole(text: str, codec: str) -> str | None:
    """Text of which every run is UTF-8 read with a codec, restored; None if one isn't."""
    table = _bytes_of(codec)
    try:
        got = RUN.sub(lambda m: bytes(map(table.__getitem__, m.group())).decode(), text)
    except (KeyError, UnicodeDecodeError):
        return None
    return got if got != text else None


@cache
def _read_back(read: str, meant: str) -> dict[int, str]:
    """What each character of one encoding, by its code point, is in another."""
    return {ord(c): _upper(meant)[b] for c, b in _bytes_of(read).items() if b in _upper(meant)}


@cache
def _sequence(codec: str) -> re.Pattern:
    """A first byte of a UTF-8 sequence and one that goes on with it, as a codec reads them."""
    table = _bytes_of(codec)
    chars = lambda low, high: "[" + re.escape("".join(c for c, b in table.items() if low <= b <= high)) + "]"
    return re.compile(chars(0xC2, 0xF4) + chars(0x80, 0xBF))


def _as_single(text: str, read: str, meant: str) -> str | None:
    """Text of one single-byte encoding read with another, restored; None if that can't be."""
    table = _read_back(read, meant)
    odd = set("".join(RUN.findall(text)))
    if any(ord(c) not in table for c in odd) or all(table[ord(c)] == c for c in odd):
        return None
    restored = text.translate(table)
    if restored == text or any(_CYRILLIC.search(w) and _LATIN.search(w) for w in _LETTERS.findall(restored)):
        return None
    return restored


def undo(text: str, read: str, meant: str) -> str | None:
    return _as_utf8(text, read) if meant == "utf_8" else _as_single(text, read, meant)


# Learning: twins, mappings, transformations


def units(run: str, size: int) -> list[str]:
    return [run[i : i + size] for i in range(0, len(run), size)]


def pattern(stretch: str, size: int) -> str | None:
    """A stretch with its non-ASCII units of a size numbered by first sight: what a one-to-one change
    of units keeps. None where too few units come again to tell stretches apart."""
    seen: dict[str, int] = {}
    n = 0

    def number(m: re.Match) -> str:
        nonlocal n
        own = units(m.group(), size)
        n += len(own)
        return "".join([chr(0x100 + seen.setdefault(u, len(seen))) for u in own])

    key = RUN.sub(number, stretch)
    return key if len(seen) <= n - REPEATS else None


def stretches(text: str) -> Iterator[tuple[str, str, int]]:
    """(key, stretch, unit) of the shortest rows of words without ASCII letters, from each such word on,
    that have UNITS units of one, two or three characters."""
    words = _SPLIT.split(text)
    own = [None if w.isascii() or _ASCII_LETTER.search(w) else [len(r) for r in RUN.findall(w)] for w in words]
    if not any(own):
        return
    for size in (1, 2, 3):
        counts = [sum(lengths) // size if lengths and not any(n % size for n in lengths) else 0 for lengths in own]
        for i, first in enumerate(counts):
            n, j = 0, i
            while first and n < UNITS and j < len(words) and counts[j]:
                n += counts[j]
                j += 1
            if n >= UNITS:
                stretch = " ".join(words[i:j])
                if key := pattern(stretch, size):
                    yield key, stretch, size


@lru_cache(1 << 16)
def _explained_one(given: str, meant: str) -> int:
    """Which single-byte hypotheses turn one character into another, as bits of a number."""
    bits = 0
    for read in codecs():
        b = _bytes_of(read).get(given)
        if b is not None:
            for m in codecs():
                if m != read and _upper(m).get(b) == meant:
                    bits |= 1 << _index()[read, m]
    return bits


@lru_cache(1 << 16)
def explained(given: str, meant: str) -> int:
    """Which hypotheses turn what stands into what is meant, as bits of a number; UTF-8 in any number of rounds."""
    bits = 0
    if len(given) == len(meant):
        bits = -1
        for a, b in zip(given, meant, strict=True):
            bits &= _explained_one(a, b)
            if not bits:
                return 0
        return bits
    for i, read in enumerate(codecs()):
        step = given
        while step is not None and len(step) > len(meant):
            step = _whole(step, read)
            if step == meant:
                bits |= 1 << i
                break
    return bits


@lru_cache(1 << 14)
def _is_utf8(runs: str) -> bool:
    """Whether some encoding reads all of a text's runs as UTF-8: such a text is no clean twin."""
    return any(_whole(runs, c) is not None for c in codecs())


def mappings(form: str, clean: str, size: int) -> set[tuple[str, str]]:
    """What differs between twins: their runs, or the units of their stretches, one by one."""
    a, b = RUN.findall(form), RUN.findall(clean)
    if len(a) != len(b):
        return set()
    if size:
        a, b = units("".join(a), size), list("".join(b))
    found = {(x, y) for x, y in zip(a, b, strict=False) if x != y}
    return set() if any(len(x) == len(y) for x, y in found) and _is_utf8(clean) else found


@dataclass(frozen=True)
class Evidence:
    """distinct: mappings that a transformation must explain and no other explains so far; support:
    in how many twins they stand, all together, and as a share of the twins of all explained mappings."""

    distinct: int = 3
    support: int = 8
    share: float = 0.003


def chosen(explained_by: list[tuple[int, int, int]], declared: dict[str, int], e: Evidence = Evidence()) -> list[tuple[str, str, int]]:
    """(read, meant, votes): the transformations that explain the mappings, best first.

    explained_by has (hypotheses as bits, mappings, twins). The hypothesis with most twins is
    taken, what it explains is set aside, and so on while there is evidence. Ties go to the one
    that explains more in all, then to the encodings that headers declare more often.
    """
    left, out = list(explained_by), []
    total: Counter = Counter()
    each = [[i for i in range(bits.bit_length()) if bits >> i & 1] for bits, _, _ in left]
    for own, (_, _, n) in zip(each, left, strict=True):
        total.update(dict.fromkeys(own, n))
    alive = [True] * len(left)
    least = max(e.support, e.share * sum(n for _, _, n in left))
    while True:
        twins: Counter = Counter()
        kinds: Counter = Counter()
        for own, (_, k, n), there in zip(each, left, alive, strict=True):
            if there:
                twins.update(dict.fromkeys(own, n))
                kinds.update(dict.fromkeys(own, k))
        good = [i for i in twins if kinds[i] >= e.distinct and twins[i] >= least]
        if not good:
            return out
        known = lambda i: sum(declared.get(c, 0) for c in hypotheses()[i])
        best = max(good, key=lambda i: (twins[i], total[i], known(i), -i))
        out.append((*hypotheses()[best], twins[best]))
        alive = [there and best not in own for there, own in zip(alive, each, strict=True)]


# Judging: surroundings of characters


def _kind(c: str) -> str:
    if c < "\x80":
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " "
    if c.isalpha():
        return "c" if _CYRILLIC.match(c) else "e" if c.islower() else "E"
    return "."


def _fine(c: str) -> str:
    return c.lower() if c.isascii() and c.isalpha() else _kind(c)


def contexts(text: str) -> Iterator[str]:
    """Each non-ASCII character between its neighbours (first sign =) and between their kinds (first sign ~).

    A neighbour is one of 26 letters or a kind, so there are at most so many contexts as characters
    of Unicode times a constant, however much text there is."""
    padded = f" {text} "
    for m in RUN.finditer(padded):
        for i in range(m.start(), m.end()):
            yield "=" + _fine(padded[i - 1]) + padded[i] + _fine(padded[i + 1])
            yield "~" + _kind(padded[i - 1]) + padded[i] + _kind(padded[i + 1])


class Likelihood:
    """Mean log frequency of a text's non-ASCII characters between their neighbours; where those are rare, between kinds of them."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.chars = Counter()
        for k, v in counts.items():
            if k[0] == "~":
                self.chars[k[2]] += v
        self.total = math.log(sum(self.chars.values()) + 1.0)

    def total_of(self, text: str) -> float:
        keys = list(contexts(text))
        return sum(math.log(self.counts.get(fine, 0) + 0.01 * self.counts.get(kind, 0) + 0.01) - self.total for fine, kind in zip(keys[::2], keys[1::2], strict=True))

    def mean(self, keys: Counter) -> float | None:
        """Mean log frequency of the letters of some contexts, between kinds of neighbours; None without letters."""
        own = {c: k for c, k in keys.items() if c[0] == "~" and c[2].isalpha()}
        n = sum(own.values())
        return sum(k * math.log(self.counts.get(c, 0) + 0.01) for c, k in own.items()) / n if n else None

    def known(self, text: str) -> bool:
        return all(self.chars[c] > 0 for c in set("".join(RUN.findall(text))))


def restore(text: str, learned: list[tuple[str, str, int]], model: Likelihood, declared: str | None = None) -> str | None:
    """The original of a garbled text: "" if characters are lost for good, None if it isn't garbled."""
    if text.isascii():
        return None
    if LOST in text:
        return ""
    best, sure = text, False
    while True:  # each round of UTF-8 read back makes the text shorter
        step = _whole_utf8(best, learned, model, declared)
        sure = sure or step is not None
        step = step or _part_utf8(best, learned, model, declared)
        if step is None:
            break
        best = step
    if sure:
        return best
    options, odd, as_is = [], set("".join(RUN.findall(text))), None
    for read, meant, _ in learned:
        if meant == "utf_8":
            continue
        table = _read_back(read, meant)
        turned = [table.get(ord(c)) for c in odd]
        if all(to is not None and model.chars[to] > 0 for to in turned) and set(turned) != odd and (got := _as_single(text, read, meant)) is not None:
            as_is = model.total_of(text) if as_is is None else as_is
            gain = model.total_of(got) - as_is + DECLARED * (declared in (read, meant))
            changed = sum(x != y for x, y in zip(text, got, strict=True))
            if gain > max(LEAST, MARGIN * changed):
                options.append((gain, got))
    if options and (best == text or max(options)[0] > model.total_of(best) - model.total_of(text)):
        return max(options)[1]
    return best if best != text else None


def _whole_utf8(text: str, learned: list[tuple[str, str, int]], model: Likelihood, declared: str | None) -> str | None:
    """A text that is UTF-8 from end to end once read back; the best reading by known characters, likelihood and votes.

    A reading must be in known characters, or of several sequences."""
    options = []
    for i, (read, meant, votes) in enumerate(learned):
        if meant != "utf_8" or not _sequence(read).search(text) or (got := _whole(text, read)) is None:
            continue
        known = model.known(got)
        many = sum(c >= "\x80" for c in got) >= SEQUENCES and not any("\u0250" <= c < "\u0370" and c not in "ˆ˜" for c in got)
        if many or known:
            options.append((known, model.total_of(got) + math.log1p(votes) + DECLARED * (declared == read), -i, got))
    return max(options)[3] if options else None


def _part_utf8(text: str, learned: list[tuple[str, str, int]], model: Likelihood, declared: str | None) -> str | None:
    """A text of which some runs are UTF-8 once read back, in known characters and likelier than before; the likeliest reading.

    What comes is less than what goes, and so likelier in sum; it mustn't be far less likely each."""
    options = []
    for read, meant, votes in learned:
        if meant == "utf_8" and _sequence(read).search(text) and (got := _as_utf8(text, read)) is not None and model.known(got) and (total := model.total_of(got)) > model.total_of(text):
            before, after = Counter(contexts(text)), Counter(contexts(got))
            come, go = model.mean(after - before), model.mean(before - after)
            if come is None or go is None or come > go - FALL:
                options.append((total + DECLARED * (declared == read), votes, got))
    return max(options)[2] if options else None


# Over tables


def word_counts(cells: DataFrame) -> DataFrame:
    """(word, n) of the words with a non-ASCII character."""
    odd = lambda c: F.length(c) != F.octet_length(c)
    words = cells.where(odd("text")).select(F.explode(F.split("text", SPACE)).alias("word"))
    return words.where(odd("word")).groupBy("word").agg(F.count("*").alias("n"))


def _stretch_counts(cells: DataFrame) -> DataFrame:
    """(key, form, size, n) of the stretches of all cells, counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter(x for text in b.column("text").to_pylist() for x in stretches(text))
            keys = list(zip(*seen, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(keys[2], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["key", "form", "size", "n"])

    odd = cells.where(F.length("text") != F.octet_length("text")).select("text")
    return odd.mapInArrow(run, "key string, form string, size int, n bigint").groupBy("key", "form", "size").agg(F.sum("n").alias("n"))


def twins(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(form, clean, size): every form of a key beside the key's commonest form.

    The key of a word is its ASCII skeleton with a mark for each run left out; of a stretch without
    ASCII letters, its pattern of units. Keys are equal for twins and join them; what share a key
    stand beside one form, so the rows are as many as forms, however many a key has. Ties go to
    the shorter form, then to the one that sorts last.
    """
    skeleton = F.regexp_replace("word", "[^\\x00-\\x7f]+", "\u0001")
    whole = words.select(skeleton.alias("key"), F.col("word").alias("form"), F.lit(0).alias("size"), "n").where(F.length(F.regexp_replace("key", "[^A-Za-z]", "")) >= LETTERS)
    forms = stored(whole.unionByName(_stretch_counts(cells)), "forms")
    best = forms.groupBy("key").agg(F.max_by(F.struct("form", "size"), F.struct("n", -F.length("form"), "form")).alias("x"), F.count("*").alias("forms"))
    best = best.where("forms > 1 and x.size < 2").select("key", F.col("x.form").alias("clean"))
    return forms.join(best, "key").where("form <> clean").select("form", "clean", "size")


def learned_mappings(pairs: DataFrame) -> DataFrame:
    """(given, meant, bits, n): mappings that some hypothesis explains, and in how many twins they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter(m for x in zip(*(b.column(c).to_pylist() for c in ("form", "clean", "size")), strict=True) for m in mappings(*x))
            got = [(g, c, f"{bits:x}", n) for (g, c), n in seen.items() if (bits := explained(g, c))]
            cols = list(zip(*got, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["given", "meant", "bits", "n"])

    return pairs.mapInArrow(run, "given string, meant string, bits string, n bigint").groupBy("given", "meant", "bits").agg(F.sum("n").alias("n"))


def learn(cells: DataFrame, words: DataFrame, e: Evidence = Evidence()) -> list[tuple[str, str, int]]:
    """The transformations that the twins of cells(text, declared) teach.

    Mappings are added up by what explains them; sets of encodings that agree on a character are
    few, whatever the number of rows. declared may be null.
    """
    by = learned_mappings(twins(words, cells)).groupBy("bits").agg(F.count("*").alias("mappings"), F.sum("n").alias("twins")).collect()
    said = {page(r["declared"]): r["n"] for r in cells.where("declared is not null").groupBy("declared").agg(F.count("*").alias("n")).collect() if page(r["declared"])}
    return chosen(sorted((int(r["bits"], 16), r["mappings"], r["twins"]) for r in by), said, e)


def context_counts(words: DataFrame) -> DataFrame:
    """(context, n) over all words, counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                for c in contexts(word):
                    seen[c] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["context", "n"])

    return words.mapInArrow(run, "context string, n bigint").groupBy("context").agg(F.sum("n").alias("n"))


def restore_garbled(cells: DataFrame, e: Evidence = Evidence()) -> DataFrame:
    """(record_id, field, restored): one row per garbled cell of cells(record_id, field, text, declared).

    Sound, null and empty cells give no row; repeated cells count each; declared, the header's
    encoding, may be null or anything. With no twins nothing is learned and only lost cells come
    out. The learned transformations and the table of surroundings go to the tasks: the first are
    some pairs of encodings, the second is bounded by the characters of Unicode, not by the rows.
    Cells are restored whole.
    """
    cells = spread(cells.select("record_id", "field", "text", "declared").where("text <> ''"))
    words = stored(word_counts(cells), "words")
    learned = learn(cells, words, e)
    counts = {r["context"]: r["n"] for r in context_counts(words).collect()}
    sent = cells.sparkSession.sparkContext.broadcast((learned, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Likelihood(sent.value[1])
        for b in batches:
            got = [restore(x, sent.value[0], model, page(d)) for x, d in zip(b.column("text").to_pylist(), b.column("declared").to_pylist(), strict=True)]
            keep = pa.array([x is not None for x in got])
            yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("field"), pa.array(got, pa.string())], ["record_id", "field", "restored"]).filter(keep)

    return cells.where(F.length("text") != F.octet_length("text")).mapInArrow(run, "record_id bigint, field string, restored string")


def header_cells(headers: DataFrame, files: DataFrame) -> DataFrame:
    """(record_id, field, text, declared) of headers(record_id, title, description) and files(record_id, encoding)."""
    said = files.groupBy(F.col("record_id").alias("r")).agg(F.min("encoding").alias("declared"))
    both = headers.select("record_id", "title", "description").join(said, F.col("record_id") == F.col("r"), "left")
    one = F.explode(F.expr("array(named_struct('field', 'title', 'text', title), named_struct('field', 'description', 'text', description))"))
    return both.select("record_id", "declared", one.alias("x")).select("record_id", "x.field", "x.text", "declared")
