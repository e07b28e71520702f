"""One consistent form for text that looks ordinary but is made of other characters.

A transducer over grapheme clusters is compiled once per process from the Unicode tables
and a list of look-alike letters: its mapping is checked for conflicts (each key one value,
each value a fixed point) and applied longest match first. A cell without any trigger
character costs one scan by a compiled character class.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import spread

# Letters of the same look as Latin, Cyrillic and Greek capitals and small letters; "-" where there is none.
LOOKALIKES = """
A А Α
B В Β
C С -
E Е Ε
H Н Η
I І Ι
J Ј -
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
S Ѕ -
T Т Τ
X Х Χ
Y - Υ
Z - Ζ
a а -
c с -
d ԁ -
e е -
h һ -
i і -
j ј -
o о ο
p р -
q ԛ -
s ѕ -
w ԝ -
x х -
y у -
ë ё -
ï ї -
Ë Ё -
Ï Ї Ϊ
"""
ALPHABETS = ("Latin", "Cyrillic", "Greek")
_RANGES = {"Latin": "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", "Cyrillic": "Ѐ-ҁҊ-ԯ", "Greek": "Ͱ-ͽͿ-Ͽἀ-῿"}
_CONTROL = re.compile("[\0-\x08\x0e-\x1f\x7f]")
#: Anything but ASCII, composed Latin letters and usual punctuation, none of which is ever changed.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ıĴ-ňŊ-ſ–—‘-„…]")
_ASCII = bytes([9, 10, 13, *range(0x20, 0x7F)])
#: Characters of class Cf that show as signs of their own.
_SHOWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Invisible though not of class Cf: joiners, fillers and variation selectors.
_HIDDEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _plain(cp: int) -> str | None:
    """What a single character becomes, or None if it stays."""
    c = chr(cp)
    kind = unicodedata.category(c)
    if cp in _HIDDEN or (kind == "Cf" and cp not in _SHOWN) or (kind == "Cc" and c not in "\t\n\r\x0b\x0c\x85"):
        return ""
    if kind == "Zs" and cp not in (0x20, 0x1680):
        return " "
    if cp in (0x2010, 0x2011, 0xFE63, 0xFF0D):
        return "-"
    tag, _, rest = unicodedata.decomposition(c).rpartition(">")
    if tag in ("<wide", "<narrow") or (tag == "<compat" and len(rest.split()) > 1):
        text = unicodedata.normalize("NFKC", c)
        if text != c and all(unicodedata.category(x)[0] in "LNM" for x in text):
            return text
        return None
    composed = unicodedata.normalize("NFC", c)
    return composed if composed != c else None


@cache
def singles() -> dict[str, str]:
    """The mapping of single characters, by rule over the planes that have such characters."""
    found = {}
    for cp in (*range(0x80, 0xD800), *range(0xE000, 0x1F000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200), *range(0, 0x20), 0x7F):
        if (to := _plain(cp)) is not None:
            found[chr(cp)] = to
    # A Hangul or kana letter of half width may still compose with what follows: clusters do that.
    for key, to in found.items():
        if any(found.get(x, x) != x for x in to):
            raise ValueError(f"conflict at U+{ord(key):04X}")
    return found


@cache
def lookalikes() -> dict[str, dict[str, str]]:
    """By alphabet, the letters of other alphabets and what each becomes; every class is checked to hold one letter per alphabet."""
    to: dict[str, dict[str, str]] = {a: {} for a in ALPHABETS}
    seen: set[str] = set()
    for line in LOOKALIKES.split("\n"):
        row = [x for x in zip(ALPHABETS, line.split(), strict=False) if x[1] != "-"]
        for alphabet, letter in row:
            if letter in seen:
                raise ValueError(f"conflict at {letter}")
            seen.add(letter)
            for other, written in row:
                if other != alphabet:
                    to[alphabet][written] = letter
    return to


def _class(chars) -> str:
    """A regular-expression class of the characters, in ranges."""
    cps, out = sorted(map(ord, chars)), []
    start = last = cps[0]
    for cp in [*cps[1:], -1]:
        if cp != last + 1:
            out.append(f"\\U{start:08x}" + (f"-\\U{last:08x}" if last > start else ""))
            start = cp
        last = cp
    return "".join(out)


@cache
def _compiled():
    one = singles()
    marks = [chr(cp) for cp in range(0x300, 0x3100) if unicodedata.combining(chr(cp))] + ["゙", "゚", "ﾞ", "ﾟ"]
    la, cy, gr = (_RANGES[a] for a in ALPHABETS)
    mixed = f"[{la}](?=[{cy}{gr}])|[{cy}](?=[{la}{gr}])|[{gr}](?=[{la}{cy}])"
    trigger = re.compile(f"[{_class([*one, *marks])}{cy}{gr}]")
    if any(not _UNUSUAL.match(c) for c in [*one, *marks]):
        raise ValueError("a usual character would be changed")
    hidden = _class(k for k, v in one.items() if not v)
    cluster = re.compile(f"[^{_class(marks)}][{hidden}]*[{_class(marks)}][{_class(marks)}{hidden}]*|[{_class([*one, *marks])}]")
    word = re.compile(f"[{la}{cy}{gr}{_class(marks)}]+")
    own = [re.compile(f"[{_RANGES[a]}]") for a in ALPHABETS]
    ambiguous = set().union(*lookalikes().values())
    return trigger, cluster, word, own, ambiguous, re.compile(mixed)


def _alphabets(text: str) -> list[int]:
    _, _, _, own, ambiguous, _ = _compiled()
    return [sum(1 for c in p.findall(text) if c not in ambiguous) for p in own]


def usual(text: str) -> bool:
    """Whether a text has only characters that are never changed; the usual ones of ASCII are left out without a look at each."""
    rest = text.encode("utf-8", "surrogatepass").translate(None, _ASCII)
    return not rest or not _UNUSUAL.search(rest.decode("utf-8", "surrogatepass"))


def clean(text: str | None) -> str | None:
    """The clean form; null stays null, and a clean text comes back as it is.

    Letters of a word that look alike in several alphabets take the alphabet of its
    unmistakable letters; with none, or as many of two, that of the text around, else Latin.
    """
    if text is None or text.isascii() and not _CONTROL.search(text):
        return text
    if not _UNUSUAL.search(text):
        return text
    trigger, cluster, word, own, ambiguous, mixed = _compiled()
    if not trigger.search(text):
        return text
    one = singles()

    def plain(m: re.Match) -> str:
        c = m.group()
        return one[c] if c in one else unicodedata.normalize("NFC", "".join(one.get(x, x) for x in c))

    text = cluster.sub(plain, text)
    if not mixed.search(text):
        return text
    around: list[int] = []

    def single(m: re.Match) -> str:
        w = m.group()
        if w.isascii() or sum(1 for p in own if p.search(w)) < 2:
            return w
        counts = _alphabets(w)
        if sorted(counts)[-1] == sorted(counts)[-2]:
            if not around:
                around.extend(_alphabets(text))
            counts = [2 * n + (around[i] == max(around)) for i, n in enumerate(counts)]
        to = lookalikes()[ALPHABETS[counts.index(max(counts))]]
        return unicodedata.normalize("NFC", "".join(to.get(c, c) for c in w))

    return word.sub(single, text)


def clean_md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()  # noqa: S324


def unclean_cells(cells: DataFrame) -> DataFrame:
    """(field, row_key, pos, clean_md5) of the cells(field, row_key, pos, text) that aren't in the clean form.

    Null and empty cells are clean. Each cell counts on its own, repeated ones too; the work is
    one pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep, sums = b.column("text").to_pylist(), [], []
            for i, text in enumerate(texts):
                if text and (to := clean(text)) != text:
                    keep.append(i)
                    sums.append(clean_md5(to))
            rows = b.select(["field", "row_key", "pos"]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sums, pa.string())], ["field", "row_key", "pos", "clean_md5"])

    return spread(cells.select("field", "row_key", "pos", "text").where("text <> ''")).mapInArrow(run, "field string, row_key bigint, pos int, clean_md5 string")


def text_cells(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Titles, authors and chapter documents as cells."""
    whole = lambda df, field, key, col: df.select(F.lit(field).alias("field"), F.col(key).alias("row_key"), F.lit(0).alias("pos"), F.col(col).alias("text"))
    authors = books.select("record_id", F.posexplode("authors").alias("at", "text")).select(F.lit("books.authors").alias("field"), F.col("record_id").alias("row_key"), (F.col("at") + 1).alias("pos"), "text")
    return whole(books, "books.title", "record_id", "title").unionByName(authors).unionByName(whole(chapters, "chapters.document", "chapter_key", "document"))
