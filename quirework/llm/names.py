"""Variant spellings of names typed by people, linked to one person or organisation.

A name is a profile: its words in their formal form, its particles, and an initial where it has
but one word. Tokens are compared by a prefix-filtered set-similarity join on their padded
three-letter grams; names that share two of their rarest tokens, or slips of them, are verified by
a soft similarity of all their tokens in which a rare token weighs more, and go to the commonest
name they are similar to. Short forms, initials above all, go to the only one they fit among the
names with the same other tokens. Weights are relative, so more data of the same kind change no link.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.lookalike import clean
from quirework.session import spread, stored

# Short and familiar forms of given names, each line a formal name and its forms.
NICKNAMES = """
alexander alex sasha alec sandy xander lex
antonia toni tonia
benedict ben benny
begona bego
charles charlie chuck chas
dorothea dora thea dolly dot
edouard edy eddy ed eddie
elizabeth liz beth lizzie betty eliza lisa bess betsy
francesca cesca fran frannie
frederick fred freddie freddy
gabriel gabe
ignacio nacho
johannes hannes jan hans
josephine josie jo
katherine kate kathy kat katie kitty kathie
leopold leo poldi
magdalena magda lena
margaret maggie peggy meg marge
nathaniel nate nat
penelope penny
robert bob rob bobby robbie bert
rosalind roz ros
samuel sam sammy
susanna sue suzy susie suzie
theodore ted theo teddy
tomasz tomek
ulrich uli
victoria vicky vicki tori
wilhelmina mina minna willa
william bill will billy willy
"""
# Abbreviations of words in names of organisations.
SHORT = """
association assoc assn
book bk
editions eds edn
foundation found fdn
history hist
house hse
institute inst
library lib libr
literary lit
museum mus
press pr
printing print prtg
publishing publ pub
society soc
translators transl tr
university univ uni
"""
# Words that say nothing about which person or organisation is meant.
IDLE = frozenset("dr prof mr mrs ms miss sir dame rev phd jr sr the of for and a an ltd inc co gmbh llc sa bv".split())
PARTICLES = frozenset("van von de di da del der den la le du dos das".split())
FORMAL = {short: line.split()[0] for line in (NICKNAMES + SHORT).split("\n") if line for short in line.split()}


@dataclass(frozen=True)
class Settings:
    """least: letters of the longer of two tokens that may be slips of each other. twice: letters
    from which on a token may have two slips. similar: soft similarity of two names that are one.
    short: what a listed short form, beside its formal one, counts as equal."""

    least: int = 5
    twice: int = 16
    similar: float = 0.8
    short: float = 0.9


_PIECE = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def tokens(name: str) -> tuple[str, list[str], list[str]]:
    """(plain form, words, initials) of a name; initials of a double name stay together (j.-l. is jl)."""
    text = unicodedata.normalize("NFKD", clean(name))
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    text = text.translate({0x2019: None, 0x27: None, 0x2BC: None, 0x60: None, 0xF8: "o", 0x142: "l", 0xDF: "ss", 0xE6: "ae", 0x153: "oe"}).replace(".-", "-").replace(".", " . ")
    words, initials = [], []
    for m in _PIECE.finditer(text):
        parts = m.group().split("-")
        if all(len(p) == 1 for p in parts):
            initials.append("".join(parts))
        elif (word := "".join(parts)) not in IDLE:
            words.append(word)
    return " ".join(_PIECE.findall(text)), words, initials


def _first_letters(name: str) -> list[str]:
    return ["".join(p[0] for p in m.group().split("-")) for m in _PIECE.finditer(unicodedata.normalize("NFKD", clean(name)).lower()) if "-" in m.group()]


def _wanted(words: list[str], initials: list[str], plain: str) -> tuple[list[str], str]:
    """(words, particles) of a profile; a name of one word keeps its first initial as a word of its own (j.)."""
    own = sorted({FORMAL.get(w, w) for w in words if w not in PARTICLES})
    if len(own) < 2 and initials:
        own.append(initials[0] + ".")
    return own or ["?" + plain], " ".join(sorted({w for w in words if w in PARTICLES}))


def parsed(names: DataFrame) -> DataFrame:
    """(name, profile, words, particles, double, short) of names(name): profile is words and particles as one
    text, double has the initials of hyphenated words, short tells of a listed short form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name in b.column("name").to_pylist():
                plain, words, initials = tokens(name)
                if plain:
                    own, particles = _wanted(words, initials, plain)
                    out.append((name, " ".join(own) + "|" + particles, own, particles, _first_letters(name), any(w in FORMAL for w in words)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["name", "profile", "words", "particles", "double", "short"])

    return names.select("name").mapInArrow(run, "name string, profile string, words array<string>, particles string, double array<string>, short boolean")


def distance(a: str, b: str, most: int = 2) -> int:
    """Letters more, less, other or swapped between two tokens; most + 1 if there are more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def soft(a: str, b: str, s: Settings = Settings()) -> float:
    """How equal two tokens are: 1, the share of letters without slips, or 0 with more slips than their length allows."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    if n < s.least or a[-1] == "." or b[-1] == ".":
        return 0.0
    most = 2 if n >= s.twice else 1
    d = distance(a, b, most)
    return 1 - d / n if d <= most else 0.0


def similarity(a: list[tuple[str, float]], b: list[tuple[str, float]], s: Settings = Settings()) -> float:
    """Soft similarity of two names' (token, weight): twice the matched weight over all the weight.

    Each token is matched with the likest that is left, the heaviest tokens first; a pair weighs as
    its commoner token, as a slip is rare only by being one. Names of which each has a token that the
    other lacks are not similar."""
    left, matched, total, missed = list(b), 0.0, 0.0, 0
    for token, w in sorted(a, key=lambda x: -x[1]):
        best = max(((soft(token, u, s), i) for i, (u, _) in enumerate(left)), default=(0.0, 0))
        if best[0] > 0:
            pair = min(w, left.pop(best[1])[1])
            matched += 2 * pair * best[0]
            total += 2 * pair
        else:
            missed += 1
            total += w
    total += sum(w for _, w in left)
    return matched / total if total and not (missed and left) else 0.0


def slips(counted: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(token, root): tokens that may be slips of one that is not rarer, or a listed formal or short form.

    counted(token, df). An edit changes at most four of a token's padded three-letter grams, so
    two tokens k edits apart meet on one of the first 4k + 1 of each by one order, rare grams
    first, at places at most k apart. Formal and listed short forms are no slips of others.
    """
    n = F.length("token")
    edits = F.when(n + 1 >= s.twice, 2).otherwise(1)
    grams = F.transform(F.sequence(F.lit(1), n + 2), lambda i: F.struct(i.alias("at"), F.substring(F.concat(F.lit("##"), "token", F.lit("##")), i, F.lit(3)).alias("gram")))
    listed = counted.where((n >= s.least - 1) & ~F.col("token").endswith(".") & ~F.col("token").startswith("?")).withColumn("g", F.explode(grams)).select("token", "df", "g.at", "g.gram")
    common = listed.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = listed.join(common, "gram").groupBy("token", "df").agg(F.sort_array(F.collect_list(F.struct("n", "gram", "at"))).alias("all"))
    first = ranked.select("token", "df", edits.alias("k"), F.explode(F.slice("all", F.lit(1), 4 * edits + 1)).alias("x")).select("token", "df", "k", "x.gram", "x.at")
    known = F.create_map(*[F.lit(x) for k in sorted(set(FORMAL) | set(FORMAL.values())) for x in (k, True)])
    left = first.where(known[F.col("token")].isNull()).withColumn("at", F.explode(F.sequence(F.col("at") - F.col("k"), F.col("at") + F.col("k"))))
    right = first.select(F.col("token").alias("root"), F.col("df").alias("root_df"), "gram", "at")
    order = known[F.col("root")].isNotNull() | (F.col("root_df") > F.col("df")) | (F.col("root_df") == F.col("df")) & (F.col("root") < F.col("token"))
    met = left.join(right, ["gram", "at"]).where(order & (F.abs(n - F.length("root")) <= F.col("k"))).select("token", "root").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [soft(x, y, s) > 0 for x, y in zip(b.column("token").to_pylist(), b.column("root").to_pylist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    # Two edits are at most four by the JVM's distance, which knows no swaps; it thins what Python sees.
    return met.where(F.levenshtein("token", "root", 4) >= 0).mapInArrow(run, "token string, root string")


def _keys(weighed: DataFrame, s: Settings) -> DataFrame:
    """(profile, a, b): pairs of a profile's rarest tokens, of which any name as similar has one pair too.

    Similar names have at most 1 - similar of their weight unmatched, so of the rarest tokens that
    weigh more than that, with one more, two at least are matched. b is empty for names of one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for profile, particles, own in zip(b.column("profile").to_pylist(), b.column("particles").to_pylist(), b.column("own").to_pylist(), strict=True):
                own = sorted(((x["token"], x["w"]) for x in own), key=lambda x: (-x[1], x[0]))
                spare, n = 2 * (1 - s.similar) * sum(w for _, w in own), 0
                while n < len(own) and spare >= 0:
                    spare -= own[n][1]
                    n += 1
                first = [x for x, _ in own[: n + 1]]
                pairs = [(x, y) for i, x in enumerate(first) for y in first[i + 1 :]] if len(own) > 1 else [(first[0], "")]
                out += [(profile, particles, *sorted(p, reverse=True)) for p in pairs]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in cols], ["profile", "particles", "a", "b"])

    return weighed.select("profile", "particles", "own").mapInArrow(run, "profile string, particles string, a string, b string")


def similar_profiles(weighed: DataFrame, root: DataFrame, s: Settings) -> DataFrame:
    """(profile, other): names that are one by their soft similarity; weighed(profile, particles, n, own), root is slips()."""
    keys = _keys(weighed, s)
    itself = lambda c: F.array(F.col(c))
    to = root.groupBy("token").agg(F.collect_list("root").alias("roots"))
    with_a = keys.join(to.select(F.col("token").alias("a"), F.col("roots").alias("ra")), "a", "left")
    both = with_a.join(to.select(F.col("token").alias("b"), F.col("roots").alias("rb")), "b", "left")
    none = F.array().cast("array<string>")
    spelt = both.select("profile", "particles", F.explode(F.concat(itself("a"), F.coalesce("ra", none))).alias("x"), F.concat(itself("b"), F.coalesce("rb", none)).alias("rb")).select("profile", "particles", "x", F.explode("rb").alias("y"))
    spelt = spelt.select("profile", "particles", F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    spelt = stored(spelt, "spelt")
    met = spelt.join(keys.select(F.col("profile").alias("other"), "particles", "a", "b"), ["particles", "a", "b"])
    # Slips in different tokens meet at a spelling that nobody has: there, at the commonest name.
    centre = spelt.join(weighed.select("profile", "n"), "profile").groupBy("particles", "a", "b").agg(F.max_by("profile", F.struct("n", "profile")).alias("other"))
    met = met.unionByName(spelt.join(centre, ["particles", "a", "b"])).where("profile <> other")
    met = met.select(F.least("profile", "other").alias("profile"), F.greatest("profile", "other").alias("other")).distinct()
    facts = weighed.select("profile", "own")
    pairs = met.join(facts, "profile").join(facts.withColumnsRenamed({"profile": "other", "own": "own_b"}), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda own: [(x["token"], x["w"]) for x in own]
        for b in batches:
            keep = [similarity(pack(x), pack(y), s) >= s.similar for x, y in zip(b.column("own").to_pylist(), b.column("own_b").to_pylist(), strict=True)]
            yield b.select(["profile", "other"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("profile", "other", "own", "own_b").mapInArrow(run, "profile string, other string")


def _settled(profiles: DataFrame, links: DataFrame) -> DataFrame:
    """(profile, entity): each profile goes to the commonest one it is linked with, if that is commoner
    than itself, and so on to one that goes nowhere. Ties go to the name that sorts last."""
    n = profiles.select("profile", "n")
    sides = links.union(links.select("other", "profile"))
    best = sides.join(n.withColumnsRenamed({"profile": "other", "n": "m"}), "other").groupBy("profile").agg(F.max(F.struct("m", "other")).alias("x"))
    to = n.join(best, "profile", "left").select("profile", F.when(F.struct("x.m", "x.other") > F.struct("n", "profile"), F.col("x.other")).otherwise(F.col("profile")).alias("entity"))
    to = stored(to, "to")
    while True:
        further = to.select(F.col("profile").alias("entity"), F.col("entity").alias("next")).where("entity <> next")
        new = stored(to.join(further, "entity", "left").select("profile", F.coalesce("next", "entity").alias("entity"), F.col("next").isNotNull().alias("moved")), "to")
        to = new.select("profile", "entity")
        if new.where("moved").isEmpty():
            return to


def _abbreviates(short: str, long: str, double: list[str]) -> bool:
    """Whether an initial, or a beginning of two letters or more, may stand for a word."""
    if short.endswith("."):
        return short[:-1] == long[0] or short[:-1] in double or short[:-1][0] == long[0] and len(short) > 2 and not double
    return 1 < len(short) < len(long) and long.startswith(short)


def short_forms(weighed: DataFrame, root: DataFrame) -> DataFrame:
    """(profile, other, slip): names of which one token stands shortened in one and whole in the other, all else being equal.

    weighed(profile, particles, words, double). slip tells that the only other token is a slip of
    the other name's. They meet on the sum of their other tokens' hashes and the first letter."""

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for profile, particles, words, double in zip(*(b.column(c).to_pylist() for c in ("profile", "particles", "words", "double")), strict=True):
                if len(words) > 1:
                    out += [(profile, particles, words[1 - i] if len(words) == 2 else " ".join(words[:i] + words[i + 1 :]), w, double) for i, w in enumerate(words)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["profile", "particles", "rest", "word", "double"])

    each = stored(weighed.select("profile", "particles", "words", "double").mapInArrow(rests, "profile string, particles string, rest string, word string, double array<string>"), "rests")
    letter = lambda df: df.withColumn("letter", F.substring("word", 1, 1))
    short = letter(each.where("word like '%.' or length(word) between 2 and 6")).select("profile", "particles", "rest", "word", "letter", F.lit(0).alias("slip"))
    spelt = short.join(root.withColumnsRenamed({"token": "rest", "root": "r"}), "rest").select("profile", "particles", F.col("r").alias("rest"), "word", "letter", F.lit(1).alias("slip"))
    whole = letter(each.where("word not like '%.'")).select(F.col("profile").alias("other"), "particles", "rest", F.col("word").alias("long"), "letter", "double")
    met = short.unionByName(spelt).join(whole, ["particles", "rest", "letter"]).where("profile <> other and length(long) > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_abbreviates(*x) for x in zip(*(b.column(c).to_pylist() for c in ("word", "long", "double")), strict=True)]
            yield b.select(["profile", "other", "slip"]).filter(pa.array(keep, pa.bool_()))

    return met.select("profile", "other", "slip", "word", "long", "double").mapInArrow(run, "profile string, other string, slip int")


def link_names(names: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(name, entity): which person or organisation each distinct name means.

    names(name). Nulls and names without a letter or digit are left out; a name that fits nobody
    else is its own entity. A short form that fits several is one of its own. Everything is joined
    by tokens; no group is collected into a task, and what is compared are distinct profiles.
    """
    own = stored(parsed(spread(names.select("name").where("name is not null").distinct())), "names")
    # The initials of a hyphenated word hold for all spellings of its profile.
    doubles = own.select("profile", F.explode("double").alias("d")).groupBy("profile").agg(F.collect_set("d").alias("double"))
    profiles = own.groupBy("profile").agg(F.count("*").alias("n"), F.first("words").alias("words"), F.first("particles").alias("particles"))
    profiles = stored(profiles.join(doubles, "profile", "left").withColumn("double", F.coalesce("double", F.array().cast("array<string>"))), "profiles")
    tokens_ = profiles.select("profile", F.explode("words").alias("token"))
    counted = stored(tokens_.groupBy("token").agg(F.count("*").alias("df")), "tokens")
    total = max(profiles.count(), 1)
    root = stored(slips(counted, s), "slips")
    weight = F.log((F.lit(float(total)) + 1) / F.col("df")) + 0.01
    owned = tokens_.join(counted, "token").groupBy("profile").agg(F.collect_list(F.struct("token", weight.alias("w"))).alias("own"))
    weighed = stored(profiles.join(owned, "profile"), "weighed")
    settled = _settled(profiles, stored(similar_profiles(weighed, root, s), "similar"))
    short = short_forms(weighed, root)
    ent = lambda side, to: settled.withColumnsRenamed({"profile": side, "entity": to})
    fits = short.join(ent("profile", "entity"), "profile").join(ent("other", "whole"), "other").where("entity <> whole")
    only = fits.groupBy("entity", "slip").agg(F.count_distinct("whole").alias("k"), F.min("whole").alias("whole"))
    only = only.groupBy("entity").agg(F.min(F.struct("slip", "k", "whole")).alias("x")).where("x.k = 1").select("entity", F.col("x.whole").alias("whole"))
    only = stored(only, "only")
    # A beginning may itself be begun: j. to jo to josephine.
    again = only.select(F.col("entity").alias("whole"), F.col("whole").alias("last"))
    ended = settled.join(only.join(again, "whole", "left").select("entity", F.coalesce("last", "whole").alias("whole")), "entity", "left").select("profile", F.coalesce("whole", "entity").alias("entity"))
    return own.select("name", "profile").join(ended, "profile").select("name", F.xxhash64("entity").alias("entity"))


def name_pairs(names: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point: all pairs of different strings of one entity."""
    linked = stored(link_names(names, s), "linked")
    left = linked.withColumnRenamed("name", "name_a")
    right = linked.withColumnRenamed("name", "name_b")
    return left.join(right, "entity").where("name_a < name_b").select("name_a", "name_b")


def name_entities(names: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(name, entity, variants): each distinct name, its entity and how many names mean the same."""
    linked = stored(link_names(names, s), "linked")
    return linked.join(linked.groupBy("entity").agg(F.count("*").alias("variants")), "entity").select("name", "entity", "variants")


def typed_names(books: DataFrame, headers: DataFrame) -> DataFrame:
    authors = lambda df: df.select(F.explode("authors").alias("name"))
    filed = books.select(F.explode("contributors.file_as").alias("name"))
    return authors(books).unionByName(filed).unionByName(authors(headers))
