"""Free-text dates in many formats, precisions and zones, brought to one form.

``normalise_dates`` parses each value, puts zone-less times on the clock of their feed and
writes UTC instants or plain dates. ``judge_zones`` and ``best_zones`` find the clock of feeds that name
none: they align local times with the nearest instants of the same item and with the times of
ingestion, and pick, of all zones there are, the offset history that violates the fewest of them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import cache, lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.session import stored

UTC = timezone.utc
#: Hours by which a clock may be off UTC, and by which an aligned time may differ from its instant.
MOST_HOURS = 15
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

# Month names of the languages that feeds write, without final dots.
MONTHS = {
    name: n
    for names in (
        "january february march april may june july august september october november december",
        "jan feb mar apr may jun jul aug sep oct nov dec",
        "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
        "januar februar märz april mai juni juli august september oktober november dezember",
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
        "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
        "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
        "januari februari maart april mei juni juli augustus september oktober november december",
        "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
        "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
        "tammikuuta helmikuuta maaliskuuta huhtikuuta toukokuuta kesäkuuta heinäkuuta elokuuta syyskuuta lokakuuta marraskuuta joulukuuta",
    )
    for n, name in enumerate(names.split(), 1)
} | {"sept": 9, "fevrier": 2, "aout": 8, "decembre": 12, "juil": 7, "janv": 1, "févr": 2, "avr": 4, "déc": 12, "mrz": 3, "okt": 10, "dez": 12}

_CLOCK = r"(?P<h>\d{1,2})[:h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap])\.?m\.?)?(?:\s*uhr)?"
_ZONE = r"(?:\s*(?:(?P<z>z)|(?:utc|gmt)?\s?(?P<off>[+\-−]\d{1,2}(?::?\d{2})?)|(?P<ab>[a-z]{2,5})))?(?:\s*\[(?P<iana>[a-z0-9_+\-/]+)\])?"
_WEEKDAY = r"(?:[^\W\d]{2,12}\.?,?\s+)?"


def _form(text: str) -> re.Pattern:
    return re.compile(text.replace("CLOCK", _CLOCK).replace("ZONE", _ZONE).replace("WEEKDAY", _WEEKDAY), re.I)


FORMS = [
    _form(r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})(?:(?:t|,?\s+)CLOCKZONE)?"),
    _form(r"(?:d:)?(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)t?(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?(?:[.,](?P<f>\d+))?ZONE"),
    _form(r"d:(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)(?P<off>[+-]\d\d'\d\d)'?"),
    _form(r"(?:d:)?(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)"),
    _form(r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4})(?:(?:t|,?\s+)CLOCKZONE)?"),
    _form(r"WEEKDAY(?P<mon>[^\W\d]+)\.?\s+(?P<d>\d{1,2})\s+CLOCK(?:\s+(?P<ab2>[a-z]{2,5}))?\s+(?P<y>\d{4})"),
    _form(r"WEEKDAY(?P<mon>[^\W\d]+)\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})(?:,?\s+(?:at\s+)?CLOCKZONE)?"),
    _form(r"WEEKDAY(?P<d>\d{1,2})(?:\.|er|º|st|nd|rd|th)?[\s-]+(?:de\s+)?(?P<mon>[^\W\d]+)\.?,?[\s-]+(?:de\s+)?(?P<y>\d{4})(?:(?:,|\s+um|\s+à)?\s+CLOCKZONE)?"),
    _form(r"(?P<y>\d{4})-?w(?P<week>\d\d)-?(?P<wd>\d)"),
    _form(r"(?P<y>\d{4})-(?P<yd>\d{3})"),
    _form(r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})"),
    _form(r"(?P<m>\d{1,2})[-/.](?P<y>\d{4})"),
    _form(r"(?P<mon>[^\W\d]+)\.?,?\s+(?:de\s+)?(?P<y>\d{4})"),
    _form(r"\[?[c©]?\s*(?P<y>\d{4})\]?"),
]
_EPOCH_SECONDS = re.compile(r"\d{9,10}")
_EPOCH_MILLIS = re.compile(r"\d{12,13}")


def _offset(text: str) -> timedelta:
    digits = re.sub(r"\D", "", text)
    hours, minutes = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
    if hours > 15 or minutes > 59:
        raise ValueError(text)
    return (-1 if text[0] in "-−" else 1) * timedelta(hours=hours, minutes=minutes)


@lru_cache(4096)
def _zone(name: str) -> ZoneInfo:
    return ZoneInfo(name)


def _abbreviated(local: datetime, name: str, zone: ZoneInfo) -> timedelta:
    """Offset of a zone abbreviation: of the two readings of the clock, or else of any time of year."""
    for fold in (0, 1):
        t = local.replace(tzinfo=zone, fold=fold)
        if (t.tzname() or "").upper() == name:
            return t.utcoffset()
    for days in (30, 60, 91, 121, 152, 182, 213, 243, 274, 304, 335, 365):
        for way in (-1, 1):
            t = (local + way * timedelta(days=days)).replace(tzinfo=zone)
            if (t.tzname() or "").upper() == name:
                return t.utcoffset()
    if name in ("UTC", "GMT", "UT"):
        return timedelta(0)
    raise ValueError(name)


def on_clock(local: datetime, zone: ZoneInfo) -> datetime:
    """UTC of a wall time: shown twice, the first; skipped, by the offset just before (both are fold 0)."""
    return (local - local.replace(tzinfo=zone, fold=0).utcoffset()).replace(tzinfo=UTC)


def instant_text(t: datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%S.").zfill(20) + f"{t.microsecond:06d}Z"


def parse_date(raw: str | None, zone_name: str | None, day_first: bool | None):
    """(norm, local): norm is the final text or None where no real date is stated; local is the
    wall time as text where norm rests on the feed's clock. With no zone known, norm is None and
    local tells what there is to align, with the zone's abbreviation behind a space where one stands."""
    text = " ".join((raw or "").split())
    if not text:
        return None, None
    try:
        if _EPOCH_SECONDS.fullmatch(text):
            return instant_text(EPOCH + timedelta(seconds=int(text))), None
        if _EPOCH_MILLIS.fullmatch(text) and not (len(text) == 12 and text[:2] in ("18", "19", "20")):
            return instant_text(EPOCH + timedelta(milliseconds=int(text))), None
        for form in FORMS:
            m = form.fullmatch(text)
            if m:
                return _read(m.groupdict(), zone_name, day_first)
    except (ValueError, OverflowError, KeyError):
        pass
    return None, None


def _read(g: dict, zone_name: str | None, day_first: bool | None):
    y = int(g["y"])
    if y == 0 or y == 9999:
        raise ValueError(y)
    if g.get("week"):
        return date.fromisocalendar(y, int(g["week"]), int(g["wd"])).isoformat(), None
    if g.get("yd"):
        day = date(y, 1, 1) + timedelta(days=int(g["yd"]) - 1)
        if day.year != y or g["yd"] == "000":
            raise ValueError(g["yd"])
        return day.isoformat(), None
    if g.get("a"):
        d, m = (int(g["a"]), int(g["b"])) if day_first else (int(g["b"]), int(g["a"]))
    else:
        m = MONTHS[g["mon"].lower()] if g.get("mon") else int(g["m"]) if g.get("m") else None
        d = int(g["d"]) if g.get("d") else None
    if m is None:
        return f"{y:04d}", None
    if d is None:
        date(y, m, 1)
        return f"{y:04d}-{m:02d}", None
    day = date(y, m, d)
    if not g.get("h"):
        return day.isoformat(), None
    h = int(g["h"])
    if g.get("ap"):
        if not 1 <= h <= 12:
            raise ValueError(h)
        h = h % 12 + 12 * (g["ap"].lower() == "p")
    second = int(g.get("s") or 0)
    leap = second == 60
    local = datetime(y, m, d, h, int(g["mi"]), 59 if leap else second, int((g.get("f") or "0")[:6].ljust(6, "0"))) + timedelta(seconds=leap)
    if g.get("z"):
        return instant_text(local.replace(tzinfo=UTC)), None
    if g.get("off"):
        return instant_text((local - _offset(g["off"])).replace(tzinfo=UTC)), None
    name = (g.get("ab") or g.get("ab2") or "").upper()
    if name == "Z":
        return instant_text(local.replace(tzinfo=UTC)), None
    if name and name not in ("UTC", "GMT", "UT") and zone_name is None and not g.get("iana"):
        return None, local.isoformat(timespec="microseconds") + " " + name
    if name:
        zone = _zone(g["iana"] if g.get("iana") else zone_name or "UTC")
        return instant_text((local - _abbreviated(local, name, zone)).replace(tzinfo=UTC)), None
    if g.get("iana"):
        return instant_text(on_clock(local, _zone(g["iana"]))), None
    wall = local.isoformat(timespec="microseconds")
    if zone_name is None:
        return None, wall
    return instant_text(on_clock(local, _zone(zone_name))), wall


def parsed_values(values: DataFrame, feeds: DataFrame) -> DataFrame:
    """(src, record_id, item, feed, ingested, norm, local) of each value; a feed that isn't listed has no clock."""
    return _parsed(values.join(feeds.select("feed", "zone_name", "day_first"), "feed", "left"))


def _parsed(values: DataFrame) -> DataFrame:
    """Adds norm and local to values(src, record_id, item, feed, raw, zone_name, day_first[, ingested])."""
    if "ingested" not in values.columns:
        values = values.withColumn("ingested", F.lit(None).cast("timestamp"))
    kept = ("src", "record_id", "item", "feed", "raw", "day_first", "ingested")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse_date(*x) for x in zip(*(b.column(c).to_pylist() for c in ("raw", "zone_name", "day_first")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string())], [*kept, "norm", "local"])

    schema = "src string, record_id bigint, item string, feed string, raw string, day_first boolean, ingested timestamp, norm string, local string"
    return values.select(*kept, "zone_name").mapInArrow(run, schema)


def _offset_at(zone_name: Column, local: Column) -> Column:
    """Seconds by which a zone's clock is ahead of UTC at a wall time."""
    return F.unix_timestamp(local) - F.unix_timestamp(F.to_utc_timestamp(local, zone_name))


@cache
def world_zones() -> dict[str, tuple[str, ...]]:
    """Each zone of the world that is a place, with the abbreviations its clock has shown since 1970."""
    out = {}
    for name in sorted(available_timezones()):
        if "/" in name and not name.startswith(("Etc/", "SystemV/", "US/", "posix/", "right/")):
            zone = _zone(name)
            out[name] = tuple(sorted({datetime(y, m, 1, tzinfo=zone).tzname() for y in range(1970, 2038, 2) for m in (1, 7)}))
    return out


def aligned_offsets(parsed: DataFrame) -> DataFrame:
    """(feed, kind, at, ahead, n): what the times of each feed tell of its clock, counted by hour of the wall time.

    kind "=": a local time lies ahead seconds from the nearest instant that another value of its item
    states, to a quarter of an hour. kind ">": the clock is at least ahead seconds fast, as the value was
    ingested when it was; only such times tell something that are within MOST_HOURS of it. kind "z":
    ahead is null and the abbreviation stands in name. Local times and instants of an item are made
    distinct and meet by day, so an item of most rows costs no more than its different times.
    """
    hours = MOST_HOURS * 3600
    when = F.to_timestamp(F.substring_index("local", " ", 1))
    locals_ = parsed.where("local is not null").select("item", "feed", "ingested", when.alias("at"), F.when(F.instr("local", " ") > 0, F.substring_index("local", " ", -1)).alias("name"))
    plain = locals_.where("name is null")
    counted = plain.where("item is not null").groupBy("item", "feed", "at").agg(F.count("*").alias("n"))
    refs = parsed.where("norm like '%Z' and local is null and item is not null").select("item", F.to_timestamp("norm").alias("ref")).distinct().withColumn("day", F.to_date("ref"))
    days = F.explode(F.array(*[F.date_add(F.to_date("at"), i) for i in (-1, 0, 1)]))
    gap = F.unix_timestamp("at") - F.unix_timestamp("ref")
    met = counted.withColumn("day", days).join(refs, ["item", "day"]).withColumn("gap", gap).where(F.abs("gap") <= hours)
    nearest = met.groupBy("item", "feed", "at", "n").agg(F.min_by("gap", F.struct(F.abs("gap"), "ref")).alias("gap"))
    hour = F.date_trunc("hour", "at").alias("at")
    none = F.lit(None).cast("string").alias("name")
    same = nearest.groupBy("feed", hour, (F.round(F.col("gap") / 900) * 900).cast("long").alias("ahead")).agg(F.sum("n").alias("n")).select("feed", F.lit("=").alias("kind"), "at", "ahead", none, "n")
    late = F.unix_timestamp("at") - F.unix_timestamp("ingested")
    least = plain.withColumn("ahead", (F.floor(late / 900) * 900).cast("long")).where(F.abs("ahead") <= hours).groupBy("feed", hour, "ahead").agg(F.count("*").alias("n")).select("feed", F.lit(">").alias("kind"), "at", "ahead", none, "n")
    named = locals_.where("name is not null").groupBy("feed", "name").agg(F.count("*").alias("n")).select("feed", F.lit("z").alias("kind"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("ahead"), "name", "n")
    return same.unionByName(least).unionByName(named)


def judge_zones(parsed: DataFrame, zones: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """How each zone fits each feed: (feed, zone_name, aligned, violations).

    parsed(item, feed, ingested, norm, local); zones are names with the abbreviations they show, all of
    the world's if none are given; they become a literal. A zone's violations are the aligned times
    at which its history has another offset, the times that it puts after their ingestion, and the
    abbreviations that it never shows. A feed without anything aligned has no row. Nulls never align.
    """
    zones = world_zones() if zones is None else zones
    java = parsed.sparkSession.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toString().strip("[]").split(", ")
    zones = {z: zones[z] for z in set(zones).intersection(java)}  # both sides' zone tables may be of different years
    seen = aligned_offsets(parsed)
    listed = F.from_json(F.lit(json.dumps([{"zone_name": z, "shown": names} for z, names in sorted(zones.items())])), "array<struct<zone_name:string,shown:array<string>>>")
    tried = seen.withColumn("z", F.explode(listed)).select("feed", "kind", "at", "ahead", "name", "n", "z.zone_name", "z.shown")
    ahead = _offset_at(F.col("zone_name"), F.col("at"))
    wrong = F.when(F.col("kind") == "=", F.abs(ahead - F.col("ahead")) > 450).when(F.col("kind") == ">", ahead < F.col("ahead")).otherwise(~F.array_contains("shown", F.col("name")))
    return tried.groupBy("feed", "zone_name").agg(F.sum(F.when(F.col("kind") != ">", F.col("n")).otherwise(0)).alias("aligned"), F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("violations")).where("aligned > 0")


def best_zones(judged: DataFrame, usual: list[str] = ()) -> DataFrame:
    """(feed, zone_name, aligned, violations, ties): the zone of each feed with the fewest violations.

    ties is how many zones have so few. Of them a usual one (those that other feeds declare) goes first,
    then the name that sorts first: nothing aligned tells them apart."""
    rank = F.struct("violations", (~F.col("zone_name").isin(*usual) if usual else F.lit(True)).alias("odd"), "zone_name", "aligned")
    best = judged.groupBy("feed").agg(F.min(rank).alias("b"), F.collect_list("violations").alias("all"))
    return best.select("feed", "b.zone_name", "b.aligned", "b.violations", F.size(F.filter("all", lambda v: v == F.col("b.violations"))).alias("ties"))


def normalise_dates(values: DataFrame, feeds: DataFrame, estimate: bool = True) -> DataFrame:
    """(src, record_id, norm): one row per value that states a real date.

    values(src, record_id, item, feed, raw[, ingested]); feeds(feed unique, zone_name, day_first),
    whose zone_name may be null: then, with estimate, the feed's clock is found by judge_zones among
    all zones of the world, and its times are read again with it. Times of feeds whose clock stays
    unknown, placeholders, impossible dates, nulls and empty texts give no row. feeds is broadcast
    only if Spark knows it to be small.
    """
    known = feeds.select("feed", "zone_name", "day_first")
    first = parsed_values(values, known)
    found = first.where(F.col("norm").isNotNull()).select("src", "record_id", "norm")
    if not estimate or known.where(F.col("zone_name").isNull()).isEmpty():
        return found
    first = stored(first, "dates")
    found = first.where(F.col("norm").isNotNull()).select("src", "record_id", "norm")
    open_ = first.where("norm is null and local is not null")
    # Feeds without a clock are judged; what the others state are instants to align with.
    told = first.where("norm like '%Z'").withColumn("local", F.lit(None).cast("string"))
    usual = [r[0] for r in known.where("zone_name is not null").groupBy("zone_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "zone_name").limit(len(world_zones())).collect()]
    clocks = stored(best_zones(judge_zones(open_.unionByName(told)), usual), "clocks")
    late = _parsed(open_.select("src", "record_id", "item", "feed", "raw", "day_first", "ingested").join(clocks.select("feed", "zone_name"), "feed"))
    return found.unionByName(late.where("norm is not null").select("src", "record_id", "norm"))


def date_values(books: DataFrame, headers: DataFrame) -> DataFrame:
    """The date fields of both tables as one list of values."""
    one = lambda df, src, col, at: df.where(F.col(col).isNotNull()).select(F.lit(src).alias("src"), "record_id", F.col("book_id").alias("item"), "feed", F.col(col).alias("raw"), F.col(at).cast("timestamp").alias("ingested"))
    return one(books, "books", "date", "captured_at").unionByName(one(headers, "exth_headers", "pub_date", "loaded_at"))
