import pytest

from quirework.operators import dates
from quirework.operators.dates import parse_date

NY, LONDON, KATHMANDU = "America/New_York", "Europe/London", "Asia/Kathmandu"


@pytest.mark.parametrize(
    ("raw", "zone", "day_first", "norm"),
    [
        ("2009-01-22T14:49:16", NY, False, "2009-01-22T19:49:16.000000Z"),
        ("2009-01-22t14:49:16z", NY, False, "2009-01-22T14:49:16.000000Z"),
        ("2012-02-05 23:17:15.180", LONDON, True, "2012-02-05T23:17:15.180000Z"),
        ("2011-04-02T22:21:52.061093394-0400", NY, False, "2011-04-03T02:21:52.061093Z"),
        ("20151101014312", NY, False, "2015-11-01T05:43:12.000000Z"),
        ("20171116T015953Z", NY, False, "2017-11-16T01:59:53.000000Z"),
        ("D:20130723011109+09'00'", None, None, "2013-07-22T16:11:09.000000Z"),
        ("1480406394", NY, False, "2016-11-29T07:59:54.000000Z"),
        ("1353602321364", NY, False, "2012-11-22T16:38:41.364000Z"),
        ("2010/05/02 22:31 UTC+2", NY, False, "2010-05-02T20:31:00.000000Z"),
        ("2013-05-01 10:00 +0545", KATHMANDU, True, "2013-05-01T04:15:00.000000Z"),
        ("3/10/2024 4:17 am", NY, False, "2024-03-10T08:17:00.000000Z"),
        ("10/3/2024 4:17 am", LONDON, True, "2024-03-10T04:17:00.000000Z"),
        ("12/1/2020 12:05 am", NY, False, "2020-12-01T05:05:00.000000Z"),
        ("06.04.2013 17:33 Uhr", "Europe/Berlin", True, "2013-04-06T15:33:00.000000Z"),
        ("Wed Jan 14 11:36:44 2009", LONDON, True, "2009-01-14T11:36:44.000000Z"),
        ("Sun, 25 Oct 2015 01:55:34 +0200", None, None, "2015-10-24T23:55:34.000000Z"),
        ("June 21, 2014, 5:18 PM CEST", "Europe/Madrid", True, "2014-06-21T15:18:00.000000Z"),
        ("November 5, 2023, 1:30 AM EST", NY, False, "2023-11-05T06:30:00.000000Z"),
        ("2023-05-11T22:22:13-04:00[America/New_York]", LONDON, True, "2023-05-12T02:22:13.000000Z"),
        ("2023-11-05 01:30", NY, False, "2023-11-05T05:30:00.000000Z"),  # shown twice: the first
        ("2023-03-12 02:30", NY, False, "2023-03-12T07:30:00.000000Z"),  # skipped: the offset before
        ("19 de noviembre de 2013", None, None, "2013-11-19"),
        ("3. März 2014", None, None, "2014-03-03"),
        ("2014-W10-1", None, None, "2014-03-03"),
        ("1944-156", None, None, "1944-06-04"),
        ("18660918", None, None, "1866-09-18"),
        ("23.03.2010", None, True, "2010-03-23"),
        ("01-15-2013", None, False, "2013-01-15"),
        ("July 2017", None, None, "2017-07"),
        ("01/2009", None, None, "2009-01"),
        ("[2014]", None, None, "2014"),
        ("c1894", None, None, "1894"),
        *[(x, NY, False, None) for x in ("", None, "unknown", "n.d.", "0000-00-00", "2019-02-30", "31/31/2020", "2021-13-07T10:00:00Z", "—", "9" * 5000)],
    ],
)
def test_parse(raw, zone, day_first, norm):
    assert parse_date(raw, zone, day_first)[0] == norm


def _values(spark, rows):
    return spark.createDataFrame(rows, "src string, record_id bigint, item string, feed string, raw string")


FEEDS = "feed string, zone_name string, day_first boolean"


def test_edge_rows(spark, rows):
    feeds = spark.createDataFrame([("a", NY, False)], FEEDS)
    values = _values(spark, [("b", 1, None, "a", "2020"), ("b", 1, None, "a", "2020"), ("b", None, "x", None, "2021-01"), ("b", 3, "x", "no", "2021-01-02 10:00"), ("b", 4, "x", "a", None)])
    got = rows(dates.normalise_dates(values, feeds))
    assert got == [("b", None, "2021-01"), ("b", 1, "2020"), ("b", 1, "2020")]
    assert rows(dates.normalise_dates(values.limit(0), feeds)) == []
    assert rows(dates.normalise_dates(values, feeds.limit(0))) == got


def test_zone_is_found_from_other_values_of_the_item(spark, rows):
    feeds = spark.createDataFrame([("k", None, False), ("a", NY, False), ("b", "Asia/Tokyo", False), ("c", LONDON, True)], FEEDS)
    known, local = [], []
    for m in range(1, 13):
        known.append(("b", m, f"i{m}", "a", f"2020-{m:02d}-10T12:00:00Z"))
        hour = 7 if m in (1, 2, 11, 12) else 8
        local.append(("b", 100 + m, f"i{m}", "k", f"2020-{m:02d}-10 {hour:02d}:00"))
    values = _values(spark, known + local)
    got = {r[1]: r[2] for r in rows(dates.normalise_dates(values, feeds))}
    assert all(got[100 + m] == got[m] for m in range(1, 13))
    assert {r[1] for r in rows(dates.normalise_dates(values, feeds, estimate=False))} == set(range(1, 13))
    judged = dates.judge_zones(dates.parsed_values(values, feeds))
    best = rows(dates.best_zones(judged, [NY]).select("feed", "zone_name", "violations", "ties"))
    assert [r[:3] for r in best] == [("k", NY, 0)] and best[0][3] > 1  # Toronto and others had the same clock


def test_zone_that_no_other_feed_has(spark, rows):
    feeds = spark.createDataFrame([("k", None, True), ("a", NY, False)], FEEDS)
    known = [("b", m, f"i{m}", "a", f"2020-{m:02d}-10T12:00:00Z") for m in range(1, 13)] + [("b", 50, "i1", "a", "2020-01-09T23:00:00Z")]
    local = [("b", 100 + m, f"i{m}", "k", f"2020-{m:02d}-10 17:45") for m in range(1, 13)] + [("b", 200, None, "k", "2020-01-10 05:45")]
    got = {r[1]: r[2] for r in rows(dates.normalise_dates(_values(spark, known + local), feeds))}
    assert all(got[100 + m] == got[m] for m in range(1, 13)) and got[200] == "2020-01-10T00:00:00.000000Z"


def test_abbreviations_and_ingestion_tell_a_zone(spark, rows):
    feeds = spark.createDataFrame([("k", None, True), ("a", NY, False)], FEEDS)
    known = [("b", m, f"i{m}", "a", f"2020-{m:02d}-10T12:00:00Z", None) for m in (1, 2, 7, 8)]
    hour = {1: 12, 2: 12, 7: 13, 8: 13}
    local = [("b", 100 + m, f"i{m}", "k", f"2020-{m:02d}-10 {hour[m]}:00", None) for m in hour] + [("b", 200, None, "k", "June 21, 2014, 5:18 PM BST", None), ("b", 201, None, "k", "June 21, 2014, 5:18 PM GMT", None)]
    values = spark.createDataFrame(known + local, "src string, record_id bigint, item string, feed string, raw string, ingested timestamp")
    got = {r[1]: r[2] for r in rows(dates.normalise_dates(values, feeds))}
    assert got[200] == "2014-06-21T16:18:00.000000Z" and got[201] == "2014-06-21T17:18:00.000000Z"
    seen = dates.aligned_offsets(dates.parsed_values(values.where("record_id > 100").selectExpr("src", "record_id", "item", "feed", "raw", "timestamp'2020-02-10 11:00:00' as ingested"), feeds))
    assert ("k", ">") in {r[:2] for r in rows(seen)} and ("k", "z") in {r[:2] for r in rows(seen)}
