from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from lodeline.operators.instants import normalise_instants, read_fields

SITES = [("de", "Europe/Berlin", "dmy"), ("us", "America/New_York", "mdy"), ("jp", "Asia/Tokyo", "ymd"), ("np", "Asia/Kathmandu", "ymd"), ("none", None, "dmy")]


def us(*a, tz=timezone.utc, micro=0):
    return int(datetime(*a, tzinfo=tz).timestamp()) * 1_000_000 + micro


BERLIN, NY = ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York")
CASES = [
    ("de", "2020-02-19T12:16:23.082+0100", us(2020, 2, 19, 11, 16, 23, micro=82_000)),
    ("de", "2020-12-10T17:10:48.723123493Z", us(2020, 12, 10, 17, 10, 48, micro=723_123)),
    ("de", "2020-02-19 12:16:23,5", us(2020, 2, 19, 11, 16, 23, micro=500_000)),
    ("de", "19. Februar 2020 12:16", us(2020, 2, 19, 11, 16)), ("de", "3. März 2021 02:05", us(2021, 3, 3, 1, 5)), ("de", "14 août 2020 15:42", us(2020, 8, 14, 13, 42)),
    ("us", "16/Dec/23 10:05 PM", us(2023, 12, 17, 3, 5)), ("us", "10/23/2020 10:14 PM", us(2020, 10, 24, 2, 14)), ("de", "03/05/2020 12:25", us(2020, 5, 3, 10, 25)),
    ("us", "03.11.2020 17:44:02", us(2020, 11, 3, 22, 44, 2)), ("jp", "2020/12/01 02:12", us(2020, 11, 30, 17, 12)), ("us", "October 28, 2020 9:15 AM", us(2020, 10, 28, 13, 15)),
    ("us", "Sun Oct 25 23:38:38 2020 +0545", us(2020, 10, 25, 17, 53, 38)), ("us", "Sat Dec 5 20:26:55 2020 +0000", us(2020, 12, 5, 20, 26, 55)),
    ("us", "Sat, 05 Dec 2020 06:30:54 -0500", us(2020, 12, 5, 11, 30, 54)), ("us", "20210128T054333Z", us(2021, 1, 28, 5, 43, 33)),
    ("us", "1608014585 +0530", us(2020, 12, 15, 6, 43, 5)), ("us", "1608307562723", 1608307562723000), ("us", "1604430254723123", 1604430254723123), ("us", "1608007977", 1608007977000000),
    ("de", "2020-12-28 09:01:00 EST", us(2020, 12, 28, 14, 1)), ("us", "2021-03-23T11:36:19[Asia/Kathmandu]", us(2021, 3, 23, 5, 51, 19)), ("us", "2021-02-28 23:14:34 Australia/Sydney", us(2021, 2, 28, 12, 14, 34)),
    ("np", "2021-02-28", us(2021, 2, 27, 18, 15)), ("us", "2019-10-27T02:52:03+01", us(2019, 10, 27, 1, 52, 3)), ("us", " 2021-05-15t04:46:17z\n", us(2021, 5, 15, 4, 46, 17)),
    ("us", "2020-11-07 12:30:46 AM", us(2020, 11, 7, 5, 30, 46)), ("us", "2020-11-07 12:30:46 PM", us(2020, 11, 7, 17, 30, 46)),
    ("de", "2020-10-25 02:30:00", us(2020, 10, 25, 0, 30)), ("de", "2021-03-28 02:30:00", us(2021, 3, 28, 1, 30)),  # shown twice, skipped
    ("us", "2020-11-01 01:30:00", us(2020, 11, 1, 5, 30)), ("us", "2021-03-14 02:30:00", us(2021, 3, 14, 7, 30)),
]
BAD = ["2022-13-05 09:15:00", "2023-02-30T10:00:00Z", "0000-00-00 00:00:00", "yesterday", "24/??/2021", "-", "", "   ", "N/A", "null", "2020-01-01 25:00:00", "2020-01-01 10:61", "2020-01-01 13:00 PM",
       "2020-01-01 10:00 QQQ", "2020-01-01T10:00:00[Mars/Base]", "31/Feb/20 1:00 AM", "x" * 5000, "Foo 12, 2020 9:15 AM"]


@pytest.fixture
def sites(spark):
    return spark.createDataFrame(SITES, "site_id string, time_zone string, date_order string")


def found(spark, sites, data):
    df = spark.createDataFrame([(i, s, v, datetime(2030, 1, 1), "z") for i, (s, v) in enumerate(data)], "row_id long, site_id string, created string, acquired_at timestamp_ntz, fields string")
    return {r["row_id"]: (r["utc_us"], r["zone_source"]) for r in normalise_instants(read_fields(df, {"created": "created"}, ["row_id"]), sites, ["row_id"]).collect()}


def test_forms(spark, sites):
    got = found(spark, sites, [c[:2] for c in CASES])
    wrong = [(s, v, want, got.get(i, (None,))[0]) for i, (s, v, want) in enumerate(CASES) if got.get(i, (None,))[0] != want]
    assert not wrong


def test_what_is_no_instant_gives_no_row(spark, sites):
    assert found(spark, sites, [("de", b) for b in BAD] + [("de", None)]) == {}
    assert found(spark, sites, []) == {}


def test_unknown_zone_is_estimated_from_the_times_of_intake(spark):
    tokyo, data = ZoneInfo("Asia/Tokyo"), []
    for k in range(400):
        utc = datetime(2021, 1, 1, tzinfo=timezone.utc) + timedelta(hours=37 * k)
        local = utc.astimezone(tokyo).strftime("%Y-%m-%d %H:%M:%S")
        data.append((k, "lost", local, (utc + timedelta(minutes=7 + k % 50)).replace(tzinfo=None), int(utc.timestamp()) * 1_000_000))
    df = spark.createDataFrame([d[:4] for d in data], "row_id long, site_id string, created string, acquired_at timestamp_ntz")
    sites = spark.createDataFrame([("other", "UTC", "dmy")], "site_id string, time_zone string, date_order string")
    out = normalise_instants(read_fields(df, {"created": "created"}, ["row_id"]), sites, ["row_id"]).collect()
    assert {r["row_id"]: r["utc_us"] for r in out} == {d[0]: d[4] for d in data}
    assert {r["zone_source"] for r in out} == {"estimate"}
