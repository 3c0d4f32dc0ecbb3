from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.operators import timestamps as t

ZONES = ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Europe/Lisbon"]


@pytest.fixture(scope="module")
def tables(spark):
    return t.zone_tables(spark, [*ZONES, "No/Where"])


def utc(tables, value, zone=None):
    micros, _ = t.to_utc(pa.array([value], pa.string()), pa.array([zone], pa.string()), tables)
    return t.spell(micros)[0].as_py()


CASES = {
    "2026-03-01T00:00:01Z": "2026-03-01T00:00:01.000000Z",
    "2026-03-01t00:00:01.5z": "2026-03-01T00:00:01.500000Z",
    "2026-03-01T00:00:01.123456789Z": "2026-03-01T00:00:01.123456Z",
    "2026-03-01T05:30:00.250+05:30": "2026-03-01T00:00:00.250000Z",
    "2026-03-01 00:00:00-0800": "2026-03-01T08:00:00.000000Z",
    "20260301T101500Z": "2026-03-01T10:15:00.000000Z",
    "01.03.2026 09:00:00": "2026-03-01T09:00:00.000000Z",
    "2026/06/01 10:00:00 CEST": "2026-06-01T08:00:00.000000Z",
    "2026/06/01 10:00:00 XYZT": "invalid",
    "Thu, 02 Jul 2026 01:13:51 +1000": "2026-07-01T15:13:51.000000Z",
    "Jul 1, 2026 12:05:00 AM": "2026-07-01T00:05:00.000000Z",
    "Jul 1, 2026 12:05:00 PM": "2026-07-01T12:05:00.000000Z",
    "Jul 1, 2026 13:05:00 PM": "invalid",
    "1772337410": "2026-03-01T03:56:50.000000Z",
    "1772337410123": "2026-03-01T03:56:50.123000Z",
    "1772337410123456": "2026-03-01T03:56:50.123456Z",
    "177233741": "invalid",
    " 2026-03-01 00:00 ": "2026-03-01T00:00:00.000000Z",
    "2026-02-30T10:00:00Z": "invalid",
    "2024-02-29T10:00:00Z": "2024-02-29T10:00:00.000000Z",
    "2026-02-29T10:00:00Z": "invalid",
    "2026-09-12T11:61:00+02:00": "invalid",
    "0000-00-00 00:00:00": "invalid",
    "2026-01-01T24:00:00Z": "invalid",
    "1899-12-31T23:00:00Z": "1899-12-31T23:00:00.000000Z",
    "2300-01-01T00:00:00Z": "2300-01-01T00:00:00.000000Z",
    "9999-12-31 23:59:59.9999999999999Z": "9999-12-31T23:59:59.999999Z",
    "0001-01-01T00:00:00Z": "0001-01-01T00:00:00.000000Z",
    "9999-12-31T23:59:59-01:00": "invalid",
    "0001-01-01T00:00:00+01:00": "invalid",
    "2026-03-01x00:00:01Z": "invalid",
    "2026-03-01T00:00:01y": "invalid",
    "1.7e9": "invalid",
    "pending": "invalid",
    "２０２６-03-01T00:00:00Z": "invalid",
    "x" * 100_000: "invalid",
}


@pytest.mark.parametrize("value", CASES)
def test_spellings(tables, value):
    assert utc(tables, value) == CASES[value]


def test_daylight_saving(tables):
    assert utc(tables, "2026-10-25 02:30", "Europe/Berlin") == "2026-10-25T00:30:00.000000Z"  # twice: the earlier
    assert utc(tables, "2026-03-29 02:30", "Europe/Berlin") == "2026-03-29T01:30:00.000000Z"  # skipped: the offset before
    assert utc(tables, "2026-03-29 02:30", "No/Where") == utc(tables, "2026-03-29 02:30") == "2026-03-29T02:30:00.000000Z"


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(1905, 1, 1), datetime(2400, 12, 31)), st.sampled_from(ZONES))
def test_zone_tables_agree_with_zoneinfo(tables, local, zone):
    local = local.replace(microsecond=0)
    expected = local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
    assert utc(tables, local.strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0"), zone) == expected.strftime("%Y-%m-%dT%H:%M:%S.%fZ")


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney"])
def test_rules_for_ever(spark, tables, zone):
    """Far years are the same years of the calendar's cycle."""
    rules = spark._jvm.java.time.ZoneId.of(zone).getRules()
    for year in (2038, 2100, 2437, 2440, 2803, 9998):
        for month in range(1, 13):
            local = np.array([t._days(year, month, 15) * t._DAY])
            there = spark._jvm.java.time.LocalDateTime.of(year, month, 15, 0, 0)
            assert tables.offset(zone, local)[0] == rules.getOffset(there).getTotalSeconds() * 1_000_000


def test_masks(spark):
    df = spark.createDataFrame([(" 2026-01-02",), ("Jan é",), ("soon",), (None,), (" ",)], "v string").selectExpr("v", "'x' AS k")
    assert sorted((r.mask, r.has_parser, r.n) for r in t.mask_report(df, "v", ["k"]).collect()) == [("9999-99-99", False, 1), ("?", False, 1), ("aaaa", False, 1)]
    zones = spark.createDataFrame([("Europe/Berlin",), ("No/Where",)], "time_zone string")
    (a, b) = t.zones_used(spark, zones).orderBy("time_zone").collect()
    assert a.version and a.changes > 800 and (b.version, b.changes) == (None, None)


def test_canonical_and_blank(tables):
    values = pa.array(["2026-03-01T00:00:01Z", "2026-03-01T00:00:01.25Z", "2026-02-30T00:00:01Z", " 2026-03-01T00:00:01Z", None, " "], pa.string())
    micros, plain = t.to_utc(values, pa.nulls(6, pa.string()), tables)
    assert plain.tolist() == [True, True, False, False, False, False]
    assert (micros == np.iinfo(np.int64).min).tolist() == [False, False, True, False, True, True]
    assert len(t.to_utc(pa.array([], pa.string()), pa.array([], pa.string()), tables)[0]) == 0


def test_frames(spark, tables):
    rows = spark.createDataFrame([(1, "2026-07-01 12:00", " ORG-1 ", "u"), (2, None, "org-1", "u"), (3, "  ", None, "u"), (4, "2026-07-01T12:00:00Z", None, "u")], "row_no bigint, v string, o string, utc string")
    zones = spark.createDataFrame([("organization", "Org-1", "Europe/Berlin"), ("organization", "org-1", "Europe/Lisbon"), ("project", "org-1", "UTC"), (None, None, None)], "owner_kind string, owner_id string, time_zone string")
    owners = t.zone_owners(zones, "organization")
    got = {r.row_no: r.utc for r in t.normalised(rows, "v", "o", owners, ["row_no"]).collect()}
    assert got == {1: "2026-07-01T10:00:00.000000Z", 4: "2026-07-01T12:00:00.000000Z"}
    assert [r.row_no for r in t.normalised(rows, "v", "o", owners, ["row_no"], cases_only=True).collect()] == [1]
    assert t.normalised(rows.limit(0), "v", "o", owners, ["row_no"]).count() == 0
    assert t.normalised(rows, "v", "o", owners, ["row_no"], keep_blank=True).count() == 4
