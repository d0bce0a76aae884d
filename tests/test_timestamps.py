from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest

from swaplens.operators import timestamps

SOURCES = [("b", "Europe/Berlin", "dmy"), ("n", "America/New_York", "mdy"), ("y", "UTC", "ymd"), ("s", "Australia/Sydney", "dmy")]


def us(*parts, zone="UTC", fold=0, micro=0):
    at = datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold)
    return int(at.timestamp()) * 1_000_000 + micro


CASES = [
    ("b", "2025-03-30T02:30:00", us(2025, 3, 30, 1, 30)),  # skipped: the offset before the change
    ("b", "2025-10-26 02:30:00", us(2025, 10, 26, 0, 30)),  # twice: the earlier
    ("n", "2024-11-03T01:30", us(2024, 11, 3, 5, 30)),
    ("b", "03/04/2025 10:00:00", us(2025, 4, 3, 10, zone="Europe/Berlin")),
    ("n", "03/04/2025 4:06 PM", us(2025, 3, 4, 16, 6, zone="America/New_York")),
    ("y", "25/03/04 10:00:01", us(2025, 3, 4, 10, 0, 1)),
    ("n", "31.03.2026 09:44:56  ", us(2026, 3, 31, 9, 44, 56, zone="America/New_York")),
    ("y", "2026-02-01T22:38:54,561482z", us(2026, 2, 1, 22, 38, 54, micro=561482)),
    ("y", "20260610T232329.266603+0200", us(2026, 6, 10, 21, 23, 29, micro=266603)),
    ("y", "Thu, 27 Aug 2026 00:16:43 +0530", us(2026, 8, 26, 18, 46, 43)),
    ("y", "Sat Mar 08 02:16:03 EST 2025", us(2025, 3, 8, 7, 16, 3)),
    ("y", "26 December 2024, 09:01 a.m.", us(2024, 12, 26, 9, 1)),
    ("y", "Jul 29, 2026 12:00 AM", us(2026, 7, 29)),
    ("y", "2026-05-25 02:48:50 PST", us(2026, 5, 25, 10, 48, 50)),
    ("s", "2024-02-22 03:28:54+11:00[Australia/Sydney]", us(2024, 2, 21, 16, 28, 54)),
    ("y", "2025-08-08T21:38:23.042339−09:30", us(2025, 8, 9, 7, 8, 23, micro=42339)),
    ("y", "2025-11-06T10:20:46.559938924", us(2025, 11, 6, 10, 20, 46, micro=559938)),
    ("y", "1717390628", 1717390628_000000),
    ("y", "1773435627.830833", 1773435627_830833),
    ("y", "1759542112345", 1759542112345_000),
    ("y", "1732306074091182", 1732306074091182),
    ("y", "1768874196880370210", 1768874196880370),
    ("y", "1.721249830E9", 1721249830_000000),
    *[("y", x, None) for x in (None, "", " ", "n/a", "0", "-1", "2025-02-30T10:00:00Z", "2025-06-01 25:10:00", "2026-13-01 08:00:00", "2026-04-18", "12:07:43", "2025-W14", "March 2026", "yesterday 14:00", "2025-01-01T00:00:00 XYZ", "x" * 100_000, "9" * 5000)],
]


def test_cases(spark):
    df = spark.createDataFrame([(i, e, t, datetime(2027, 1, 1), "clash") for i, (e, t, _) in enumerate(CASES)], "id int, exporter string, t string, loaded timestamp, zone string")
    sources = spark.createDataFrame(SOURCES, "exporter string, zone string, date_order string")
    got = {r.id: r.us for r in timestamps.normalise_timestamps(df, "t", sources, "exporter", "loaded", out="us").collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_zone_is_estimated_from_ingestion_times(spark):
    zone = ZoneInfo("America/New_York")
    rows = []
    for k in range(60):
        at = datetime(2025, 1 + k % 12, 5, 14, k, tzinfo=UTC)
        rows.append((k, "q", at.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S"), datetime.fromtimestamp(at.timestamp() + 600, UTC).replace(tzinfo=None)))
    df = spark.createDataFrame(rows, "id int, exporter string, t string, loaded timestamp_ntz")
    sources = spark.createDataFrame([("q", None, "ymd")], "exporter string, zone string, date_order string")
    candidates = ["UTC", "Europe/Berlin", "America/New_York", "Asia/Tokyo"]
    got = timestamps.normalise_timestamps(df, "t", sources, "exporter", "loaded", candidates, out="us").collect()
    assert all(datetime.fromtimestamp(r.us / 1e6, UTC).hour == 14 for r in got)


def test_undeclared_and_unknown_sources_get_their_offsets_back(spark):
    """Of all zones the estimate has the offsets of the true one, whatever its name, also where only the table of sources lacks the source."""
    zones = {"a": "America/New_York", "b": "Asia/Kolkata", "c": "Australia/Sydney", "d": "Europe/Berlin"}
    rows, want = [], {}
    for source, name in zones.items():
        for k in range(400):
            at = datetime(2025, 1 + k % 12, 1 + k % 28, k % 24, (7 * k) % 60, tzinfo=UTC)
            want[len(rows)] = int(at.timestamp()) * 1_000_000
            rows.append((len(rows), source, at.astimezone(ZoneInfo(name)).strftime("%Y-%m-%d %H:%M:%S"), datetime.fromtimestamp(at.timestamp() + 60 * (1 + k % 25), UTC).replace(tzinfo=None)))
    df = spark.createDataFrame(rows, "id int, exporter string, t string, loaded timestamp_ntz")
    sources = spark.createDataFrame([("a", None, "ymd"), ("b", None, "ymd")], "exporter string, zone string, date_order string")
    got = {r.id: r.us for r in timestamps.normalise_timestamps(df, "t", sources, "exporter", "loaded", out="us").collect()}
    assert sum(got[i] == us_ for i, us_ in want.items()) >= 0.995 * len(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "exporter string, t string, loaded timestamp")
    sources = spark.createDataFrame(SOURCES, "exporter string, zone string, date_order string")
    assert timestamps.normalise_timestamps(df, "t", sources, "exporter", "loaded").count() == 0


@pytest.mark.parametrize("text", ["2024-01-01T00:00:00Z"])
def test_repeated_rows_are_kept(spark, text):
    df = spark.createDataFrame([("y", text, None)] * 3, "exporter string, t string, loaded timestamp")
    sources = spark.createDataFrame(SOURCES, "exporter string, zone string, date_order string")
    assert timestamps.normalise_timestamps(df, "t", sources, "exporter", "loaded").where("instant_us is not null").count() == 3
