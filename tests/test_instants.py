from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from barloom.operators import instants

ZONES = [("a", "Europe/Berlin", "utc", "dmy"), ("b", "America/New_York", "local", "mdy"), ("c", "America/Sao_Paulo", "utc", "dmy"), ("d", "UTC", "utc", "mdy")]


SPAN = (datetime(2023, 7, 1, tzinfo=UTC), datetime(2025, 3, 1, tzinfo=UTC))


@pytest.fixture(scope="module")
def clocks(spark):
    return instants.collector_clocks(spark, spark.createDataFrame(ZONES, "collector string, zone_name string, epoch_basis string, date_order string"), SPAN)


def us(text, zone="UTC", fold=0):
    t = datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone), fold=fold)
    return int(round(t.astimezone(UTC).timestamp() * 1e6))


CASES = [
    ("a", "2024-05-04T06:05:59+00:00", us("2024-05-04T06:05:59")),
    ("a", "2024-05-04 06:05:59", us("2024-05-04T06:05:59", "Europe/Berlin")),
    ("a", "04/03/2024 23:48:01", us("2024-03-04T23:48:01", "Europe/Berlin")),
    ("b", "04/03/2024 23:48:01", us("2024-04-03T23:48:01", "America/New_York")),
    ("b", "4/1/24 12:05 am", us("2024-04-01T00:05:00", "America/New_York")),
    ("b", "4/1/24 12:05 pm", us("2024-04-01T12:05:00", "America/New_York")),
    ("a", "1.04.2024 15:13:22", us("2024-04-01T15:13:22", "Europe/Berlin")),
    ("c", "2024/08/25 22:26:16 BRT", us("2024-08-26T01:26:16")),
    ("a", "2023/10/29 02:30:00 CET", us("2023-10-29T01:30:00")),
    ("a", "2023/10/29 02:30:00 CEST", us("2023-10-29T00:30:00")),
    ("a", "2023-10-29 02:30:00", us("2023-10-29T00:30:00")),  # twice: first occurrence
    ("a", "2024-03-31 02:30:00", None),  # never
    ("d", "Nov 13, 2023 9:30:50 PM UTC", us("2023-11-13T21:30:50")),
    ("b", "Oct 21, 2023 12:20:18 AM EDT", us("2023-10-21T04:20:18")),
    ("d", "Sun Sep 01 21:52:33 +0900 2024", us("2024-09-01T12:52:33")),
    ("d", "Tue, 09 Apr 2024 18:50:06 GMT", us("2024-04-09T18:50:06")),
    ("d", "20240324T235058Z", us("2024-03-24T23:50:58")),
    ("d", "1710854611.618", 1710854611618000),
    ("d", "1716799919081", 1716799919081000),
    ("d", "1711221719", 1711221719000000),
    ("d", "  2024-05-25 23:18 -0430", us("2024-05-26T03:48:00")),
    ("d", "2024-05-07 12:33:00.896253+00:00", us("2024-05-07T12:33:00.896253")),
    ("d", "2024-02-30 10:00:00", None),
    ("d", "2023-02-29 10:00:00", None),
    ("d", "2024-13-45T25:61:00Z", None),
    ("d", "0000-00-00 00:00:00", None),
    ("d", "1970-01-01 00:00:00", None),
    ("d", "", None),
    ("d", "N/A", None),
    ("d", None, None),
    ("zzz", "2024-05-04 06:05:59", None),  # no zone known
    ("zzz", "2024-05-04T06:05:59Z", us("2024-05-04T06:05:59")),
    (None, "2024-05-04T06:05:59Z", us("2024-05-04T06:05:59")),
]


def test_spellings(spark, clocks):
    df = spark.createDataFrame([(i, c, t) for i, (c, t, _) in enumerate(CASES)], "id bigint, collector string, timestamp string")
    got = {r["id"]: r["utc_us"] for r in instants.with_text_instants(df, "timestamp", clocks, SPAN).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(CASES)}


def test_integers(spark, clocks):
    wall = us("2024-01-05T10:00:00")
    rows = [(1, "a", wall // 1000), (2, "a", wall // 10**6), (3, "a", wall), (4, "a", wall * 1000), (5, "b", wall // 1000), (6, "a", 0), (7, "a", -1), (8, "a", None), (9, "a", 99999999999999999), (10, "b", us("2024-03-10T02:30:00") // 1000)]
    df = spark.createDataFrame(rows, "row_id bigint, collector string, open_time bigint")
    got = {r["row_id"]: (r["utc_us"], r["nonexistent"]) for r in instants.with_integer_instants(df, "open_time", clocks, SPAN).collect()}
    assert [got[i][0] for i in range(1, 5)] == [wall] * 4
    assert got[5][0] == us("2024-01-05T10:00:00", "America/New_York")
    assert [got[i][0] for i in (6, 7, 8, 9, 10)] == [None] * 5 and got[10][1]


def test_empty_and_extra_columns(spark, clocks):
    df = spark.createDataFrame([], "id bigint, collector string, timestamp string, offsets2 string")
    assert instants.with_text_instants(df, "timestamp", clocks).where(F.col("utc_us").isNotNull()).count() == 0


def test_without_a_span_nothing_is_dropped(spark):
    clocks = instants.collector_clocks(spark, spark.createDataFrame(ZONES, "collector string, zone_name string, epoch_basis string, date_order string"))
    cases = [("a", "1999-07-01 12:00:00", us("1999-07-01T12:00:00", "Europe/Berlin")), ("d", "1970-01-01 00:00:00", 0), ("b", "2040-12-01T00:00:00Z", us("2040-12-01T00:00:00"))]
    df = spark.createDataFrame([(i, c, t) for i, (c, t, _) in enumerate(cases)], "id bigint, collector string, timestamp string")
    assert [r["utc_us"] for r in instants.with_text_instants(df, "timestamp", clocks).orderBy("id").collect()] == [w for _, _, w in cases]
