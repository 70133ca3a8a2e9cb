import pytest
from pyspark.sql import functions as F

from corpusloom.operators import timestamps as T

CLOCKS = [("tokyo", "Asia/Tokyo", "ymd"), ("la", "America/Los_Angeles", "mdy"), ("uk", "Europe/London", "dmy"), ("utc", "UTC", "ymd")]
CASES = [
    ("tokyo", "20101125031059", None, "2010-11-25T03:10:59Z"),
    ("la", "1213370033955", None, "2008-06-13T15:13:53Z"),
    ("utc", "965761652", None, "2000-08-08T19:07:32Z"),
    ("tokyo", "98/9/11", None, "1998-09-11"),
    ("tokyo", "平成12年3月13日", None, "2000-03-13"),
    ("tokyo", "H14.1.18", None, "2002-01-18"),
    ("tokyo", "２００３年５月号", None, "2003-05"),
    ("tokyo", "May 1998", None, "1998-05"),
    ("tokyo", "2005/8/24　17時19分", None, "2005-08-24T08:19:00Z"),
    ("tokyo", "2000年2月28日 午前8時36分", None, "2000-02-27T23:36:00Z"),
    ("tokyo", "2003年9月1日 午後0時5分", None, "2003-09-01T03:05:00Z"),
    ("la", "12/28/2004 11:11 PM", None, "2004-12-29T07:11:00Z"),
    ("uk", "4/7/2002 12:05 AM", None, "2002-07-03T23:05:00Z"),
    ("tokyo", "2004/6/25 26:04", None, "2004-06-25T17:04:00Z"),
    ("tokyo", "Mon, 23 Jul 2001 16:35:09 +0930", None, "2001-07-23T07:05:09Z"),
    ("tokyo", "Thu, 12 Apr 2007 12:06:18 BST", None, "2007-04-12T11:06:18Z"),
    ("uk", "[15/Oct/2001:00:28:11 +0900]", None, "2001-10-14T15:28:11Z"),
    ("uk", "2008.9.27 14時47分（EDT）", None, "2008-09-27T18:47:00Z"),
    ("uk", "2012-01-30T14:01:33+09", None, "2012-01-30T05:01:33Z"),
    ("uk", "2011-06-16T07:55:49.743", None, "2011-06-16T06:55:49Z"),
    ("utc", "Fri Mar  8 11:43:03 2002", None, "2002-03-08T11:43:03Z"),
    ("utc", "2003/05/18 （日）", None, "2003-05-18"),
    # twice, never, not in the calendar, void
    ("la", "2007-11-04 01:30:00", None, "2007-11-04T08:30:00Z"),
    ("la", "4/7/2002 2:59 AM", None, "2002-04-07T10:59:00Z"),
    ("tokyo", "2001/2/30", "2001-03-02", "2001-03-02"),
    ("tokyo", "2003/13/04", None, None),
    ("tokyo", "----/--/--", "0000-00-00", None),
    ("tokyo", "１０月のどこか", "", None),
    ("tokyo", None, None, None),
    ("tokyo", "x" * 100_000, "2001-01", "2001-01"),
    (None, "2001-01-02", None, "2001-01-02"),
    (None, "2001-01-02 10:00:00", None, None),
    (None, "2001-01-02 10:00:00Z", None, "2001-01-02T10:00:00Z"),
]


def run(spark, rows):
    clocks = spark.createDataFrame(CLOCKS, "recorder string, zone string, day_order string")
    df = spark.createDataFrame([(i, *r[:3], "own") for i, r in enumerate(rows)], "id int, recorder string, date_raw string, date string, zone string")
    # names that clash with those of the clocks, the result and the operator's own
    df = df.withColumn("moment", F.lit("old")).withColumn("day_order", F.lit(1)).withColumn("_p", F.lit(2)).withColumn("local_s", F.lit(3))
    return T.normalised(df, ["date_raw", "date"], "recorder", clocks)


def test_forms(spark):
    got = {r["id"]: r["moment"] for r in run(spark, CASES).collect()}
    assert [(c[1] or "")[:40] for i, c in enumerate(CASES) if got[i] != c[3]] == []


def test_kinds_and_clashing_names(spark):
    d = run(spark, CASES)
    assert {"zone", "day_order", "_p", "local_s"} <= set(d.columns) and d.columns.count("moment") == 1
    kinds = {r["date_raw"]: r["moment_kind"] for r in d.collect()}
    assert kinds["2007-11-04 01:30:00"] == "ambiguous" and kinds["4/7/2002 2:59 AM"] == "nonexistent"
    assert kinds["98/9/11"] == "none" and kinds["2011-06-16T07:55:49.743"] == "direct"


def test_empty_and_repeated(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [CASES[0], CASES[0]]).count() == 2


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Kolkata"])
def test_intervals_agree_with_zoneinfo(spark, zone):
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo

    zones = spark.createDataFrame([(zone,)], "zone string")
    rows = T.zone_intervals(zones, "zone", (2000, 2005)).orderBy("utc_from").collect()
    for r in rows:
        for s in (r["utc_from"], r["utc_to"] - 1):
            assert datetime.fromtimestamp(s, timezone.utc).astimezone(ZoneInfo(zone)).utcoffset().total_seconds() == r["offset_s"]
    assert all(a["utc_to"] == b["utc_from"] for a, b in zip(rows, rows[1:]))


def test_zone_names_and_twelve_digits(spark):
    rows = [
        ("tokyo", "Thu, 12 Apr 2007 12:06:18 MSK", None, "2007-04-12T09:06:18Z"), ("tokyo", "2007-04-12 12:06:18 UT", None, "2007-04-12T12:06:18Z"),
        ("tokyo", "Fri Mar  8 11:43:03 MSK 2002", None, "2002-03-08T08:43:03Z"), ("tokyo", "200704121206", None, "2007-04-12T03:06:00Z"),
        ("tokyo", "965761652123", None, "2000-08-08T19:07:32Z"), ("tokyo", "2007-04-12 12:06:18 QQT", None, None),
    ]
    got = {r["date_raw"]: r["moment"] for r in run(spark, rows).collect()}
    assert got == {r[1]: r[3] for r in rows}


def test_years_outside(spark):
    clocks = spark.createDataFrame(CLOCKS, "recorder string, zone string, day_order string")
    df = spark.createDataFrame([("tokyo", "1985-03-04 05:06:07", None), ("tokyo", "1985-03-04", "2001-02-03"), ("tokyo", "1985-03", ""), ("tokyo", "?", None)], "recorder string, date_raw string, date string")
    wide = {(r["date_raw"], r["moment"], r["moment_kind"]) for r in T.normalised(df, ["date_raw", "date"], "recorder", clocks).collect()}
    assert wide == {("1985-03-04 05:06:07", "1985-03-03T20:06:07Z", "direct"), ("1985-03-04", "1985-03-04", "none"), ("1985-03", "1985-03", "none"), ("?", None, None)}
    close = {(r["date_raw"], r["moment"], r["moment_kind"], r["moment_from"]) for r in T.normalised(df, ["date_raw", "date"], "recorder", clocks, (1997, 2015)).collect()}
    assert close == {("1985-03-04 05:06:07", None, "outside", None), ("1985-03-04", "2001-02-03", "none", "date"), ("1985-03", None, "outside", None), ("?", None, None, None)}
