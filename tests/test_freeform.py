"""Free-form dates against what the usual parser makes of them."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from handbill.functions import dates, freeform

AS_OF = date(2026, 8, 31)
CASES = {
    "Saturday, August 22, 2026": "2026-08-22", "Aug. 22nd, 2026 at 7:30 p.m.": "2026-08-22T19:30:00", "22 August 2026 7pm": "2026-08-22T19:00:00", "8/22/2026": "2026-08-22", "22/8/2026": "2026-08-22",
    "22-Aug-26 19:05": "2026-08-22T19:05:00", "2026-08-22T19:00:00Z": "2026-08-22T19:00:00Z", "2026-08-22 19:00:00.123 -0700": "2026-08-22T19:00:00-0700", "Sat, 22 Aug 2026 19:00:00 GMT": "2026-08-22T19:00:00Z",
    "2026/08/22 12:15 AM": "2026-08-22T00:15:00", "12 pm Aug 22": "2026-08-22T12:00:00", "August 22": "2026-08-22", "February 2027": "2027-02-28", "20260822": "2026-08-22", "8/22": "2026-08-22",
    "22.08.2026": "2026-08-22", "Wednesday": "2026-09-02", "monday": "2026-08-31", "7:30 pm": "2026-08-31T19:30:00", "Sept 5 '27": "2027-09-05", "5 Sep 75": "2075-09-05", "5 Sep 77": "1977-09-05", "2027": "2027-08-31", "15": "2026-08-15",
    "19:00 on 3 May 2026 PST": "2026-05-03T19:00:00", "May 3rd 2026, 09:05:07": "2026-05-03T09:05:07",
    "the 22nd": None, "TBA": None, "": None, None: None, "February 30, 2026": None, "Aug 22 Sep 3": None, "25:00": None, "13 pm": None, "pm": None, "ongoing 2026": None, "1/2/3/4": None, "8/22/2026 8/23/2026": None,
}


def read(spark, column):
    rows = spark.createDataFrame([(k, v) for k, v in CASES.items()], "told string, want string")
    return rows.select("told", "want", column.alias("got")).collect()


def test_forms(spark):
    wrong = [tuple(r) for r in read(spark, freeform.parse_date(F.col("told"), AS_OF)) if r.got != r.want]
    assert not wrong


def test_the_usual_parser_agrees(spark):
    parser = pytest.importorskip("dateutil.parser")
    for r in read(spark, freeform.parse_date(F.col("told"), AS_OF)):
        if r.want:
            there = parser.parse(r.told, default=datetime(2026, 8, 31), ignoretz="PST" in r.told)
            mine = datetime.fromisoformat(r.got)
            assert (mine.date(), mine.hour, mine.minute, mine.second) == (there.date(), there.hour, there.minute, there.second), r.told


def test_local_iso_of_any_form(spark):
    found = {r.told: r.got for r in read(spark, dates.to_local_iso(F.col("told"), AS_OF))}
    assert found["Aug. 22nd, 2026 at 7:30 p.m."] == "2026-08-22T19:30:00-07:00" and found["2026-08-22T19:00:00Z"] == "2026-08-22T12:00:00-07:00"
    assert found["2026/08/22 12:15 AM"] == "2026-08-22T00:15:00-07:00" and found["TBA"] is None and found["Wednesday"] == "2026-09-02"
