from datetime import datetime

import pytest
from pyspark.sql import functions as F

from absentia.functions.dates import (
    hours_between,
    outside_school_year,
    parse_mixed_date,
    school_year_bounds,
    school_year_of,
    school_year_wellformed,
)
from absentia.functions.days import absence_days_exact, absence_days_priority
from absentia.functions.numbers import to_number
from absentia.functions.text import clean_name, norm_token

DATES = {
    "2021-03-04 08:00:00": datetime(2021, 3, 4, 8),
    "2021-03-04": datetime(2021, 3, 4),
    "2021-3-4": datetime(2021, 3, 4),
    "3/4/2021": datetime(2021, 3, 4),
    "03-04-2021": datetime(2021, 3, 4),
    "25/12/2021": datetime(2021, 12, 25),
    "25-12-2021": datetime(2021, 12, 25),
    "2021/3/4": datetime(2021, 3, 4),
    "March 4, 2021": datetime(2021, 3, 4),
    "march  4,  2021": datetime(2021, 3, 4),
    "Sep 4, 2021": datetime(2021, 9, 4),
    "May 4, 2021": datetime(2021, 5, 4),
    "04-Mar-2021": datetime(2021, 3, 4),
    "3/4/70": datetime(1970, 3, 4),
    "3/4/68": datetime(2068, 3, 4),
    "3/4/69": datetime(1969, 3, 4),
    "25/12/21": datetime(2021, 12, 25),
    " 2021-03-04 ": datetime(2021, 3, 4),
    "2021-03-04T08:00": datetime(2021, 3, 4, 8),
    "2021-03-04 08:00:00.5": datetime(2021, 3, 4, 8, 0, 0, 500000),
    "3/4/2021 8:00 AM": datetime(2021, 3, 4, 8),
    "3/4/2021 12:15 AM": datetime(2021, 3, 4, 0, 15),
    "3/4/2021 12:15 pm": datetime(2021, 3, 4, 12, 15),
    "3/4/2021 8:00 PM": datetime(2021, 3, 4, 20),
    "3/4/2021 14:30:15": datetime(2021, 3, 4, 14, 30, 15),
    "20210304": datetime(2021, 3, 4),
    "bad": None,
    "": None,
    "44621": None,
    "2021-02-30": None,
    "2/30/2021": None,
    "13/13/2021": None,
    "0021-03-04": None,
    "2300-01-01": None,
    "2021-03-04 25:00": None,
}


def _column(spark, values, name="c"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_dates_of_every_shape(spark):
    rows = _column(spark, DATES).select("c", parse_mixed_date(F.col("c")).alias("t")).collect()
    assert {r.c: r.t for r in rows} == DATES


@pytest.mark.parametrize("zone", ["America/Sao_Paulo", "America/New_York", "Asia/Tokyo"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # Both fall into a summer-time gap somewhere.
        df = _column(spark, ["2018-11-04", "2021-03-14 02:30:00"])
        got = [r[0] for r in df.select(parse_mixed_date(F.col("c")).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2018-11-04 00:00:00", "2021-03-14 02:30:00"]


def test_ten_formats_round_trip(spark):
    formats = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%m/%d/%Y", "%m-%d-%Y", "%d/%m/%Y", "%Y/%m/%d",
               "%B %d, %Y", "%b %d, %Y", "%m/%d/%y", "%d-%b-%Y"]
    days = [datetime(y, m, 17) for y in (1999, 2020) for m in range(1, 13)]
    pairs = [(d.strftime(f), d) for d in days for f in formats]
    df = spark.createDataFrame(pairs, "c string, d timestamp_ntz")
    parsed = df.withColumn("t", parse_mixed_date(F.col("c")))
    assert parsed.filter(~F.col("t").eqNullSafe(F.col("d"))).count() == 0


def test_numbers(spark):
    want = {" 7.5 ": 7.5, "1e3": 1000.0, "+5": 5.0, ".5": 0.5, "5.": 5.0, "-1": -1.0, "1,000": None,
            "inf": None, "nan": None, "0x10": None, "1_000": None, "1d": None, "0f": None, "": None}
    rows = _column(spark, want).select("c", to_number(F.col("c")).alias("n")).collect()
    assert {r.c: r.n for r in rows} == want


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "n double")
    got = [r[0] for r in df.select(to_number(F.col("n"), df.schema["n"].dataType)).collect()]
    assert got == [None, 1.0]


def test_school_year_bounds(spark):
    want = {
        "2020-2021": ("2020-07-01 00:00:00", "2021-06-30 00:00:00"),
        "20-21": ("0020-07-01 00:00:00", "0021-06-30 00:00:00"),
        " 2020 - 2021": ("2020-07-01 00:00:00", "2021-06-30 00:00:00"),
        "FY21": (None, None),
        "2020-2021-2022": (None, None),
        "0-1": (None, None),
        "10000-10001": (None, None),
        "2020.0-2021.0": (None, None),
    }
    first, last = school_year_bounds(F.col("c"))
    rows = _column(spark, want).select("c", first.cast("string"), last.cast("string")).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == want


def test_school_year_edges(spark):
    cases = [
        ("2020-2021", "2020-06-30 23:59:59", True),
        ("2020-2021", "2020-07-01 00:00:00", False),
        ("2020-2021", "2021-06-30 00:00:00", False),
        ("2020-2021", "2021-06-30 00:00:00.000001", True),
        ("2020-2021", "2021-06-30 10:00:00", True),
        ("2020-2021", "2021-07-01 00:00:00", True),
        ("2020-2022", "2021-12-01 00:00:00", False),
        ("20-21", "2021-01-01 00:00:00", True),
        ("FY21", "2021-01-01 00:00:00", None),
        (None, "2021-01-01 00:00:00", None),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "y string, t string")
    got = df.select(outside_school_year(F.col("t").cast("timestamp_ntz"), F.col("y"))).collect()
    assert [r[0] for r in got] == [c for _, _, c in cases]


def test_school_year_label(spark):
    df = _column(spark, ["2020-06-30", "2020-07-01", None])
    label = school_year_of(parse_mixed_date(F.col("c")))
    assert [r[0] for r in df.select(label).collect()] == ["2019-2020", "2020-2021", None]
    shape = _column(spark, ["2020-2021", "20-21", "FY21"])
    assert [r[0] for r in shape.select(school_year_wellformed(F.col("c"))).collect()] == [
        True, False, False]


def test_hours_between(spark):
    cases = [("8:00 AM", "3:30 PM", 7.5), ("14:30", "14:00", None), ("8:00", "15:30", 7.5),
             ("2021-03-04 08:00:00", "3/4/2021 3:30 PM", 7.5), ("x", "8:00", None),
             ("8:00", "2021-03-04", None), ("12:00 AM", "12:00 PM", 12.0), (None, "8:00", None)]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string")
    got = [r.h for r in hours_between(df, "a", "b", "h").collect()]
    assert got == [c[2] for c in cases]


def test_words(spark):
    df = _column(spark, ["\t No ", None])
    rows = df.select(norm_token(F.col("c")), clean_name(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("no", "No"), (None, "")]


def _records(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_days_by_type(spark):
    df = spark.createDataFrame(
        [("Full Day", None), (" AM Half Day ", "9"), ("Custom Duration", "7.5"),
         ("Custom Duration", "x"), ("Custom Duration", "-7.5"), ("Sick", "3"), (None, "3")],
        "`Absence Type` string, Duration string",
    )
    got = [r[0] for r in df.select(absence_days_exact(df)).collect()]
    assert got == [1.0, 0.5, 1.0, 0.0, -1.0, 0.0, 0.0]
    present = df.withColumn("Absence_Days", F.lit("kept"))
    assert {r[0] for r in present.select(absence_days_exact(present)).collect()} == {"kept"}


def test_days_by_priority(spark):
    schema = ("Absence_Days string, `Days of Absence` string, Duration string, "
              "`Absence Reason Usage (Hours)` string, `Start Time` string, `End Time` string, "
              "`Absence Type` string")
    cases = [
        (("2", "1", "7.5", None, None, None, "Full Day"), 2.0),
        (("-2", "0.5", "7.5", None, None, None, "Full Day"), 0.5),
        ((None, "-1", "3.75", "7.5", None, None, "Full Day"), 0.5),
        ((None, None, None, "15", None, None, "Full Day"), 2.0),
        # a negative duration skips usage hours and goes on to the times
        ((None, None, "-1", "15", "8:00", "15:30", "Full Day"), 1.0),
        ((None, None, "-1", "15", "15:30", "8:00", "Full Day"), 1.0),
        ((None, None, "x", None, "8:00 AM", None, "PM Half Day"), 0.5),
        ((None, None, None, None, None, None, "Sick"), 0.0),
        ((None, None, None, None, None, None, None), 0.0),
    ]
    df = spark.createDataFrame([c for c, _ in cases], schema)
    assert [r.Absence_Days for r in absence_days_priority(df).collect()] == [d for _, d in cases]


def test_cells_that_are_no_numbers_are_not_cast(spark):
    """A cast of what the pattern left empty throws an exception for each cell."""
    df = spark.createDataFrame([("12d",), ("",), (" 7.5\n",), ("1e3",), (None,)], "t string")
    read = df.select(to_number(F.col("t"), df.schema["t"].dataType).alias("x"))
    assert [r.x for r in read.collect()] == [None, None, 7.5, 1000.0, None]
    assert "CASE WHEN RLIKE" in read._jdf.queryExecution().analyzed().toString()
