"""Free wordings of dates beside a general parser, and each text parsed once."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from absentia.functions import date_words
from absentia.functions.dates import parse_mixed_date
from absentia.operators import coded

# Texts that both read alike.
AGREED = """4 March 2021|March 4 2021|Mar 4th 2021|Thu, 4 Mar 2021|2021.03.04|4-Mar-21|20210304 10:00
4th of March 2021|March 4th, 2021 at 5:30 PM|Mar. 4, 2021|4 Mar 2021 10:00:05|Thursday, March 4, 2021
2021 March 4|2021-Mar-04|04.03.2021|25.12.2021|3 4 2021|March 2021|2021 March|Mar-2021|03/2021
10:30 4 March 2021|5:30 pm March 4, 2021|4 March 2021 5pm|4 March 2021 12 am|20210304T1000
20210304T100005|20210304100005|202103041000|March 4, 2021 10:00:05.250 PM|Sep 4 21|4 mar 99|04.03.21
25-12-21|3-4-21|4march2021|Mar4,2021|4/Mar/2021|2021/Mar/4|Sat 4 Sep 2021 08:00|On March 4 2021
March 4, 2021, 10:00 a.m.|2021 03 04|2021.3.4 10:00|8:30 AM 3/4/2021|March 4, '21|2021-03-04 Thu
Thu 2021-03-04|may 5 2021|5 may 2021 0:05|1 Sept 2020|31 december 1999|29 Feb 2020
13/13/2021|32 March 2021|30 February 2021|March|hello|4 Marchember 2021|4 5 6 7|March 4 2021 25:00
4 March 2021 13 pm|20211301|Mon|5 pm|4 March 20211|4 March, 10:00|2021-W10-4|Q1 2021|4 mars 2021|1.5
44259|99|29 Feb 2021""".replace("\n", "|").split("|")
# Deliberately not read: what stands for another day tomorrow, or could be any number.
UNREAD = ["2021", "10:00", "2021.5", "March 4 2021 10", "99 Mar 4", "4 March 2021 10:00 UTC", "", None]


def test_wordings_agree_with_a_general_parser(spark):
    df = spark.createDataFrame([(t,) for t in AGREED], "t string")
    found = df.select("t", parse_mixed_date(F.col("t")).alias("d")).collect()
    assert sum(r.d is not None for r in found) > 50
    for r in found:
        want = pd.to_datetime(pd.Series([r.t]), errors="coerce", format="mixed")[0]
        assert (None if want is pd.NaT else want.to_pydatetime()) == r.d, r.t


def test_unread_wordings(spark):
    df = spark.createDataFrame([(t,) for t in UNREAD], "t string")
    assert all(r.d is None for r in df.select(parse_mixed_date(F.col("t")).alias("d")).collect())


def test_every_listed_wording_has_what_a_date_needs():
    for wording, parts in date_words._TABLE.items():
        assert set(parts) & set("ytcef"), wording
        assert set(parts) & set("macef"), wording
        assert set(parts) <= set(date_words._PARTS)
        assert len(parts) == len(wording.replace(".", " ").replace(":", " ").split())


@pytest.fixture
def cells(spark):
    texts = ["2021-01-02", "3/4/2021", "bad", "4 March 2021", None, "`", ""] + [f"{d} May 2020" for d in range(1, 30)]
    rows = [(i, texts[i % 90 if i % 90 < len(texts) else 0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, `a day` string")
    return df.withColumns({"n": F.lit(1), "_x": F.lit(2)})


@pytest.mark.parametrize("rows, repeats, once", [(0, 8, True), (0, 100_000, False), (100_000, 8, False)])
def test_texts_are_parsed_once_where_it_pays(spark, cells, monkeypatch, rows, repeats, once):
    monkeypatch.setattr(coded, "WORTH_ROWS", rows)
    monkeypatch.setattr(coded, "REPEATS", repeats)
    settled = []
    real = coded.settle
    monkeypatch.setattr(coded, "settle", lambda df, name: settled.append(real(df, name)) or settled[-1])
    found = coded.parse_dates_once(cells, "a day", "d")
    assert found.columns == [*cells.columns, "d"]
    direct = cells.withColumn("d", parse_mixed_date(F.col("`a day`")))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, direct.collect()), key=str)
    assert [t.count() for t in settled] == ([35] if once else [])


def test_a_parsed_column_can_take_its_place(spark, cells, monkeypatch):
    monkeypatch.setattr(coded, "WORTH_ROWS", 0)
    found = coded.parse_dates_once(cells, "a day", "a day")
    assert found.columns == cells.columns and dict(found.dtypes)["a day"] == "timestamp_ntz"
    assert found.where("`a day` = timestamp_ntz'2021-01-02'").count() > 1000


def test_hot_and_missing_texts_take_ways_of_their_own(spark, cells, monkeypatch):
    """Without broadcasts by size the light texts are shuffled; the result is the same."""
    monkeypatch.setattr(coded, "WORTH_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = coded.parse_dates_once(cells, "a day", "d")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
        assert found.where("d is not null").count() == cells.withColumn(
            "d", parse_mixed_date(F.col("`a day`"))
        ).where("d is not null").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
