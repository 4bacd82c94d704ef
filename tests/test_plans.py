"""What the plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from absentia.config import RowFilters, RuleConfig
from absentia.operators.filters import filter_school_year
from absentia.operators.rules import rule1_exact
from absentia.operators.validation import cleaning_stats, validation_report
from absentia.plans.end_to_end import rate_file
from absentia.plans.judged import row_counts
from absentia.plans.rate import rate_adaptive

# These write and read files as they are built; their plans are those of a scan.
WRITES = {"scan_csv", "sink_csv", "rate_end_to_end", "append_run", "append_failed_run",
          "scan_known_layouts", "scan_column_orders", "header_catalogue", "rate_two_layouts",
          "rate_file_counts", "parse_dates_once", "append_run_twice", "export_csv",
          "first_rows", "date_mismatches", "shared_profiles"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - WRITES))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    plan = _plan(entry.queries()[name](spark, sf_dir))
    assert not re.search(r"Python|MapInPandas|ArrowEval", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name, shuffles", [
    ("year_breakdown", 2), ("year_metrics", 2), ("teacher_days", 2), ("band_counts", 3),
    ("rating_summary", 3), ("validation_report", 1), ("cleaning_stats", 1),
    ("first_row_per_employee", 1), ("clean_adaptive", 0), ("parse_mixed_date", 0),
    ("cc_range_details", 2),
])
def test_shuffles(spark, sf_dir, name, shuffles):
    plan = _plan(entry.queries()[name](spark, sf_dir))
    raw = [line for line in plan.splitlines() if re.search(r"Exchange (hash|Single|range)", line)]
    lookups = sum("p_partkey" in x or "l_partkey" in x for x in raw)
    assert len(raw) - lookups <= shuffles, plan


def test_scan_reads_only_what_is_needed(spark, sf_dir):
    plan = _plan(entry.queries()["year_breakdown"](spark, sf_dir))
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "l_extendedprice" not in schema and "l_suppkey" not in schema


def test_filters_reach_a_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "records")
    spark.createDataFrame(
        [("Filled", "NO", "2020-2021")], "Filled string, `Needs Substitute` string, `School Year` string"
    ).write.parquet(path)
    df = filter_school_year(rule1_exact(spark.read.parquet(path)), ["2020-2021", "2021-2022"])
    pushed = re.search(r"PushedFilters: \[(.*)\]", _plan(df)).group(1)
    assert "In(`School Year`" in pushed or "In(School Year" in pushed
    assert "Not(EqualTo(Filled,Unfilled))" in pushed


CSV = """Emp ID,Date,SY,Employee Type,Duration,Filled,Needs Substitute,Start Time,End Time
1,2020-09-01,2020-2021,Teacher,7.5,Filled,YES,,
1,bad,2020-2021,Teacher,7.5,Filled,YES,,
,,,,,,,,
2,2020-10-01,2020-2021,Teacher,-1,Unfilled,NO,,
,2020-10-02,FY21,Teacher,,Filled,YES,8:00 AM,3:30 PM
3,2019-10-02,2020-2021,Teacher,15,Filled,YES,,
4,2020-10-03,2020-2021,Aide,15,Filled,YES,8:00 AM,bad
4,2020-10-04,2020-2021,Nurse,,Filled,YES,8:00 AM,9:30 AM
"""


@pytest.mark.parametrize("filters", [
    RowFilters(), RowFilters(employee_type=("Teacher", "Aide")), RowFilters(school_year=("2020-2021",)),
    RowFilters(date_range=("2020-09-01", "2020-10-02")), RowFilters(filled_status=("Filled",)),
    RowFilters(employee_type=("Nobody",))])
def test_a_file_is_rated_in_one_scan(spark, tmp_path, filters):
    """Counts that ride on the ledger equal those counted apart; nothing scans twice."""
    (tmp_path / "a.csv").write_text(CSV)
    lazy = rate_file(spark, str(tmp_path / "a.csv"), filters=filters, keep_ledger=False)
    assert _plan(lazy.book).count("FileScan csv") == 1
    rated = rate_file(spark, str(tmp_path / "a.csv"), filters=filters)
    config = RuleConfig(user_filtered_types=bool(filters.employee_type))
    assert rated.stats.collect() == cleaning_stats(rated.selected, config).collect()
    assert rated.validation.collect() == validation_report(rated.selected).collect()
    apart = rate_adaptive(rated.cleaned, order_by=["_row_order"])
    for name in ("year_metrics", "year_breakdown", "summary"):
        assert getattr(rated.tables, name).collect() == getattr(apart, name).collect()
        assert "FileScan csv" not in _plan(getattr(rated.tables, name))
    for frame in (rated.stats, rated.validation, row_counts(rated.book)):
        assert "FileScan csv" not in _plan(frame)
    counts = row_counts(rated.book).first()
    assert tuple(counts) == (rated.raw.count(), rated.selected.count(), rated.cleaned.count())
