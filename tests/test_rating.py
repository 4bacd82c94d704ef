import random
from collections import defaultdict
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from absentia.config import RatingParams
from absentia.operators import rating, totals
from absentia.plans import report
from absentia.plans.rate import rate_adaptive, rate_exact

FRAME = "`School Year` string, `Employee Identifier` string, Absence_Days double"


def _tables(spark, rows, params=RatingParams()):
    return rate_adaptive(spark.createDataFrame(rows, FRAME), params)


def _one_total(spark, t, **terms):
    return _tables(spark, [("2020-2021", "e", float(t))], RatingParams(**terms)).summary.first()


@pytest.mark.parametrize("t, cc, excess, bands", [
    (50, 30.0, 0.0, (0, 1, 0)),
    (100, 0.0, 20.0, (0, 0, 1)),
    (20, 0.0, 0.0, (1, 0, 0)),
    (80, 60.0, 0.0, (0, 1, 0)),
])
def test_worked_examples(spark, t, cc, excess, bands):
    row = _one_total(spark, t)
    assert (row.total_cc_days, row.excess_days) == (cc, excess)
    assert (row.below_deductible_count, row.num_staff_cc_range, row.num_high_claimant) == bands


def test_zero_terms(spark):
    rows = [("y", "a", 0.0), ("y", "b", 0.5), ("y", "c", 70.0)]
    free = _tables(spark, rows, RatingParams(deductible=0)).summary.first()
    assert (free.below_deductible_count, free.num_staff_cc_range, free.num_high_claimant) == (1, 1, 1)
    none = _tables(spark, rows, RatingParams(cc_days=0)).summary.first()
    assert (none.num_staff_cc_range, none.total_premium, none.num_high_claimant) == (0, 0.0, 1)


def test_defaults():
    p = RatingParams()
    assert (p.deductible, p.cc_days, p.cc_maximum, p.replacement_cost) == (20, 60, 80, 150.0)
    assert (p.carrier_rate, p.acquisition_rate, p.school_year_days) == (0.15, 0.15, 180)


def test_thirds_reach_the_deductible_exactly(spark):
    rows = [(f"y{i}", "e", 1 / 3) for i in range(15)]
    row = _tables(spark, rows, RatingParams(deductible=5)).summary.first()
    assert row.below_deductible_count == 1


def test_unknown_keys(spark):
    rows = [("y", "a", 1.0), (None, "b", 2.0), ("y", None, 4.0), (None, None, 8.0), ("y", "c", None)]
    tables = _tables(spark, rows)
    summary = tables.summary.first()
    assert (summary.overall_total_staff, summary.total_teachers) == (3, 2)
    assert summary.overall_total_absences_exact == 15.0
    year = tables.year_metrics.collect()
    assert [tuple(r)[:3] for r in year] == [("y", 2, 5.0)]
    assert tables.year_breakdown.first().total_teachers == 2


def test_truncation_and_no_rows(spark):
    assert _one_total(spark, 7.9).overall_total_absences == 7
    empty = _tables(spark, [])
    assert empty.summary.first().total_teachers == 0
    assert empty.year_breakdown.count() == 0
    assert report.headline_avg(empty.year_figures, RatingParams()).count() == 0


def test_excess_of_all_days(spark):
    book = _tables(spark, [("y", "e", 100.0)]).ledger
    row = rating.rating_summary(book, RatingParams(), "all_days").first()
    assert row.excess_days == 100.0
    detail = rating.high_claimant_details(book, RatingParams(), "all_days").first()
    assert detail.calculation == "All days counted: 100.0"


def test_exact_variant_counts_whole_totals(spark):
    df = spark.createDataFrame([("y", "e", 50.0)], FRAME)
    row = rate_exact(df).first()
    assert (row.total_cc_days, row.total_premium) == (50.0, pytest.approx(50 * 150 * 1.3))


def test_names_come_from_the_first_row(spark):
    schema = FRAME + ", `First Name` string, Surname string, place int"
    rows = [("y", "a", 15.0, " Ann ", None, 2), ("y", "a", 15.0, "Anna", "Z", 3),
            (None, "a", 1.0, None, "First", 1), ("y", "b", 100.0, "Bo", "Lee", 4),
            (None, None, 1.0, "No", "One", 0)]
    tables = rate_adaptive(spark.createDataFrame(rows, schema), RatingParams(), ["place"])
    cc = tables.cc_range_details.collect()
    assert [tuple(r) for r in cc] == [
        ("a", "", "First", 30.0, 10.0, "min(30.0 - 20, 80 - 20) = 10.0")]
    high = tables.high_claimant_details.collect()
    assert [tuple(r) for r in high] == [("b", "Bo", "Lee", 100.0, 20.0, "100.0 - 80 = 20.0")]
    frame = totals.rating_frame(spark.createDataFrame(rows, schema), True, ["place"])
    names = totals.employee_names(frame)
    joined = totals.join_employee_names(
        spark.createDataFrame([("a",), ("ghost",)], "employee_id string"), names)
    assert {tuple(r) for r in joined.collect()} == {("a", "", "First"), ("ghost", "", "")}


def test_first_row_per_employee(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), (None, 5, "u"), (None, 4, "v")]
    df = spark.createDataFrame(rows, "`Employee Identifier` string, place int, v string")
    got = totals.first_row_per_employee(df, ["place"]).collect()
    assert {tuple(r) for r in got} == {("a", 1, "y"), (None, 4, "v")}


def test_hot_employee_and_year_against_brute_force(spark):
    """A third of the rows belong to one employee and most to one year."""
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        e = "hot" if i % 3 == 0 else f"e{rng.randrange(300)}"
        y = "2020-2021" if rng.random() < 0.7 else f"{rng.randrange(2015, 2019)}"
        rows.append((y, e, rng.randrange(0, 60) / 7.5 / 4))
    p = RatingParams(deductible=5, cc_days=10)
    year_total = defaultdict(Decimal)
    for y, e, d in rows:
        year_total[y, e] += Decimal(round(d * 30)) / 30
    want = defaultdict(lambda: [0, 0, 0, 0, Decimal(0), Decimal(0)])
    for (y, _), t in year_total.items():
        t, w = round(t, 9), want[y]
        w[0] += 1
        if t <= 5:
            w[1] += 1
        elif t <= 15:
            w[2] += 1
            w[4] += min(t - 5, 10)
        else:
            w[3] += 1
            w[5] += t - 15
    for r in _tables(spark, rows, p).year_breakdown.collect():
        w = want.pop(r.school_year)
        assert list(r)[1:5] == w[:4]
        assert r.total_cc_days == pytest.approx(float(w[4]), abs=1e-5)
        assert r.excess_days == pytest.approx(float(w[5]), abs=1e-5)
        assert r.premium == pytest.approx(float(w[4]) * 150 * 1.3, abs=1e-2)
    assert not want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["y1", "y2", None]), st.sampled_from(["a", "b", "c", None]),
                  st.sampled_from([0.0, 0.5, 1 / 3, 4.0, 11.0, None])),
        min_size=1, max_size=30),
    st.integers(0, 6), st.integers(0, 6))
def test_properties(spark, rows, deductible, cc_days):
    p = RatingParams(deductible=deductible, cc_days=cc_days)
    row = _tables(spark, rows, p).summary.first()
    shuffled = _tables(spark, rows[::-1], p).summary.first()
    assert row == shuffled
    assert row.total_teachers == (
        row.below_deductible_count + row.num_staff_cc_range + row.num_high_claimant)
    assert row.total_premium == pytest.approx(row.replacement_cost_cc * 1.3, abs=1e-4)
    metrics = _tables(spark, rows, p).year_metrics.agg(F.sum("total_absences")).first()[0] or 0
    assert metrics <= row.overall_total_absences_exact + 1e-5


def test_reports(spark):
    rows = [("2020-2021", "a", 50.0), ("2021-2022", "a", 30.0), ("2021-2022", "b", 1234.5)]
    p = RatingParams()
    tables = _tables(spark, rows, p)
    shown = report.report_year_metrics(tables.year_metrics, p).collect()
    assert [r.school_year for r in shown] == ["2020-2021", "2021-2022", "5-Yr Avg"]
    assert [r.total_absences for r in shown] == ["50.00", "1,264.50", "657.2"]
    assert [r.total_staff for r in shown] == ["1", "2", "1.5"]
    assert shown[0].total_replacement_cost == "$7,500.00"
    table = report.report_breakdown(tables.year_figures).collect()
    assert table[-1].school_year == "5 yr Avg" and table[-1].total_cc_days == "20.00"
    single = _tables(spark, rows[:1], p)
    assert report.report_year_metrics(single.year_metrics, p).count() == 1
    assert report.report_breakdown(single.year_figures).count() == 2
    lines = report.report_premium(report.headline_avg(tables.year_figures, p)).collect()
    assert [r.amount for r in sorted(lines, key=lambda r: r.line)] == [
        "$3,000.00", "$450.00", "$450.00", "$3,900.00"]
    cumulative = report.headline_cumulative(tables.summary).first()
    assert (cumulative.staff_in_cc_range, cumulative.total_cc_days) == (1.0, 60.0)
    values = dict(map(tuple, report.report_parameters(spark, p).collect()))
    assert values["Carrier Profit Margin"] == "15.0%" and values["CC Maximum (Deductible + CC)"] == "80"
