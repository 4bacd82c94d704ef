import pytest
from pyspark.sql import functions as F

from absentia.config import RowFilters, RuleConfig
from absentia.operators import columns as cols
from absentia.operators import filters, rules
from absentia.operators.validation import cleaning_stats, validate, validation_report
from absentia.plans.cleaning import clean_adaptive, clean_exact
from absentia.vocabulary import KEEP_AS_IS


def _pairs(spark, pairs, a="Filled", b="Needs Substitute"):
    return spark.createDataFrame(pairs, f"`{a}` string, `{b}` string")


def test_rule1_exact_keeps_unknown(spark):
    pairs = [("Unfilled", "NO"), ("Unfilled", "YES"), ("Filled", "NO"), ("Unfilled", None),
             (None, "NO"), (None, None), ("unfilled", "NO")]
    kept = rules.rule1_exact(_pairs(spark, pairs)).collect()
    assert [tuple(r) for r in kept] == pairs[1:]


@pytest.mark.parametrize("names", [("Filled", "Needs Substitute"),
                                   ("Is Filled", "Substitute Is Required")])
def test_rule1_reads_any_wording(spark, names):
    gone = [("Unfilled", "NO"), ("No", "No"), ("0", "0.00"), (" n ", "FALSE"), ("0.0", "-0"),
            ("0e3", ".0")]
    kept = [("Filled", "YES"), ("Unfilled", "YES"), ("", "NO"), ("nan", "NO"), ("N/A", "NO"),
            (None, "NO"), ("No", None), ("0f", "NO"), ("10", "NO"), ("none", "none")]
    got = rules.rule1(_pairs(spark, gone + kept, *names)).collect()
    assert [tuple(r) for r in got] == kept


def test_rule1_reads_numbers_and_needs_both_columns(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 0), (None, 0)], "Filled double, `Needs Substitute` int")
    assert rules.rule1(df).count() == 2
    assert rules.rule1(df.drop("Filled")).count() == 3


def test_rule2(spark):
    df = spark.createDataFrame([("Teacher",), ("Aide",), (None,)], "`Employee Type` string")
    assert rules.rule2(df).count() == 1
    assert rules.rule2(df, ["Aide"]).first()[0] == "Aide"
    assert rules.rule2(df, []).count() == 3


def test_rule3_on_text(spark):
    rows = [("2020-2021", "2020-07-01"), ("2020-2021", "7/1/2021"), ("2020-2021", "bad"),
            ("FY21", "bad"), (None, "bad"), ("2020-2021", None), ("20-21", "2021-01-01"),
            ("2020-2021", "2021-06-30 10:00:00")]
    df = spark.createDataFrame(rows, "`School Year` string, Date string")
    assert [tuple(r) for r in rules.rule3(df).collect()] == [rows[i] for i in (0, 3, 4, 5)]


def test_filters(spark):
    df = spark.createDataFrame(
        [("1/2/2021", "Teacher"), ("2021-03-31", "Aide"), ("bad", "Teacher")],
        "Date string, `Employee Type` string")
    both = RowFilters(date_range=("2021-01-02", "2021-03-31"))
    assert filters.filter_rows(df, both).count() == 2
    assert filters.filter_rows(df, RowFilters(date_range=("2021-01-02", None))).count() == 3
    assert filters.filter_rows(df, RowFilters(filled_status=("Filled",))).count() == 3
    once = filters.filter_rows(df, RowFilters(employee_type=("Aide",)))
    assert filters.filter_rows(once, RowFilters(employee_type=("Aide",))).count() == once.count() == 1
    with pytest.raises(ValueError):
        filters.filter_rows(df, RowFilters(employee_type=("Nobody",)), require_rows=True)


def test_selection(spark):
    df = spark.createDataFrame([(1, 2, "x")], "a int, b int, `hire_date` string")
    assert cols.select_strict(df, ["b", "a", "b"]).columns == ["b", "a"]
    with pytest.raises(ValueError):
        cols.select_strict(df, ["a", "z"])
    assert cols.select_present(df, ["z", "a"]).columns == ["a"]
    with pytest.raises(ValueError):
        cols.select_present(df, ["z"])
    assert cols.drop_hire_date(df).columns == ["a", "b"]
    assert cols.drop_hire_date(df.select("hire_date")).columns == ["hire_date"]


def test_alias_suggestions():
    got = cols.suggest_mapping(["Emp ID", "Absence Date", "Hire Date", "SY", "percent of day",
                                "Is Filled", "Nonsense", "id", "EMPLOYEE_TYPE"])
    assert got == {"Emp ID": "Employee Identifier", "Absence Date": "Date", "SY": "School Year",
                   "percent of day": "Absence_Days", "Is Filled": "Filled",
                   "id": "Employee Identifier", "EMPLOYEE_TYPE": "Employee Type"}


def test_mapping_merge_and_warnings():
    suggested = {"a": "Date", "hire": "Date", "b": "Duration", "gone": "Reason", "c": "Filled"}
    merged = cols.merge_mappings({"c": "Reason"}, suggested, ["a", "b", "c", "hire"])
    assert merged == {"a": "Date", "c": "Reason"}
    assert len(cols.mapping_warnings({})) == 3
    assert cols.mapping_warnings({"a": "Date", "b": "Employee Identifier", "c": "Duration"}) == []


def test_rename(spark):
    df = spark.createDataFrame([("2021-08-01", "1", "2", "x")], "date string, a string, b string, c string")
    renamed = cols.rename_map(df, {"a": "Filled", "b": "Filled", "c": KEEP_AS_IS, "no": "Date"})
    assert renamed.columns == ["date", "Filled", "c"] and renamed.first()["Filled"] == "1"
    year = cols.rename_map(df, {"date": "School Year"})
    assert year.columns == ["a", "b", "c", "School Year"]
    assert year.first()["School Year"] == "2021-2022"
    clash = cols.rename_map(df, {"a": "Date"})
    assert clash.columns == ["date.1", "Date", "b", "c"] and clash.first()["Date"] == "1"


def test_duplicates(spark):
    df = spark.createDataFrame([("1", "x", "2", "y"), (None, "x", "bad", "y"), ("1", "x", None, "y")],
                               "a string, b string, c string, d string")
    twice = df.toDF("Absence_Days", "Reason", "Absence_Days", "Reason")
    assert cols.dedup_header(twice).columns == ["Absence_Days", "Reason"]
    merged = cols.merge_duplicates(twice).collect()
    assert [tuple(r) for r in merged] == [(3.0, "x"), (0.0, "x"), (1.0, "x")]
    named = cols.normalize_for_rating(df.toDF("Absence_Days", "Emp ID", "Days", "Fiscal Year"))
    assert named.columns == ["Absence_Days", "Employee Identifier", "School Year"]
    assert named.first()["Absence_Days"] == 3.0


def test_require_and_derive(spark):
    df = spark.createDataFrame([("3/4/2021", "e", "1")], "Date string, `Employee Identifier` string, Absence_Days string")
    with pytest.raises(ValueError, match="School Year"):
        cols.require_columns(df)
    derived = cols.require_columns(cols.derive_school_year(df))
    assert derived.first()["School Year"] == "2020-2021"


def test_name_headings():
    assert cols.pick_name_columns(["First Name", "Last_Name"]) == ("First Name", "Last_Name")
    assert cols.pick_name_columns(["Employee First Name", "Given", "Surname", "Last Name"]) == (
        "Given", "Surname")
    assert cols.pick_name_columns(["x", "Name (first)"]) == ("Name (first)", None)


RAW = """`School Year` string, Date string, `Employee Identifier` string, `Absence Type` string,
Duration string, Filled string, `Needs Substitute` string, `Employee Type` string"""
ROWS = [
    ("2020-2021", "2020-09-01", "1", "Full Day", None, "Filled", "YES", "Teacher"),
    ("2020-2021", "9/2/2020", "1", "Sick", "7.5", "No", "No", "Teacher"),
    ("2020-2021", "bad", "2", "Full Day", None, "Filled", "YES", "Teacher"),
    ("FY21", "2020-09-03", None, "Full Day", "-1", "Filled", "YES", "Aide"),
    ("2019-2020", "2020-09-04", "3", "Full Day", None, "Filled", "YES", "Teacher"),
    (None,) * 8,
]


def test_validation(spark):
    df = spark.createDataFrame(ROWS, RAW)
    report = {r.check: r.n for r in validation_report(df).collect()}
    assert report == {"missing_required_columns": 0, "empty_rows": 1, "bad_dates": 1,
                      "negative_durations": 1, "malformed_school_years": 1,
                      "missing_employee_ids": 1, "rows_removed": 2, "final_rows": 4}
    assert validate(df).count() == 4
    missing = {r.check: r.n for r in validation_report(df.drop("Date", "Absence Type")).collect()}
    assert missing["missing_required_columns"] == 2 and missing["final_rows"] == 5


def test_empty_frame(spark):
    df = spark.createDataFrame([], RAW)
    assert {r.n for r in validation_report(df).collect()} == {0}
    assert cleaning_stats(df).first().final_rows == 0
    assert clean_adaptive(df).count() == 0


def test_cleaning(spark):
    df = spark.createDataFrame(ROWS, RAW)
    assert [r["Absence_Days"] for r in clean_adaptive(df).collect()] == [1.0]
    stats = cleaning_stats(df).first()
    assert tuple(stats) == (6, 4, 3, 2, 1, 1, 5)
    open_types = RuleConfig(user_filtered_types=True, apply_school_year_rule=False)
    assert clean_adaptive(df, open_types).count() == cleaning_stats(df, open_types).first()[-2] == 2
    # the exact variant has no semantic wording, no validation and no Rule 3
    assert clean_exact(df).count() == 4
