import time

import pytest
from pyspark.sql import functions as F

from absentia.config import RatingParams, RowFilters
from absentia.operators import profile
from absentia.plans.end_to_end import rate_file
from absentia.sources import headers
from absentia.sources.csv_files import (
    layouts_of,
    require_rows,
    scan_csv,
    scan_known,
    scan_layouts,
    sink_csv,
)
from absentia.sources.runs import read_runs
from absentia.sources.storage import settle, shared_folder


def _file(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_scan(spark, tmp_path):
    path = _file(tmp_path, "a.csv", 'Emp ID,Date,Date,,Reason\n00123,2021-01-01,x,N/A,"say ""hi"", ok"\n'
                 "NA,None,NO,n/a,\n,,,,\n")
    df = scan_csv(spark, path)
    assert df.columns == ["Emp ID", "Date", "Date.1", "Unnamed: 3", "Reason"]
    assert [tuple(r) for r in df.collect()] == [
        ("00123", "2021-01-01", "x", None, 'say "hi", ok'),
        (None, None, "NO", None, None), (None,) * 5]


def test_scan_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="format"):
        scan_csv(spark, _file(tmp_path, "a.xlsx", "x"))
    with pytest.raises(ValueError, match="no rows"):
        require_rows(scan_csv(spark, _file(tmp_path, "b.csv", "a,b\n")))
    with pytest.raises(ValueError, match="empty"):
        scan_csv(spark, _file(tmp_path, "c.csv", ""))


def test_row_order_follows_the_file(spark, tmp_path):
    path = _file(tmp_path, "a.csv", "v\n" + "\n".join(str(i) for i in range(200)))
    df = scan_csv(spark, path, with_row_order=True)
    assert [r.v for r in df.orderBy("_row_order").collect()] == [str(i) for i in range(200)]


def test_layouts_join_by_name(spark, tmp_path):
    a = _file(tmp_path, "a.csv", "Emp ID,SY\n1,2020-2021\n")
    b = _file(tmp_path, "b.csv", "Staff,Day\n2,2021-01-01\n")
    df = scan_layouts(spark, [(a, {"Emp ID": "Employee Identifier", "SY": "School Year"}),
                              (b, {"Staff": "Employee Identifier", "Day": "Date"})])
    assert {tuple(r) for r in df.select("Employee Identifier", "School Year", "Date").collect()} == {
        ("1", "2020-2021", None), ("2", None, "2021-01-01")}


def _folder(tmp_path, files):
    folder = tmp_path / "in put [1]"  # characters that paths and globs treat apart
    folder.mkdir()
    for name, text in files.items():
        _file(folder, name, text)
    return str(tmp_path / "in put*")


def test_files_are_read_under_their_own_header(spark, tmp_path):
    path = _folder(tmp_path, {
        "a 1.csv": "Emp ID,Date,Days\n1,2021-01-01,0.5\n", "b.csv": "Date,Days,Emp ID\n2021-01-02,1,2\n",
        "c%20.csv": "Emp ID,Date,Days\n3,,\n", "empty.csv": "", "blank.csv": "\n\n",
        "headed.csv": "Days,Emp ID,Date\n"})
    df = scan_csv(spark, path, with_row_order=True)
    assert df.columns[:3] == ["Emp ID", "Date", "Days"]
    assert {tuple(r)[:3] for r in df.collect()} == {
        ("1", "2021-01-01", "0.5"), ("2", "2021-01-02", "1"), ("3", None, None)}


def test_other_columns_are_an_error_that_names_files(spark, tmp_path):
    path = _folder(tmp_path, {
        "a.csv": "x,y\n1,2\n", "b.csv": "x,y\n1,2\n", "rogue.csv": "x,z\n1,2\n", "cased.csv": "X,y\n1,2\n"})
    with pytest.raises(ValueError, match="other columns than .*/a.csv: .*(cased|rogue).csv"):
        scan_csv(spark, path)


def test_known_layouts_are_told_apart(spark, tmp_path):
    path = _folder(tmp_path, {
        "a.csv": "Emp ID,SY,Other\n1,2020-2021,o\n", "b.csv": "Day,Staff\n2021-01-01,2\n",
        "b2.csv": "Staff,Day\n3,2021-01-03\n", "r.csv": "region,name\n1,x\n"})
    known = [{"Emp ID": "Employee Identifier", "SY": "School Year"},
             {"Staff": "Employee Identifier", "Day": "Date"}]
    with pytest.raises(ValueError, match="no known layout: .*/r.csv$"):
        scan_known(spark, path, known)
    df = scan_known(spark, path, known, unknown="leave out")
    got = df.select("Employee Identifier", "School Year", "Date", "Other").collect()
    assert {tuple(r) for r in got} == {
        ("1", "2020-2021", None, "o"), ("2", None, "2021-01-01", None), ("3", None, "2021-01-03", None)}
    with pytest.raises(ValueError, match="no known layout"):
        scan_known(spark, path, [{"Nobody": "Date"}], unknown="leave out")


def test_layouts_are_counted_not_listed(spark, tmp_path):
    """Many files of one layout come back as one; a name for each only if they differ."""
    files = {f"{i}.csv": "a,b\n1,2\n" for i in range(30)}
    one = layouts_of(spark, _folder(tmp_path, files))
    assert [(x.cells, x.n_files, x.files, x.has_rows) for x in one] == [(("a", "b"), 30, None, True)]


def test_headers_cost_a_short_read(spark, tmp_path):
    """Tasks stop after the first lines: one of 50 MB reads no more than some batches."""
    row = "x" * 99 + "\n"
    path = _file(tmp_path, "big.csv", "a\n" + row * 500_000)
    starts = headers._file_starts(spark, [path])
    start = time.perf_counter()
    (found,) = starts.collect()
    assert len(found["lines"]) == headers._LINES
    read = time.perf_counter() - start
    start = time.perf_counter()
    assert spark.read.text(path).selectExpr("sum(length(value))").first()[0] > 49_000_000
    assert read < 5 + time.perf_counter() - start


def test_only_first_lines_leave_the_scan_of_headers(spark, tmp_path):
    """Python is fed 32 lines a file; lines of blanks of any kind do not count."""
    blanks = " \t\n\u00a0\n\x1c\x1f\n\n" * 20
    path = _file(tmp_path, "long.csv", blanks + "a\n" + "x\n" * 500)
    starts = headers._file_starts(spark, [path])
    assert [r["lines"] for r in starts.collect()] == [["a"] + ["x"] * 31]
    plan = starts._jdf.queryExecution().optimizedPlan().toString()
    fed = plan[plan.index("MapInArrow"):]
    assert f"< {headers._LINES})" in fed and "monotonically_increasing_id" in fed


@pytest.mark.parametrize("text", [
    'id,note,day\n1,"a\nb",x\n', 'id,note,day\n"1\n2",b,x\n', 'id,note,day\n1,b,"x\ny"\n',
    'id,note,day\n1,b,"x ""q"" \n\n y"\n'])
def test_line_breaks_in_cells_are_found(spark, tmp_path, text):
    path = _file(tmp_path, "a.csv", "id,note,day\n" + 'p,q,"r ""s"""\n' * 50 + text.partition("\n")[2])
    with pytest.raises(Exception, match="multi_line=True"):
        scan_csv(spark, path).select("day").collect()
    with pytest.raises(Exception, match="multi_line=True"):
        scan_csv(spark, path).count()
    assert scan_csv(spark, path, multi_line=True).count() == 51
    assert scan_csv(spark, path, check_records=False).count() > 51


def test_ragged_records_are_no_line_breaks(spark, tmp_path):
    path = _file(tmp_path, "a.csv", 'a,b,c\n1\n1,2,3,4\n"x ""y""",2\n')
    got = [tuple(r) for r in scan_csv(spark, path).collect()]
    assert got == [("1", None, None), ("1", "2", "3"), ('x "y"', "2", None)]


def test_headings_with_line_breaks(spark, tmp_path):
    path = _file(tmp_path, "a.csv", 'a,"b\nc"\n1,2\n')
    with pytest.raises(ValueError, match="multi_line"):
        scan_csv(spark, path)
    df = scan_csv(spark, path, multi_line=True)
    assert df.columns == ["a", "b\nc"] and [tuple(r) for r in df.collect()] == [("1", "2")]


def test_sink_keeps_blanks_and_quotes(spark, tmp_path):
    rows = [(' a "b", c ', "1"), (None, "2")]
    df = spark.createDataFrame(rows, "t string, n string")
    folder = str(tmp_path / "out")
    sink_csv(df, folder, {"t": "t (T)"})
    back = scan_csv(spark, folder)
    assert back.columns == ["t (T)", "n"] and {tuple(r) for r in back.collect()} == set(rows)


class _Session:
    """Stands for a session with a given master and checkpoint setting."""

    def __init__(self, master, folder):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": lambda _, key, default: folder})()


def test_shared_folder_is_the_cluster_setting():
    assert shared_folder(_Session("yarn", "hdfs://shared/checkpoints/")) == "hdfs://shared/checkpoints"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_Session("yarn", None))
    assert shared_folder(_Session("local[2]", None))


def test_settled_table_is_read_from_files(spark):
    settled = settle(spark.range(3))
    assert settled.count() == 3 and settled.inputFiles()


CSV = """Emp ID,Absence Date,First Name,Surname,Kind Of Day,Duration,Is Filled,Substitute Is Required,Employee Type,Hire Date
001,2020-09-01,Ann,Lee,Full Day,7.5,Filled,YES,Teacher,2001-01-01
001,9/2/2020,Anne,Lee,Full Day,15,Filled,YES,Teacher,2001-01-01
002,2020-10-01,Bo,Kim,Sick,75,No,No,Teacher,2001-01-01
003,2021-10-01,Cy,Roe,Sick,75,Filled,YES,Aide,2001-01-01
"""


def test_file_to_rating_and_history(spark, tmp_path):
    path, runs = _file(tmp_path, "d.csv", CSV), str(tmp_path / "runs")
    p = RatingParams(deductible=1, cc_days=5)
    rated = rate_file(spark, path, params=p, runs_folder=runs, user_email="u@example.org", run_id="r1")
    assert rated.mapping["Emp ID"] == "Employee Identifier" and "Hire Date" not in rated.mapping
    # The raw pair is renamed to the standard one, the year comes from the date.
    assert {"Filled", "Needs Substitute"} <= set(rated.selected.columns)
    assert [tuple(r)[:2] for r in rated.tables.year_metrics.collect()] == [("2020-2021", 1)]
    detail = rated.tables.cc_range_details.collect()
    assert [tuple(r)[:4] for r in detail] == [("001", "Ann", "Lee", 3.0)]
    run = read_runs(spark, runs).first()
    assert (run.status, run.rows_raw, run.rows_selected, run.rows_cleaned, run.total_teachers) == (
        "success", 4, 4, 2, 1)
    assert run.total_premium == pytest.approx(2 * 150 * 1.3) and len(run.dataset_fingerprint) == 16
    # A filter on types switches Rule 2 off.
    aides = rate_file(spark, path, params=p, filters=RowFilters(employee_type=("Aide",)))
    assert aides.tables.summary.first().total_teachers == 1


def test_failure_is_recorded(spark, tmp_path):
    path, runs = _file(tmp_path, "d.csv", "a,b\n1,2\n"), str(tmp_path / "runs")
    with pytest.raises(ValueError):
        rate_file(spark, path, runs_folder=runs)
    run = read_runs(spark, runs).first()
    assert (run.status, run.step) == ("error", "calculate")
    assert "Traceback" in run.error_message


def test_profiles(spark):
    df = spark.createDataFrame(
        [("b", 1.0, "7"), ("a", 2.0, "8"), ("b", None, "7"), (None, 3.0, "9")],
        "w string, n double, t string")
    assert [tuple(r) for r in profile.top_values(df, "w", 1).collect()] == [("b", 2)]
    view = {(r.column_name, r["rank"]): (r.value, r.number_value)
            for r in profile.column_value_view(df, n=2).collect()}
    assert view == {("w", 1): ("b", None), ("w", 2): ("a", None), ("n", 1): (None, 1.0),
                    ("n", 2): (None, 3.0), ("t", 1): (None, 7.0), ("t", 2): (None, 9.0)}
    assert {tuple(r) for r in profile.null_counts(df).collect()} == {("w", 1), ("n", 1), ("t", 0)}
    info = profile.file_info(df).collect()
    assert [(r.position, r.column_name, r.n_rows, r.n_columns) for r in info] == [
        (0, "w", 4, 3), (1, "n", 4, 3), (2, "t", 4, 3)]
    assert [r[0] for r in profile.preview(df, ["t", "w", "n"], 2).select("n").collect()] == ["1.0", None]
