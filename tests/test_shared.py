"""Shared scans, first rows and staff bitmaps, beside the plain operators."""

import random

import pytest
from pyspark.sql import functions as F

from absentia.config import RuleConfig
from absentia.operators import profile
from absentia.operators.staff_bitmaps import add_staff, distinct_staff, staff_bitmaps, staff_numbers
from absentia.operators.validation import cleaning_stats, validation_report
from absentia.plans import shared_scan
from absentia.sources import first_rows as first
from absentia.sources.first_rows import date_mismatches, first_rows
from workload.fixtures import raw_absences

COLUMNS = ["Date", "School Year", "Employee Identifier", "Employee Type", "Absence Type", "Duration",
           "Filled", "Needs Substitute"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _same(found, config, df):
    assert found.structure_profile.collect() == profile.structure_profile(df).collect()
    assert found.null_counts.collect() == profile.null_counts(df).collect()
    if "Date" in df.columns:
        assert found.date_range.collect() == profile.date_range(df).collect()
    if "Employee Type" in df.columns:
        assert found.distinct_types.collect() == profile.distinct_types(df).collect()
    assert found.validation_report.collect() == validation_report(df).collect()
    assert found.cleaning_stats.collect() == cleaning_stats(df, config).collect()


@pytest.mark.parametrize("without", [(), ("Date",), ("Employee Type", "Duration"), ("School Year", "Filled")])
def test_profiles_of_one_scan(spark, sf_dir, without):
    df = raw_absences(spark, sf_dir, [c for c in COLUMNS if c not in without])
    config = RuleConfig(employee_types=("Teacher",))
    found = shared_scan.profiles_of(df, config)
    _same(found, config, df)
    for name in ("structure_profile", "date_range", "distinct_types", "validation_report", "cleaning_stats"):
        plan = _plan(getattr(found, name))
        assert plan.count("FileScan") == 1 and "lineitem" not in plan


def test_profiles_come_from_a_single_read(spark, sf_dir, monkeypatch):
    read = []
    real = shared_scan.settle
    monkeypatch.setattr(shared_scan, "settle", lambda df, name: read.append(_plan(df)) or real(df, name))
    shared_scan.profiles_of(raw_absences(spark, sf_dir, COLUMNS))
    assert len(read) == 1 and read[0].count("FileScan") == 1 and read[0].count("Exchange hash") == 1


def test_profiles_of_no_rows(spark, sf_dir):
    df = raw_absences(spark, sf_dir, COLUMNS).limit(0)
    _same(shared_scan.profiles_of(df), RuleConfig(), df)


def _write(folder, files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


def test_first_rows_follow_files(spark, tmp_path):
    files = {f"{i:02d}.csv": "n,v\n" + "".join(f"{i * 10 + k},x\n" for k in range(i % 4)) for i in range(30)}
    files["05.csv"] = ""
    files["07.csv"] = "v,n\n" + "".join(f"x,{70 + k}\n" for k in range(3))
    path = _write(tmp_path / "a", files)
    want = [str(i * 10 + k) for i in range(30) for k in range(i % 4) if i != 5]
    for n in (0, 1, 5, 20, 1000):
        assert [r.n for r in first_rows(spark, path, n).collect()] == want[:n]


def test_first_rows_do_not_read_on(spark, tmp_path):
    """A later file that cannot be read, and a broken record far behind, are not met."""
    path = _write(tmp_path / "a", {"a.csv": "n,v\n" + "1,x\n" * 400_000 + '2,"broken\n', "b.csv": "n,v\n1,2\n",
                                   "c.csv.gz": "no archive"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 18)
    try:
        assert first_rows(spark, path, 5000).count() == 5000
        with pytest.raises(Exception, match="multi_line|gzip|GZIP"):
            first_rows(spark, path, 1_000_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_first_rows_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        first_rows(spark, _write(tmp_path / "e", {"a.csv": "", "b.csv": "\n"}), 5)
    path = _write(tmp_path / "o", {"a.csv": "n,v\n1,2\n", "b.csv": "n,w\n1,2\n"})
    assert first_rows(spark, path, 1).count() == 1
    with pytest.raises(ValueError, match="other columns"):
        first_rows(spark, path, 2)


def test_big_files_are_read_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(first, "TOGETHER_BYTES", 20)
    path = _write(tmp_path / "a", {f"{i}.csv": f"n\n{i}\n" * (1 + i % 2 * 3) for i in range(6)})
    runs = [len(r) for r in first._runs_of_files(spark, path)]
    assert sum(runs) == 6 and max(runs) <= 4
    assert [r.n for r in first_rows(spark, path, 3).collect()] == ["0", "1", "n"]


def test_mismatches_in_the_first_rows(spark, tmp_path):
    rows = "2020-2021,2020-09-01\n2020-2021,2021-09-01\nFY21,2020-09-01\n2019-2020,3/4/2021\n,\n"
    path = _write(tmp_path / "a", {"a.csv": "School Year,Date\n" + rows * 9})
    issues = [r.issue for r in date_mismatches(spark, path, 5).collect()]
    assert issues == ["School Year 2020-2021 has date 2021-09-01", "School Year 2019-2020 has date 3/4/2021"]
    assert date_mismatches(spark, path, 45, messages=3).count() == 3


def _book(spark, rows):
    return spark.createDataFrame(rows, "school_year string, employee_id string, days double")


def test_staff_of_any_union(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice(["y1", "y2", "y3", None]), rng.choice([None] + [f"e{i}" for i in range(50)]),
             rng.choice([None, 1.0, 0.5])) for _ in range(400)]
    # Two employees whose bits lie in other buckets.
    book = _book(spark, rows)
    numbers = staff_numbers(book)
    assert sorted(r.number for r in numbers.collect()) == list(range(numbers.count()))
    far = numbers.withColumn("number", F.col("number") * 10_007)
    for known in (numbers, far):
        bitmaps = staff_bitmaps(book, known)
        for years in (["y1"], ["y1", "y3"], ["y1", "y2", "y3"]):
            part = [r for r in rows if r[0] in years]
            got = distinct_staff(bitmaps.where(F.col("school_year").isin(years))).first()
            assert got.total_staff == len({e for _, e, _ in part} - {None})
            assert got.total_days == sum(d or 0 for _, _, d in part)
    by_year = {r.school_year: r.total_staff for r in distinct_staff(staff_bitmaps(book, numbers), ["school_year"]).collect()}
    assert by_year == {y: len({e for x, e, _ in rows if x == y} - {None}) for y in ("y1", "y2", "y3", None)}


def test_later_files_add_staff(spark):
    one, two = _book(spark, [("y1", "a", 1.0), ("y1", "b", 1.0)]), _book(spark, [("y2", "b", 1.0), ("y2", "c", 1.0)])
    numbers = staff_numbers(one)
    more = add_staff(numbers, two)
    assert sorted(r.number for r in more.collect()) == [0, 1, 2]
    both = staff_bitmaps(one, more).unionByName(staff_bitmaps(two, more))
    assert distinct_staff(both).first().total_staff == 3


def test_unions_read_bitmaps_only(spark, tmp_path):
    book = _book(spark, [(f"y{i % 3}", f"e{i}", 1.0) for i in range(1000)])
    path = str(tmp_path / "bitmaps")
    staff_bitmaps(book, staff_numbers(book)).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() <= 6  # a row for each year and bucket
    assert "employee_id" not in _plan(distinct_staff(stored)) and distinct_staff(stored).first().total_staff == 1000


def test_no_staff(spark):
    for rows in ([], [("y", None, 1.0)]):
        book = _book(spark, rows)
        got = distinct_staff(staff_bitmaps(book, staff_numbers(book))).first()
        assert (got.total_staff, got.total_days) == (0, float(len(rows)))
