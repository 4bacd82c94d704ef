"""Queries on totals: aggregates, bands, premiums, profiles, reports, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from absentia.config import RatingParams, RowFilters
from absentia.functions.numbers import round6
from absentia.functions.text import money
from absentia.operators import profile, rating, totals
from absentia.operators.columns import require_columns
from absentia.operators.staff_bitmaps import distinct_staff, staff_bitmaps, staff_numbers
from absentia.plans import report
from absentia.plans.cleaning import clean_adaptive, clean_exact
from absentia.plans.end_to_end import rate_file
from absentia.plans.judged import row_counts
from absentia.plans.rate import RatingTables, rate_adaptive, rate_exact
from absentia.plans.shared_scan import profiles_of
from absentia.sources.csv_files import export_csv, sink_csv
from absentia.sources.first_rows import date_mismatches, first_rows
from absentia.sources.runs import append_failed_run, append_run, compact_runs, read_runs, run_row
from absentia.sources.storage import new_folder, settle
from absentia.vocabulary import KEEP_AS_IS
from workload import sql
from workload.fixtures import RAW_COLUMNS, absences, raw_absences
from workload.registry import query

# Terms under which no band is empty: over all years, and within one year.
OVERALL = RatingParams(deductible=5, cc_days=10)
YEARLY = RatingParams(deductible=2, cc_days=3)

_MEASURED = ["School Year", "Date", "Employee Identifier", "Employee Type", "Absence Type",
             "Duration", "Filled", "Needs Substitute"]
_NAMES = ["Employee First Name", "Employee Last Name"]


def _cleaned(spark: SparkSession, sf: str, named: bool = False) -> DataFrame:
    columns = _MEASURED + (_NAMES + ["row_no"] if named else [])
    return clean_adaptive(absences(spark, sf, columns))


def _book(spark: SparkSession, sf: str) -> DataFrame:
    return totals.ledger(totals.rating_frame(_cleaned(spark, sf)))


def _raw_book(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger of the text records, which have unknown years and employees."""
    columns = [*_MEASURED, "Start Time", "End Time", "Days of Absence",
               "Absence Reason Usage (Hours)"]
    cleaned = clean_adaptive(raw_absences(spark, sf, columns))
    return totals.ledger(totals.rating_frame(cleaned))


def _tables(spark: SparkSession, sf: str, params: RatingParams) -> RatingTables:
    return rate_adaptive(_cleaned(spark, sf, named=True), params, ["row_no"])


# --- totals ------------------------------------------------------------------


@query("teacher_days", f"""WITH {sql.staff(sql.RAW_CLEANED)} SELECT sy AS school_year,
  e AS employee_id, round(t, 6) AS total_days FROM staff_years""")
def _teacher_days(spark, sf):
    return totals.teacher_days(_raw_book(spark, sf))


@query("employee_days", f"""WITH {sql.staff(sql.RAW_CLEANED)} SELECT e AS employee_id,
  round(t, 6) AS total_days FROM staff""")
def _employee_days(spark, sf):
    return totals.employee_days(_raw_book(spark, sf))


_B = sql.bands("t", 5, 10)


@query("band_counts", f"""WITH {sql.staff()} SELECT count(*) AS total_teachers,
  {_B['below']} AS below_deductible, {_B['inside']} AS in_cc_range, {_B['high']} AS high_claimant
  FROM staff""")
def _band_counts(spark, sf):
    return rating.band_counts(_book(spark, sf), OVERALL)


def _one(book: DataFrame, column) -> DataFrame:
    return totals.employee_totals(book).agg(column)


@query("cc_days_range_only", f"""WITH {sql.staff()} SELECT
  round({_B['cc']}::DOUBLE, 6) AS total_cc_days FROM staff""")
def _cc_days_range_only(spark, sf):
    total = round6(rating.cc_days_total(F.col("total_days"), OVERALL))
    return _one(_book(spark, sf), total.alias("total_cc_days"))


@query("cc_days_all_days", f"""WITH {sql.staff()} SELECT
  round({_B['cc_all']}::DOUBLE, 6) AS total_cc_days FROM staff""")
def _cc_days_all_days(spark, sf):
    total = round6(rating.cc_days_total(F.col("total_days"), OVERALL, "all_days"))
    return _one(_book(spark, sf), total.alias("total_cc_days"))


@query("excess_only", f"""WITH {sql.staff()} SELECT
  round({_B['excess']}::DOUBLE, 6) AS excess_days FROM staff""")
def _excess_only(spark, sf):
    total = round6(rating.excess_total(F.col("total_days"), OVERALL))
    return _one(_book(spark, sf), total.alias("excess_days"))


@query("excess_all_days", f"""WITH {sql.staff()} SELECT
  round({_B['excess_all']}::DOUBLE, 6) AS excess_days FROM staff""")
def _excess_all_days(spark, sf):
    total = round6(rating.excess_total(F.col("total_days"), OVERALL, "all_days"))
    return _one(_book(spark, sf), total.alias("excess_days"))


_COVERAGE = f"""{_B['inside']} AS num_staff_cc_range,
  round({_B['cc_all']}::DOUBLE, 6) AS total_cc_days, {_B['high']} AS num_high_claimant,
  round({_B['excess']}::DOUBLE, 6) AS excess_days,
  round(({_B['cc_all']} * 150.0)::DOUBLE, 6) AS replacement_cost_cc,
  round(({_B['excess']} * 150.0)::DOUBLE, 6) AS high_claimant_cost,
  5 AS deductible, 10 AS cc_days, 15 AS cc_maximum, 150.0::DOUBLE AS replacement_cost"""


@query("coverage_metrics", f"WITH {sql.staff()} SELECT {_COVERAGE} FROM staff")
def _coverage_metrics(spark, sf):
    return rating.coverage_metrics(_book(spark, sf), OVERALL)


@query("premium", f"""WITH {sql.staff()}, c AS (SELECT {_B['cc']} AS cc FROM staff)
  SELECT round(cc::DOUBLE, 6) AS total_cc_days, round((cc * 150.0)::DOUBLE, 6) AS replacement_cost_cc,
  round((cc * 150.0 * 0.15)::DOUBLE, 6) AS carrier_margin,
  round((cc * 150.0 * 0.15)::DOUBLE, 6) AS acquisition_cost,
  round((cc * 150.0 * 1.3)::DOUBLE, 6) AS premium FROM c""")
def _premium(spark, sf):
    return rating.premium(_book(spark, sf), OVERALL)


@query("overall_totals", f"""WITH {sql.summary(5, 10, sql.RAW_CLEANED)} SELECT overall_total_staff,
  overall_total_absences, overall_total_absences_exact, overall_total_replacement_cost FROM summary""")
def _overall_totals(spark, sf):
    return rating.overall_totals(_raw_book(spark, sf), OVERALL)


@query("year_metrics", f"""WITH {sql.metrics(sql.RAW_CLEANED)}
  SELECT {sql.METRIC_COLUMNS} FROM metrics""")
def _year_metrics(spark, sf):
    return rating.year_metrics(_raw_book(spark, sf), YEARLY)


@query("year_breakdown", f"""WITH {sql.breakdown(2, 3)}
  SELECT {sql.BREAKDOWN_COLUMNS} FROM breakdown""")
def year_breakdown(spark, sf):
    return rating.year_breakdown(_book(spark, sf), YEARLY)


_METRIC_AVG = f"""{sql.metrics()}, rows AS (
  SELECT school_year, total_staff::DOUBLE AS total_staff, total_absences, total_replacement_cost,
    0 AS is_average FROM metrics
  UNION ALL SELECT '5-Yr Avg', avg(total_staff), avg(total_absences), avg(total_replacement_cost), 1
    FROM metrics HAVING count(*) > 1)"""


@query("year_metrics_avg", f"""WITH {_METRIC_AVG} SELECT school_year,
  round(total_staff, 6) AS total_staff, round(total_absences::DOUBLE, 6) AS total_absences,
  round(total_replacement_cost::DOUBLE, 6) AS total_replacement_cost, is_average FROM rows""")
def _year_metrics_avg(spark, sf):
    return report.year_metrics_avg(rating.year_metrics(_book(spark, sf), YEARLY))


_FIELDS = report.BREAKDOWN_FIELDS
_BREAKDOWN_AVG = f"""{sql.breakdown(2, 3)}, rows AS (
  SELECT school_year, {', '.join(f'{c}::DOUBLE AS {c}' for c in _FIELDS)}, 0 AS is_average
    FROM breakdown
  UNION ALL SELECT '5 yr Avg', {', '.join(f'avg({c})' for c in _FIELDS)}, 1 FROM breakdown
    HAVING count(*) > 0)"""


@query("year_breakdown_avg", f"""WITH {_BREAKDOWN_AVG} SELECT school_year,
  {', '.join(f'round({c}, 6) AS {c}' for c in _FIELDS)}, is_average FROM rows""")
def _year_breakdown_avg(spark, sf):
    return report.year_breakdown_avg(rating.year_figures(_book(spark, sf), YEARLY))


_HEADLINE_AVG = f"""{sql.breakdown(2, 3)}, headline AS (SELECT 'average' AS basis,
  round(avg(in_cc_range), 6) AS staff_in_cc_range, round(avg(total_cc_days), 6) AS total_cc_days,
  round(avg(replacement_cost_cc), 6) AS replacement_cost_cc,
  round(avg(high_claimant), 6) AS high_claimant_staff, round(avg(excess_days), 6) AS excess_days,
  round(avg(excess_days) * 150.0::DOUBLE, 6) AS high_claimant_cost,
  round(avg(carrier_margin), 6) AS carrier_margin,
  round(avg(acquisition_cost), 6) AS acquisition_cost, round(avg(premium), 6) AS total_premium
  FROM breakdown)"""
_HEADLINE_ALL = f"""{sql.summary(5, 10)}, headline AS (SELECT 'cumulative' AS basis,
  num_staff_cc_range::DOUBLE AS staff_in_cc_range, total_cc_days, replacement_cost_cc,
  num_high_claimant::DOUBLE AS high_claimant_staff, excess_days, high_claimant_cost,
  carrier_margin, acquisition_cost, total_premium FROM summary)"""


@query("headline_avg", f"WITH {_HEADLINE_AVG} SELECT * FROM headline")
def _headline_avg(spark, sf):
    return report.headline_avg(rating.year_figures(_book(spark, sf), YEARLY), YEARLY)


@query("headline_cumulative", f"WITH {_HEADLINE_ALL} SELECT * FROM headline")
def _headline_cumulative(spark, sf):
    return report.headline_cumulative(rating.rating_summary(_book(spark, sf), OVERALL))


@query("rating_summary", f"WITH {sql.summary(5, 10, sql.RAW_CLEANED)} SELECT * FROM summary")
def _rating_summary(spark, sf):
    return rating.rating_summary(_raw_book(spark, sf), OVERALL)


_YB = sql.bands("t", 2, 3)


@query("teacher_year_stats", f"""WITH {sql.staff()} SELECT count(*) AS n_staff_years,
  round(sum(t), 6) AS sum_days, round(avg(t), 6) AS avg_days, round(max(t), 6) AS max_days,
  {_YB['below']} AS below_deductible, {_YB['inside']} AS in_cc_range, {_YB['high']} AS high_claimant
  FROM staff_years""")
def _teacher_year_stats(spark, sf):
    return rating.teacher_year_stats(_book(spark, sf), YEARLY)


# --- names and details -------------------------------------------------------

_FIRST_NAMES = """names AS (SELECT e, trim(fn) AS fn, trim(ln) AS ln FROM (SELECT *, row_number() OVER (
    PARTITION BY e ORDER BY row_no, fn, ln) AS place FROM cleaned) WHERE place = 1)"""


@query("join_employee_names", f"""WITH {sql.staff()}, {_FIRST_NAMES} SELECT staff.e AS employee_id,
  round(t, 6) AS total_days, coalesce(fn, '') AS first_name, coalesce(ln, '') AS last_name
  FROM staff LEFT JOIN names ON names.e = staff.e""")
def _join_employee_names(spark, sf):
    frame = totals.rating_frame(_cleaned(spark, sf, named=True), True, ["row_no"])
    days = totals.employee_days(totals.ledger(frame.select(
        "school_year", "employee_id", "absence_days")))
    return totals.join_employee_names(days, totals.employee_names(frame))


def _detail_sql(where: str, value: str, name: str, text: str) -> str:
    return f"""WITH {sql.staff()}, {_FIRST_NAMES}, picked AS (SELECT staff.e AS employee_id,
    coalesce(fn, '') AS employee_first_name, coalesce(ln, '') AS employee_last_name,
    round(t, 6) AS total_days, round({value}, 6) AS {name}
    FROM staff LEFT JOIN names ON names.e = staff.e WHERE {where})
  SELECT *, {text} AS calculation FROM picked"""


_IN_RANGE_SQL = _detail_sql(
    "round(t, 6) > 5 AND round(t, 6) <= 15",
    "least(t - 5, 10)",
    "days_in_cc_range",
    "'min(' || total_days::VARCHAR || ' - 5, 15 - 5) = ' || days_in_cc_range::VARCHAR",
)
_HIGH_SQL = _detail_sql(
    "round(t, 6) > 15",
    "(t - 15)",
    "excess_days",
    "total_days::VARCHAR || ' - 15 = ' || excess_days::VARCHAR",
)


@query("cc_range_details", _IN_RANGE_SQL)
def _cc_range_details(spark, sf):
    return rating.cc_range_details(_tables(spark, sf, OVERALL).ledger, OVERALL)


@query("high_claimant_details", _HIGH_SQL)
def _high_claimant_details(spark, sf):
    return rating.high_claimant_details(_tables(spark, sf, OVERALL).ledger, OVERALL)


@query("details_sorted", _IN_RANGE_SQL)
def _details_sorted(spark, sf):
    return _tables(spark, sf, OVERALL).cc_range_details


@query("clamp_days", f"""WITH {sql.staff()} SELECT e AS employee_id,
  round(least(t - 5, 10), 6) AS days_in_range FROM staff""")
def _clamp_days(spark, sf):
    clamped = round6(rating.clamp_days(F.col("total_days"), OVERALL))
    return totals.employee_totals(_book(spark, sf)).select(
        "employee_id", clamped.alias("days_in_range")
    )


@query("explain_calc", f"""WITH {sql.staff()} SELECT e AS employee_id, CASE
    WHEN round(t, 6) <= 5 THEN NULL
    WHEN round(t, 6) <= 15 THEN 'min(' || round(t, 6)::VARCHAR || ' - 5, 15 - 5) = '
      || round(least(t - 5, 10), 6)::VARCHAR
    ELSE round(t, 6)::VARCHAR || ' - 15 = ' || round(t - 15, 6)::VARCHAR END AS calculation FROM staff""")
def _explain_calc(spark, sf):
    t = F.col("total_days")
    inside = rating.explain_cc(round6(t), round6(rating.clamp_days(t, OVERALL)), OVERALL)
    beyond = rating.explain_excess(round6(t), round6(t - OVERALL.cc_maximum), OVERALL)
    text = F.when(rating.in_range(t, OVERALL), inside).when(rating.high(t, OVERALL), beyond)
    return totals.employee_totals(_book(spark, sf)).select(
        "employee_id", text.alias("calculation")
    )


# --- profiles ----------------------------------------------------------------

_ORDER = ["l_orderkey", "l_linenumber", "Date", "Employee Identifier", "School Year",
          "Absence Type", "Duration", "Filled", "Needs Substitute"]
_ORDER_SQL = "l_orderkey, l_linenumber, d, e, sy, atype, dur NULLS LAST, filled, needs NULLS LAST"
_ORDERED_COLUMNS = """l_orderkey, l_linenumber, d AS "Date", e AS "Employee Identifier",
  sy AS "School Year", atype AS "Absence Type", dur AS "Duration", filled AS "Filled",
  needs AS "Needs Substitute\""""


@query("preview", f"""WITH {sql.ABSENCES} SELECT CAST(COLUMNS(*) AS VARCHAR) FROM (
  SELECT {_ORDERED_COLUMNS} FROM absences ORDER BY {_ORDER_SQL} LIMIT 5000)""")
def _preview(spark, sf):
    return profile.preview(absences(spark, sf, _ORDER), _ORDER)


@query("sample_rows", f"""WITH {sql.ABSENCES} SELECT {_ORDERED_COLUMNS} FROM absences
  ORDER BY {_ORDER_SQL} LIMIT 20""")
def _sample_rows(spark, sf):
    return profile.sample_rows(absences(spark, sf, _ORDER), _ORDER, 20)


@query("date_mismatch_sample", f"""WITH {sql.ABSENCES}, head AS (SELECT * FROM absences
    ORDER BY {_ORDER_SQL} LIMIT 20)
  SELECT 'School Year ' || sy || ' has date ' || CAST(d AS VARCHAR) AS issue FROM (
    SELECT * FROM head WHERE NOT ({sql.RULE3}) ORDER BY {_ORDER_SQL} LIMIT 10)""")
def _date_mismatch_sample(spark, sf):
    return profile.date_mismatch_sample(absences(spark, sf, _ORDER), _ORDER)


_FINGERPRINT_COLUMNS = ["Date", "Employee Identifier", "School Year"]


@query("dataset_fingerprint", """SELECT substr(sha256(
  '(''Date'', ''Employee Identifier'', ''School Year'')|' || CAST(count(*) AS VARCHAR)), 1, 16)
  AS dataset_fingerprint FROM lineitem""")
def _dataset_fingerprint(spark, sf):
    return profile.dataset_fingerprint(absences(spark, sf, _FINGERPRINT_COLUMNS))


def _rows_sql(rows: list[str], n: str = "(SELECT count(*) FROM lineitem)") -> str:
    return " UNION ALL ".join(f"SELECT {n} AS n_rows, {r}" for r in rows)


@query("file_info", _rows_sql([
    f"3 AS n_columns, {i} AS \"position\", '{c}' AS column_name, '{t}' AS data_type"
    for i, (c, t) in enumerate([("Date", "timestamp_ntz"), ("Duration", "double"),
                                ("Filled", "string")])]))
def _file_info(spark, sf):
    return profile.file_info(absences(spark, sf, ["Date", "Duration", "Filled"]))


_PROFILED = [("Date", "date_text"), ("School Year", "sy"), ("Employee Identifier", "e"),
             ("Employee Type", "etype"), ("Duration", "dur_text"), ("Needs Substitute", "needs")]


@query("structure_profile", f"""WITH {sql.RAW} """ + " UNION ALL ".join(
    f"""SELECT count(*) AS n_rows, '{c}' AS column_name, 'string' AS data_type,
    count(*) FILTER (WHERE {s} IS NULL) AS n_nulls FROM raw""" for c, s in _PROFILED))
def _structure_profile(spark, sf):
    return profile.structure_profile(raw_absences(spark, sf, [c for c, _ in _PROFILED]))


@query("null_counts", f"WITH {sql.RAW} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {s} IS NULL) AS n_nulls FROM raw"""
    for c, s in _PROFILED))
def _null_counts(spark, sf):
    return profile.null_counts(raw_absences(spark, sf, [c for c, _ in _PROFILED]))


@query("top_values", f"""WITH {sql.ABSENCES}, typed AS (
    SELECT etype AS value, count(*) AS n FROM absences WHERE etype IS NOT NULL GROUP BY etype
    ORDER BY n DESC, value LIMIT 50), years AS (
    SELECT sy AS value, count(*) AS n FROM absences WHERE sy IS NOT NULL GROUP BY sy
    ORDER BY n DESC, value LIMIT 20), filled AS (
    SELECT filled AS value, count(*) AS n FROM absences GROUP BY filled ORDER BY n DESC, value LIMIT 50)
  SELECT 'Employee Type' AS column_name, * FROM typed
  UNION ALL SELECT 'School Year', * FROM years UNION ALL SELECT 'Filled', * FROM filled""")
def _top_values(spark, sf):
    df = absences(spark, sf, ["Employee Type", "School Year", "Filled"])
    return reduce(DataFrame.unionByName, [
        profile.top_values(df, c, n).select(F.lit(c).alias("column_name"), "value", "n")
        for c, n in (("Employee Type", 50), ("School Year", 20), ("Filled", 50))
    ])


def _most_frequent(column: str, expr: str) -> str:
    return f"""SELECT '{column}' AS column_name, "rank"::INT AS "rank", value, CAST(NULL AS DOUBLE) AS number_value
  FROM (SELECT {expr} AS value, row_number() OVER (ORDER BY count(*) DESC, {expr}) AS "rank"
    FROM absences WHERE {expr} IS NOT NULL GROUP BY {expr}) WHERE "rank" <= 12"""


@query("column_value_view", f"""WITH {sql.ABSENCES}
  {_most_frequent('School Year', 'sy')} UNION ALL {_most_frequent('Employee Type', 'etype')}
  UNION ALL SELECT 'l_linenumber', row_number() OVER (ORDER BY l_linenumber)::INT, NULL, l_linenumber::DOUBLE
    FROM (SELECT DISTINCT l_linenumber FROM absences)
  UNION ALL SELECT 'Employee Identifier', 1, NULL, min(e::DOUBLE) FROM absences
  UNION ALL SELECT 'Employee Identifier', 2, NULL, max(e::DOUBLE) FROM absences
  UNION ALL SELECT 'Duration', 1, NULL, min(dur) FROM absences
  UNION ALL SELECT 'Duration', 2, NULL, max(dur) FROM absences""")
def _column_value_view(spark, sf):
    df = absences(spark, sf, ["School Year", "Employee Type", "l_linenumber",
                              "Employee Identifier", "Duration"])
    return profile.column_value_view(df)


@query("date_range", f"WITH {sql.RAW} SELECT min(d) AS min_date, max(d) AS max_date FROM raw")
def _date_range(spark, sf):
    return profile.date_range(raw_absences(spark, sf, ["Date"]))


@query("distinct_types", f"""WITH {sql.ABSENCES} SELECT DISTINCT etype AS employee_type
  FROM absences WHERE trim(etype) <> '' ORDER BY 1""")
def _distinct_types(spark, sf):
    return profile.distinct_types(absences(spark, sf, ["Employee Type"]))


_FILE_ORDER = ["l_orderkey", "l_linenumber", "Date", "Employee Identifier", "School Year"]
_FILE_ORDER_SQL = "l_orderkey, l_linenumber, date_text NULLS FIRST, e NULLS FIRST, sy NULLS FIRST"


def _ordered_export(spark: SparkSession, sf: str) -> str:
    folder = new_folder(spark, "ordered-csv")
    export_csv(raw_absences(spark, sf, _FILE_ORDER), folder, _FILE_ORDER)
    return folder


@query("first_rows", f"""WITH {sql.RAW} SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey,
  CAST(l_linenumber AS VARCHAR) AS l_linenumber, date_text AS "Date", e AS "Employee Identifier",
  sy AS "School Year" FROM raw ORDER BY raw.{_FILE_ORDER_SQL.replace(", l_line", ", raw.l_line", 1)} LIMIT 5000""")
def _first_rows(spark, sf):
    return first_rows(spark, _ordered_export(spark, sf))


@query("date_mismatches", f"""WITH {sql.RAW}, head AS (SELECT * FROM raw ORDER BY {_FILE_ORDER_SQL} LIMIT 20)
  SELECT 'School Year ' || sy || ' has date ' || date_text AS issue FROM (
    SELECT * FROM head WHERE NOT ({sql.RULE3}) ORDER BY {_FILE_ORDER_SQL} LIMIT 10)""")
def _date_mismatches(spark, sf):
    return date_mismatches(spark, _ordered_export(spark, sf))


_SHARED = ["Date", "School Year", "Employee Identifier", "Employee Type", "Absence Type", "Duration",
           "Filled", "Needs Substitute"]


def _shared_sql() -> str:
    cells = dict(_PROFILED) | {"Absence Type": "atype", "Filled": "filled"}
    valid = "NOT blank AND d IS NOT NULL"
    steps = {
        "original_rows": "true", "after_validation": "d IS NOT NULL",
        "after_rule1": "d IS NOT NULL AND NOT rule1_drops",
        "after_rule2": f"d IS NOT NULL AND NOT rule1_drops AND {sql.RULE2}",
    }
    last = f"{steps['after_rule2']} AND {sql.RULE3}"
    steps |= {"after_rule3": last, "final_rows": last, "rows_removed": f"NOT ({last})"}
    checks = {
        "missing_required_columns": "false", "empty_rows": "blank", "bad_dates": "NOT blank AND d IS NULL",
        "negative_durations": f"{valid} AND dur < 0",
        "malformed_school_years": f"{valid} AND sy IS NOT NULL AND sy NOT LIKE '____-____'",
        "missing_employee_ids": f"{valid} AND e IS NULL", "rows_removed": f"NOT ({valid})", "final_rows": valid,
    }
    rows = [("nulls", c, f"{cells[c]} IS NULL") for c in _SHARED]
    rows += [("checks", k, v) for k, v in checks.items()] + [("steps", k, v) for k, v in steps.items()]
    parts = [f"SELECT '{s}' AS section, '{k}' AS name, CAST(count(*) FILTER (WHERE {v}) AS VARCHAR) AS value FROM raw"
             for s, k, v in rows]
    parts += [f"SELECT 'dates', '{e}', strftime({e}(d), '%Y-%m-%d %H:%M:%S') FROM raw" for e in ("min", "max")]
    parts.append("SELECT 'types', etype, etype FROM (SELECT DISTINCT etype FROM raw WHERE trim(etype) <> '')")
    return f"WITH {sql.RAW} " + " UNION ALL ".join(parts)


@query("shared_profiles", _shared_sql())
def _shared_profiles(spark, sf):
    """Null counts, validation, cleaning steps, date range and types, all from one scan."""
    found = profiles_of(raw_absences(spark, sf, _SHARED))

    def rows(section: str, df: DataFrame, name, value) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.alias("name"), value.cast("string").alias("value"))

    steps = found.cleaning_stats
    cells = [x for c in steps.columns for x in (F.lit(c), F.col(c).cast("bigint"))]
    steps = steps.select(F.stack(F.lit(len(steps.columns)), *cells).alias("name", "n"))
    dates = found.date_range.select(
        F.stack(F.lit(2), F.lit("min"), "min_date", F.lit("max"), "max_date").alias("name", "d")
    )
    return reduce(DataFrame.unionByName, [
        rows("nulls", found.null_counts, F.col("column_name"), F.col("n_nulls")),
        rows("checks", found.validation_report, F.col("check"), F.col("n")),
        rows("steps", steps, F.col("name"), F.col("n")),
        rows("dates", dates, F.col("name"), F.date_format("d", "yyyy-MM-dd HH:mm:ss")),
        rows("types", found.distinct_types, F.col("employee_type"), F.col("employee_type")),
    ])


@query("staff_of_years", f"""WITH {sql.CLEANED}, years AS (
    SELECT DISTINCT sy FROM cleaned WHERE sy IS NOT NULL), unions AS (
    SELECT a.sy AS first_year, b.sy AS last_year FROM years a JOIN years b ON a.sy <= b.sy)
  SELECT first_year, last_year, count(DISTINCT e) AS total_staff, round(sum(days)::DOUBLE, 6) AS total_days
  FROM unions JOIN cleaned ON sy BETWEEN first_year AND last_year GROUP BY ALL""")
def _staff_of_years(spark, sf):
    """Distinct staff and days of every run of school years, from one table of bitmaps."""
    book = settle(_book(spark, sf), "ledger")
    bitmaps = settle(staff_bitmaps(book, staff_numbers(book)), "bitmaps")
    # Years are few; each row below is a bitmap of a year.
    years = bitmaps.where("school_year IS NOT NULL").select("school_year").distinct()
    ends = F.array_sort(F.collect_set("school_year"))
    runs = years.agg(ends.alias("y")).select(F.posexplode("y").alias("i", "first_year"), "y").select(
        "first_year", F.posexplode(F.expr("slice(y, i + 1, size(y))")).alias("j", "last_year"), "y", "i"
    ).select("first_year", "last_year", F.explode(F.expr("slice(y, i + 1, j + 1)")).alias("school_year"))
    of_runs = runs.join(bitmaps, "school_year")
    found = distinct_staff(of_runs, ["first_year", "last_year"])
    return found.withColumn("total_days", round6(F.col("total_days")))


# --- reports -----------------------------------------------------------------


@query("order_by_year", f"""WITH {_METRIC_AVG} SELECT school_year,
  round(total_staff, 6) AS total_staff, round(total_absences::DOUBLE, 6) AS total_absences,
  round(total_replacement_cost::DOUBLE, 6) AS total_replacement_cost, is_average FROM rows
  ORDER BY is_average, school_year""")
def _order_by_year(spark, sf):
    metrics = rating.year_metrics(_book(spark, sf), YEARLY)
    return report.order_by_year(report.year_metrics_avg(metrics))


@query("format_report", f"""WITH {sql.breakdown(2, 3)} SELECT school_year,
  format('{{:,d}}', total_teachers) AS total_teachers,
  format('{{:,.2f}}', round(total_cc_days::DOUBLE, 6)) AS total_cc_days,
  '$' || format('{{:,.2f}}', round(premium::DOUBLE, 6)) AS premium FROM breakdown""")
def _format_report(spark, sf):
    return rating.year_breakdown(_book(spark, sf), YEARLY).select(
        "school_year",
        F.format_number("total_teachers", 0).alias("total_teachers"),
        F.format_number("total_cc_days", 2).alias("total_cc_days"),
        money(F.col("premium")).alias("premium"),
    )


@query("report_year_metrics", f"""WITH {_METRIC_AVG} SELECT school_year,
  CASE WHEN is_average = 1 THEN format('{{:,.1f}}', round(total_staff, 6))
    ELSE format('{{:,.0f}}', total_staff) END AS total_staff,
  CASE WHEN is_average = 1 THEN format('{{:,.1f}}', round(total_absences::DOUBLE, 6))
    ELSE format('{{:,.2f}}', round(total_absences::DOUBLE, 6)) END AS total_absences,
  '$150.00' AS replacement_cost_per_day,
  '$' || format('{{:,.2f}}', round(total_replacement_cost::DOUBLE, 6)) AS total_replacement_cost,
  180 AS school_year_days, 2 AS deductible_days, 3 AS cc_max_days FROM rows""")
def _report_year_metrics(spark, sf):
    return report.report_year_metrics(rating.year_metrics(_book(spark, sf), YEARLY), YEARLY)


def _report_cells() -> str:
    counts = [
        f"""CASE WHEN is_average = 1 THEN format('{{:,.1f}}', round({c}, 6))
        ELSE format('{{:,.0f}}', {c}) END AS {c}""" for c in _FIELDS[:4]
    ]
    days = [f"format('{{:,.2f}}', round({c}, 6)) AS {c}" for c in _FIELDS[4:6]]
    amounts = [f"'$' || format('{{:,.2f}}', round({c}, 6)) AS {c}" for c in _FIELDS[6:]]
    return ", ".join(counts + days + amounts)


@query("report_breakdown", f"WITH {_BREAKDOWN_AVG} SELECT school_year, {_report_cells()} FROM rows")
def _report_breakdown(spark, sf):
    return report.report_breakdown(rating.year_figures(_book(spark, sf), YEARLY))


_PREMIUM_LINES = """SELECT basis, 1 AS line, 'Replacement Cost (CC)' AS item,
    '$' || format('{:,.2f}', replacement_cost_cc) AS amount FROM headline
  UNION ALL SELECT basis, 2, 'Carrier Profit Margin', '$' || format('{:,.2f}', carrier_margin)
    FROM headline
  UNION ALL SELECT basis, 3, 'Acquisition Costs', '$' || format('{:,.2f}', acquisition_cost)
    FROM headline
  UNION ALL SELECT basis, 4, 'TOTAL PREMIUM', '$' || format('{:,.2f}', total_premium) FROM headline"""


@query("report_premium", f"WITH {_HEADLINE_AVG} {_PREMIUM_LINES}")
def _report_premium(spark, sf):
    breakdown = rating.year_figures(_book(spark, sf), YEARLY)
    return report.report_premium(report.headline_avg(breakdown, YEARLY))


@query("report_premium_cumulative", f"WITH {_HEADLINE_ALL} {_PREMIUM_LINES}")
def _report_premium_cumulative(spark, sf):
    summary = rating.rating_summary(_book(spark, sf), OVERALL)
    return report.report_premium(report.headline_cumulative(summary))


@query("replacement_identity", f"""WITH {sql.metrics()} SELECT count(*) AS n_years,
  CAST(0 AS BIGINT) AS n_violations FROM metrics""")
def _replacement_identity(spark, sf):
    metrics = rating.year_metrics(_book(spark, sf), YEARLY)
    return rating.replacement_identity(metrics, YEARLY)


# --- whole ratings and runs --------------------------------------------------


@query("rate_exact", f"""WITH {sql.staff(sql.ABSENCES + ", cleaned AS (SELECT *, " + sql.DAYS_EXACT
  + " AS days FROM absences WHERE " + sql.RULE1_EXACT + " AND " + sql.RULE2 + ")")}
  SELECT {_COVERAGE}, round(({_B['cc_all']} * 150.0 * 0.15)::DOUBLE, 6) AS carrier_margin,
  round(({_B['cc_all']} * 150.0 * 0.15)::DOUBLE, 6) AS acquisition_cost,
  round(({_B['cc_all']} * 150.0 * 1.3)::DOUBLE, 6) AS total_premium, 180 AS school_year_days FROM staff""")
def _rate_exact(spark, sf):
    columns = ["School Year", "Employee Identifier", "Employee Type", "Absence Type", "Duration",
               "Filled", "Needs Substitute"]
    return rate_exact(clean_exact(absences(spark, sf, columns)), OVERALL)


def _long(table: DataFrame, name: str, key: str | None) -> DataFrame:
    """(section, school_year, metric, value) rows of a result table."""
    values = [c for c in table.columns if c != key]
    cells = [x for c in values for x in (F.lit(c), F.col(c).cast("double"))]
    return table.select(
        F.lit(name).alias("section"),
        (F.col(key) if key else F.lit("all")).alias("school_year"),
        F.stack(F.lit(len(values)), *cells).alias("metric", "value"),
    )


def _long_sql(section: str, table: str, key: str, fields) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{section}' AS section, {key} AS school_year, '{c}' AS metric,
        round({c}::DOUBLE, 6) AS value FROM {table}""" for c in fields
    )


_SUMMARY_FIELDS = (
    "overall_total_staff", "overall_total_absences", "overall_total_absences_exact",
    "overall_total_replacement_cost", "total_teachers", "below_deductible_count",
    "num_staff_cc_range", "total_cc_days", "replacement_cost_cc", "num_high_claimant",
    "excess_days", "high_claimant_cost", "carrier_margin", "acquisition_cost", "total_premium",
    "deductible", "cc_days", "cc_maximum", "replacement_cost", "school_year_days",
)
_SUMMARY_CTE = sql.summary(2, 3)[len(sql.staff()):]


@query("rate_adaptive", f"""WITH {sql.breakdown(2, 3)}, metrics AS (SELECT sy AS school_year,
    count(DISTINCT e) AS total_staff, coalesce(sum(days), 0) AS total_absences,
    coalesce(sum(days), 0) * 150.0 AS total_replacement_cost FROM cleaned
    WHERE sy IS NOT NULL GROUP BY sy){_SUMMARY_CTE.replace('banded', 'banded_all')}
  {_long_sql('year_metrics', 'metrics', 'school_year', report.METRIC_FIELDS)} UNION ALL
  {_long_sql('year_breakdown', 'breakdown', 'school_year', _FIELDS)} UNION ALL
  {_long_sql('rating_summary', 'summary', "'all'", _SUMMARY_FIELDS)}""")
def _rate_adaptive(spark, sf):
    tables = _tables(spark, sf, YEARLY)
    return (
        _long(tables.year_metrics, "year_metrics", "school_year")
        .unionByName(_long(tables.year_breakdown, "year_breakdown", "school_year"))
        .unionByName(_long(tables.summary, "rating_summary", None))
    )


def _export(spark: SparkSession, sf: str) -> str:
    """The text records as CSV files under one district's headings."""
    folder = new_folder(spark, "district-csv")
    own = {"Employee Identifier": "Emp ID", "Date": "Absence Date", "School Year": "SY"}
    sink_csv(raw_absences(spark, sf, RAW_COLUMNS), folder, own)
    return folder


# Left to the aliases, usage hours would be taken for the reason of the absence.
_KEEP_HOURS = {"Absence Reason Usage (Hours)": KEEP_AS_IS}


@query("rate_end_to_end", f"""WITH {sql.breakdown(2, 3, sql.RAW_CLEANED)}
  SELECT {sql.BREAKDOWN_COLUMNS} FROM breakdown""")
def _rate_end_to_end(spark, sf):
    rated = rate_file(spark, _export(spark, sf), params=YEARLY,
                      mapping=_KEEP_HOURS, keep_ledger=True)
    return rated.tables.year_breakdown


def _two_exports(spark: SparkSession, sf: str) -> str:
    """The text records as files of two districts with headings and orders of their own."""
    folder = new_folder(spark, "districts-csv")
    df = raw_absences(spark, sf, [*RAW_COLUMNS, "l_orderkey"])
    one = {"Employee Identifier": "Emp ID", "Date": "Absence Date", "School Year": "SY"}
    two = {"Employee Identifier": "Employee ID", "School Year": "SchoolYear", "Filled": "Is Filled"}
    for k, shown in enumerate((one, two)):
        half = df.where(F.col("l_orderkey") % 2 == k).drop("l_orderkey")
        sink_csv(half.select(half.columns[:: 1 - 2 * k]), f"{folder}/district={k}", shown)
    return f"{folder}/*"


@query("rate_two_layouts", f"""WITH {sql.breakdown(2, 3, sql.RAW_CLEANED)}
  SELECT {sql.BREAKDOWN_COLUMNS} FROM breakdown""")
def _rate_two_layouts(spark, sf):
    rated = rate_file(spark, _two_exports(spark, sf), params=YEARLY, mapping=_KEEP_HOURS)
    return rated.tables.year_breakdown


_KEPT = "d IS NOT NULL AND NOT rule1_drops"


@query("rate_file_counts", f"""WITH {sql.RAW}, s AS (
    SELECT *, NOT blank AND d IS NOT NULL AS valid FROM raw WHERE etype IN ('Teacher', 'Aide'))
  SELECT 'rows' AS section, 'rows_raw' AS name, count(*) AS n FROM raw
  UNION ALL SELECT 'rows', 'rows_selected', count(*) FROM s
  UNION ALL SELECT 'rows', 'rows_cleaned', count(*) FROM s WHERE {_KEPT} AND {sql.RULE3}
  UNION ALL SELECT 'checks', 'missing_required_columns', 0
  UNION ALL SELECT 'checks', 'empty_rows', count(*) FROM s WHERE blank
  UNION ALL SELECT 'checks', 'bad_dates', count(*) FROM s WHERE NOT blank AND d IS NULL
  UNION ALL SELECT 'checks', 'negative_durations', count(*) FROM s WHERE valid AND dur < 0
  UNION ALL SELECT 'checks', 'malformed_school_years', count(*) FROM s
    WHERE valid AND sy IS NOT NULL AND sy NOT LIKE '____-____'
  UNION ALL SELECT 'checks', 'missing_employee_ids', count(*) FROM s WHERE valid AND e IS NULL
  UNION ALL SELECT 'checks', 'rows_removed', count(*) FROM s WHERE NOT valid
  UNION ALL SELECT 'checks', 'final_rows', count(*) FROM s WHERE valid
  UNION ALL SELECT 'steps', 'original_rows', count(*) FROM s
  UNION ALL SELECT 'steps', 'after_validation', count(*) FROM s WHERE valid
  UNION ALL SELECT 'steps', 'after_rule1', count(*) FROM s WHERE {_KEPT}
  UNION ALL SELECT 'steps', 'after_rule2', count(*) FROM s WHERE {_KEPT}
  UNION ALL SELECT 'steps', 'after_rule3', count(*) FROM s WHERE {_KEPT} AND {sql.RULE3}
  UNION ALL SELECT 'steps', 'final_rows', count(*) FROM s WHERE {_KEPT} AND {sql.RULE3}
  UNION ALL SELECT 'steps', 'rows_removed', count(*) FROM s WHERE NOT ({_KEPT} AND {sql.RULE3})""")
def _rate_file_counts(spark, sf):
    rated = rate_file(
        spark, _export(spark, sf), params=YEARLY, mapping=_KEEP_HOURS,
        filters=RowFilters(employee_type=("Teacher", "Aide")),
    )
    parts = [
        rated.validation.select(F.lit("checks").alias("section"), F.col("check").alias("name"), "n")
    ]
    for section, row in (("rows", row_counts(rated.book)), ("steps", rated.stats)):
        cells = [x for c in row.columns for x in (F.lit(c), F.col(c).cast("bigint"))]
        stacked = F.stack(F.lit(len(row.columns)), *cells).alias("name", "n")
        parts.append(row.select(F.lit(section).alias("section"), stacked))
    return reduce(DataFrame.unionByName, parts)


_RUN_COLUMNS = ["user_email", "filters_json", "rows_raw", "rows_selected", "rows_cleaned",
                "total_teachers", "total_premium", "status", "error_message", "step", "run_id"]


_RUN_SQL = (f"""WITH {sql.summary(5, 10, sql.RAW + ", selected AS (SELECT * FROM raw WHERE etype IN ('Teacher', 'Aide')), cleaned AS (SELECT *, " + sql.DAYS_RAW + " AS days FROM selected WHERE d IS NOT NULL AND NOT rule1_drops AND " + sql.RULE3 + ")")}
  SELECT 'rater@example.org' AS user_email, '{{"employee_type": ["Teacher", "Aide"]}}' AS filters_json,
    (SELECT count(*) FROM raw) AS rows_raw, (SELECT count(*) FROM selected) AS rows_selected,
    (SELECT count(*) FROM cleaned) AS rows_cleaned, overall_total_staff AS total_teachers,
    total_premium, 'success' AS status, CAST(NULL AS VARCHAR) AS error_message,
    CAST(NULL AS VARCHAR) AS step, 'run-1' AS run_id FROM summary""")


@query("append_run", _RUN_SQL)
def _append_run(spark, sf):
    runs = new_folder(spark, "runs")
    rate_file(
        spark, _export(spark, sf), params=OVERALL, runs_folder=runs, mapping=_KEEP_HOURS,
        filters=RowFilters(employee_type=("Teacher", "Aide")),
        user_email="rater@example.org", run_id="run-1",
    )
    return read_runs(spark, runs).select(_RUN_COLUMNS)


@query("append_run_twice", _RUN_SQL)
def _append_run_twice(spark, sf):
    """Two attempts at one run, then the history in fewer files, then a third attempt."""
    runs = new_folder(spark, "runs")
    export = _export(spark, sf)
    for attempt in range(3):
        rate_file(
            spark, export, params=OVERALL, runs_folder=runs, mapping=_KEEP_HOURS,
            filters=RowFilters(employee_type=("Teacher", "Aide")),
            user_email="rater@example.org", run_id="run-1",
        )
        if attempt == 1:
            compact_runs(spark, runs)
    return read_runs(spark, runs).select(_RUN_COLUMNS)


@query("append_failed_run", """SELECT 'error' AS status, 'calculate' AS step,
  count(*) AS rows_raw, true AS has_traceback FROM lineitem""")
def _append_failed_run(spark, sf):
    runs = new_folder(spark, "runs")
    df = absences(spark, sf, ["Date", "Duration"])
    try:
        require_columns(df)
    except ValueError as error:
        append_failed_run(
            spark, runs, "calculate", error,
            measured=df.agg(F.count(F.lit(1)).alias("rows_raw")),
        )
    return read_runs(spark, runs).select(
        "status", "step", "rows_raw",
        F.col("error_message").contains("Traceback").alias("has_traceback"),
    )
