"""Queries on records: scans, projections, filters, rules, scalars, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from absentia.config import RowFilters, RuleConfig
from absentia.functions.dates import (
    hours_between,
    moment_of,
    parse_mixed_date,
    school_year_bounds,
    school_year_of,
    school_year_wellformed,
)
from absentia.functions.days import absence_days_exact, absence_days_priority
from absentia.functions.numbers import number_of, round6
from absentia.functions.text import clean_name, norm_token
from absentia.operators import columns as cols
from absentia.operators import filters, rules
from absentia.operators.coded import parse_dates_once
from absentia.operators.totals import first_row_per_employee, rating_frame
from absentia.operators.validation import (
    cleaning_stats,
    drop_all_null_rows,
    drop_bad_dates,
    exact_cleaning_stats,
    validation_report,
)
from absentia.plans.cleaning import clean_adaptive, clean_exact
from absentia.sources.csv_files import (
    export_csv,
    export_manifest,
    layouts_of,
    read_export,
    require_rows,
    scan_csv,
    scan_known,
    sink_csv,
)
from absentia.sources.storage import new_folder, settle
from absentia.vocabulary import ROW_ORDER
from workload import sql
from workload.fixtures import ORDER_COLUMNS, RAW_COLUMNS, absences, raw_absences, table as fixture_table
from workload.registry import query

KEYS = list(ORDER_COLUMNS)
FIRST, LAST = "Employee First Name", "Employee Last Name"

# SQL text of the raw cells under their headings, as a file would show them.
RAW_CELLS = """sy AS "School Year", date_text AS "Date", e AS "Employee Identifier",
  fn AS "Employee First Name", ln AS "Employee Last Name", school AS "School Name",
  etype AS "Employee Type", atype AS "Absence Type", dur_text AS "Duration",
  start_text AS "Start Time", end_text AS "End Time", day_count AS "Days of Absence",
  usage_hours AS "Absence Reason Usage (Hours)", filled AS "Filled", needs AS "Needs Substitute",
  hired AS "Hire Date\""""


# --- files -------------------------------------------------------------------


@query("scan_csv", f"WITH {sql.RAW} SELECT {RAW_CELLS} FROM raw")
def _scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "export-csv")
    # Missing cells written out as words, which the scan must read as missing.
    cells = raw_absences(spark, sf).fillna("N/A", ["Needs Substitute"]).fillna(
        "None", ["Employee Type"]
    )
    sink_csv(cells, folder)
    return scan_csv(spark, folder)


_ORDERS = ["Employee Identifier", "Date", "School Year", "l_orderkey", "l_linenumber"]


def _exports(spark: SparkSession, sf: str) -> str:
    """The records as files of several layouts: two districts' own headings, one of them
    in two orders of columns, and files that hold no absences."""
    folder = new_folder(spark, "exports-csv")
    df = raw_absences(spark, sf, _ORDERS)
    kind = F.col("l_orderkey") % 3
    first = df.where(kind == 0).toDF("Emp ID", "Absence Date", "SY", "Order", "Line")
    sink_csv(first, f"{folder}/district=1")
    turned = df.where(kind == 1).toDF("Emp ID", "Absence Date", "SY", "Order", "Line")
    sink_csv(turned.select("Line", "SY", "Absence Date", "Emp ID", "Order"), f"{folder}/district=2")
    second = df.where(kind == 2).toDF("Staff No", "Day", "Year", "Order", "Line")
    sink_csv(second, f"{folder}/district=3")
    sink_csv(spark.read.parquet(f"{sf}/nation.parquet"), f"{folder}/district=4")
    return folder


@query("scan_known_layouts", f"""WITH {sql.RAW} SELECT e AS "Employee Identifier",
  date_text AS "Date", sy AS "School Year", CAST(l_orderkey AS VARCHAR) AS "Order",
  CAST(l_linenumber AS VARCHAR) AS "Line" FROM raw""")
def _scan_known_layouts(spark, sf):
    known = [
        {"Emp ID": "Employee Identifier", "Absence Date": "Date", "SY": "School Year"},
        {"Staff No": "Employee Identifier", "Day": "Date", "Year": "School Year"},
    ]
    scanned = scan_known(spark, f"{_exports(spark, sf)}/*", known, unknown="leave out")
    return scanned.select("Employee Identifier", "Date", "School Year", "Order", "Line")


@query("scan_column_orders", f"""WITH {sql.RAW} SELECT e AS "Emp ID", date_text AS "Absence Date",
  sy AS "SY", CAST(l_orderkey AS VARCHAR) AS "Order", CAST(l_linenumber AS VARCHAR) AS "Line"
  FROM raw WHERE l_orderkey % 3 < 2""")
def _scan_column_orders(spark, sf):
    scanned = scan_csv(spark, f"{_exports(spark, sf)}/district=[12]")
    return scanned.select("Emp ID", "Absence Date", "SY", "Order", "Line")


@query("header_catalogue", """SELECT 'Absence Date,Emp ID,Line,Order,SY' AS columns, 2 AS n_orders
  UNION ALL SELECT 'Day,Line,Order,Staff No,Year', 1
  UNION ALL SELECT string_agg(column_name, ',' ORDER BY column_name), 1
    FROM (DESCRIBE SELECT * FROM nation)""")
def _header_catalogue(spark, sf):
    found = layouts_of(spark, f"{_exports(spark, sf)}/*")
    rows = [(",".join(sorted(x.cells)), ",".join(x.cells)) for x in found]
    df = spark.createDataFrame(rows, "columns string, cells string")
    return df.groupBy("columns").agg(F.count_distinct("cells").cast("int").alias("n_orders"))


@query("sink_csv", f"""WITH {sql.CLEANED} SELECT e AS "Employee Identifier (Emp ID)",
  sy AS "School Year", CAST(days AS VARCHAR) AS "Absence_Days (Days)" FROM cleaned""")
def _sink_csv(spark, sf):
    folder = new_folder(spark, "cleaned-csv")
    cleaned = clean_adaptive(absences(spark, sf))
    shown = {
        "Employee Identifier": "Employee Identifier (Emp ID)",
        "Absence_Days": "Absence_Days (Days)",
    }
    sink_csv(cleaned.select("Employee Identifier", "School Year", "Absence_Days"), folder, shown)
    return scan_csv(spark, folder)


@query("export_csv", f"""WITH {sql.RAW} SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber,
    date_text NULLS FIRST, e NULLS FIRST, sy NULLS FIRST) AS line, CAST(l_orderkey AS VARCHAR) AS "Order",
  CAST(l_linenumber AS VARCHAR) AS "Line", date_text AS "Date", e AS "Emp ID" FROM raw""")
def _export_csv(spark, sf):
    """The records in a total order, as numbered lines of the parts of an export."""
    folder = new_folder(spark, "ordered-csv")
    df = raw_absences(spark, sf, [*KEYS, "Date", "Employee Identifier", "School Year"])
    order = [*KEYS, "Date", "Employee Identifier", "School Year"]
    shown = {"l_orderkey": "Order", "l_linenumber": "Line", "Employee Identifier": "Emp ID"}
    export_csv(df, folder, order, shown)
    # The result has both "line" and "Line": only a session that tells them apart can
    # address or write them. It is read in one of its own; the caller's stays as it is.
    cased = spark.newSession()
    cased.conf.set("spark.sql.caseSensitive", "true")
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each part file.
    starts = export_manifest(cased, folder).withColumn("start", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
    rows = read_export(cased, folder).withColumn("place", F.col(f"{ROW_ORDER}.place"))
    within = Window.partitionBy("place").orderBy(f"{ROW_ORDER}.row")
    numbered = rows.withColumn("at", F.row_number().over(within)).join(starts, "place")
    return numbered.select((F.col("start") + F.col("at")).alias("line"), "Order", "Line", "Date", "Emp ID")


@query("scan_nonempty", "SELECT count(*) AS n_rows FROM lineitem")
def _scan_nonempty(spark, sf):
    return require_rows(absences(spark, sf, ["Date"])).agg(F.count(F.lit(1)).alias("n_rows"))


@query("scan_dedup_header", f"""WITH {sql.ABSENCES} SELECT l_orderkey, l_linenumber,
  d AS "Date", filled AS "Filled" FROM absences""")
def _scan_dedup_header(spark, sf):
    df = absences(spark, sf, [*KEYS, "Date", "Filled", "School Year"])
    return cols.dedup_header(df.toDF(*KEYS, "Date", "Filled", "Date"))


# --- projections -------------------------------------------------------------


@query("select_strict", f"""WITH {sql.ABSENCES} SELECT l_orderkey, e AS "Employee Identifier",
  sy AS "School Year" FROM absences""")
def _select_strict(spark, sf):
    wanted = ["l_orderkey", "Employee Identifier", "School Year", "Employee Identifier"]
    return cols.select_strict(absences(spark, sf), wanted)


@query("select_present", f"""WITH {sql.ABSENCES} SELECT l_orderkey, atype AS "Absence Type"
  FROM absences""")
def _select_present(spark, sf):
    return cols.select_present(absences(spark, sf), ["l_orderkey", "Absence Type", "Unheard Of"])


@query("drop_hire_date", f"""WITH {sql.RAW} SELECT e AS "Employee Identifier", date_text AS "Date"
  FROM raw""")
def _drop_hire_date(spark, sf):
    return cols.drop_hire_date(
        raw_absences(spark, sf, ["Employee Identifier", "Date", "Hire Date"])
    )


def _district(spark: SparkSession, sf: str) -> DataFrame:
    """The records under one district's own headings."""
    df = raw_absences(
        spark, sf, ["Employee Identifier", "Date", "Days of Absence", LAST, FIRST,
                    "School Year", "Absence Type", "Hire Date"]
    )
    return df.toDF("Emp ID", "Absence Date", "Days", "Surname", "Given", "SY", "Kind", "hire_date")


@query("rename_map", f"""WITH {sql.RAW} SELECT e AS "Employee Identifier", date_text AS "Date",
  day_count AS "Days", ln AS "Surname", fn AS "Given", sy AS "SY", atype AS "Absence Type",
  hired AS "hire_date" FROM raw""")
def _rename_map(spark, sf):
    mapping = {"Emp ID": "Employee Identifier", "Absence Date": "Date", "Kind": "Absence Type",
               "Days": "Keep as-is", "Surname": "", "Not There": "Filled"}
    return cols.rename_map(_district(spark, sf), mapping)


@query("dedup_after_rename", f"""WITH {sql.RAW} SELECT e AS "Employee Identifier",
  date_text AS "Date", sy AS "SY" FROM raw""")
def _dedup_after_rename(spark, sf):
    df = _district(spark, sf).select("Emp ID", "Absence Date", "SY", "hire_date")
    return cols.rename_map(
        df, {"Emp ID": "Employee Identifier", "Absence Date": "Date", "hire_date": "Date"}
    )


@query("alias_map_fallback", f"""WITH {sql.RAW} SELECT e AS "Employee Identifier",
  date_text AS "Date", day_count AS "Absence_Days", ln AS "Surname", fn AS "Given",
  sy AS "School Year", atype AS "Kind", hired AS "hire_date" FROM raw""")
def _alias_map_fallback(spark, sf):
    df = _district(spark, sf)
    return cols.rename_map(df, cols.suggest_mapping(df.columns))


@query("alias_map_calc", f"""WITH {sql.RAW} SELECT e AS "Employee Identifier", date_text AS "Date",
  CAST(day_count AS DOUBLE) AS "Absence_Days", ln AS "Employee Last Name",
  fn AS "Employee First Name", sy AS "School Year", atype AS "Kind", hired AS "hire_date"
  FROM raw""")
def _alias_map_calc(spark, sf):
    return cols.normalize_for_rating(_district(spark, sf))


@query("valid_suggestion", f"""WITH {sql.RAW} SELECT e AS "Employee Identifier",
  date_text AS "Date", hired AS "hire_date", atype AS "Kind" FROM raw""")
def _valid_suggestion(spark, sf):
    df = _district(spark, sf).select("Emp ID", "Absence Date", "hire_date", "Kind")
    proposed = {"Emp ID": "Employee Identifier", "Absence Date": "Date", "hire_date": "Date",
                "Kind": "Sort Of Absence", "Nowhere": "Filled"}
    return cols.rename_map(df, cols.valid_suggestion(proposed, df.columns))


@query("map_precedence", f"""WITH {sql.RAW} SELECT e AS "Employee Identifier",
  date_text AS "Date", atype AS "Reason" FROM raw""")
def _map_precedence(spark, sf):
    df = _district(spark, sf).select("Emp ID", "Absence Date", "Kind")
    final = cols.merge_mappings(
        {"Kind": "Reason"},
        {"Kind": "Absence Type", "Emp ID": "Employee Identifier", "Absence Date": "Date"},
        df.columns,
    )
    return cols.rename_map(df, final)


@query("mapping_check", f"""WITH {sql.RAW}, n AS (SELECT count(*) AS n_rows FROM raw)
  SELECT 'no column is mapped to Employee Identifier' AS warning, n_rows FROM n""")
def _mapping_check(spark, sf):
    return cols.mapping_check(
        _district(spark, sf), {"SY": "School Year", "Kind": "Absence Type"}
    )


@query("require_columns", f"""WITH {sql.CLEANED} SELECT sy AS school_year, e AS employee_id,
  round(days, 6) AS absence_days FROM cleaned""")
def _require_columns(spark, sf):
    frame = rating_frame(clean_adaptive(absences(spark, sf)))
    return frame.withColumn("absence_days", round6(F.col("absence_days")))


def _doubled(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns each of days and of employee types."""
    df = absences(spark, sf, ["l_orderkey", "Duration", "l_linenumber", "Employee Type", "Filled"])
    return df.toDF("l_orderkey", "Absence_Days", "Absence_Days", "Employee Type", "Employee Type")


@query("merge_dup_first", f"""WITH {sql.ABSENCES} SELECT l_orderkey, etype AS "Employee Type"
  FROM absences""")
def _merge_dup_first(spark, sf):
    return cols.merge_duplicates(_doubled(spark, sf)).select("l_orderkey", "Employee Type")


@query("merge_dup_sum", f"""WITH {sql.ABSENCES} SELECT l_orderkey,
  coalesce(dur, 0) + l_linenumber AS "Absence_Days" FROM absences""")
def _merge_dup_sum(spark, sf):
    return cols.merge_duplicates(_doubled(spark, sf)).select("l_orderkey", "Absence_Days")


@query("display_names", f"""WITH {sql.RAW} SELECT e AS "Employee Identifier (Emp ID)",
  date_text AS "Date (Absence Date)", atype AS "Kind" FROM raw""")
def _display_names(spark, sf):
    mapping = {"Emp ID": "Employee Identifier", "Absence Date": "Date"}
    df = cols.rename_map(_district(spark, sf).select("Emp ID", "Absence Date", "Kind"), mapping)
    return cols.display_names(df, mapping)


@query("pick_name_columns", f"""WITH {sql.RAW} SELECT e AS employee_id, coalesce(trim(fn), '') AS first_name,
  coalesce(ln, '') AS last_name FROM raw""")
def _pick_name_columns(spark, sf):
    df = _district(spark, sf)
    first, last = cols.pick_name_columns(df.columns)
    return df.select(
        F.col("Emp ID").alias("employee_id"),
        clean_name(F.col(first)).alias("first_name"),
        clean_name(F.col(last)).alias("last_name"),
    )


# --- filters and rules -------------------------------------------------------

_ROW = 'l_orderkey, l_linenumber'
_FROM_ABSENCES = f"WITH {sql.ABSENCES} SELECT {_ROW}"
RANGE = ("1997-03-01", "1999-06-30")


@query("filter_date_range", f"""WITH {sql.RAW} SELECT {_ROW}, d AS "Date" FROM raw
  WHERE d BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1999-06-30'""")
def _filter_date_range(spark, sf):
    return filters.filter_date_range(raw_absences(spark, sf, [*KEYS, "Date"]), RANGE)


@query("filter_employee_type", f"""{_FROM_ABSENCES}, etype AS "Employee Type" FROM absences
  WHERE etype IN ('Aide', 'Teacher Music')""")
def _filter_employee_type(spark, sf):
    df = absences(spark, sf, [*KEYS, "Employee Type"])
    return filters.filter_employee_type(df, ["Aide", "Teacher Music"])


@query("filter_filled", f"""{_FROM_ABSENCES}, filled AS "Filled" FROM absences
  WHERE filled IN ('Filled')""")
def _filter_filled(spark, sf):
    return filters.filter_filled(absences(spark, sf, [*KEYS, "Filled"]), ["Filled"])


@query("filter_school_year", f"""{_FROM_ABSENCES}, sy AS "School Year" FROM absences
  WHERE sy IN ('1997-1998', '1999-2000', 'FY1998')""")
def _filter_school_year(spark, sf):
    df = absences(spark, sf, [*KEYS, "School Year"])
    return filters.filter_school_year(df, ["1997-1998", "1999-2000", "FY1998"])


_FILTERS = RowFilters(
    date_range=RANGE,
    employee_type=("Teacher", "Aide"),
    filled_status=("Filled",),
    school_year=("1997-1998", "1998-1999"),
)
_FILTERS_SQL = """d BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1999-06-30'
  AND etype IN ('Teacher', 'Aide') AND filled = 'Filled' AND sy IN ('1997-1998', '1998-1999')"""


@query("filter_rows", f"""{_FROM_ABSENCES}, d AS "Date", etype AS "Employee Type",
  filled AS "Filled", sy AS "School Year" FROM absences WHERE {_FILTERS_SQL}""")
def _filter_rows(spark, sf):
    df = absences(spark, sf, [*KEYS, "Date", "Employee Type", "Filled", "School Year"])
    return filters.filter_rows(df, _FILTERS)


@query("select_and_filter", f"""{_FROM_ABSENCES}, d AS "Date", filled AS "Filled" FROM absences
  WHERE filled = 'Filled' AND d BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1999-06-30'""")
def _select_and_filter(spark, sf):
    return filters.select_and_filter(
        absences(spark, sf),
        [*KEYS, "Date", "Filled"],
        RowFilters(date_range=RANGE, filled_status=("Filled",), school_year=("1997-1998",)),
    )


_SUBSTITUTE = [*KEYS, "Filled", "Needs Substitute"]


@query("rule1_exact", f"""{_FROM_ABSENCES}, filled AS "Filled", needs AS "Needs Substitute"
  FROM absences WHERE {sql.RULE1_EXACT}""")
def _rule1_exact(spark, sf):
    return rules.rule1_exact(absences(spark, sf, _SUBSTITUTE))


@query("rule1_semantic", f"""WITH {sql.RAW} SELECT {_ROW}, filled AS "Filled",
  needs AS "Needs Substitute" FROM raw WHERE NOT rule1_drops""")
def _rule1_semantic(spark, sf):
    return rules.rule1(raw_absences(spark, sf, _SUBSTITUTE))


@query("rule1_alt_columns", f"""WITH {sql.RAW} SELECT {_ROW}, filled AS "Is Filled",
  needs AS "Substitute Is Required" FROM raw WHERE NOT rule1_drops""")
def _rule1_alt_columns(spark, sf):
    df = raw_absences(spark, sf, _SUBSTITUTE)
    return rules.rule1(df.toDF(*KEYS, "Is Filled", "Substitute Is Required"))


@query("rule2_default", f"""{_FROM_ABSENCES}, etype AS "Employee Type" FROM absences
  WHERE {sql.RULE2}""")
def _rule2_default(spark, sf):
    return rules.rule2(absences(spark, sf, [*KEYS, "Employee Type"]))


@query("rule2_list", f"""{_FROM_ABSENCES}, etype AS "Employee Type" FROM absences
  WHERE etype = 'Aide'""")
def _rule2_list(spark, sf):
    df = absences(spark, sf, [*KEYS, "Employee Type"])
    return rules.rule2(rules.rule2(df, ["Aide"]), [])


@query("rule3_school_year", f"""WITH {sql.RAW} SELECT {_ROW}, sy AS "School Year",
  date_text AS "Date" FROM raw WHERE NOT coalesce(
    (sy IS NOT NULL AND {sql.YEAR_START} IS NOT NULL AND date_text IS NOT NULL AND d IS NULL)
    OR d < {sql.YEAR_START} OR d > {sql.YEAR_END}, false)""")
def _rule3_school_year(spark, sf):
    return rules.rule3(raw_absences(spark, sf, [*KEYS, "School Year", "Date"]))


@query("rule_gating", f"""WITH {sql.RAW} SELECT {_ROW}, etype AS "Employee Type" FROM raw
  WHERE etype = 'Aide' AND d IS NOT NULL AND NOT rule1_drops AND {sql.RULE3}""")
def _rule_gating(spark, sf):
    # The user filtered employee types: Rule 2 stays off, Rules 1 and 3 run.
    df = filters.filter_employee_type(
        raw_absences(spark, sf, [*_SUBSTITUTE, "Date", "School Year", "Employee Type"]), ["Aide"]
    )
    config = RuleConfig(user_filtered_types=True, apply_substitute_rule=False)
    return clean_adaptive(df, config).select(*KEYS, "Employee Type")


@query("drop_all_null_rows", f"""WITH {sql.RAW} SELECT e AS "Employee Identifier",
  atype AS "Absence Type" FROM raw WHERE NOT blank""")
def _drop_all_null_rows(spark, sf):
    return drop_all_null_rows(raw_absences(spark, sf, ["Employee Identifier", "Absence Type"]))


@query("drop_bad_dates", f"""WITH {sql.RAW} SELECT {_ROW}, d AS "Date" FROM raw
  WHERE d IS NOT NULL""")
def _drop_bad_dates(spark, sf):
    return drop_bad_dates(raw_absences(spark, sf, [*KEYS, "Date"]))


@query("first_row_per_employee", f"""WITH {sql.CLEANED}, ranked AS (SELECT *, row_number() OVER (
    PARTITION BY e ORDER BY l_orderkey, l_linenumber, d, sy, atype) AS place FROM cleaned)
  SELECT e AS "Employee Identifier", l_orderkey, l_linenumber, d AS "Date", sy AS "School Year",
    atype AS "Absence Type" FROM ranked WHERE place = 1""")
def _first_row_per_employee(spark, sf):
    order = [*KEYS, "Date", "School Year", "Absence Type"]
    kept = clean_adaptive(absences(spark, sf, [*order, "Employee Identifier", *_SUBSTITUTE[2:],
                                               "Employee Type"]))
    return first_row_per_employee(kept.select("Employee Identifier", *order), order)


# --- scalars -----------------------------------------------------------------


@query("parse_mixed_date", f"""WITH {sql.RAW} SELECT {_ROW}, date_text, d AS parsed FROM raw""")
def _parse_mixed_date(spark, sf):
    df = raw_absences(spark, sf, [*KEYS, "Date"])
    return df.select(*KEYS, F.col("Date").alias("date_text"),
                     parse_mixed_date(F.col("Date")).alias("parsed"))


@query("parse_dates_once", f"""WITH {sql.RAW} SELECT {_ROW}, date_text, d AS parsed FROM raw""")
def _parse_dates_once(spark, sf):
    stored = settle(raw_absences(spark, sf, [*KEYS, "Date"]), "dates")
    return parse_dates_once(stored.withColumnRenamed("Date", "date_text"), "date_text", "parsed")


# --- fixed values: wordings of a date, as Spark and DuckDB write them, and the clock
# that each shows (minutes of the day).
_WORDINGS = (
    ("d MMMM yyyy", "%-d %B %Y", 0), ("MMMM d yyyy", "%B %-d %Y", 0),
    ("EEE, d MMM yyyy", "%a, %-d %b %Y", 0), ("EEEE, MMMM d, yyyy", "%A, %B %-d, %Y", 0),
    ("yyyy.MM.dd", "%Y.%m.%d", 0), ("yyyy MM dd", "%Y %m %d", 0), ("d-MMM-yy", "%-d-%b-%y", 0),
    ("yyyyMMdd 10:00", "%Y%m%d 10:00", 600), ("yyyyMMdd'T'1000", "%Y%m%dT1000", 600),
    ("yyyyMMdd100000", "%Y%m%d100000", 600), ("d'th of' MMMM yyyy", "%-dth of %B %Y", 0),
    ("MMM d'th' yyyy", "%b %-dth %Y", 0), ("MMMM d, yyyy 'at 5:30 PM'", "%B %-d, %Y at 5:30 PM", 1050),
    ("MMM'.' d, yyyy", "%b. %-d, %Y", 0), ("yyyy MMMM d", "%Y %B %-d", 0), ("yyyy-MMM-dd", "%Y-%b-%d", 0),
    ("MM.dd.yyyy", "%m.%d.%Y", 0), ("M d yyyy", "%-m %-d %Y", 0), ("M-d-yy", "%-m-%-d-%y", 0),
    ("d/MMM/yyyy", "%-d/%b/%Y", 0), ("'10:30' d MMMM yyyy", "10:30 %-d %B %Y", 630),
    ("'5:30 pm' MMMM d, yyyy", "5:30 pm %B %-d, %Y", 1050), ("d MMM yyyy '5pm'", "%-d %b %Y 5pm", 1020),
    ("d MMMM yyyy '12 am'", "%-d %B %Y 12 am", 0), ("MMMM d, yyyy, '10:00 a.m.'", "%B %-d, %Y, 10:00 a.m.", 600),
    ("'on' MMMM d yyyy", "on %B %-d %Y", 0), ("ddMMMyyyy", "%d%b%Y", 0), ("yyyy.M.d 10:00", "%Y.%-m.%-d 10:00", 600),
    ("MMMM d, ''yy", "%B %-d, '%y", 0), ("yyyy-MM-dd EEE", "%Y-%m-%d %a", 0),
    ("EEE yyyy-MM-dd", "%a %Y-%m-%d", 0), ("'8:30 AM' M/d/yyyy", "8:30 AM %-m/%-d/%Y", 510),
)
_STYLE = f"((l_orderkey + l_linenumber) % {len(_WORDINGS)})"


@query("parse_date_wordings", f"""SELECT {_ROW}, CASE {_STYLE} """ + " ".join(
    f"WHEN {i} THEN strftime(l_shipdate, '{f.replace(chr(39), chr(39) * 2)}')"
    for i, (_, f, _) in enumerate(_WORDINGS)
) + f""" END AS wording, date_trunc('day', l_shipdate) + CASE {_STYLE} """ + " ".join(
    f"WHEN {i} THEN INTERVAL '{m}' MINUTE" for i, (_, _, m) in enumerate(_WORDINGS)
) + " END AS parsed FROM lineitem")
def _parse_date_wordings(spark, sf):
    shipped = fixture_table(spark, sf, "lineitem").select(*KEYS, "l_shipdate")
    style = (F.col("l_orderkey") + F.col("l_linenumber")) % len(_WORDINGS)
    wording = F.lit(None).cast("string")
    for i, (shape, _, _) in enumerate(_WORDINGS):
        wording = F.when(style == i, F.date_format("l_shipdate", shape)).otherwise(wording)
    cells = shipped.select(*KEYS, wording.alias("wording"))
    return cells.withColumn("parsed", parse_mixed_date(F.col("wording")))


_Y = "(year(l_shipdate) - CASE WHEN month(l_shipdate) < 7 THEN 1 ELSE 0 END)"


@query("school_year_of", f"""SELECT {_ROW}, CAST({_Y} AS VARCHAR) || '-' ||
  CAST({_Y} + 1 AS VARCHAR) AS school_year FROM lineitem""")
def _school_year_of(spark, sf):
    df = absences(spark, sf, [*KEYS, "Date"])
    return df.select(*KEYS, school_year_of(moment_of(df, "Date")).alias("school_year"))


@query("school_year_from_map", f"""SELECT {_ROW}, CAST({_Y} AS VARCHAR) || '-' ||
  CAST({_Y} + 1 AS VARCHAR) AS "School Year" FROM lineitem""")
def _school_year_from_map(spark, sf):
    df = absences(spark, sf, [*KEYS, "Date"])
    return cols.rename_map(df, {"Date": "School Year"})


@query("school_year_bounds", f"""{_FROM_ABSENCES}, sy AS school_year, {sql.YEAR_START} AS first_day,
  {sql.YEAR_END} AS last_day FROM absences""")
def _school_year_bounds(spark, sf):
    first, last = school_year_bounds(F.col("School Year"))
    return absences(spark, sf, [*KEYS, "School Year"]).select(
        *KEYS, F.col("School Year").alias("school_year"), first.alias("first_day"),
        last.alias("last_day"),
    )


@query("school_year_wellformed", f"""{_FROM_ABSENCES}, sy LIKE '____-____' AS wellformed
  FROM absences""")
def _school_year_wellformed(spark, sf):
    return absences(spark, sf, [*KEYS, "School Year"]).select(
        *KEYS, school_year_wellformed(F.col("School Year")).alias("wellformed")
    )


@query("to_number", f"WITH {sql.RAW} SELECT {_ROW}, dur_text, dur AS hours FROM raw")
def _to_number(spark, sf):
    df = raw_absences(spark, sf, [*KEYS, "Duration"])
    return df.select(*KEYS, F.col("Duration").alias("dur_text"),
                     number_of(df, "Duration").alias("hours"))


@query("norm_token", f"WITH {sql.RAW} SELECT {_ROW}, lower(trim(filled)) AS token FROM raw")
def _norm_token(spark, sf):
    df = raw_absences(spark, sf, [*KEYS, "Filled"])
    return df.select(*KEYS, norm_token(F.col("Filled")).alias("token"))


@query("clean_name", f"""WITH {sql.RAW} SELECT {_ROW}, coalesce(trim(fn), '') AS first_name,
  coalesce(trim(ln), '') AS last_name FROM raw""")
def _clean_name(spark, sf):
    df = raw_absences(spark, sf, [*KEYS, FIRST, LAST])
    return df.select(*KEYS, clean_name(F.col(FIRST)).alias("first_name"),
                     clean_name(F.col(LAST)).alias("last_name"))


@query("hours_between", f"""WITH {sql.RAW} SELECT {_ROW}, round(span, 6) AS hours FROM raw
  WHERE start_text IS NOT NULL""")
def _hours_between(spark, sf):
    df = raw_absences(spark, sf, [*KEYS, "Start Time", "End Time"])
    timed = hours_between(df.filter(F.col("Start Time").isNotNull()), "Start Time", "End Time", "hours")
    return timed.select(*KEYS, round6(F.col("hours")).alias("hours"))


@query("absence_days_exact", f"""{_FROM_ABSENCES}, round({sql.DAYS_EXACT}, 6) AS days
  FROM absences""")
def _absence_days_exact(spark, sf):
    df = absences(spark, sf, [*KEYS, "Absence Type", "Duration"])
    return df.select(*KEYS, round6(absence_days_exact(df)).alias("days"))


@query("absence_days_priority", f"WITH {sql.RAW} SELECT {_ROW}, round({sql.DAYS_RAW}, 6) AS days FROM raw")
def _absence_days_priority(spark, sf):
    df = raw_absences(spark, sf, [*KEYS, "Absence Type", "Duration", "Start Time", "End Time",
                                  "Days of Absence", "Absence Reason Usage (Hours)"])
    days = round6(F.col("Absence_Days"))
    return absence_days_priority(df).select(*KEYS, days.alias("days"))


# --- validation and cleaning -------------------------------------------------

_RECORD = [c for c in RAW_COLUMNS if c not in ("School Name", FIRST, LAST)]


@query("validation_report", f"""WITH {sql.RAW}, v AS (SELECT *, NOT blank AND d IS NOT NULL AS valid
    FROM raw), c AS (SELECT
    count(*) FILTER (WHERE blank) AS empty_rows,
    count(*) FILTER (WHERE NOT blank AND d IS NULL) AS bad_dates,
    count(*) FILTER (WHERE valid AND dur < 0) AS negative_durations,
    count(*) FILTER (WHERE valid AND sy IS NOT NULL AND sy NOT LIKE '____-____') AS malformed,
    count(*) FILTER (WHERE valid AND e IS NULL) AS no_id,
    count(*) FILTER (WHERE NOT valid) AS removed,
    count(*) FILTER (WHERE valid) AS final_rows FROM v)
  SELECT 'missing_required_columns' AS "check", CAST(0 AS BIGINT) AS n
  UNION ALL SELECT 'empty_rows', empty_rows FROM c
  UNION ALL SELECT 'bad_dates', bad_dates FROM c
  UNION ALL SELECT 'negative_durations', negative_durations FROM c
  UNION ALL SELECT 'malformed_school_years', malformed FROM c
  UNION ALL SELECT 'missing_employee_ids', no_id FROM c
  UNION ALL SELECT 'rows_removed', removed FROM c
  UNION ALL SELECT 'final_rows', final_rows FROM c""")
def _validation_report(spark, sf):
    return validation_report(raw_absences(spark, sf, _RECORD))


_V, _R1, _R2, _R3 = "d IS NOT NULL", "NOT rule1_drops", sql.RULE2, sql.RULE3


@query("cleaning_stats", f"""WITH {sql.RAW} SELECT count(*) AS original_rows,
  count(*) FILTER (WHERE {_V}) AS after_validation,
  count(*) FILTER (WHERE {_V} AND {_R1}) AS after_rule1,
  count(*) FILTER (WHERE {_V} AND {_R1} AND {_R2}) AS after_rule2,
  count(*) FILTER (WHERE {_V} AND {_R1} AND {_R2} AND {_R3}) AS after_rule3,
  count(*) FILTER (WHERE {_V} AND {_R1} AND {_R2} AND {_R3}) AS final_rows,
  count(*) FILTER (WHERE NOT ({_V} AND {_R1} AND {_R2} AND {_R3})) AS rows_removed FROM raw""")
def _cleaning_stats(spark, sf):
    return cleaning_stats(raw_absences(spark, sf, _RECORD))


@query("cleaning_stats_exact", f"""WITH {sql.ABSENCES} SELECT count(*) AS original_rows,
  count(*) FILTER (WHERE {sql.RULE1_EXACT}) AS after_rule1,
  count(*) FILTER (WHERE {sql.RULE1_EXACT} AND {sql.RULE2}) AS after_rule2,
  count(*) FILTER (WHERE {sql.RULE1_EXACT} AND {sql.RULE2}) AS final_rows,
  count(*) FILTER (WHERE NOT ({sql.RULE1_EXACT} AND {sql.RULE2})) AS rows_removed FROM absences""")
def _cleaning_stats_exact(spark, sf):
    return exact_cleaning_stats(absences(spark, sf, ["Filled", "Needs Substitute", "Employee Type"]))


@query("clean_adaptive", f"""WITH {sql.RAW_CLEANED} SELECT {_ROW}, e AS "Employee Identifier",
  sy AS "School Year", d AS "Date", round(days, 6) AS "Absence_Days" FROM cleaned""")
def _clean_adaptive(spark, sf):
    cleaned = clean_adaptive(raw_absences(spark, sf, [*_RECORD, *KEYS]))
    return cleaned.select(*KEYS, "Employee Identifier", "School Year", "Date",
                          round6(F.col("Absence_Days")).alias("Absence_Days"))


@query("clean_exact", f"""{_FROM_ABSENCES}, e AS "Employee Identifier", sy AS "School Year",
  round({sql.DAYS_EXACT}, 6) AS "Absence_Days" FROM absences
  WHERE {sql.RULE1_EXACT} AND {sql.RULE2}""")
def _clean_exact(spark, sf):
    cleaned = clean_exact(absences(spark, sf))
    return cleaned.select(*KEYS, "Employee Identifier", "School Year",
                          round6(F.col("Absence_Days")).alias("Absence_Days"))
