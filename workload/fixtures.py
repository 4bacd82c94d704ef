"""Absence records derived from the supplied tables.

Each line item is one absence. `absences` is the typed form, `raw_absences` the
same records as an export would hold them: all text, mixed date styles, several
wordings, missing cells. Both touch only the columns asked for, and look up
names or schools only if those are among them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from absentia.functions.lateral import with_computed

ORDER_COLUMNS = ("l_orderkey", "l_linenumber")
# Rows share order and line numbers; a total order adds what else sets them apart.
TOTAL_ORDER = ("l_orderkey", "l_linenumber", "Date", "Employee Identifier", "School Year",
               "Absence Type", "Duration", "Filled", "Needs Substitute")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_lookups(lines: DataFrame, spark, sf_dir: str, wanted: set[str]) -> DataFrame:
    # Left joins with keys unique on the right: every absence stays, once. Sizes
    # decide the strategy at run time; nothing is broadcast unseen.
    if "School Name" in wanted:
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        schools = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        lines = lines.join(schools, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    if wanted & {"Employee First Name", "Employee Last Name"}:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return lines


# Costly to make: each in a step of its own.
_COSTLY = ("School Year", "Date", "Start Time", "End Time")


def _records(
    lines: DataFrame, made: dict[str, Column], names: list[str], made_once: Sequence[str]
) -> DataFrame:
    """The named columns; those in `made_once` are made once per row, as if read
    from a file, and not again by each rule that looks at them."""
    once = [n for n in names if n in made_once]
    steps = [[n] for n in once if n in _COSTLY] + [[n for n in once if n not in _COSTLY]]
    for step in filter(None, steps):
        lines = with_computed(lines, {n: made[n] for n in step})
    return lines.select([(F.col(n) if n in once else made[n]).alias(n) for n in names])


def _start_year() -> Column:
    shipped = F.col("l_shipdate")
    return F.year(shipped) - F.when(F.month(shipped) < 7, 1).otherwise(0)


def _year_label(first: Column) -> Column:
    return F.concat_ws("-", first.cast("string"), (first + 1).cast("string"))


def _typed_columns() -> dict[str, Column]:
    y, line, quantity = _start_year(), F.col("l_linenumber"), F.col("l_quantity")
    kind = quantity % 5
    absence_type = (
        F.when(kind == 0, "Full Day")
        .when(kind == 1, "AM Half Day")
        .when(kind == 2, "PM Half Day")
        .when(kind == 3, "Custom Duration")
        .otherwise("Sick")
    )
    return {
        "School Year": F.when(
            (F.col("l_discount") > 0.095) & (line == 1), F.concat(F.lit("FY"), y.cast("string"))
        )
        .when(F.col("l_tax") > 0.075, _year_label(y - 1))
        .otherwise(_year_label(y)),
        "Date": F.col("l_shipdate"),
        "Employee Identifier": F.col("l_partkey").cast("string"),
        "Employee First Name": F.col("p_brand"),
        "Employee Last Name": F.col("p_name"),
        "School Name": F.col("n_name"),
        "Employee Type": F.when(line == 3, "Teacher Music")
        .when(line == 4, "Teacher SpecEd")
        .when(line == 5, "Aide")
        .when(line != 7, "Teacher"),
        "Absence Type": absence_type,
        "Duration": F.when((line == 2) & (F.col("l_discount") < 0.005), F.lit(-1.0)).when(
            (line == 1) | (kind == 3), quantity / 4
        ),
        "Filled": F.when(F.col("l_linestatus") == "F", "Filled").otherwise("Unfilled"),
        "Needs Substitute": F.when(F.col("l_returnflag") == "N", "NO").when(
            F.col("l_returnflag") == "A", "YES"
        ),
        "l_orderkey": F.col("l_orderkey"),
        "l_linenumber": F.col("l_linenumber"),
        "row_no": F.col("l_orderkey") * 8 + F.col("l_linenumber"),
    }


def absences(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Typed absence records under standard names."""
    made = _typed_columns()
    names = list(columns or [n for n in made if n != "row_no"])
    lines = _with_lookups(table(spark, sf_dir, "lineitem"), spark, sf_dir, set(names))
    return _records(lines, made, names, ["School Year"])


def _date_text() -> Column:
    shipped, style = F.col("l_shipdate"), F.col("l_orderkey") % 12
    day_first = F.dayofmonth(shipped) > 12
    return (
        F.when(style == 0, F.date_format(shipped, "yyyy-MM-dd' 08:30:00'"))
        .when(style == 1, F.date_format(shipped, "yyyy-MM-dd"))
        .when(style == 2, F.date_format(shipped, "M/d/yyyy"))
        .when(style == 3, F.date_format(shipped, "MM-dd-yyyy"))
        .when((style == 4) & day_first, F.date_format(shipped, "dd/MM/yyyy"))
        .when(style == 4, F.date_format(shipped, "MM/dd/yyyy"))
        .when(style == 5, F.date_format(shipped, "yyyy/M/d"))
        .when(style == 6, F.date_format(shipped, "MMMM d, yyyy"))
        .when(style == 7, F.date_format(shipped, "MMM dd, yyyy"))
        .when(style == 8, F.date_format(shipped, "M/d/yy"))
        .when(style == 9, F.date_format(shipped, "dd-MMM-yyyy"))
        .when(style == 10, F.date_format(shipped, "'  'yyyy-MM-dd'T08:30'"))
        .when(F.col("l_linenumber") == 7, F.lit("bad"))
        .otherwise(F.date_format(shipped, "yyyyMMdd"))
    )


def _clock_text(minutes: Column, half_day_style: Column) -> Column:
    hour, minute = F.floor(minutes / 60), minutes % 60
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    two = F.lpad(minute.cast("string"), 2, "0")
    return F.when(
        half_day_style,
        F.concat(
            shown.cast("string"), F.lit(":"), two, F.when(hour < 12, " AM").otherwise(" PM")
        ),
    ).otherwise(F.concat(hour.cast("string"), F.lit(":"), two))


def _raw_columns() -> dict[str, Column]:
    typed = _typed_columns()
    line, quantity, style = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_orderkey") % 4
    timed = quantity % 5 == 4
    start = 420 + (line % 3) * 30
    minutes = F.when(line == 3, -30).otherwise((quantity * 6).cast("int"))
    unfilled, unneeded = F.col("l_linestatus") != "F", F.col("l_returnflag") == "N"
    missing = F.lit(None).cast("string")
    raw = {
        "School Year": F.when((line == 6) & (F.col("l_tax") < 0.005), missing).otherwise(
            typed["School Year"]
        ),
        "Date": _date_text(),
        "Employee Identifier": F.when(
            (line == 7) & (F.col("l_tax") < 0.005), missing
        ).otherwise(F.lpad(F.col("l_partkey").cast("string"), 9, "0")),
        "Employee First Name": F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")),
        "Employee Last Name": F.when(F.col("l_partkey") % 50 != 0, F.col("p_name")),
        "School Name": F.col("n_name"),
        "Employee Type": typed["Employee Type"],
        "Absence Type": typed["Absence Type"],
        "Duration": F.when(quantity % 7 == 0, F.concat(quantity.cast("int").cast("string"), F.lit("d")))
        .otherwise(typed["Duration"].cast("string")),
        "Start Time": F.when(timed, _clock_text(start, line % 2 == 1)),
        "End Time": F.when(timed, _clock_text(start + minutes, line % 2 == 1)),
        "Days of Absence": F.when((line == 5) & (quantity > 45), "1").when(
            (line == 5) & (quantity < 5), "-1"
        ),
        "Absence Reason Usage (Hours)": F.when(line == 6, F.lit("7.5")),
        "Filled": F.when(~unfilled, "Filled")
        .when(style == 0, "Unfilled")
        .when(style == 1, "No")
        .when(style == 2, "0")
        .otherwise(" unfilled"),
        "Needs Substitute": F.when(unneeded & (style == 2), "0.00")
        .when(unneeded & (style == 3), "n")
        .when(unneeded, "NO")
        .when(F.col("l_returnflag") == "A", "YES"),
        "Hire Date": F.date_format(F.col("l_shipdate") - F.expr("INTERVAL '3' YEAR"), "yyyy-MM-dd"),
    }
    blank = (F.col("l_orderkey") % 97 == 0) & (line == 1)
    return {n: F.when(~blank, c) for n, c in raw.items()} | {
        n: typed[n] for n in ("l_orderkey", "l_linenumber", "row_no")
    }


RAW_COLUMNS = (
    "School Year", "Date", "Employee Identifier", "Employee First Name", "Employee Last Name",
    "School Name", "Employee Type", "Absence Type", "Duration", "Start Time", "End Time",
    "Days of Absence", "Absence Reason Usage (Hours)", "Filled", "Needs Substitute", "Hire Date",
)


def raw_absences(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """The records as text; some rows are empty, some cells unreadable."""
    made = _raw_columns()
    names = list(columns or RAW_COLUMNS)
    lines = _with_lookups(table(spark, sf_dir, "lineitem"), spark, sf_dir, set(names))
    return _records(lines, made, names, RAW_COLUMNS)
