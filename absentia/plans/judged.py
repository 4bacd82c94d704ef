"""One pass over the records: the ledger and every count of a run at once.

Each row is judged instead of filtered: `fell` says where it left (at a row filter, as
empty, for its date, at a rule) or is null. The ledger's aggregate groups by it, fallen
rows without their keys, so they add a handful of groups. Row counts, the validation
report and the cleaning steps are sums over that one small table.

The counts travel through the ledger's shuffle, not through metrics observed beside it:
those count a task again when it is repeated after an executor was lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from absentia.config import RowFilters, RuleConfig
from absentia.functions.days import absence_days_priority
from absentia.functions.dates import school_year_wellformed
from absentia.functions.lateral import with_computed
from absentia.functions.text import ref
from absentia.operators.filters import rows_wanted
from absentia.operators.rules import gated_rules
from absentia.operators.totals import rating_frame
from absentia.operators.validation import as_rows, flagged, record_columns
from absentia.vocabulary import (
    DATE,
    DURATION,
    EMPLOYEE_ID,
    END_TIME,
    SCHOOL_YEAR,
    START_TIME,
    VALIDATION_COLUMNS,
)

FILTERED, EMPTY, BAD_DATE = "filter", "empty", "bad_date"
RULES = ("rule1", "rule2", "rule3")
# Checks on valid rows, whatever the rules then do with them.
CHECKS = ("negative_durations", "malformed_school_years", "missing_employee_ids")


def _named_checks(columns: Sequence[str]) -> dict[str, Column]:
    checks = {}
    if DURATION in columns:
        checks[CHECKS[0]] = ref(DURATION) < 0
    if SCHOOL_YEAR in columns:
        checks[CHECKS[1]] = ~school_year_wellformed(ref(SCHOOL_YEAR))
    if EMPLOYEE_ID in columns:
        checks[CHECKS[2]] = ref(EMPLOYEE_ID).isNull()
    return checks


def judge(
    renamed: DataFrame, filters: RowFilters, config: RuleConfig, also: Sequence[Column] = ()
) -> DataFrame:
    """All rows, dates and durations typed, with `_fell` and the checks; `also` are
    columns to be read off the raw cells."""
    marked = flagged(renamed, also)
    readable = ref(DATE).isNotNull() if DATE in marked.columns else F.lit(True)
    fell = (
        F.when(~rows_wanted(marked, filters), FILTERED)
        .when(~F.col("_content"), EMPTY)
        .when(~readable, BAD_DATE)
    )
    for name, keep in gated_rules(marked, config):
        if keep is not None:
            fell = fell.when(~keep, name)
    columns = record_columns(renamed)
    verdicts = {f"_{c}": F.coalesce(v, F.lit(False)) for c, v in _named_checks(columns).items()}
    return with_computed(marked, {"_fell": fell, **verdicts}).drop("_content")


def judged_ledger(
    judged: DataFrame, with_names: bool = True, order_by: Sequence[str] = ()
) -> DataFrame:
    """The ledger with `fell` and the sums of the checks; fallen rows have no keys.

    Times are looked at only in rows that stay: reading them costs most.
    """
    stays = F.col("_fell").isNull()
    times = {c: F.when(stays, ref(c)) for c in (START_TIME, END_TIME) if c in judged.columns}
    days = absence_days_priority(judged.withColumns(times) if times else judged)
    checks = [c for c in CHECKS if f"_{c}" in judged.columns]
    frame = rating_frame(days, with_names, order_by, also=["_fell", *[f"_{c}" for c in checks]])
    keys = ["school_year", "employee_id"] + (["first_name", "last_name"] if with_names else [])
    counted = frame.withColumns({k: F.when(stays, F.col(k)) for k in keys})
    totals = [F.sum(F.when(stays, F.col("absence_days"))).alias("days"), F.count("*").alias("n_rows")]
    if with_names:
        totals.append(F.min(F.when(stays, F.col("row_order"))).alias("row_order"))
    totals += [F.count_if(f"_{c}").alias(c) for c in checks]
    return counted.groupBy(F.col("_fell").alias("fell"), *keys).agg(*totals)


def ledger_of(book: DataFrame) -> DataFrame:
    """What is rated: the rows that stayed."""
    return book.where(F.col("fell").isNull()).drop("fell", *CHECKS)


def _rows(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n_rows"))), F.lit(0)).cast("bigint")


def _in(*names: str) -> Column:
    return F.coalesce(F.col("fell").isin(*names), F.lit(False))


def row_counts(book: DataFrame) -> DataFrame:
    """rows_raw, rows_selected, rows_cleaned: one row."""
    return book.agg(
        _rows(F.lit(True)).alias("rows_raw"),
        _rows(~_in(FILTERED)).alias("rows_selected"),
        _rows(F.col("fell").isNull()).alias("rows_cleaned"),
    )


def step_counts(book: DataFrame) -> DataFrame:
    """As `cleaning_stats` counts them, from the book."""
    gone = [FILTERED, EMPTY, BAD_DATE]
    counts = [_rows(~_in(FILTERED)).alias("original_rows"), _rows(~_in(*gone)).alias("after_validation")]
    for rule in RULES:
        gone.append(rule)
        counts.append(_rows(~_in(*gone)).alias(f"after_{rule}"))
    left, selected = _rows(~_in(*gone)), _rows(~_in(FILTERED))
    return book.agg(*counts, left.alias("final_rows"), (selected - left).alias("rows_removed"))


def checks_report(book: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As `validation_report` counts them for records of these columns, from the book."""
    missing = [c for c in VALIDATION_COLUMNS if c not in columns]
    valid = ~_in(FILTERED, EMPTY, BAD_DATE)
    counts = {"missing_required_columns": F.max(F.lit(len(missing))), "empty_rows": _rows(_in(EMPTY))}
    if DATE in columns:
        counts["bad_dates"] = _rows(_in(BAD_DATE))
    for c in _named_checks(columns):
        counts[c] = F.sum(F.when(valid, F.col(c)))
    counts["rows_removed"] = _rows(_in(EMPTY, BAD_DATE))
    counts["final_rows"] = _rows(valid)
    empty = {"missing_required_columns": len(missing)}
    row = book.agg(
        *[F.coalesce(c, F.lit(empty.get(n, 0))).cast("bigint").alias(n) for n, c in counts.items()]
    )
    return as_rows(row, "check", "n")
