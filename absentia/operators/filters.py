"""Row filters a user may set before cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from absentia.config import RowFilters
from absentia.functions.dates import moment_of
from absentia.functions.text import ref
from absentia.operators.columns import dedup_header, select_strict
from absentia.functions.lateral import with_computed
from absentia.vocabulary import DATE, EMPLOYEE_TYPE, FILLED, SCHOOL_YEAR


def _moment_literal(value) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def filter_date_range(df: DataFrame, date_range: tuple | None) -> DataFrame:
    """Dates within both bounds, inclusive; no-op unless both are given.

    A text column leaves parsed, and unreadable dates drop out.
    """
    if DATE not in df.columns or not date_range:
        return df
    df = with_computed(df, {DATE: moment_of(df, DATE)})
    first, last = date_range
    if not first or not last:
        return df
    return df.filter(ref(DATE).between(_moment_literal(first), _moment_literal(last)))


def _filter_in(df: DataFrame, column: str, values) -> DataFrame:
    if column not in df.columns or not values:
        return df
    return df.filter(ref(column).isin(*values))


def filter_employee_type(df: DataFrame, values) -> DataFrame:
    return _filter_in(df, EMPLOYEE_TYPE, values)


def filter_filled(df: DataFrame, values) -> DataFrame:
    return _filter_in(df, FILLED, values)


def filter_school_year(df: DataFrame, values) -> DataFrame:
    return _filter_in(df, SCHOOL_YEAR, values)


def rows_wanted(df: DataFrame, filters: RowFilters) -> Column:
    """The condition that `filter_rows` filters by, for a frame with parsed dates."""
    wanted = F.lit(True)
    chosen = (
        (EMPLOYEE_TYPE, filters.employee_type),
        (FILLED, filters.filled_status),
        (SCHOOL_YEAR, filters.school_year),
    )
    for column, values in chosen:
        if column in df.columns and values:
            wanted = wanted & F.coalesce(ref(column).isin(*values), F.lit(False))
    first, last = filters.date_range or (None, None)
    if DATE in df.columns and first and last:
        within = ref(DATE).between(_moment_literal(first), _moment_literal(last))
        wanted = wanted & F.coalesce(within, F.lit(False))
    return wanted


def filter_rows(df: DataFrame, filters: RowFilters, require_rows: bool = False) -> DataFrame:
    """All filters together. `require_rows` costs a one-row job to raise on none."""
    kept = dedup_header(df) if len(set(df.columns)) < len(df.columns) else df
    kept = filter_employee_type(kept, filters.employee_type)
    kept = filter_filled(kept, filters.filled_status)
    kept = filter_school_year(kept, filters.school_year)
    kept = filter_date_range(kept, filters.date_range)
    if require_rows and kept.isEmpty():
        raise ValueError("no data after applying filters")
    return kept


def select_and_filter(df: DataFrame, columns, filters: RowFilters) -> DataFrame:
    return filter_rows(select_strict(df, columns), filters)
