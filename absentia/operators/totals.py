"""Absence days added up per school year and employee.

Everything a rating needs derives from one compact table, the ledger: one row
per (school year, employee, first name, last name). It is the only aggregate
that sees raw rows, and its partial sums leave the map side, so an employee who
holds a third of all rows still sends one row per task. Later totals group the
ledger, never the raw data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from absentia.functions.numbers import number_of, round6
from absentia.functions.text import clean_name, ref
from absentia.operators.columns import (
    derive_school_year,
    normalize_for_rating,
    pick_name_columns,
    require_columns,
)
from absentia.vocabulary import ABSENCE_DAYS, EMPLOYEE_ID, SCHOOL_YEAR


def rating_frame(
    cleaned: DataFrame,
    with_names: bool = False,
    order_by: Sequence[str] = (),
    also: Sequence[str] = (),
) -> DataFrame:
    """The columns a rating reads, under neutral names.

    school_year, employee_id, absence_days and, if asked for, first_name,
    last_name and row_order (where a row stands in its source). Columns in `also`
    are passed on as they are.
    """
    df = derive_school_year(normalize_for_rating(cleaned))
    require_columns(df)
    columns = [
        ref(SCHOOL_YEAR).cast("string").alias("school_year"),
        ref(EMPLOYEE_ID).alias("employee_id"),
        number_of(df, ABSENCE_DAYS).alias("absence_days"),
    ]
    if with_names:
        first, last = pick_name_columns(df.columns)
        columns += [
            (clean_name(ref(first)) if first else F.lit("")).alias("first_name"),
            (clean_name(ref(last)) if last else F.lit("")).alias("last_name"),
            order_key(order_by).alias("row_order"),
        ]
    return df.select(columns + [ref(c) for c in also])


def order_key(order_by: Sequence[str]) -> Column:
    """One comparable value that says which row comes first."""
    if not order_by:
        return F.lit(0).cast("bigint")
    if len(order_by) == 1:
        return ref(order_by[0])
    return F.struct(*[ref(c) for c in order_by])


def ledger(frame: DataFrame) -> DataFrame:
    """Days (null if all are missing) per school year, employee and name.

    Rows of unknown year or employee stay, under null. Days are not rounded:
    rounding comes after the last addition.
    """
    named = "first_name" in frame.columns
    keys = ["school_year", "employee_id"] + (["first_name", "last_name"] if named else [])
    totals = [F.sum("absence_days").alias("days"), F.count(F.lit(1)).alias("n_rows")]
    if named:
        totals.append(F.min("row_order").alias("row_order"))
    return frame.groupBy(*keys).agg(*totals)


def staff_years(book: DataFrame) -> DataFrame:
    """Unrounded total per known (school year, employee)."""
    known = F.col("school_year").isNotNull() & F.col("employee_id").isNotNull()
    return (
        book.filter(known)
        .groupBy("school_year", "employee_id")
        .agg(F.coalesce(F.sum("days"), F.lit(0.0)).alias("total_days"))
    )


def teacher_days(book: DataFrame) -> DataFrame:
    return staff_years(book).withColumn("total_days", round6(F.col("total_days")))


def employee_totals(book: DataFrame) -> DataFrame:
    """Unrounded total per known employee over all known years."""
    known = F.col("school_year").isNotNull() & F.col("employee_id").isNotNull()
    return (
        book.filter(known)
        .groupBy("employee_id")
        .agg(F.coalesce(F.sum("days"), F.lit(0.0)).alias("total_days"))
    )


def employee_days(book: DataFrame) -> DataFrame:
    return employee_totals(book).withColumn("total_days", round6(F.col("total_days")))


def staff_totals_and_names(book: DataFrame) -> DataFrame:
    """Unrounded total and names per employee: one aggregate instead of a join.

    Names are those of the employee's first row, of any year; equal places are
    settled by the names themselves.
    """
    in_year = F.col("school_year").isNotNull()
    return (
        book.filter(F.col("employee_id").isNotNull())
        .groupBy("employee_id")
        .agg(
            F.sum(F.when(in_year, F.coalesce("days", F.lit(0.0)))).alias("total_days"),
            F.min_by(
                F.struct("first_name", "last_name"),
                F.struct("row_order", "first_name", "last_name"),
            ).alias("names"),
        )
        .filter(F.col("total_days").isNotNull())
        .select("employee_id", "names.first_name", "names.last_name", "total_days")
    )


def employee_names(frame: DataFrame) -> DataFrame:
    """(employee_id, first_name, last_name) off each employee's first row.

    Rows shrink to one per distinct spelling before anything is compared.
    """
    spellings = (
        frame.filter(F.col("employee_id").isNotNull())
        .groupBy("employee_id", "first_name", "last_name")
        .agg(F.min("row_order").alias("row_order"))
    )
    return (
        spellings.groupBy("employee_id")
        .agg(
            F.min_by(
                F.struct("first_name", "last_name"),
                F.struct("row_order", "first_name", "last_name"),
            ).alias("names")
        )
        .select("employee_id", "names.first_name", "names.last_name")
    )


def join_employee_names(details: DataFrame, names: DataFrame) -> DataFrame:
    """Add names to rows of one employee each; unknown employees get ''.

    Both sides hold an employee at most once, so no key is hot and the join
    strategy is left to the planner, which knows the sizes at run time.
    """
    return details.join(names, "employee_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in ("first_name", "last_name")}
    )


def first_row_per_employee(
    df: DataFrame, order_by: Sequence[str], key: str = EMPLOYEE_ID
) -> DataFrame:
    """Each employee's first row; rows without an employee count as one.

    A minimum, not a window: partial minima leave the map side, while a window
    would bring all rows of one employee into one task.
    """
    columns = df.columns
    whole = F.struct(*[ref(c) for c in columns])
    place = F.struct(*[ref(c) for c in order_by])
    return (
        df.groupBy(ref(key).alias("_key"))
        .agg(F.min_by(whole, place).alias("_row"))
        .select([F.col("_row").getField(c).alias(c) for c in columns])
    )
