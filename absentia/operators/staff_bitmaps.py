"""Distinct staff of any union of years or files, from stored bitmaps.

Employees get dense numbers once. A year's (or file's) staff is then a set of bits,
4 KB for each 32,768 employees, and the staff of a union is the bits set in any of its
parts: exact, and mergeable without going back to (year, employee) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from absentia.operators.numbering import numbered


def staff_numbers(book: DataFrame) -> DataFrame:
    """employee_id, number: every known employee of a ledger, numbered without gaps."""
    known = book.where(F.col("employee_id").isNotNull())
    return numbered(known.select("employee_id").distinct())


def add_staff(numbers: DataFrame, book: DataFrame) -> DataFrame:
    """Numbers for the employees of one more ledger; those there are keep theirs."""
    fresh = staff_numbers(book.join(numbers, "employee_id", "left_anti"))
    size = numbers.agg(F.count("*")).first()[0]
    return numbers.unionByName(fresh.withColumn("number", F.col("number") + size))


def staff_bitmaps(
    book: DataFrame, numbers: DataFrame, by: Sequence[str] = ("school_year",)
) -> DataFrame:
    """by, bucket, bitmap, days: who is in each part, and the days of the part's bucket.

    Worth storing: what follows reads these rows only. Employees without an identifier
    have no bit; their days are in a bucket of their own (null).
    """
    staff = book.groupBy(*by, "employee_id").agg(F.sum("days").alias("days"))
    # One row an employee and part on the left, one an employee on the right.
    met = staff.join(numbers, "employee_id", "left")
    return met.groupBy(*by, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"),
        F.sum("days").alias("days"),
    )


def distinct_staff(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, total_staff, total_days: each employee once, in however many parts."""
    merged = bitmaps.groupBy(*by, "bucket").agg(
        F.bitmap_or_agg("bitmap").alias("bitmap"), F.sum("days").alias("days")
    )
    staff = F.when(F.col("bucket").isNotNull(), F.bitmap_count("bitmap"))
    return merged.groupBy(*by).agg(
        F.coalesce(F.sum(staff), F.lit(0)).cast("bigint").alias("total_staff"),
        F.coalesce(F.sum("days"), F.lit(0.0)).alias("total_days"),
    )
