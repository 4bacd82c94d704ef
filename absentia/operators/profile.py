"""Profiles of a data set: what a person or a rule author looks at first.

Only aggregates and a bounded number of sample rows leave the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from absentia.functions.dates import moment_of
from absentia.functions.text import ref
from absentia.operators.frequent import leading_values
from absentia.operators.rules import rule3_keep
from absentia.vocabulary import (
    DATE,
    EMPLOYEE_TYPE,
    MISMATCH_MESSAGES,
    MISMATCH_SAMPLE_ROWS,
    PREVIEW_ROWS,
    SCHOOL_YEAR,
    TOP_CATEGORIES,
    VALUE_VIEW_CATEGORIES,
)


def _ordered(order_by: Sequence[str]) -> list[Column]:
    return [ref(c).asc_nulls_last() for c in order_by]


def sample_rows(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """The first n rows in a stated order: a top-n, not a full sort."""
    return df.orderBy(_ordered(order_by)).limit(n)


def preview(df: DataFrame, order_by: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows with every column as text."""
    return sample_rows(df, order_by, n).select(
        [ref(c).cast("string").alias(c) for c in df.columns]
    )


def fingerprint_of(columns: Sequence[str], n_rows: Column) -> Column:
    """Short hash of the sorted column names and a row count, not of contents."""
    names = repr(tuple(sorted(columns)))
    text = F.concat(F.lit(names + "|"), n_rows.cast("string"))
    return F.substring(F.sha2(text, 256), 1, 16)


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    count = df.agg(F.count(F.lit(1)).alias("n"))
    return count.select(fingerprint_of(df.columns, F.col("n")).alias("dataset_fingerprint"))


def file_info(df: DataFrame) -> DataFrame:
    """One row per column: its place, name and type beside the overall counts."""
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    fields = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return rows.select("n_rows", F.lit(len(fields)).alias("n_columns"), F.inline(F.array(*fields)))


def structure_profile(df: DataFrame) -> DataFrame:
    """Per column: type and number of nulls, beside the row count. One pass."""
    nulls = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(ref(c).isNull()).alias(f"_nulls_{i}") for i, c in enumerate(df.columns)],
    )
    fields = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"_nulls_{i}").alias("n_nulls"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return nulls.select("n_rows", F.inline(F.array(*fields)))


def null_counts(df: DataFrame) -> DataFrame:
    return structure_profile(df).select("column_name", "n_nulls")


def top_values(df: DataFrame, column: str, n: int = TOP_CATEGORIES) -> DataFrame:
    """Most frequent values; equal counts in order of value."""
    counted, _ = leading_values(df, {column: n}, numbers=False)
    return (
        counted.groupBy("value")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), F.col("value"))
        .limit(n)
    )


def column_value_view(
    df: DataFrame, columns: Sequence[str] | None = None, n: int = VALUE_VIEW_CATEGORIES
) -> DataFrame:
    """What is in each column: (column_name, rank, value, number_value).

    A column of numbers shows its distinct values if there are at most n, else
    its minimum and maximum; any other column shows its n most frequent values.
    Two scans: a summary of every column, then exact counts of its candidates
    (`operators/frequent.py`); only a column whose leading values the summary cannot
    prove has its values counted in full.
    """
    columns = list(columns or df.columns)
    counted, known = leading_values(df, dict.fromkeys(columns, n))
    numbers = [c for c in columns if known[c]["n"] and known[c]["n_numbers"] == known[c]["n"]]
    few = [c for c in numbers if known[c]["n_distinct"] is not None]
    ends = [
        (c, i, None, known[c][end])
        for c in numbers
        if c not in few
        for i, end in ((1, "low"), (2, "high"))
    ]
    by_count = Window.partitionBy("column_name").orderBy(F.col("n").desc(), "value")
    words = (
        counted.filter(~F.col("column_name").isin(numbers))
        .withColumn("rank", F.row_number().over(by_count))
        .filter(F.col("rank") <= n)
        .select("column_name", "rank", "value", F.lit(None).cast("double").alias("number_value"))
    )
    by_value = Window.partitionBy("column_name").orderBy("number_value")
    lowest = (
        counted.filter(F.col("column_name").isin(few))
        .select("column_name", "number_value")
        .distinct()
        .withColumn("rank", F.row_number().over(by_value))
        .select("column_name", "rank", F.lit(None).cast("string").alias("value"), "number_value")
    )
    many = df.sparkSession.createDataFrame(ends, words.schema)
    return words.unionByName(lowest).unionByName(many)


def date_range(df: DataFrame) -> DataFrame:
    moment = moment_of(df, DATE)
    return df.select(moment.alias("moment")).agg(
        F.min("moment").alias("min_date"), F.max("moment").alias("max_date")
    )


def distinct_types(df: DataFrame, column: str = EMPLOYEE_TYPE) -> DataFrame:
    """Non-blank values in order."""
    value = ref(column).cast("string")
    return (
        df.filter(F.trim(value) != "")
        .select(value.alias("employee_type"))
        .distinct()
        .orderBy("employee_type")
    )


def date_mismatch_sample(
    df: DataFrame,
    order_by: Sequence[str],
    rows: int = MISMATCH_SAMPLE_ROWS,
    messages: int = MISMATCH_MESSAGES,
) -> DataFrame:
    """Up to ten messages on dates outside their school year, in the first rows."""
    head = sample_rows(df, order_by, rows)
    return (
        head.filter(~rule3_keep(head))
        .orderBy(_ordered(order_by))
        .limit(messages)
        .select(
            F.format_string(
                "School Year %s has date %s", ref(SCHOOL_YEAR), ref(DATE).cast("string")
            ).alias("issue")
        )
    )
