"""Costly scalars worked out once for each distinct text.

A column of dates or names repeats a few ten thousand texts over any number of rows. For
a stored table it pays to evaluate those texts and attach the results; a column of
mostly different texts, or a short one, is evaluated row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from absentia.functions.dates import parse_mixed_date
from absentia.functions.lateral import with_computed
from absentia.functions.text import ref
from absentia.operators.skew import attach
from absentia.sources.storage import settle

# Fewer rows are not worth the passes over them.
WORTH_ROWS = 100_000
# Rows for each distinct text from which on evaluating once pays.
REPEATS = 8


def with_coded(
    df: DataFrame, target: str, column: str, evaluate: Callable[[Column], Column]
) -> DataFrame:
    """Add (or replace) `target` = evaluate(column), a text column.

    One narrow pass estimates how many texts there are (a sketch). If they repeat, a
    second counts them, each is evaluated once and kept in the shared folder, and rows
    meet their result by `attach`: texts that are everywhere by broadcast, of which
    there are few, the others as the size of their table allows.
    """
    rows, distinct = df.agg(F.count(ref(column)), F.approx_count_distinct(ref(column), 0.05)).first()
    if rows < WORTH_ROWS or distinct * REPEATS > rows:
        return with_computed(df, {target: evaluate(ref(column))})
    texts = df.where(ref(column).isNotNull()).groupBy(ref(column).alias("_text"))
    counted = texts.agg(F.count("*").alias("n"))
    known = settle(counted.withColumn("_value", evaluate(F.col("_text"))), "coded")
    keyed = df.withColumn("_text", ref(column))
    met = attach(keyed, known, "_text", ["_value"], F.monotonically_increasing_id(), "_coded")
    names = list(df.columns) + ([target] if target not in df.columns else [])
    return met.select(
        [F.col("_coded._value").alias(n) if n == target else ref(n) for n in names]
    )


def parse_dates_once(df: DataFrame, column: str, target: str) -> DataFrame:
    """Mixed dates of a stored text column, each distinct text parsed once."""
    return with_coded(df, target, column, parse_mixed_date)
