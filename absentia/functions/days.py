"""Length of one absence in days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from absentia.functions.dates import hours_from, moment_or_clock
from absentia.functions.lateral import with_computed
from absentia.functions.numbers import number_of
from absentia.functions.text import ref, strip
from absentia.vocabulary import (
    ABSENCE_DAYS,
    ABSENCE_TYPE,
    CUSTOM_DURATION,
    DAY_COUNT_COLUMNS,
    DAYS_BY_ABSENCE_TYPE,
    DURATION,
    END_TIME,
    HOURS_PER_DAY,
    START_TIME,
    USAGE_HOURS,
)


def _days_by_type(df: DataFrame) -> Column:
    """1 or 0.5 where the absence type says so outright, else null."""
    if ABSENCE_TYPE not in df.columns:
        return F.lit(None).cast("double")
    kind = strip(ref(ABSENCE_TYPE))
    days = F.lit(None).cast("double")
    for name, length in DAYS_BY_ABSENCE_TYPE.items():
        days = F.when(kind == name, F.lit(length)).otherwise(days)
    return days


def absence_days_exact(df: DataFrame) -> Column:
    """Days by absence type alone; a day column already present wins as a whole."""
    if ABSENCE_DAYS in df.columns:
        return ref(ABSENCE_DAYS)
    days = _days_by_type(df)
    if ABSENCE_TYPE in df.columns and DURATION in df.columns:
        custom = strip(ref(ABSENCE_TYPE)) == CUSTOM_DURATION
        days = F.coalesce(days, F.when(custom, number_of(df, DURATION) / HOURS_PER_DAY))
    return F.coalesce(days, F.lit(0.0))


def absence_days_priority(df: DataFrame) -> DataFrame:
    """Set the days to the first source that has an answer for the row.

    A day count on file, then hours, then start and end time, then the absence
    type, else 0. Usage hours stand in only for a missing duration: a negative
    duration moves on to the times. Times are parsed in steps of their own, and
    only in rows that get that far: one expression for all sources would grow
    beyond what the JVM compiles.
    """
    present = set(df.columns)
    sources = []
    for name in DAY_COUNT_COLUMNS:
        if name in present:
            count = number_of(df, name)
            sources.append(F.when(count >= 0, count))
    hour_columns = [number_of(df, n) for n in (DURATION, USAGE_HOURS) if n in present]
    if hour_columns:
        hours = F.coalesce(*hour_columns)
        sources.append(F.when(hours >= 0, hours / HOURS_PER_DAY))
    last = [_days_by_type(df), F.lit(0.0)]
    if not {START_TIME, END_TIME} <= present:
        return df.withColumn(ABSENCE_DAYS, F.coalesce(*sources, *last))
    known = F.coalesce(*sources) if sources else F.lit(None).cast("double")
    staged = with_computed(df, {"_days": known})
    open_row = F.col("_days").isNull() & ref(START_TIME).isNotNull() & ref(END_TIME).isNotNull()
    for name, text in (("_start", START_TIME), ("_end", END_TIME)):
        staged = with_computed(staged, {name: F.when(open_row, moment_or_clock(ref(text)))})
    timed = hours_from(F.col("_start"), F.col("_end")) / HOURS_PER_DAY
    days = F.coalesce(F.col("_days"), timed, *last)
    return staged.withColumn(ABSENCE_DAYS, days).drop("_days", "_start", "_end")
