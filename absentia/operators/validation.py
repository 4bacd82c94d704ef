"""Format checks before the rules, and counts of what each step leaves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from absentia.config import RuleConfig
from absentia.functions.dates import moment_of, school_year_wellformed
from absentia.functions.numbers import number_of
from absentia.functions.text import ref
from absentia.functions.lateral import with_computed
from absentia.operators.rules import gated_rules, rule1_exact_keep, rule2_keep
from absentia.vocabulary import (
    DATE,
    DURATION,
    EMPLOYEE_ID,
    ROW_ORDER,
    SCHOOL_YEAR,
    TEACHER_TYPES,
    VALIDATION_COLUMNS,
)


def record_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ORDER]


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    return df.filter(_any_value(df))


def _typed(df: DataFrame) -> DataFrame:
    """Parsed dates and numeric durations, computed once for all that follows."""
    computed = {}
    if DATE in df.columns and df.schema[DATE].dataType.typeName() != "timestamp_ntz":
        computed[DATE] = moment_of(df, DATE)
    if DURATION in df.columns and df.schema[DURATION].dataType.typeName() != "double":
        computed[DURATION] = number_of(df, DURATION)
    return with_computed(df, computed) if computed else df


def drop_bad_dates(df: DataFrame) -> DataFrame:
    """Parse the dates and drop rows without a readable one."""
    return _typed(df).filter(ref(DATE).isNotNull()) if DATE in df.columns else df


def validate(df: DataFrame) -> DataFrame:
    """Rows with any content and a readable date; dates and durations typed."""
    return drop_bad_dates(_typed(drop_all_null_rows(df)))


def _any_value(df: DataFrame) -> Column:
    return reduce(lambda a, b: a | b, [ref(c).isNotNull() for c in record_columns(df)])


def flagged(df: DataFrame, also: Sequence[Column] = ()) -> DataFrame:
    """The typed frame plus whether a row has content, and what else is to be read off
    the raw cells."""
    marked = df.select("*", _any_value(df).alias("_content"), *also)
    return _typed(marked)


def _valid(df: DataFrame) -> Column:
    return F.col("_content") & (ref(DATE).isNotNull() if DATE in df.columns else F.lit(True))


def as_rows(counts: DataFrame, key: str, value: str) -> DataFrame:
    """One row of named counts, turned into (name, count) rows."""
    pairs = [x for c in counts.columns for x in (F.lit(c), F.col(c))]
    return counts.select(F.stack(F.lit(len(counts.columns)), *pairs).alias(key, value))


def validation_report(df: DataFrame) -> DataFrame:
    """(check, n) rows, all counted in one pass over the raw frame."""
    missing = [c for c in VALIDATION_COLUMNS if c not in df.columns]
    marked = flagged(df)
    content, valid = F.col("_content"), _valid(marked)

    def count(condition: Column) -> Column:
        return F.count_if(condition).cast("bigint")

    checks = {
        "missing_required_columns": F.max(F.lit(len(missing))),
        "empty_rows": count(~content),
    }
    if DATE in df.columns:
        checks["bad_dates"] = count(content & ref(DATE).isNull())
    if DURATION in df.columns:
        checks["negative_durations"] = count(valid & (ref(DURATION) < 0))
    if SCHOOL_YEAR in df.columns:
        checks["malformed_school_years"] = count(valid & ~school_year_wellformed(ref(SCHOOL_YEAR)))
    if EMPLOYEE_ID in df.columns:
        checks["missing_employee_ids"] = count(valid & ref(EMPLOYEE_ID).isNull())
    checks["rows_removed"] = count(~valid)
    checks["final_rows"] = count(valid)
    counts = marked.agg(
        *[F.coalesce(c.cast("bigint"), F.lit(len(missing) if n.startswith("missing_r") else 0)
                     .cast("bigint")).alias(n) for n, c in checks.items()]
    )
    return as_rows(counts, "check", "n")


def _step_counts(df: DataFrame, steps: list[tuple[str, Column | None]]) -> DataFrame:
    """Rows left after each step, cumulatively, in one aggregate.

    The flags are projected first, so each condition is evaluated once per row.
    """
    flags = df.select(
        [(F.lit(True) if keep is None else keep).alias(name) for name, keep in steps]
    )
    running: Column = F.lit(True)
    counts = [F.count(F.lit(1)).alias("original_rows")]
    for name, _ in steps:
        running = running & F.col(name)
        counts.append(F.count_if(running).alias(f"after_{name}"))
    left = F.count_if(running)
    return flags.agg(
        *counts, left.alias("final_rows"), (F.count(F.lit(1)) - left).alias("rows_removed")
    )


def cleaning_stats(df: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Row counts after validation and each rule."""
    marked = flagged(df)
    return _step_counts(marked, [("validation", _valid(marked)), *gated_rules(marked, config)])


def exact_cleaning_stats(df: DataFrame) -> DataFrame:
    """Row counts of the exact variant, which has no validation and no Rule 3."""
    return _step_counts(
        df, [("rule1", rule1_exact_keep(df)), ("rule2", rule2_keep(df, TEACHER_TYPES))]
    )
