"""Cleaning rules: substitute relevance, employee type, date within school year.

Each rule is a row condition plus a filter. A condition states which rows go
and is read as "does not hold" when unknown, so nulls never lose a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from absentia.config import RuleConfig
from absentia.functions.dates import label_years, moment_of, outside_school_year
from absentia.functions.text import ref
from absentia.functions.lateral import with_computed
from absentia.vocabulary import (
    DATE,
    EMPLOYEE_TYPE,
    FILLED,
    IS_FILLED,
    NEEDS_SUBSTITUTE,
    NOT_NEEDED_WORDS,
    SCHOOL_YEAR,
    SUBSTITUTE_REQUIRED,
    TEACHER_TYPES,
    UNFILLED_WORDS,
)

# Any spelling of zero counts as "no".
_ZERO = r"[+-]?(?:0+\.?0*|\.0+)(?:e[+-]?\d+)?"


def rule1_exact_keep(df: DataFrame) -> Column | None:
    """Not (Filled = 'Unfilled' and Needs Substitute = 'NO'), to the letter.

    Written out per operand, so it reaches the scan as a pushed filter.
    """
    if FILLED not in df.columns or NEEDS_SUBSTITUTE not in df.columns:
        return None
    filled, needs = ref(FILLED), ref(NEEDS_SUBSTITUTE)
    return (
        filled.isNull() | (filled != "Unfilled") | needs.isNull() | (needs != "NO")
    )


def substitute_columns(df: DataFrame) -> tuple[str, str] | None:
    """The pair of columns Rule 1 reads: standard names, else the raw pair."""
    for pair in ((FILLED, NEEDS_SUBSTITUTE), (IS_FILLED, SUBSTITUTE_REQUIRED)):
        if set(pair) <= set(df.columns):
            return pair
    return None


def _says(c: Column, words: tuple[str, ...]) -> Column:
    """The cell holds one of the words or a zero, in any case, blanks around it."""
    options = "|".join([re.escape(w) for w in words] + [_ZERO])
    return c.cast("string").rlike(rf"(?i)^\s*(?:{options})\s*$")


def rule1_keep(df: DataFrame) -> Column | None:
    """Rows but those unfilled and in no need of a substitute, in any wording.

    A blank or missing word on either side matches nothing and keeps the row.
    """
    pair = substitute_columns(df)
    if pair is None:
        return None
    filled, needs = pair
    return ~F.coalesce(
        _says(ref(filled), UNFILLED_WORDS) & _says(ref(needs), NOT_NEEDED_WORDS), F.lit(False)
    )


def rule2_keep(df: DataFrame, employee_types) -> Column | None:
    if EMPLOYEE_TYPE not in df.columns or not employee_types:
        return None
    return F.coalesce(ref(EMPLOYEE_TYPE).isin(*employee_types), F.lit(False))


def rule3_keep(df: DataFrame) -> Column | None:
    """Rows whose date lies within their school year, or that cannot be judged.

    Compared as moments: 30 June counts only up to midnight at its start.
    """
    if SCHOOL_YEAR not in df.columns or DATE not in df.columns:
        return None
    return ~_outside(df, moment_of(df, DATE))


def _outside(df: DataFrame, moment: Column) -> Column:
    return F.coalesce(outside_school_year(moment, ref(SCHOOL_YEAR)), F.lit(False))


def _filtered(df: DataFrame, keep: Column | None) -> DataFrame:
    return df if keep is None else df.filter(keep)


def rule1_exact(df: DataFrame) -> DataFrame:
    return _filtered(df, rule1_exact_keep(df))


def rule1(df: DataFrame) -> DataFrame:
    return _filtered(df, rule1_keep(df))


def rule2(df: DataFrame, employee_types=TEACHER_TYPES) -> DataFrame:
    if EMPLOYEE_TYPE not in df.columns or not employee_types:
        return df
    return df.filter(ref(EMPLOYEE_TYPE).isin(*employee_types))


def rule3(df: DataFrame) -> DataFrame:
    """Rule 3 as a filter. Text dates are parsed once for it and stay text; one
    that cannot be read goes, if the label can.

    The verdict is projected before it filters: a projection reads each part of
    the label once, a bare filter condition once per mention.
    """
    if not {SCHOOL_YEAR, DATE} <= set(df.columns):
        return df
    if isinstance(df.schema[DATE].dataType, T.StringType):
        parsed = with_computed(df, {"_moment": moment_of(df, DATE)})
        moment = F.col("_moment")
        unreadable = (
            ref(DATE).isNotNull()
            & moment.isNull()
            & label_years(ref(SCHOOL_YEAR))[0].isNotNull()
        )
        gone = _outside(parsed, moment) | unreadable
    else:
        parsed = df
        gone = _outside(df, moment_of(df, DATE))
    judged = with_computed(parsed, {"_gone": gone})
    return judged.filter(~F.col("_gone")).drop("_gone", "_moment")


def gated_rules(df: DataFrame, config: RuleConfig) -> list[tuple[str, Column | None]]:
    """(rule, keep condition) in order; None where the rule does not run."""
    types = () if config.user_filtered_types else config.employee_types
    return [
        ("rule1", rule1_keep(df)),
        ("rule2", rule2_keep(df, types)),
        ("rule3", rule3_keep(df)),
    ]


def apply_rules(df: DataFrame, config: RuleConfig) -> DataFrame:
    kept = rule1(df)
    if not config.user_filtered_types:
        kept = rule2(kept, config.employee_types)
    return rule3(kept)
