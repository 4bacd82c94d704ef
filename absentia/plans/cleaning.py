"""The two ways to clean absence records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from absentia.config import RuleConfig
from absentia.functions.days import absence_days_exact, absence_days_priority
from absentia.operators.rules import apply_rules, rule1_exact, rule2
from absentia.operators.validation import validate
from absentia.vocabulary import ABSENCE_DAYS


def clean_adaptive(df: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Validate, apply the rules their columns allow, work out days per row."""
    return absence_days_priority(apply_rules(validate(df), config))


def clean_exact(df: DataFrame) -> DataFrame:
    """Literal Rule 1, teacher types only, days by absence type."""
    kept = rule2(rule1_exact(df))
    return kept.withColumn(ABSENCE_DAYS, absence_days_exact(kept))
