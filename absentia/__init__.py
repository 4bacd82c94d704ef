"""Absence rating on Spark: harmonise, clean, total and price absence records."""

from absentia.config import RatingParams, RowFilters, RuleConfig

__all__ = ["RatingParams", "RowFilters", "RuleConfig"]
