"""Parameters of a rating and of the cleaning rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from absentia.vocabulary import TEACHER_TYPES


@dataclass(frozen=True)
class RatingParams:
    """Insurance terms: waiting days, covered days above them, prices and rates."""

    deductible: int = 20
    cc_days: int = 60
    replacement_cost: float = 150.0
    carrier_rate: float = 0.15
    acquisition_rate: float = 0.15
    school_year_days: int | None = 180

    @property
    def cc_maximum(self) -> int:
        return self.deductible + self.cc_days


@dataclass(frozen=True)
class RuleConfig:
    """Which cleaning rules run.

    Rules 1 and 3 always run when their columns exist, whatever is asked for
    here. Rule 2 is left out once the user has filtered employee types.
    """

    apply_substitute_rule: bool = True
    employee_types: tuple[str, ...] = field(default=TEACHER_TYPES)
    apply_school_year_rule: bool = True
    user_filtered_types: bool = False


@dataclass(frozen=True)
class RowFilters:
    """Optional row filters, ANDed; an empty one does nothing."""

    date_range: tuple | None = None
    employee_type: tuple[str, ...] = ()
    filled_status: tuple[str, ...] = ()
    school_year: tuple[str, ...] = ()
