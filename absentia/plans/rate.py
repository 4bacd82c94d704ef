"""From cleaned records to all rating tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from absentia.config import RatingParams
from absentia.operators import rating
from absentia.operators.totals import ledger, rating_frame
from absentia.sources.storage import settle


@dataclass(frozen=True)
class RatingTables:
    """The results, all lazy and all derived from the one ledger."""

    ledger: DataFrame
    params: RatingParams

    @property
    def year_metrics(self) -> DataFrame:
        return rating.year_metrics(self.ledger, self.params)

    @property
    def year_figures(self) -> DataFrame:
        return rating.year_figures(self.ledger, self.params)

    @property
    def year_breakdown(self) -> DataFrame:
        return rating.year_breakdown(self.ledger, self.params)

    @property
    def summary(self) -> DataFrame:
        return rating.rating_summary(self.ledger, self.params)

    @property
    def cc_range_details(self) -> DataFrame:
        return rating.cc_range_details(self.ledger, self.params).orderBy("employee_id")

    @property
    def high_claimant_details(self) -> DataFrame:
        return rating.high_claimant_details(self.ledger, self.params).orderBy("employee_id")


def rate_adaptive(
    cleaned: DataFrame,
    params: RatingParams = RatingParams(),
    order_by: Sequence[str] = (),
    keep_ledger: bool = False,
) -> RatingTables:
    """All rating tables of cleaned records.

    With `keep_ledger` the ledger is computed now and kept in the shared folder,
    so that reading several tables scans the records once.
    """
    book = ledger(rating_frame(cleaned, with_names=True, order_by=order_by))
    return RatingTables(settle(book, "ledger") if keep_ledger else book, params)


def rate_exact(cleaned: DataFrame, params: RatingParams = RatingParams()) -> DataFrame:
    """One row: coverage on whole totals and the premium on it."""
    return rating.coverage_and_premium(ledger(rating_frame(cleaned)), params)
