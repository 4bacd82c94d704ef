"""Report tables: formatted rows with their average, headlines, premium lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from absentia.config import RatingParams
from absentia.functions.numbers import round6
from absentia.functions.text import money
from absentia.vocabulary import BREAKDOWN_AVERAGE_LABEL, METRICS_AVERAGE_LABEL

METRIC_FIELDS = ("total_staff", "total_absences", "total_replacement_cost")
BREAKDOWN_FIELDS = (
    "total_teachers",
    "below_deductible",
    "in_cc_range",
    "high_claimant",
    "total_cc_days",
    "excess_days",
    "replacement_cost_cc",
    "carrier_margin",
    "acquisition_cost",
    "premium",
)


def _averages(yearly: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The yearly rows plus one row of their averages, in one pass.

    A rollup over rows that are already one per year: a year's own average is
    its value, the grand total is the average over the years present.
    """
    return yearly.rollup("school_year").agg(
        *[F.avg(c).alias(c) for c in fields],
        F.count(F.lit(1)).alias("n_years"),
        F.grouping("school_year").cast("int").alias("is_average"),
    )


def _labelled(rows: DataFrame, label: str) -> Column:
    return F.when(F.col("is_average") == 1, F.lit(label)).otherwise(F.col("school_year"))


def _with_average(
    yearly: DataFrame, fields: tuple[str, ...], label: str, min_years: int
) -> DataFrame:
    rows = _averages(yearly, fields)
    return rows.filter(
        (F.col("is_average") == 0) | (F.col("n_years") >= F.lit(min_years))
    ).select(
        _labelled(rows, label).alias("school_year"),
        *[round6(F.col(c)).alias(c) for c in fields],
        "is_average",
    )


def year_metrics_avg(metrics: DataFrame, min_years: int = 2) -> DataFrame:
    """Year metrics and, from `min_years` years on, their average row."""
    return _with_average(metrics, METRIC_FIELDS, METRICS_AVERAGE_LABEL, min_years)


def year_breakdown_avg(breakdown: DataFrame, min_years: int = 1) -> DataFrame:
    return _with_average(breakdown, BREAKDOWN_FIELDS, BREAKDOWN_AVERAGE_LABEL, min_years)


def order_by_year(rows: DataFrame) -> DataFrame:
    """Years in order of label, the average last."""
    keys = ["is_average"] if "is_average" in rows.columns else []
    return rows.orderBy(*keys, "school_year")


def _number(c: str, year_digits: int, average_digits: int) -> Column:
    return F.when(
        F.col("is_average") == 1, F.format_number(c, average_digits)
    ).otherwise(F.format_number(c, year_digits))


def report_year_metrics(metrics: DataFrame, p: RatingParams) -> DataFrame:
    """Eight display columns per year and the average row, in order."""
    rows = year_metrics_avg(metrics)
    return order_by_year(
        rows.select(
            "school_year",
            _number("total_staff", 0, 1).alias("total_staff"),
            _number("total_absences", 2, 1).alias("total_absences"),
            F.lit(f"${p.replacement_cost:.2f}").alias("replacement_cost_per_day"),
            money(F.col("total_replacement_cost")).alias("total_replacement_cost"),
            F.lit(p.school_year_days).cast("int").alias("school_year_days"),
            F.lit(p.deductible).alias("deductible_days"),
            F.lit(p.cc_days).alias("cc_max_days"),
            "is_average",
        )
    ).drop("is_average")


def report_breakdown(breakdown: DataFrame) -> DataFrame:
    """Eleven display columns per year and the average row, in order."""
    rows = year_breakdown_avg(breakdown)
    counts, days, amounts = BREAKDOWN_FIELDS[:4], BREAKDOWN_FIELDS[4:6], BREAKDOWN_FIELDS[6:]
    return order_by_year(
        rows.select(
            "school_year",
            *[_number(c, 0, 1).alias(c) for c in counts],
            *[F.format_number(c, 2).alias(c) for c in days],
            *[money(F.col(c)).alias(c) for c in amounts],
            "is_average",
        )
    ).drop("is_average")


def report_parameters(spark: SparkSession, p: RatingParams) -> DataFrame:
    """(parameter, value) rows."""
    rows = [
        ("Deductible (Days)", str(p.deductible)),
        ("CC Days per Teacher", str(p.cc_days)),
        ("CC Maximum (Deductible + CC)", str(p.cc_maximum)),
        ("Replacement Cost per Day", f"${p.replacement_cost:.2f}"),
        ("School Year Days", str(p.school_year_days)),
        ("Carrier Profit Margin", f"{p.carrier_rate * 100:.1f}%"),
        ("Acquisition Costs", f"{p.acquisition_rate * 100:.1f}%"),
    ]
    text = T.StringType()
    return spark.createDataFrame(
        rows, T.StructType([T.StructField("parameter", text), T.StructField("value", text)])
    )


_HEADLINE = (
    "staff_in_cc_range",
    "total_cc_days",
    "replacement_cost_cc",
    "high_claimant_staff",
    "excess_days",
    "high_claimant_cost",
    "carrier_margin",
    "acquisition_cost",
    "total_premium",
)


def headline_avg(breakdown: DataFrame, p: RatingParams) -> DataFrame:
    """Headline figures as averages over the years; no years, no row."""
    means = breakdown.agg(
        F.count(F.lit(1)).alias("n_years"), *[F.avg(c).alias(c) for c in BREAKDOWN_FIELDS]
    ).filter("n_years > 0")
    return means.select(
        F.lit("average").alias("basis"),
        round6(F.col("in_cc_range")).alias("staff_in_cc_range"),
        round6(F.col("total_cc_days")).alias("total_cc_days"),
        round6(F.col("replacement_cost_cc")).alias("replacement_cost_cc"),
        round6(F.col("high_claimant")).alias("high_claimant_staff"),
        round6(F.col("excess_days")).alias("excess_days"),
        round6(F.col("excess_days") * F.lit(p.replacement_cost)).alias("high_claimant_cost"),
        round6(F.col("carrier_margin")).alias("carrier_margin"),
        round6(F.col("acquisition_cost")).alias("acquisition_cost"),
        round6(F.col("premium")).alias("total_premium"),
    )


def headline_cumulative(summary: DataFrame) -> DataFrame:
    """Headline figures over all years together."""
    return summary.select(
        F.lit("cumulative").alias("basis"),
        F.col("num_staff_cc_range").cast("double").alias("staff_in_cc_range"),
        "total_cc_days",
        "replacement_cost_cc",
        F.col("num_high_claimant").cast("double").alias("high_claimant_staff"),
        *_HEADLINE[4:],
    )


def report_premium(headline: DataFrame) -> DataFrame:
    """Four premium lines on the headline's basis."""
    lines = (
        (1, "Replacement Cost (CC)", "replacement_cost_cc"),
        (2, "Carrier Profit Margin", "carrier_margin"),
        (3, "Acquisition Costs", "acquisition_cost"),
        (4, "TOTAL PREMIUM", "total_premium"),
    )
    cells = [x for n, label, c in lines for x in (F.lit(n), F.lit(label), money(F.col(c)))]
    return headline.select(
        "basis", F.stack(F.lit(len(lines)), *cells).alias("line", "item", "amount")
    )
