"""Bands, covered and excess days, premiums.

`t` is a total of days, `D` the deductible, `M` the maximum covered total. Below
is t <= D, in range D < t <= M, high claimant t > M. A total is rounded to six
decimals for these comparisons: days are hours divided by 7.5, and a sum of them
that should equal D or M lands on either side of it by order of addition. Amounts
are added up unrounded and rounded once at the end, so that nothing accumulates
over many employees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from absentia.config import RatingParams
from absentia.functions.numbers import round6
from absentia.operators.totals import employee_totals, staff_totals_and_names, staff_years


def below(t: Column, p: RatingParams) -> Column:
    return round6(t) <= F.lit(p.deductible)


def in_range(t: Column, p: RatingParams) -> Column:
    days = round6(t)
    return (days > F.lit(p.deductible)) & (days <= F.lit(p.cc_maximum))


def high(t: Column, p: RatingParams) -> Column:
    return round6(t) > F.lit(p.cc_maximum)


def clamp_days(t: Column, p: RatingParams) -> Column:
    """Days above the deductible, up to the covered number."""
    return F.least(t - F.lit(p.deductible), F.lit(float(p.cc_days)))


def _total(days: Column) -> Column:
    return F.coalesce(F.sum(days), F.lit(0.0))


def cc_days_total(t: Column, p: RatingParams, mode: str = "range_only") -> Column:
    """Covered days of employees in range, unrounded; high claimants add nothing.

    "range_only" counts days above the deductible, "all_days" the whole total.
    """
    counted = {"range_only": clamp_days(t, p), "all_days": t}[mode]
    return _total(F.when(in_range(t, p), counted))


def excess_total(t: Column, p: RatingParams, mode: str = "excess_only") -> Column:
    """Days of high claimants: beyond the maximum, or all of them."""
    counted = {"excess_only": t - F.lit(p.cc_maximum), "all_days": t}[mode]
    return _total(F.when(high(t, p), counted))


def band_columns(t: Column, p: RatingParams) -> list[Column]:
    return [
        F.count(t).alias("total_teachers"),
        F.count_if(below(t, p)).alias("below_deductible"),
        F.count_if(in_range(t, p)).alias("in_cc_range"),
        F.count_if(high(t, p)).alias("high_claimant"),
    ]


def _priced(df: DataFrame, p: RatingParams) -> DataFrame:
    """Price covered days: cost, the two commissions and their sum, unrounded."""
    base = F.col("total_cc_days") * F.lit(p.replacement_cost)
    carrier, acquisition = base * F.lit(p.carrier_rate), base * F.lit(p.acquisition_rate)
    priced = {
        "replacement_cost_cc": base,
        "carrier_margin": carrier,
        "acquisition_cost": acquisition,
        "premium": base + carrier + acquisition,
    }
    if "excess_days" in df.columns:
        priced["high_claimant_cost"] = F.col("excess_days") * F.lit(p.replacement_cost)
    return df.withColumns(priced)


def rounded(df: DataFrame) -> DataFrame:
    """Every double at six decimals, for the eye; the last step of a result."""
    return df.select(
        [
            round6(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def band_counts(book: DataFrame, p: RatingParams) -> DataFrame:
    """One row: employees per band over all years."""
    return employee_totals(book).agg(*band_columns(F.col("total_days"), p))


def _coverage(book: DataFrame, p: RatingParams, mode: str) -> DataFrame:
    t = F.col("total_days")
    row = employee_totals(book).agg(
        F.count_if(in_range(t, p)).alias("num_staff_cc_range"),
        cc_days_total(t, p, mode).alias("total_cc_days"),
        F.count_if(high(t, p)).alias("num_high_claimant"),
        excess_total(t, p).alias("excess_days"),
    )
    return rounded(_priced(row, p)).withColumns(
        {
            "deductible": F.lit(p.deductible),
            "cc_days": F.lit(p.cc_days),
            "cc_maximum": F.lit(p.cc_maximum),
            "replacement_cost": F.lit(p.replacement_cost),
        }
    )


def coverage_metrics(book: DataFrame, p: RatingParams, mode: str = "all_days") -> DataFrame:
    """One row of coverage figures over all years, by default counting the whole
    total of an employee in range."""
    return _coverage(book, p, mode).drop("carrier_margin", "acquisition_cost", "premium")


def coverage_and_premium(book: DataFrame, p: RatingParams, mode: str = "all_days") -> DataFrame:
    """The coverage figures with the commissions and the total premium on them."""
    return _coverage(book, p, mode).withColumnsRenamed({"premium": "total_premium"}).withColumn(
        "school_year_days", F.lit(p.school_year_days).cast("int")
    )


def premium(book: DataFrame, p: RatingParams, mode: str = "range_only") -> DataFrame:
    """One row: premium over all years."""
    row = employee_totals(book).agg(
        cc_days_total(F.col("total_days"), p, mode).alias("total_cc_days")
    )
    return rounded(_priced(row, p))


def year_metrics(book: DataFrame, p: RatingParams) -> DataFrame:
    """Per known year: distinct known staff, days and what replacing them costs."""
    staff = (
        book.filter(F.col("school_year").isNotNull())
        .groupBy("school_year", "employee_id")
        .agg(F.sum("days").alias("days"))
    )
    total = F.coalesce(F.sum("days"), F.lit(0.0))
    return staff.groupBy("school_year").agg(
        F.count("employee_id").alias("total_staff"),
        round6(total).alias("total_absences"),
        round6(total * F.lit(p.replacement_cost)).alias("total_replacement_cost"),
    )


def year_figures(book: DataFrame, p: RatingParams) -> DataFrame:
    """The year breakdown before rounding, which averages are taken of."""
    t = F.col("total_days")
    rows = (
        staff_years(book)
        .groupBy("school_year")
        .agg(
            *band_columns(t, p),
            cc_days_total(t, p).alias("total_cc_days"),
            excess_total(t, p).alias("excess_days"),
        )
    )
    return _priced(rows, p).drop("high_claimant_cost")


def year_breakdown(book: DataFrame, p: RatingParams) -> DataFrame:
    """Per year: staff, bands on that year's totals, covered and excess days, price."""
    return rounded(year_figures(book, p))


def teacher_year_stats(book: DataFrame, p: RatingParams) -> DataFrame:
    """One row over (year, employee) totals: count, sum, mean, maximum and bands."""
    t = F.col("total_days")
    return staff_years(book).agg(
        F.count(F.lit(1)).alias("n_staff_years"),
        round6(_total(t)).alias("sum_days"),
        round6(F.avg(t)).alias("avg_days"),
        round6(F.max(t)).alias("max_days"),
        F.count_if(below(t, p)).alias("below_deductible"),
        F.count_if(in_range(t, p)).alias("in_cc_range"),
        F.count_if(high(t, p)).alias("high_claimant"),
    )


def rating_summary(book: DataFrame, p: RatingParams, excess_mode: str = "excess_only") -> DataFrame:
    """The whole all-years result in one row, parameters included.

    One chain of aggregates: the second level keeps, per employee, the days of
    known years (for bands) beside all days (for the overall sums), so nothing
    has to be joined back. Overall staff counts everyone with an identifier,
    rated staff only those with a known year.
    """
    in_year = F.col("school_year").isNotNull() & F.col("employee_id").isNotNull()
    staff = book.groupBy("employee_id").agg(
        F.sum("days").alias("all_days"),
        F.sum(F.when(in_year, F.coalesce("days", F.lit(0.0)))).alias("t"),
    )
    t = F.col("t")
    all_days = F.coalesce(F.sum("all_days"), F.lit(0.0))
    row = staff.agg(
        F.count("employee_id").alias("overall_total_staff"),
        all_days.alias("all_days"),
        *band_columns(t, p),
        cc_days_total(t, p).alias("total_cc_days"),
        excess_total(t, p, excess_mode).alias("excess_days"),
    )
    cost = F.lit(p.replacement_cost)
    result = _priced(row, p).select(
        "overall_total_staff",
        round6(F.col("all_days")).cast("bigint").alias("overall_total_absences"),
        F.col("all_days").alias("overall_total_absences_exact"),
        (F.col("all_days") * cost).alias("overall_total_replacement_cost"),
        "total_teachers",
        F.col("below_deductible").alias("below_deductible_count"),
        F.col("in_cc_range").alias("num_staff_cc_range"),
        "total_cc_days",
        "replacement_cost_cc",
        F.col("high_claimant").alias("num_high_claimant"),
        "excess_days",
        "high_claimant_cost",
        "carrier_margin",
        "acquisition_cost",
        F.col("premium").alias("total_premium"),
        F.lit(p.deductible).alias("deductible"),
        F.lit(p.cc_days).alias("cc_days"),
        F.lit(p.cc_maximum).alias("cc_maximum"),
        cost.alias("replacement_cost"),
        F.lit(p.school_year_days).cast("int").alias("school_year_days"),
    )
    return rounded(result)


def overall_totals(book: DataFrame, p: RatingParams) -> DataFrame:
    """All rows, unknown years included: distinct staff, days, replacement cost."""
    staff = book.groupBy("employee_id").agg(F.sum("days").alias("days"))
    row = staff.agg(
        F.count("employee_id").alias("overall_total_staff"),
        F.coalesce(F.sum("days"), F.lit(0.0)).alias("days"),
    )
    days = round6(F.col("days"))
    return row.select(
        "overall_total_staff",
        days.cast("bigint").alias("overall_total_absences"),
        days.alias("overall_total_absences_exact"),
        round6(F.col("days") * F.lit(p.replacement_cost)).alias("overall_total_replacement_cost"),
    )


def _days_text(c: Column) -> Column:
    return c.cast("string")


def explain_cc(t: Column, counted: Column, p: RatingParams) -> Column:
    return F.concat(
        F.lit("min("),
        _days_text(t),
        F.lit(f" - {p.deductible}, {p.cc_maximum} - {p.deductible}) = "),
        _days_text(counted),
    )


def explain_excess(t: Column, excess: Column, p: RatingParams) -> Column:
    return F.concat(_days_text(t), F.lit(f" - {p.cc_maximum} = "), _days_text(excess))


def _details(named: DataFrame, *columns: Column) -> DataFrame:
    return named.select(
        "employee_id",
        F.col("first_name").alias("employee_first_name"),
        F.col("last_name").alias("employee_last_name"),
        round6(F.col("total_days")).alias("total_days"),
        *columns,
    )


def cc_range_details(book: DataFrame, p: RatingParams) -> DataFrame:
    """One row per employee in range, with names and how the days were counted."""
    t = F.col("total_days")
    counted = round6(clamp_days(t, p))
    return _details(
        staff_totals_and_names(book).filter(in_range(t, p)),
        counted.alias("days_in_cc_range"),
        explain_cc(round6(t), counted, p).alias("calculation"),
    )


def high_claimant_details(
    book: DataFrame, p: RatingParams, mode: str = "excess_only"
) -> DataFrame:
    """One row per high claimant, with names and how the excess was counted."""
    t = F.col("total_days")
    if mode == "all_days":
        counted = round6(t)
        text = F.concat(F.lit("All days counted: "), _days_text(counted))
    else:
        counted = round6(t - F.lit(p.cc_maximum))
        text = explain_excess(round6(t), counted, p)
    return _details(
        staff_totals_and_names(book).filter(high(t, p)),
        counted.alias("excess_days"),
        text.alias("calculation"),
    )


def replacement_identity(metrics: DataFrame, p: RatingParams) -> DataFrame:
    """Years whose cost is not days times cost per day; there should be none."""
    gap = F.abs(
        F.col("total_absences") * F.lit(p.replacement_cost) - F.col("total_replacement_cost")
    )
    return metrics.agg(
        F.count(F.lit(1)).alias("n_years"), F.count_if(gap > 0.01).alias("n_violations")
    )
